"""Chemical formulas, isotope masses and the Kendrick mass scale, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELECTRON = 5.48579909044e-4
#: Nominal mass, accurate mass and abundance in percent of the isotopes
#: of common elements. read_isotopes() loads a whole table.
COMMON = """
H 1 1.007825 99.99; H 2 2.014102 0.015; Li 6 6.015123 7.42; Li 7 7.016005 92.58; B 10 10.012938 19.80; B 11 11.009305 80.20;
C 12 12.000000 98.90; C 13 13.003355 1.10; N 14 14.003074 99.63; N 15 15.000109 0.37; O 16 15.994915 99.76; O 17 16.999131 0.038; O 18 17.999159 0.20;
F 19 18.998403 100.00; Na 23 22.989770 100.00; Mg 24 23.985045 78.90; Mg 25 24.985839 10.00; Mg 26 25.982595 11.10; Al 27 26.981541 100.00;
Si 28 27.976928 92.23; Si 29 28.976496 4.67; Si 30 29.973772 3.10; P 31 30.973763 100.00; S 32 31.972072 95.02; S 33 32.971459 0.75; S 34 33.967868 4.21; S 36 35.967079 0.020;
Cl 35 34.968853 75.77; Cl 37 36.965903 24.23; K 39 38.963708 93.20; K 40 39.963999 0.012; K 41 40.961825 6.73;
Ca 40 39.962591 96.95; Ca 42 41.958622 0.65; Ca 43 42.958770 0.14; Ca 44 43.955485 2.086; Ca 46 45.953689 0.004; Ca 48 47.952532 0.19;
Ti 46 45.952633 8.00; Ti 47 46.951765 7.30; Ti 48 47.947947 73.80; Ti 49 48.947871 5.50; Ti 50 49.944786 5.40;
Cr 50 49.946046 4.35; Cr 52 51.940510 83.79; Cr 53 52.940651 9.50; Cr 54 53.938882 2.36; Mn 55 54.938046 100.00;
Fe 54 53.939612 5.80; Fe 56 55.934939 91.72; Fe 57 56.935396 2.20; Fe 58 57.933278 0.28; Co 59 58.933198 100.00;
Ni 58 57.935347 68.27; Ni 60 59.930789 26.10; Ni 61 60.931059 1.13; Ni 62 61.928346 3.59; Ni 64 63.927968 0.91; Cu 63 62.929599 69.17; Cu 65 64.927792 30.83;
Zn 64 63.929145 48.60; Zn 66 65.926035 27.90; Zn 67 66.927129 4.10; Zn 68 67.924846 18.80; Zn 70 69.925325 0.60; As 75 74.921596 100.00;
Se 74 73.922477 0.90; Se 76 75.919207 9.00; Se 77 76.919908 7.60; Se 78 77.917304 23.50; Se 80 79.916521 49.60; Se 82 81.916709 9.40; Br 79 78.918336 50.69; Br 81 80.916290 49.31;
Ag 107 106.905095 51.84; Ag 109 108.904754 48.16;
Sn 112 111.904826 0.97; Sn 114 113.902784 0.65; Sn 115 114.903348 0.36; Sn 116 115.901744 14.70; Sn 117 116.902954 7.70; Sn 118 117.901607 24.30; Sn 119 118.903310 8.60;
Sn 120 119.902199 32.40; Sn 122 121.903440 4.60; Sn 124 123.905271 5.60; I 127 126.904477 100.00
"""
COMPOUNDS = ("CH2", "H2O", "NaCl", "SnCl2", "Fe2O3", "LiBO2", "C60", "C6H12O6")


def common_isotopes(spark: SparkSession) -> DataFrame:
    """symbol, nominal, accurate, abundance of COMMON and the electron, `E`."""
    rows = [w.split() for w in COMMON.replace("\n", " ").split(";") if w.strip()]
    data = [(s, int(n), float(a), float(p)) for s, n, a, p in rows]
    return spark.createDataFrame([("E", 0, ELECTRON, 100.0), *data], "symbol string, nominal int, accurate double, abundance double")


def read_isotopes(spark: SparkSession, path: str) -> DataFrame:
    """An isotope table without a header: name, symbol, nominal and accurate mass,
    abundance; blanks and quotes around fields do not count."""
    raw = spark.read.schema("name string, symbol string, nominal string, accurate string, abundance string, rest string").csv(path)
    clean = {c: F.trim(F.regexp_replace(F.col(c), "[\"' ]", "")) for c in ("symbol", "nominal", "accurate", "abundance")}
    table = raw.select(clean["symbol"].alias("symbol"), clean["nominal"].cast("int").alias("nominal"), clean["accurate"].cast("double").alias("accurate"), clean["abundance"].cast("double").alias("abundance"))
    return table.unionByName(spark.createDataFrame([("E", 0, ELECTRON, 100.0)], table.schema))


def elements(isotopes: DataFrame) -> DataFrame:
    """symbol, isotopes: array of (accurate, nominal, abundance) by accurate mass."""
    return isotopes.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("accurate", "nominal", "abundance"))).alias("isotopes"))


def parse_formula(formula: Column | str) -> Column:
    """array of (symbol, count); a missing count is 1."""
    f = F.col(formula) if isinstance(formula, str) else formula
    pattern = F.lit("([A-Z][a-z]*)([0-9]*)")
    pairs = F.arrays_zip(F.regexp_extract_all(f, pattern, 1).alias("s"), F.regexp_extract_all(f, pattern, 2).alias("n"))
    return F.transform(pairs, lambda p: F.struct(p["s"].alias("symbol"), F.coalesce(F.nullif(p["n"], F.lit("")).cast("int"), F.lit(1)).alias("count")))


def parse(formula: str) -> list[tuple[str, int]]:
    """The same on the driver."""
    return [(s, int(n or 1)) for s, n in re.findall(r"([A-Z][a-z]*)([0-9]*)", formula)]


def compound_masses(formulas: DataFrame, isotopes: DataFrame, column: str = "formula") -> DataFrame:
    """formula, average, lightest, abundant. Abundances are taken as they stand; of
    equally abundant isotopes the lightest counts. Raises on an unknown symbol."""
    e = elements(isotopes).select(
        "symbol",
        F.expr("aggregate(isotopes, 0.0D, (t, i) -> t + i.accurate * i.abundance / 100)").alias("average"),
        F.expr("isotopes[0].accurate").alias("lightest"),
        F.expr("array_sort(isotopes, (a, b) -> case when a.abundance > b.abundance then -1 when a.abundance < b.abundance then 1 else 0 end)[0].accurate").alias("abundant"),
    )
    parts = formulas.select(column, F.explode(parse_formula(column)).alias("part")).select(column, "part.symbol", "part.count")
    known = parts.join(e, "symbol", "left").withColumn("average", F.when(F.col("average").isNull(), F.raise_error(F.concat(F.lit("unknown element "), F.col("symbol")))).otherwise(F.col("average")))
    return known.groupBy(column).agg(*[F.sum(F.col("count") * F.col(c)).alias(c) for c in ("average", "lightest", "abundant")])


def formula_mass(isotopes: DataFrame, formula: str) -> float:
    """The lightest mono-isotopic mass of one formula, on the driver."""
    one = isotopes.sparkSession.createDataFrame([(formula,)], "formula string")
    return compound_masses(one, isotopes).first()["lightest"]


def number_or_formula(isotopes: DataFrame, text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return formula_mass(isotopes, text)


def kendrick(mass: Column, base_mass: float) -> tuple[Column, Column, Column]:
    """(Kendrick mass, nominal Kendrick mass, mass defect); halves round to even."""
    km = mass * F.lit(round(base_mass) / base_mass)
    knm = F.rint(km)
    return km, knm, km - knm


def relative_size(intensity: Column, largest: Column, scale: str) -> Column:
    """Marker sizes: QUAD (s / max)^2, LINEAR s / max, LOG ln s / ln max."""
    kinds = {"QUAD": lambda: F.pow(F.try_divide(intensity, largest), 2), "LINEAR": lambda: F.try_divide(intensity, largest), "LOG": lambda: F.try_divide(F.ln(intensity), F.ln(largest))}
    return kinds[scale]()


def top_isotopes(isotopes: DataFrame) -> DataFrame:
    """The most abundant isotope of each symbol, the lightest of equal ones."""
    best = F.max_by(F.struct("nominal", "accurate", "abundance"), F.struct("abundance", -F.col("accurate"))).alias("b")
    return isotopes.groupBy("symbol").agg(best).select("symbol", "b.*")
