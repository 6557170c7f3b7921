"""Mass queries over a cube: range images and spectra, accumulation, scaling,
orientation, totals. All layers and all ranges are answered in one plan.

Ranges are closed in mass and become half-open bin intervals on the driver, where the
mass axis is known, so the scan sees a predicate on the bin index. Maxima start from
zero; sums skip NaN. Ranges may overlap: a bin counts in each of its ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.cube import Cube
from cubeloom.functions import chem
from cubeloom.operators import images
from cubeloom.operators.slicing import closed_bounds, resolve_index

#: Beyond so many ranges they are exploded to bins and meet the cube by a hash join.
NESTED_LOOP_RANGES = 64


class Norm(Enum):
    NONE = "none"
    TIC = "tic"
    MAX = "max"


class Accumulator(Enum):
    TIC = "tic"
    MAX = "max"


class Origin(Enum):
    """The corner that holds pixel (0, 0)."""

    TOP_LEFT = (False, False)
    TOP_RIGHT = (True, False)
    BOTTOM_LEFT = (False, True)
    BOTTOM_RIGHT = (True, True)


class MassMeasure(Enum):
    MASS = "mass"
    INDEX = "index"


@dataclass(frozen=True)
class MassRange:
    """Bins lo <= mz < hi under a title, with the masses to mark."""

    title: str
    lo: int
    hi: int
    markers: tuple[float, ...] = ()


def range_of(labels: list[float], low: float, high: float, title: str | None = None) -> MassRange:
    """The bins of low <= mass <= high."""
    return MassRange(title or f"{low:g} - {high:g}", *closed_bounds(labels, low, high))


def centre_of(labels: list[float], centre: float, width: float, title: str | None = None) -> MassRange:
    """The bins of centre +- width / 2, both ends in, with the centre as its marker."""
    lo, hi = closed_bounds(labels, centre - width / 2, centre + width / 2)
    return MassRange(title or f"{centre:g}", lo, hi, (centre,))


def formula_ranges(labels: list[float], masses: dict[str, float], width: float) -> list[MassRange]:
    return [centre_of(labels, m, width, f) for f, m in masses.items()]


def not_empty(ranges: list[MassRange]) -> tuple[list[MassRange], list[MassRange]]:
    """(ranges with bins, those without)."""
    return [r for r in ranges if r.hi > r.lo], [r for r in ranges if r.hi <= r.lo]


def mass_slice(labels: list[float], measure: MassMeasure, start: float | None, stop: float | None) -> tuple[int, int]:
    """A bin interval by mass (closed) or by index; None is the border."""
    if measure is MassMeasure.INDEX:
        return resolve_index(len(labels), None if start is None else int(start), None if stop is None else int(stop))
    return closed_bounds(labels, labels[0] if start is None else start, labels[-1] if stop is None else stop)


def total(value: Column) -> Column:
    """Sum that skips NaN."""
    return F.sum(F.nanvl(value.cast("double"), F.lit(0.0)))


def _sum(df: DataFrame, value: str) -> Column:
    kind = df.schema[value].dataType.typeName()
    return total(F.col(value)) if kind in ("float", "double") else F.sum(value).cast("long")


def accumulated(df: DataFrame, keys: list[str], value: str = "signal") -> DataFrame:
    """tic and max per key; the maximum is of the values and zero."""
    kind = df.schema[value].dataType
    return df.groupBy(*keys).agg(_sum(df, value).alias("tic"), F.greatest(F.lit(0).cast(kind), F.max(value)).alias("max"))


def total_image(cube: Cube) -> DataFrame:
    return accumulated(cube.df, list(cube.dims[:-1]), cube.value)


def total_spectrum(cube: Cube) -> DataFrame:
    return accumulated(cube.df, [cube.dims[0], cube.dims[-1]], cube.value)


def range_table(spark: SparkSession, ranges: list[MassRange]) -> DataFrame:
    rows = [(k, r.title, r.lo, r.hi, list(r.markers)) for k, r in enumerate(ranges)]
    return spark.createDataFrame(rows, "range_id int, title string, lo int, hi int, markers array<double>")


def in_ranges(cube: Cube, ranges: list[MassRange]) -> DataFrame:
    """Cells with the range_id of every range that holds their bin. The scan is cut
    to the hull of the ranges first."""
    kept, _ = not_empty(ranges)
    spark, mz = cube.df.sparkSession, cube.dims[-1]
    if not kept:
        return cube.df.where("false").withColumn("range_id", F.lit(0))
    inside = cube.df.where(F.col(mz).between(min(r.lo for r in kept), max(r.hi for r in kept) - 1))
    if len(ranges) <= NESTED_LOOP_RANGES:  # a literal list: no join and no shuffle
        held = F.array_compact(F.array(*[F.when((F.col(mz) >= r.lo) & (F.col(mz) < r.hi), F.lit(k)) for k, r in enumerate(ranges)]))
        return inside.withColumn("range_id", F.explode(held))
    bins = range_table(spark, ranges).where("hi > lo").select("range_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias(mz))
    return inside.join(bins, mz)


def range_images(cube: Cube, ranges: list[MassRange]) -> DataFrame:
    return accumulated(in_ranges(cube, ranges), ["range_id", *cube.dims[:-1]], cube.value)


def range_spectra(cube: Cube, ranges: list[MassRange]) -> DataFrame:
    return accumulated(in_ranges(cube, ranges), ["range_id", cube.dims[0], cube.dims[-1]], cube.value)


def range_custom(cube: Cube, ranges: list[MassRange], keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of one's own over the cells of every range: built-in expressions or
    grouped-aggregate pandas UDFs."""
    return in_ranges(cube, ranges).groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def accumulate_images(images: DataFrame, pixel: list[str], how: Accumulator) -> DataFrame:
    """One image of many: sum of the tic images (overlaps count twice) or maximum."""
    made = F.sum("tic").cast(images.schema["tic"].dataType) if how is Accumulator.TIC else F.max("max")
    return images.groupBy(*pixel).agg(made.alias("signal"))


def normalise(df: DataFrame, value: str, how: Norm, keys: list[str], alias: str = "scaled") -> DataFrame:
    """value divided by its group's sum or maximum; null where that is zero. Groups
    are aggregated first and joined back, so a large group is no single task."""
    if how is Norm.NONE:
        return df.withColumn(alias, F.col(value).cast("double"))
    made = (F.sum(value) if how is Norm.TIC else F.max(value)).cast("double").alias("_by")
    if keys:
        return df.join(df.groupBy(*keys).agg(made), keys).withColumn(alias, F.try_divide(F.col(value).cast("double"), F.col("_by"))).drop("_by")
    return df.crossJoin(F.broadcast(df.agg(made))).withColumn(alias, F.try_divide(F.col(value).cast("double"), F.col("_by"))).drop("_by")  # one row


def scale_by_spectrum(images: DataFrame, spectra: DataFrame, how: Norm, source: str = "tic") -> DataFrame:
    """Images divided by the sum or maximum of their range's spectrum, per layer."""
    if how is Norm.NONE:
        return images.withColumn("scaled", F.col(source).cast("double"))
    by = (F.sum(source) if how is Norm.TIC else F.max(source)).cast("double")
    norms = spectra.groupBy("range_id", "layer").agg(by.alias("_by"))
    return images.join(norms, ["range_id", "layer"]).withColumn("scaled", F.try_divide(F.col(source).cast("double"), F.col("_by"))).drop("_by")


def oriented(df: DataFrame, width: int, height: int, origin: Origin) -> DataFrame:
    flip_x, flip_y = origin.value
    x, y = F.col("x"), F.col("y")
    return df.withColumn("x", F.lit(width - 1) - x if flip_x else x).withColumn("y", F.lit(height - 1) - y if flip_y else y)


def rectangle(df: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """Closed box on x and y."""
    return df.where(F.col("x").between(*x) & F.col("y").between(*y))


@dataclass(frozen=True)
class QuerySpec:
    """A whole query: its ranges, the box of layers, pixels and mass it looks at, and
    what becomes of the images. A slice holds for every output."""

    ranges: tuple[MassRange, ...]
    layers: tuple[int | None, int | None] = (None, None)
    xs: tuple[int | None, int | None] = (None, None)
    ys: tuple[int | None, int | None] = (None, None)
    mass: tuple[int | None, int | None] = (None, None)
    scaling: Norm = Norm.NONE
    accumulator: Accumulator = Accumulator.TIC
    accumulate: bool = False
    origin: Origin = Origin.TOP_LEFT
    subpixels: float = 1.0  # output pixels for every pixel, by a spline of that order
    interpolation: int = 0


@dataclass(frozen=True)
class QueryResult:
    images: DataFrame
    spectra: DataFrame
    total_image: DataFrame
    total_spectrum: DataFrame
    accumulated: DataFrame | None
    empty: tuple[MassRange, ...]


def spec_box(cube: Cube, spec: QuerySpec) -> tuple[tuple[int, int], ...]:
    """The box of cells that a query looks at: its slices, and of the masses the hull of
    its ranges where no total is asked (see query)."""
    return tuple(resolve_index(cube.size(d), *cut) for d, cut in zip(cube.dims, (spec.layers, spec.xs, spec.ys, spec.mass)))


def range_hull(box: tuple[tuple[int, int], ...], ranges: tuple[MassRange, ...]) -> tuple[tuple[int, int], ...]:
    kept, _ = not_empty(list(ranges))
    if not kept:
        return box
    (a, b), lo, hi = box[-1], min(r.lo for r in kept), max(r.hi for r in kept)
    return (*box[:-1], (max(a, lo), max(max(a, lo), min(b, hi))))


def in_box(cube: Cube, box: tuple[tuple[int, int], ...]) -> Cube:
    condition = F.lit(True)
    for dim, (a, b) in zip(cube.dims, box):
        if (a, b) != (0, cube.size(dim)):
            condition = condition & (F.col(dim) >= a) & (F.col(dim) < b)
    return cube.where(condition)


def resampled(df: DataFrame, spec: QuerySpec, cube: Cube, keys: list[str], value: str) -> DataFrame:
    """Images with `subpixels` pixels for every one; what is outside them is 0."""
    if abs(spec.subpixels - 1) < 1e-2:
        return df
    return images.zoom(df.select(*keys, "x", "y", value), spec.subpixels, spec.interpolation, cube.size("x"), cube.size("y"), keys, value)


def query(cube: Cube, spec: QuerySpec, totals: tuple[DataFrame, DataFrame] | None = None, for_totals: Cube | None = None) -> QueryResult:
    """All outputs of a query. totals: the total image and spectrum (tic, max) of the
    query's box if they are known already; for_totals: what to make them from, where
    that is another layout than that for the ranges."""
    box = spec_box(cube, spec)
    cut, ranges = in_box(cube, box), list(spec.ranges)
    made, spectra = range_images(cut, ranges), range_spectra(cut, ranges)
    source, width, height, layer = spec.accumulator.value, cube.size("x"), cube.size("y"), cube.dims[0]
    turned = lambda df, keys, value: resampled(oriented(df, width, height, spec.origin), spec, cube, keys, value)
    scaled = turned(scale_by_spectrum(made, spectra, spec.scaling, source), ["range_id", layer], "scaled")
    summed = accumulate_images(made, list(cube.dims[:-1]), spec.accumulator) if spec.accumulate and ranges else None
    if summed is not None:
        summed = turned(normalise(summed, "signal", spec.scaling, [layer]), [layer], "scaled")
    whole = in_box(for_totals, box) if for_totals else cut
    image, spectrum = totals or (total_image(whole), total_spectrum(whole))
    image = turned(normalise(image, source, spec.scaling, [layer]), [layer], "scaled")
    return QueryResult(scaled, spectra, image, normalise(spectrum, source, spec.scaling, [layer]), summed, tuple(not_empty(ranges)[1]))


def kendrick_points(spectrum: DataFrame, cube: Cube, base_mass: float, scale: str = "QUAD", value: str = "scaled") -> DataFrame:
    """The points of a Kendrick plot of each layer's total spectrum: mass, nominal
    Kendrick mass, mass defect and the size of the marker, relative to the layer."""
    layer, mz = cube.dims[0], cube.dims[-1]
    mass = cube.default_axis(mz).label(F.col(mz)).cast("double")
    _, knm, defect = chem.kendrick(mass, base_mass)
    tops = spectrum.groupBy(layer).agg(F.max(value).alias("_top"))
    return spectrum.join(tops, layer).select(layer, mz, mass.alias("mass"), knm.alias("nominal"), defect.alias("defect"), chem.relative_size(F.col(value), F.col("_top"), scale).alias("size"))


def colour_ticks(image: DataFrame, value: str, keys: list[str], many: int = 6) -> DataFrame:
    """Evenly spaced ticks between the least and the largest pixel of each image."""
    ends = image.groupBy(*keys).agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    ticks = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: F.col("_a") + (F.col("_b") - F.col("_a")) * k / (many - 1))
    return ends.select(*keys, ticks.alias("ticks"))


def spectrum_points(spectrum: DataFrame, cube: Cube, value: str) -> DataFrame:
    """A spectrum as it is drawn: layer, mass, value, and whether the mass is a marker."""
    mz = cube.dims[-1]
    return spectrum.select(cube.dims[0], cube.default_axis(mz).label(F.col(mz)).cast("double").alias("mass"), F.col(value).cast("double").alias(value))
