"""Writing: cube layouts with accumulations, imzML, UniDec text, images as text."""

from __future__ import annotations

import json
import shutil
import struct
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.cube import Cube
from cubeloom.operators.massquery import total_image, total_spectrum
from cubeloom.plans.chunking import Chunks


def unpivoted(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Accumulations by name, one row each: keys, accumulator, signal."""
    return totals.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("accumulator"), F.col(a).alias("signal")) for a in ("tic", "max")])).alias("_t")).select(*keys, "_t.accumulator", "_t.signal")


def write_cube(cube: Cube, path: str, layouts: dict[str, tuple[Chunks, list[str]]], metadata: dict | None = None) -> None:
    """The cube in several layouts (name: chunks and sort order), its totals, its axes
    and its metadata. Rows of a chunk are written together and sorted, so that a box
    meets few row groups."""
    spark = cube.df.sparkSession
    for name, (chunks, order) in layouts.items():
        placed = cube.df.withColumn("chunk_id", chunks.id_column(list(cube.dims)))
        placed.repartitionByRange("chunk_id", *order).sortWithinPartitions("chunk_id", *order).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    refresh_totals(cube, path)
    shapes = [(name, list(chunks.chunk), list(cube.shape), list(cube.dims), cube.value) for name, (chunks, _) in layouts.items()]
    spark.createDataFrame(shapes, "layout string, chunk array<int>, shape array<int>, dims array<string>, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layouts")
    cube.axis_table(spark).write.mode("overwrite").parquet(f"{path}/axes")
    write_metadata(spark, metadata or {}, f"{path}/metadata")


def append_cells(cells: DataFrame, cube: Cube, path: str, layouts: dict[str, tuple[Chunks, list[str]]]) -> None:
    """More cells of a stored cube, dense or sparse, for every layout. Totals stay as
    they were until refresh_totals()."""
    for name, (chunks, order) in layouts.items():
        placed = cells.withColumn("chunk_id", chunks.id_column(list(cube.dims)))
        placed.repartitionByRange("chunk_id", *order).sortWithinPartitions("chunk_id", *order).write.mode("append").option("compression", "zstd").parquet(f"{path}/{name}")


def refresh_totals(cube: Cube, path: str) -> None:
    """Totals anew from a cube, read from one of its layouts."""
    unpivoted(total_image(cube), list(cube.dims[:-1])).write.mode("overwrite").parquet(f"{path}/total_images")
    unpivoted(total_spectrum(cube), [cube.dims[0], cube.dims[-1]]).write.mode("overwrite").parquet(f"{path}/total_spectra")


def flatten(tree: dict, path: str = "") -> list[tuple[str, str, str]]:
    """A nested dict as rows: groups are paths, leaves are attributes."""
    out = []
    for key, value in tree.items():
        if isinstance(value, dict):
            out += flatten(value, f"{path}/{key}")
        else:
            out.append((path or "/", str(key), str(value)))
    return out


def write_metadata(spark: SparkSession, tree: dict, path: str) -> None:
    spark.createDataFrame(flatten(tree), "path string, key string, value string").write.mode("overwrite").parquet(path)


def pixel_spectra(cube: Cube, mz: str | None = None) -> DataFrame:
    """One row per pixel: arrays mz and intensity in single precision, ascending bin.
    With `mz`, a column of values for each cell, pixels have axes of their own."""
    *pixel, last = cube.dims
    label = F.col(mz) if mz else cube.default_axis(last).label(F.col(last))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(last).alias("i"), label.cast("float").alias("m"), F.col(cube.value).cast("float").alias("s"))))
    return cube.df.groupBy(*pixel).agg(pairs.alias("p")).select(*pixel, F.transform("p", lambda p: p["m"]).alias("mz_values"), F.transform("p", lambda p: p["s"]).alias("intensities"))


def write_imzml(cube: Cube, path: str, x: str = "x", y: str = "y", z: str = "layer", one_indexed: bool = True, mz: str | None = None) -> None:
    """An imzML / ibd pair, written by the driver as pixels stream by in x, y, z order:
    the format is one binary file, so its writer is one process. Pixels arrive one
    partition at a time, both files grow together and nothing else is kept."""
    if len({x, y, z}) < 3 or not {x, y, z} <= set(cube.dims[:-1]):
        raise ValueError(f"x, y and z must be three different pixel dimensions of {cube.dims}")
    many = cube.df.select(*cube.dims[:-1]).distinct().count()
    rows = pixel_spectra(cube, mz).orderBy(x, y, z).toLocalIterator(prefetchPartitions=True)
    name, add = uuid.uuid4(), int(one_indexed)
    base = Path(path)
    kind = ("IMS:1000031", "processed") if mz else ("IMS:1000030", "continuous")

    def array(of: str, at: int, n: int) -> str:
        return f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{of}"/><cvParam cvRef="IMS" accession="IMS:1000102" name="external offset" value="{at}"/><cvParam cvRef="IMS" accession="IMS:1000103" name="external array length" value="{n}"/><cvParam cvRef="IMS" accession="IMS:1000104" name="external encoded length" value="{4 * n}"/><binary/></binaryDataArray>'

    def group(of: str, accession: str, called: str) -> str:
        return f'<referenceableParamGroup id="{of}"><cvParam cvRef="MS" accession="{accession}" name="{called}"/><cvParam cvRef="MS" accession="MS:1000521" name="32-bit float"/><cvParam cvRef="MS" accession="MS:1000576" name="no compression"/><cvParam cvRef="IMS" accession="IMS:1000101" name="external data" value="true"/></referenceableParamGroup>'

    with base.with_suffix(".ibd").open("wb") as ibd, base.with_suffix(".imzML").open("w", encoding="utf-8") as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1"><fileDescription><fileContent><cvParam cvRef="IMS" accession="IMS:1000080" name="universally unique identifier" value="{{{name}}}"/><cvParam cvRef="IMS" accession="{kind[0]}" name="{kind[1]}"/><cvParam cvRef="MS" accession="MS:1000128" name="profile spectrum"/></fileContent></fileDescription>')
        out.write(f'<referenceableParamGroupList count="2">{group("mzArray", "MS:1000514", "m/z array")}{group("intensityArray", "MS:1000515", "intensity array")}</referenceableParamGroupList><run id="run"><spectrumList count="{many}">\n')
        ibd.write(name.bytes)
        shared = None
        for k, r in enumerate(rows):
            m, s = r["mz_values"], r["intensities"]
            if mz or shared is None or shared[1] != m:
                shared = (ibd.tell(), m)
                ibd.write(struct.pack(f"<{len(m)}f", *m))
            at = ibd.tell()
            ibd.write(struct.pack(f"<{len(s)}f", *s))
            position = "".join(f'<cvParam cvRef="IMS" accession="IMS:100005{c}" name="position {n}" value="{r[v] + add}"/>' for c, n, v in ((0, "x", x), (1, "y", y), (2, "z", z)))
            out.write(f'<spectrum id="spectrum={k + 1}" index="{k}" defaultArrayLength="0"><scanList count="1"><scan>{position}</scan></scanList><binaryDataArrayList count="2">{array("mzArray", shared[0], len(m))}{array("intensityArray", at, len(s))}</binaryDataArrayList></spectrum>\n')
        out.write("</spectrumList></run></mzML>\n")


def read_imzml(path: str) -> list[tuple[tuple[int, int, int], list[float], list[float]]]:
    """(position, mz, intensities) of every spectrum of a file as written above."""
    import xml.etree.ElementTree as ET

    base, out = Path(path), []
    raw = base.with_suffix(".ibd").read_bytes()
    ns = "{http://psi.hupo.org/ms/mzml}"
    for s in ET.parse(base.with_suffix(".imzML")).getroot().iter(f"{ns}spectrum"):
        at = {p.get("name"): int(p.get("value")) for p in s.iter(f"{ns}cvParam") if p.get("name", "").startswith("position")}
        arrays = []
        for a in s.iter(f"{ns}binaryDataArray"):
            v = {p.get("name"): int(p.get("value")) for p in a.iter(f"{ns}cvParam")}
            arrays.append(list(struct.unpack_from(f"<{v['external array length']}f", raw, v["external offset"])))
        out.append(((at["position x"], at["position y"], at["position z"]), *arrays))
    return out


def min_max_normalised(df: DataFrame, name: str, value: str) -> DataFrame:
    """value between 0 and 1 within each spectrum; null where all are equal."""
    ends = df.groupBy(name).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(ends, name).withColumn("normalised", F.try_divide((F.col(value) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double"))).drop("_lo", "_hi")


def write_unidec(df: DataFrame, folder: str, name: str, mass: str, value: str) -> None:
    """Text files "mass intensity": the total spectrum, each spectrum raw and scaled."""
    total = df.groupBy(mass).agg(F.sum(value).alias(value)).orderBy(mass)
    total.select(F.concat_ws(" ", mass, value)).write.mode("overwrite").text(f"{folder}/total")
    both = min_max_normalised(df, name, value).repartition(name).sortWithinPartitions(name, mass)
    both.select(name, F.concat_ws(" ", mass, value)).write.mode("overwrite").partitionBy(name).text(f"{folder}/raw")
    both.select(name, F.concat_ws(" ", mass, "normalised")).write.mode("overwrite").partitionBy(name).text(f"{folder}/scaled")


def image_matrix(df: DataFrame, width: int, x: str = "x", y: str = "y", value: str = "signal") -> DataFrame:
    """One row per y with a column for each x, absent pixels as 0."""
    return df.groupBy(y).pivot(x, list(range(width))).agg(F.sum(value)).fillna(0)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", " ").csv(path)


def write_query(result, cube: Cube, folder: str) -> None:
    """A query's images and spectra as text: rows of pixels, and "mass value" lines."""
    layer, mz = cube.dims[0], cube.dims[-1]

    def image(df: DataFrame, keys: list[str], path: str) -> None:
        rows = df.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x", "scaled"))).alias("_r"))
        line = F.concat_ws(" ", F.transform("_r", lambda p: p["scaled"].cast("string"))).alias("value")
        rows.repartition(*keys).sortWithinPartitions(*keys, "y").select(*keys, line).write.mode("overwrite").partitionBy(*keys).text(path)

    def spectrum(df: DataFrame, keys: list[str], value: str, path: str) -> None:
        line = F.concat_ws(" ", cube.default_axis(mz).label(F.col(mz)).cast("string"), F.col(value).cast("string")).alias("value")
        df.repartition(*keys).sortWithinPartitions(*keys, mz).select(*keys, line).write.mode("overwrite").partitionBy(*keys).text(path)

    image(result.images, ["range_id", layer], f"{folder}/images")
    image(result.total_image, [layer], f"{folder}/total_image")
    if result.accumulated is not None:
        image(result.accumulated, [layer], f"{folder}/accumulated")
    spectrum(result.spectra, ["range_id", layer], "tic", f"{folder}/spectra")
    spectrum(result.total_spectrum, [layer], "scaled", f"{folder}/total_spectrum")


class FileGuard:
    """Deletes outputs if the block fails, and requires them if it does not."""

    def __init__(self, *paths: str):
        self.paths = [Path(p) for p in paths]

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is not None:
            for p in self.paths:
                shutil.rmtree(p, ignore_errors=True) if p.is_dir() else p.unlink(missing_ok=True)
        elif missing := [str(p) for p in self.paths if not p.exists()]:
            raise FileNotFoundError(f"not written: {missing}")
        return False


class JsonTimer:
    """Seconds of a block, put under nested keys of a JSON file."""

    def __init__(self, path: str, *keys: str):
        self.path, self.keys = Path(path), keys

    def __enter__(self):
        self.began = time.monotonic()
        return self

    def __exit__(self, *_):
        json_add(self.path, time.monotonic() - self.began, *self.keys)


def json_add(path: str | Path, value, *keys: str) -> None:
    path = Path(path)
    whole = json.loads(path.read_text()) if path.exists() else {}
    at = whole
    for k in keys[:-1]:
        at = at.setdefault(k, {})
    at[keys[-1]] = value
    path.write_text(json.dumps(whole, indent=1))
