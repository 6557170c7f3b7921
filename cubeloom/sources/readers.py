"""Reading cubes: the reader contract, Parquet layouts, a chunked data source."""

from __future__ import annotations

import tomllib
from abc import ABC, abstractmethod
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cubeloom.cube import Axis, Cube
from cubeloom.plans.chunking import Box, Chunks, choose_layout
from cubeloom.shipping import ship


class UnsupportedDataError(NotImplementedError):
    """A source has no data of that kind."""


class CubeReader(ABC):
    """What a source of cubes gives to queries."""

    @abstractmethod
    def cube(self) -> Cube: ...

    def mass_values(self) -> list[float]:
        cube = self.cube()
        return cube.default_axis(cube.dims[-1]).labels(cube.shape[-1])

    def spectrum(self, layer: int, x: int, y: int) -> DataFrame:
        """All bins of one pixel."""
        return self.cube().df.where((F.col("layer") == layer) & (F.col("x") == x) & (F.col("y") == y))

    def image(self, layer: int, mz: int, xs: tuple[int, int], ys: tuple[int, int]) -> DataFrame:
        """One bin over a closed box of pixels."""
        return self.cube().df.where((F.col("layer") == layer) & (F.col("mz") == mz) & F.col("x").between(*xs) & F.col("y").between(*ys))

    def accumulated_spectrum(self, accumulator: str, layer: int) -> DataFrame:
        raise UnsupportedDataError("no accumulated spectra")

    def accumulated_image(self, accumulator: str, layer: int) -> DataFrame:
        raise UnsupportedDataError("no accumulated images")


class FrameReader(CubeReader):
    """Over a cube at hand."""

    def __init__(self, cube: Cube):
        self._cube = cube

    def cube(self) -> Cube:
        return self._cube


class StoredReader(CubeReader):
    """Over a cube written by sinks.write_cube: picks the layout that covers a box with
    fewest chunks, and reads the accumulations made when it was written."""

    def __init__(self, spark: SparkSession, path: str, cube: Cube, layouts: dict[str, Chunks]):
        self.spark, self.path, self._cube, self.layouts = spark, path, cube, layouts

    def cube(self) -> Cube:
        return self.layout(tuple((0, s) for s in self._cube.shape))

    def layout(self, box: Box) -> Cube:
        return self._cube.with_df(self.spark.read.parquet(f"{self.path}/{choose_layout(self.layouts, box)}").select(*self._cube.dims, self._cube.value))

    def points(self) -> DataFrame:
        """Cells with every column that was stored: exact values and item counts."""
        return self.spark.read.parquet(f"{self.path}/{next(iter(self.layouts))}").drop("chunk_id")

    def totals(self) -> tuple[DataFrame, DataFrame]:
        """The stored total image and total spectrum: tic and max of every key."""
        *pixel, last = self._cube.dims
        wide = []
        for name, keys in (("total_images", pixel), ("total_spectra", [self._cube.dims[0], last])):
            t = self.spark.read.parquet(f"{self.path}/{name}")
            wide.append(t.groupBy(*keys).agg(*[F.max(F.when(F.col("accumulator") == a, F.col("signal"))).alias(a) for a in ("tic", "max")]))
        return wide[0], wide[1]

    def spectrum(self, layer: int, x: int, y: int) -> DataFrame:
        return FrameReader(self.layout(((layer, layer + 1), (x, x + 1), (y, y + 1), (0, self._cube.shape[-1])))).spectrum(layer, x, y)

    def image(self, layer: int, mz: int, xs: tuple[int, int], ys: tuple[int, int]) -> DataFrame:
        return FrameReader(self.layout(((layer, layer + 1), (xs[0], xs[1] + 1), (ys[0], ys[1] + 1), (mz, mz + 1)))).image(layer, mz, xs, ys)

    def _total(self, name: str, accumulator: str, layer: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where((F.col("accumulator") == accumulator) & (F.col("layer") == layer))

    def accumulated_spectrum(self, accumulator: str, layer: int) -> DataFrame:
        return self._total("total_spectra", accumulator, layer)

    def accumulated_image(self, accumulator: str, layer: int) -> DataFrame:
        return self._total("total_images", accumulator, layer)


def open_stored(spark: SparkSession, path: str) -> StoredReader:
    """The reader of a cube that sinks.write_cube has written: its layouts, its shape
    and its axes with their labels come from the tables beside it."""
    rows = spark.read.parquet(f"{path}/layouts").collect()  # a row for each layout
    shape, dims, value = tuple(rows[0]["shape"]), tuple(rows[0]["dims"]), rows[0]["value"]
    labels: dict[tuple, dict[int, float]] = {}
    for r in spark.read.parquet(f"{path}/axes").collect():  # a row for each label
        labels.setdefault((r["axis"], dims[r["dim"]], r["unit"], r["axis_type"]), {})[r["idx"]] = r["value"]
    axes = tuple(Axis(name, dim, unit=unit, kind=kind, values=tuple(v[k] for k in sorted(v))) for (name, dim, unit, kind), v in labels.items())
    cube = Cube(spark.read.parquet(f"{path}/{rows[0]['layout']}").select(*dims, value), dims, shape, value, axes)
    return StoredReader(spark, path, cube, {r["layout"]: Chunks(shape, tuple(r["chunk"])) for r in rows})


class ChunkSource(ABC):
    """A custom source: subclass it, register it, read it with the format of its name."""

    @abstractmethod
    def chunks(self) -> Chunks: ...

    @abstractmethod
    def dims(self) -> tuple[str, ...]: ...

    @abstractmethod
    def fill(self, box: Box) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """The cells of a box: a dense block, or (coordinates ndim x nnz, values)."""


@dataclass
class _Part(InputPartition):
    box: Box


def register_source(spark: SparkSession, name: str, source: type[ChunkSource]) -> None:
    """Makes a source readable as spark.read.format(name)."""
    ship(spark)

    class Chunked(DataSource):
        made = source

        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ", ".join(f"{d} int" for d in self.made().dims()) + ", signal double"

        def reader(self, schema):
            return _ChunkReader(self.made())

    spark.dataSource.register(Chunked)


class _ChunkReader(DataSourceReader):
    """One input partition for each chunk box; zeros are not stored."""

    def __init__(self, source: ChunkSource):
        self.source = source

    def partitions(self):
        return [_Part(b) for b in self.source.chunks().boxes()]

    def read(self, partition):
        block = self.source.fill(partition.box)
        if isinstance(block, tuple):
            coords, values = block
        else:
            coords = np.array(np.nonzero(block)) + np.array([[a] for a, _ in partition.box])
            values = block[np.nonzero(block)]
        for cell, v in zip(np.asarray(coords).T.tolist(), np.asarray(values, float).tolist()):
            yield (*cell, v)


def plot_config(path: str, prefix: str) -> dict:
    """The section `prefix` of a TOML file."""
    with Path(path).open("rb") as f:
        return tomllib.load(f).get(prefix, {})


def tree(metadata: DataFrame, max_depth: int | None = None, limit: int = 10, ends: int = 5) -> DataFrame:
    """Rows of a metadata tree (path, key, value): folders of `limit` or more entries
    show their first and last `ends`, with a row `...` between."""
    depth = F.size(F.split("path", "/")) - 1
    inside = metadata.where(depth <= max_depth) if max_depth is not None else metadata
    numbered = inside.selectExpr("path", "key", "value", "row_number() over (partition by path order by key) as n", "count(*) over (partition by path) as total")
    shown = numbered.where((F.col("total") < limit) | (F.col("n") <= ends) | (F.col("n") > F.col("total") - ends)).select("path", "key", "value", "n")
    gap = numbered.where((F.col("total") >= limit) & (F.col("n") == ends + 1)).select("path", F.lit("...").alias("key"), F.lit(None).cast("string").alias("value"), "n")
    return shown.unionByName(gap)


def storage_stats(cube: Cube, chunks: Chunks, item_bytes: int = 8) -> DataFrame:
    """One row: items and bytes of the shape, chunks, chunks in use, their share."""
    total, cells = 1, 1
    for n in chunks.counts:
        total *= n
    for s in cube.shape:
        cells *= s
    used = cube.df.select(chunks.id_column(list(cube.dims)).alias("id")).distinct().agg(F.count("*").alias("used_chunks"))
    return used.select(F.lit(cells).cast("long").alias("items"), F.lit(cells * item_bytes).cast("long").alias("bytes"), F.lit(total).cast("long").alias("total_chunks"), "used_chunks", (F.col("used_chunks") / F.lit(float(total))).alias("density"))
