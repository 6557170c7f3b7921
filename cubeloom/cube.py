"""The data model: an n-dimensional signal cube as a DataFrame.

Long view: one row per non-zero cell, a column for each dimension's index and one for
the value. Spectra view: one row per pixel with an array over the last dimension.
Axes label the indices of a dimension: a table (axis, dim, idx, value, unit,
axis_type, is_default). Several axes may share a dimension; the first is its default.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXIS_SCHEMA = "axis string, dim int, idx int, value double, unit string, axis_type string, is_default boolean"
EXACT, BINNED = "EXACT", "BINNED"


def constants(values) -> Column:
    """Numbers as one constant of the plan, however many."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


@dataclass(frozen=True)
class Axis:
    """A labelled axis over one dimension: label = start + idx * step, or `values`."""

    name: str
    dim: str
    start: float = 0.0
    step: float = 1.0
    unit: str = ""
    kind: str = EXACT
    dtype: str = "double"
    values: tuple[float, ...] | None = None

    def label(self, index: Column) -> Column:
        """The label of an index, rounded to the axis's type before it is compared."""
        if self.values is not None:
            return F.element_at(constants(self.values), index.cast("int") + 1).cast(self.dtype).cast("double")
        return (F.lit(float(self.start)) + index * F.lit(float(self.step))).cast(self.dtype).cast("double")

    def labels(self, size: int) -> list[float]:
        """The labels on the driver, as label() gives them."""
        import numpy as np

        raw = np.asarray(self.values) if self.values is not None else self.start + np.arange(size) * self.step
        kind = {"float": np.float32, "double": np.float64, "int": np.int32, "short": np.int16}[self.dtype]
        return raw.astype(kind).astype(float).tolist()


@dataclass(frozen=True)
class Cube:
    """A cube: its long view, dimension columns in order, logical shape and axes."""

    df: DataFrame
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    value: str = "signal"
    axes: tuple[Axis, ...] = field(default=())

    def __post_init__(self) -> None:
        if len(self.dims) != len(self.shape):
            raise ValueError(f"{len(self.dims)} dimensions but a shape of {len(self.shape)}")
        for axis in self.axes:
            if axis.dim not in self.dims:
                raise ValueError(f"axis {axis.name} spans {axis.dim}, which is no dimension")
            if not axis.name:
                raise ValueError("an axis has an empty name")
            if axis.values is not None and len(axis.values) != self.size(axis.dim):
                raise ValueError(f"axis {axis.name} has {len(axis.values)} labels for {self.size(axis.dim)} indices")

    def size(self, dim: str) -> int:
        return self.shape[self.dims.index(dim)]

    def axis(self, name: str) -> Axis:
        for axis in self.axes:
            if axis.name == name:
                return axis
        raise KeyError(name)

    def default_axis(self, dim: str) -> Axis:
        """The first axis of a dimension; its index where there is none."""
        return next((a for a in self.axes if a.dim == dim), Axis(dim, dim, dtype="int"))

    def with_df(self, df: DataFrame) -> Cube:
        return replace(self, df=df)

    def where(self, condition: Column | str) -> Cube:
        return self.with_df(self.df.where(condition))

    def labelled(self, *names: str) -> DataFrame:
        """The long view with a column of labels for each named axis."""
        return self.df.select("*", *[self.axis(n).label(F.col(self.axis(n).dim)).alias(n) for n in names])

    def axis_table(self, spark: SparkSession) -> DataFrame:
        """The axes as a table, one row for each label."""
        seen: set[str] = set()
        out = None
        for a in self.axes:
            part = spark.range(self.size(a.dim)).select(
                F.lit(a.name).alias("axis"), F.lit(self.dims.index(a.dim)).alias("dim"), F.col("id").cast("int").alias("idx"), a.label(F.col("id")).alias("value"),
                F.lit(a.unit).alias("unit"), F.lit(a.kind).alias("axis_type"), F.lit(a.dim not in seen).alias("is_default"),
            )
            seen.add(a.dim)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame([], AXIS_SCHEMA)

    def spectra(self, fill=0) -> DataFrame:
        """One row per pixel, the last dimension as a dense array."""
        *pixel, last = self.dims
        pairs = F.map_from_entries(F.collect_list(F.struct(F.col(last), F.col(self.value))))
        grouped = self.df.groupBy(*pixel).agg(pairs.alias("_cells"))
        kind = self.df.schema[self.value].dataType.simpleString()
        dense = F.expr(f"transform(sequence(0, {self.shape[-1] - 1}), i -> coalesce(_cells[i], cast({fill} as {kind})))")
        return grouped.select(*pixel, dense.alias("spectrum"))

    def dense(self, fill=0) -> DataFrame:
        """Every cell of the shape, `fill` where the long view has none."""
        spark = self.df.sparkSession
        grid = None
        for dim, size in zip(self.dims, self.shape):
            line = spark.range(size).select(F.col("id").cast("int").alias(dim))
            grid = line if grid is None else grid.crossJoin(line)  # the shape itself, not pairs of rows
        return grid.join(self.df.select(*self.dims, self.value), list(self.dims), "left").fillna(fill, [self.value])

    def linear(self) -> Column:
        """Row-major index of a cell."""
        total = F.lit(0).cast("long")
        for dim, size in zip(self.dims, self.shape):
            total = total * F.lit(size).cast("long") + F.col(dim)
        return total

    def density(self) -> DataFrame:
        """One row: stored cells, cells of the shape, their ratio."""
        cells = 1
        for size in self.shape:
            cells *= size
        n = F.count("*")
        return self.df.agg(n.alias("nnz"), F.lit(cells).cast("long").alias("cells"), (n / F.lit(float(cells))).alias("density"))


def from_spectra(df: DataFrame, pixel: tuple[str, ...], spectrum: str, last: str = "mz") -> DataFrame:
    """The long view of a spectra view, all cells."""
    return df.select(*pixel, F.posexplode(spectrum).alias(last, "signal"))


def concat(cubes: list[Cube], dim: str) -> Cube:
    """Cubes one after the other along a dimension; the others agree in size."""
    first, df, total = cubes[0], None, 0
    for c in cubes:
        if c.dims != first.dims or any(c.size(d) != first.size(d) for d in c.dims if d != dim):
            raise ValueError(f"cubes of shapes {first.shape} and {c.shape} do not fit along {dim}")
        part = c.df.select(*[(F.col(d) + total).cast(c.df.schema[d].dataType).alias(d) if d == dim else d for d in c.dims], F.col(c.value).alias(first.value))
        df, total = part if df is None else df.unionByName(part), total + c.size(dim)
    shape = tuple(total if d == dim else s for d, s in zip(first.dims, first.shape))
    return Cube(df, first.dims, shape, first.value, tuple(a for a in first.axes if a.dim != dim or a.values is None))


def without(left: Cube, right: Cube, dim: str) -> DataFrame:
    """The indices of a dimension that hold cells of the left cube and none of the right."""
    return left.df.select(dim).distinct().join(right.df.select(dim).distinct(), dim, "left_anti")


def same_structure(first: Cube, second: Cube) -> None:
    """Raises ValueError unless shape, default axes and axis sets agree."""
    if first.shape != second.shape:
        raise ValueError(f"shapes differ: {first.shape} and {second.shape}")
    if [first.default_axis(d).name for d in first.dims] != [second.default_axis(d).name for d in second.dims]:
        raise ValueError("default axes differ")
    if {a.name for a in first.axes} != {a.name for a in second.axes}:
        raise ValueError("axis sets differ")


def embedding_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """The dense cube of the embeddings table: layer = label, x and y from the id,
    mz = position, signal = the rounded magnitude in ten-thousandths."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    long = raw.selectExpr("cast(label as int) as layer", "cast(vec_id % 25 as int) as x", "cast(vec_id div 25 as int) as y", "posexplode(embedding) as (mz, e)")
    df = long.selectExpr("layer", "x", "y", "mz", "cast(rint(abs(cast(e as double)) * 10000) as bigint) as signal")
    axes = (Axis("layer", "layer", 1, 1, dtype="int"), Axis("x", "x", 0, 5, "um"), Axis("y", "y", 0, 5, "um"), Axis("mz", "mz", 0, 0.1, "Da"), Axis("time", "mz", 0, 1, "s"))
    return Cube(df, ("layer", "x", "y", "mz"), (10, 25, 4096, 64), "signal", axes)


COO_STEP, COO_BINS = 1000.0, 128


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw points with duplicates: x, y, an exact value and an integer signal."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return raw.selectExpr("cast(l_suppkey % 32 as int) as x", "cast(l_linenumber - 1 as int) as y", "cast(l_extendedprice as double) as exact", "cast(l_quantity as bigint) as signal")


def lineitem_edges() -> list[float]:
    return [COO_STEP * k for k in range(COO_BINS + 1)]
