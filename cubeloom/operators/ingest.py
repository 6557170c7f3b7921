"""From raw points to a cube: binning, merging of duplicates, counts, accumulations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.cube import Axis, Cube, constants

#: Up to so many edges a search is an expression of the plan; beyond, a vectorised one.
TREE_EDGES = 256


def bin_left(value: Column, edges: list[float]) -> Column:
    """How many of edges[:-2] are smaller than the value: the bin that a left-sided
    search over those edges gives."""
    inner = [float(e) for e in edges[:-2]]
    if len(inner) <= TREE_EDGES:
        return _before(value, inner, 0)
    ends = np.array(inner)

    @F.pandas_udf("int")
    def search(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, v.to_numpy(float), "left").astype(np.int32))

    return F.when(value.isNull(), F.lit(0)).otherwise(search(value.cast("double")))


def _before(value: Column, edges: list[float], begin: int) -> Column:
    """begin and how many of the ascending edges are smaller: a decision tree, so a row
    meets as many edges as their number has binary digits."""
    if not edges:
        return F.lit(begin)
    middle = len(edges) // 2
    return F.when(value > F.lit(edges[middle]), _before(value, edges[middle + 1 :], begin + middle + 1)).otherwise(_before(value, edges[:middle], begin))


def bin_uniform(value: Column, edges: list[float]) -> Column:
    """bin_left for evenly spaced edges, by arithmetic: the smallest k >= 0 with
    value <= edges[k], at most len(edges) - 2."""
    step = edges[1] - edges[0]
    return F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), F.ceil((value - F.lit(edges[0])) / F.lit(step)))).cast("int")


def bin_floor(value: Column, width: float, start: float = 0.0) -> Column:
    return F.floor((value - start) / width).cast("int")


def upper_edge(index: Column, edges: list[float]) -> Column:
    """The label of a bin: its upper edge."""
    return F.element_at(constants(edges), index.cast("int") + 2)


AGGREGATES: dict[str, Callable[[Column], Column]] = {"add": F.sum, "maximum": F.max, "minimum": F.min, "mean": F.avg}


def merge_duplicates(df: DataFrame, coords: list[str], accumulate: dict[str, str] | None = None, default: str = "maximum", count: str | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per coordinate. `signal` is added, every other value follows `default`
    unless `accumulate` names an aggregate for it; `count` names a column for how many
    rows met. Partial aggregation; integers widen, never wrap. "first" and "last" are
    those of the row that comes so by the columns of `order`: rows have none of their own."""
    how = {"signal": "add", **(accumulate or {})}
    values = [c for c in df.columns if c not in coords]
    ends = {"first": F.min_by, "last": F.max_by}
    for c in (*how.values(), default):
        if c not in AGGREGATES and c not in ends:
            raise KeyError(c)
        if c in ends and not order:
            raise ValueError(f"{c} needs the columns that order rows")
    made = [(ends[k](F.col(c), F.struct(*order)) if (k := how.get(c, default)) in ends else AGGREGATES[k](F.col(c))).alias(c) for c in values]
    if count:
        made.append(F.count("*").alias(count))
    return df.groupBy(*coords).agg(*made)


def check_sparse(dims: list[str], binned: dict[str, str], columns: list[str]) -> None:
    """Values for an axis that is not binned, or a binned axis without values."""
    for axis in binned:
        if axis not in dims:
            raise IndexError(f"{axis} is not a binned axis")
        if binned[axis] not in columns:
            raise ValueError(f"binned axis {axis} has no values")


def unique_coords(df: DataFrame, coords: list[str]) -> DataFrame:
    return df.groupBy(*coords).agg(F.count("*").alias("n"))


def accumulations(cube: Cube, named: dict[str, tuple[str, ...]], count: str | None = None) -> DataFrame:
    """Sum and maximum over the named sets of collapsed dimensions, all from one scan
    by grouping sets: accumulation, the dimensions (null where collapsed), tic, max
    and the sum of `count`."""
    for name, collapsed in named.items():
        if not name:
            raise ValueError("an accumulation has an empty name")
        if unknown := set(collapsed) - set(cube.dims):
            raise ValueError(f"accumulation {name} collapses unknown dimensions {sorted(unknown)}")
    sets = [[d for d in cube.dims if d not in collapsed] for collapsed in named.values()]
    if len({tuple(s) for s in sets}) < len(sets):
        raise ValueError("two accumulations keep the same dimensions")
    kind = cube.df.schema[cube.value].dataType
    made = [F.sum(cube.value).alias("tic"), F.greatest(F.lit(0).cast(kind), F.max(cube.value)).alias("max")]
    if count:
        made.append(F.sum(count).alias(count))
    name = F.coalesce(*[F.when(F.expr(" and ".join(f"grouping({d}) = {0 if d in s else 1}" for d in cube.dims)), F.lit(n)) for n, s in zip(named, sets)])
    grouped = cube.df.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in cube.dims])
    return grouped.agg(name.alias("accumulation"), *made).select("accumulation", *cube.dims, "tic", "max", *([count] if count else []))


def chunk_density(df: DataFrame, coords: list[str], chunk: list[int], shape: list[int]) -> DataFrame:
    """One row: chunks that hold a cell, chunks of the shape, their ratio."""
    total = 1
    for s, c in zip(shape, chunk):
        total *= -(-s // c)
    used = df.select(*[F.floor(F.col(d) / c).alias(d) for d, c in zip(coords, chunk)]).distinct().agg(F.count("*").alias("used_chunks"))
    return used.select("used_chunks", F.lit(total).cast("long").alias("total_chunks"), (F.col("used_chunks") / F.lit(float(total))).alias("density"))


def steps(df: DataFrame, keys: list[str], index: str, alias: str = "step") -> DataFrame:
    """The difference of every row's index to the one before it among equal keys; null
    for the first, so that a step that is not 1 begins a run."""
    return df.withColumn(alias, F.col(index) - F.lag(index).over(Window.partitionBy(*keys).orderBy(index)))


def convert_points(points: DataFrame, dims: tuple[str, ...], shape: tuple[int, ...], binned: dict[str, tuple[str, list[float]]], value: str = "signal", accumulate: dict[str, str] | None = None, count: str = "n", named: dict[str, tuple[str, ...]] | None = None, axes: tuple[Axis, ...] = ()) -> tuple[Cube, DataFrame | None]:
    """From raw points to a cube in one call: values of the `binned` axes (axis: column
    and edges) become bins labelled by their upper edges, points of one cell merge, and
    the named accumulations, with item counts, are made from the merged cells."""
    check_sparse(list(dims), {a: c for a, (c, _) in binned.items()}, points.columns)
    for axis, (column, edges) in binned.items():
        points = points.withColumn(axis, bin_left(F.col(column), edges))
    columns = [c for c in points.columns if c not in dims]
    cells = merge_duplicates(points.select(*dims, *columns), list(dims), accumulate, count=count)
    labels = tuple(Axis(axis, axis, values=tuple(edges[1:])) for axis, (_, edges) in binned.items() if all(a.name != axis for a in axes))
    cube = Cube(cells, dims, shape, value, axes + labels)
    return cube, accumulations(cube, named, count) if named else None
