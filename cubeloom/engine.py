"""The engine's commands: convert, query, bulk query, slice, compound, inspect, density."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.cube import Cube
from cubeloom.functions import chem
from cubeloom.operators import massquery, slicing
from cubeloom.plans.chunking import Chunks, from_max_items, memory_layout
from cubeloom.sources import readers, sinks


class FileType(Enum):
    """What a stored cube was made from."""

    PARQUET = "parquet"
    CHUNK_SOURCE = "chunk_source"


@dataclass(frozen=True)
class ConvertOptions:
    """Sizes in bytes, and for each layout the priorities of its dimensions (the
    smallest number is kept together first)."""

    chunk_bytes: int = 8 << 20
    memory_bytes: int = 4 << 30
    item_bytes: int = 8
    layouts: tuple[tuple[str, tuple[int, ...]], ...] = (("images", (3, 1, 1, 2)), ("spectra", (3, 2, 2, 1)))


def plan(shape: tuple[int, ...], options: ConvertOptions, density: float = 1.0) -> tuple[dict[str, Chunks], str, Chunks]:
    """(chunks of every layout, the layout to read by, what to read at a time)."""
    items = max(1, options.chunk_bytes // options.item_bytes)
    layouts = {n: from_max_items(shape, items, p) for n, p in options.layouts}
    return layouts, *memory_layout(layouts, options.item_bytes, options.memory_bytes, density)


def convert(cube: Cube, path: str, options: ConvertOptions = ConvertOptions(), metadata: dict | None = None) -> readers.StoredReader:
    """Writes a cube with its layouts, totals, axes and metadata; returns its reader."""
    layouts, _, _ = plan(cube.shape, options)
    order = {n: [d for _, d in sorted(zip(p, cube.dims), key=lambda x: -x[0])] for n, p in options.layouts}
    sinks.write_cube(cube, path, {n: (c, order[n]) for n, c in layouts.items()}, metadata)
    return readers.StoredReader(cube.df.sparkSession, path, cube, layouts)


def query(source: readers.CubeReader | Cube, spec: massquery.QuerySpec) -> massquery.QueryResult:
    """A query. Of a stored cube, ranges read the layout that covers their box with the
    fewest chunks, and totals those stored with it if the query has no slices."""
    if isinstance(source, Cube):
        return massquery.query(source, spec)
    cube = source.cube()
    if not isinstance(source, readers.StoredReader):
        return massquery.query(cube, spec)
    box = massquery.spec_box(cube, spec)
    whole = all((a, b) == (0, s) for (a, b), s in zip(box, cube.shape))
    return massquery.query(source.layout(massquery.range_hull(box, spec.ranges)), spec, source.totals() if whole else None, source.layout(box))


def export(result: massquery.QueryResult, cube: Cube, folder: str) -> None:
    """Images and spectra of a query as text files."""
    sinks.write_query(result, cube, folder)


def kendrick(result: massquery.QueryResult, cube: Cube, formula: str = "CH2", scale: str = "QUAD") -> DataFrame:
    """The Kendrick plot of each layer's total spectrum."""
    return massquery.kendrick_points(result.total_spectrum, cube, chem.formula_mass(chem.common_isotopes(cube.df.sparkSession), formula), scale)


def bulk_query(sources: dict[str, readers.CubeReader | Cube], spec: massquery.QuerySpec) -> DataFrame:
    """The images of many inputs in one plan, with the name of their input."""
    out = None
    for name, source in sources.items():
        part = query(source, spec).images.withColumn("input", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise slicing.MissingArgumentError("no inputs")
    return out


def slice(cubes: dict[str, Cube], groups: dict[str, slicing.GroupSpec], check: bool = False) -> dict[str, DataFrame | slicing.Bound]:
    """The result of every group; with check, what it is bound to instead. A group of
    several paths reads the first: its siblings must agree in structure."""
    bound = {n: slicing.bind(g, cubes) for n, g in groups.items()}
    return bound if check else {n: slicing.slice_cube(cubes[groups[n].paths[0]], b, groups[n].type) for n, b in bound.items()}


def compound(spark: SparkSession, formulas: list[str], isotopes: DataFrame | None = None) -> DataFrame:
    """Average, lightest and most abundant mass of formulas."""
    return chem.compound_masses(spark.createDataFrame([(f,) for f in formulas], "formula string"), isotopes if isotopes is not None else chem.common_isotopes(spark))


def inspect(spark: SparkSession, path: str, max_depth: int | None = None) -> DataFrame:
    """The metadata tree of a stored cube."""
    return readers.tree(spark.read.parquet(f"{path}/metadata"), max_depth)


def density(reader: readers.StoredReader) -> DataFrame:
    """Storage statistics of every layout."""
    out = None
    for name, chunks in reader.layouts.items():
        part = readers.storage_stats(reader.cube(), chunks).withColumn("layout", F.lit(name)).withColumn("chunk_items", F.lit(math.prod(chunks.chunk)))
        out = part if out is None else out.unionByName(part)
    return out


def link(df: DataFrame, name: str) -> None:
    """Another name for data that is there."""
    df.createOrReplaceTempView(name)
