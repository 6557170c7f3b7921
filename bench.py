"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The workloads are pixel boxes to spectra (sides 1, 5, 25) and mass windows to images
(10, 50, 250 bins) over the cube of the embeddings table, on a cube of 125 million
cells in both layouts when BENCH_SYNTHETIC is set, and further operators. Each runs
twice; the second time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom import queries as Q
from cubeloom.cube import Cube
from cubeloom.operators import massquery as M
from cubeloom.plans.chunking import Chunks
from cubeloom.sources import readers, sinks

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spectra_of_boxes(cube: Cube, side: int) -> DataFrame:
    """Spectra of up to ten boxes along the diagonal of layer 0, in one plan."""
    w, h = cube.size("x"), cube.size("y")
    boxes = [(k * side, (k + 1) * side) for k in range(min(10, w // side, h // side))]
    box = F.coalesce(*[F.when((F.col("x") >= a) & (F.col("x") < b) & (F.col("y") >= a) & (F.col("y") < b), F.lit(k)) for k, (a, b) in enumerate(boxes)])
    top = boxes[-1][1]
    return cube.where((F.col("layer") == 0) & (F.col("x") < top) & (F.col("y") < top)).df.withColumn("box", box).where("box is not null").groupBy("box", "mz").agg(F.sum("signal").alias("signal"))


def images_of_windows(cube: Cube, bins: int) -> DataFrame:
    n = cube.shape[-1]
    ranges = [M.MassRange(str(k), k * bins, (k + 1) * bins) for k in range(min(10, max(1, n // bins)))]
    return M.range_images(cube.where(F.col("layer") == 0), ranges)


def synthetic(spark: SparkSession, folder: str) -> dict[str, Cube]:
    """5 x 50 x 50 x 10 000 cells, zeros not stored (one in ten is not zero)."""
    shape, dims = (5, 50, 50, 10_000), ("layer", "x", "y", "mz")
    pixels = spark.range(5 * 50 * 50).selectExpr("cast(id div 2500 as int) as layer", "cast(id div 50 % 50 as int) as x", "cast(id % 50 as int) as y", "id")
    cells = pixels.withColumn("mz", F.explode(F.sequence(F.lit(0), F.lit(9_999), F.lit(10)))).selectExpr("layer", "x", "y", "cast(mz + id % 10 as int) as mz", "pmod(xxhash64(id, mz), 1000) as signal")
    cube = Cube(cells, dims, shape)
    layouts = {"spectra": (Chunks(shape, (1, 10, 10, 10_000)), ["x", "y", "mz"]), "images": (Chunks(shape, (1, 50, 50, 500)), ["mz", "x", "y"])}
    sinks.write_cube(cube, folder, layouts)
    reader = readers.StoredReader(spark, folder, cube, {n: c for n, (c, _) in layouts.items()})
    return {"spec": reader.layout(((0, 1), (0, 10), (0, 10), (0, 10_000))), "mass": reader.layout(((0, 1), (0, 50), (0, 50), (0, 500)))}


def main() -> None:
    spark = session()
    cube = Q.dense(spark, SF)
    runs = {f"spec_{s}": (lambda s=s: spectra_of_boxes(cube, s)) for s in (1, 5, 25)} | {f"mass_{b}": (lambda b=b: images_of_windows(cube, b)) for b in (10, 50, 250)}
    for name in ("query_images", "agg8_accumulations", "agg12_merge_duplicates", "agg15_percentiles", "jn6_densify", "win3_range_scaling", "snk9_pixel_spectra", "str_daily_layers", "agg16_p2_quantiles"):
        runs[name] = lambda name=name: Q.QUERIES[name](spark, SF)
    if os.environ.get("BENCH_SYNTHETIC"):
        made = synthetic(spark, tempfile.mkdtemp(prefix="bench-"))
        runs |= {f"med_spec_{s}": (lambda s=s: spectra_of_boxes(made["spec"], s)) for s in (1, 5, 25)} | {f"med_mass_{b}": (lambda b=b: images_of_windows(made["mass"], b)) for b in (10, 50, 250)}
    took: dict[str, float] = {}
    for name, make in runs.items():
        for _ in range(2):
            began = time.monotonic()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(time.monotonic() - began, 4)
    print(json.dumps({"metric": "total_seconds_warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
