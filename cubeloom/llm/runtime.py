"""Session helpers that the operators share: the shared folder, written tables and
connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.shipping import ship

def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where it is unset and all
    executors are threads of this machine. A cluster has to name one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='cubeloom-shared-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/cubeloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    except Exception:  # the context has gone: the folder is the cluster's scratch
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more."""
    _remove(df.sparkSession, df._written_at)


def relieved(run):
    """A function over batches that gives freed memory back when it has ended: workers
    live on, and what their allocators keep adds up beside the executor's heap."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


__all__ = ["Forest", "components", "discard", "documents", "relieved", "scratch", "shared_dir", "ship", "string_buffers", "written"]


class Forest:
    """Union-find over arbitrary ids; a root is the smallest id of its tree."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    nodes = list(forest.up)
    roots = [forest.find(a) for a in nodes]
    for at in range(0, len(nodes), 50_000):
        yield pa.record_batch([pa.array(nodes[at : at + 50_000], pa.int64()), pa.array(roots[at : at + 50_000], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (a, b), b the smallest id that a
    reaches, for every a other than b. Large-star and small-star rounds, each
    contracted inside partitions first and written, until nothing changes."""
    pair = "a long, b long"
    stars = written(edges.select("a", "b").where("a <> b").mapInArrow(relieved(_contract), pair), "stars")
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or tuple(state) == seen:
            return stars
        seen = tuple(state)
        # Minima are written before they are joined, so that a join has no aggregate
        # beneath it and the rows of a star with many arms can be split between tasks.
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        root = written(large.groupBy("a").agg(F.min("b").alias("m")), "root")
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        made = small.unionByName(root.select("a", F.col("m").alias("b"))).where("a <> b").mapInArrow(relieved(_contract), pair)
        stars = written(made.distinct(), "stars")
