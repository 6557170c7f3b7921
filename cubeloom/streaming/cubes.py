"""Streaming forms: running accumulations, windows as layers, online quantiles,
dropping of points that were seen before."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cubeloom.operators.quantiles import P2
from cubeloom.shipping import ship


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_totals(stream: DataFrame, keys: list[str], value: str = "signal") -> DataFrame:
    """Sum and maximum (at least zero) per key; both merge, so state is one row a key."""
    return stream.groupBy(*keys).agg(F.sum(value).alias("tic"), F.greatest(F.lit(0), F.max(value)).alias("max"))


def window_layers(stream: DataFrame, ts: str, width: str, keys: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Time windows as the layer axis, late rows up to the watermark."""
    cut = F.window(ts, width, slide) if slide else F.window(ts, width)
    source = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return source.groupBy(cut.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest")).select(F.col("w.start").alias("layer_start"), *keys, "n", "total", "largest")


def session_layers(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    source = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return source.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("layer_start"), *keys, "n")


def first_seen(stream: DataFrame, keys: list[str], ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each point once: with an event time, state is dropped behind the watermark."""
    if ts and stream.isStreaming:
        return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def online_quantiles(stream: DataFrame, key: str, value: str, b: int = 4) -> DataFrame:
    """P2 percentiles of each key, updated with every batch; state is 2 (b + 1) + 1
    numbers a key."""
    ship(stream.sparkSession)

    def update(k, batches, state: GroupState):
        p = P2(b, state=state.get) if state.exists else P2(b)
        for pdf in batches:
            for x in pdf[value]:
                p.add(x)
        state.update(p.state())
        yield pd.DataFrame({key: [k[0]], "seen": [p.seen], "percentiles": [p.percentiles().tolist()]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, value).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, seen long, percentiles array<double>", "heights array<double>, places array<double>, seen long", "update", GroupStateTimeout.NoTimeout
    )


def run_to_end(df: DataFrame, sink: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there into a memory table and returns that."""
    writer = df.writeStream.format("memory").queryName(sink).outputMode(mode).trigger(availableNow=True)
    query: StreamingQuery = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(sink)


def merge_into(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Incremental ingestion: every batch's totals are written as a file of their own
    under path/batch=<id>; totals() merges them. Writing a batch again overwrites it,
    so a restart counts nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        running_totals(batch, keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("tic").alias("tic"), F.max("max").alias("max"))


class Progress(StreamingQueryListener):
    """Calls `report(done, rows)` as the batches of a stream end: how many ended so far
    and the rows of the last one. Add it with spark.streams.addListener."""

    def __init__(self, report: Callable[[int, int], None]):
        self.report, self.done = report, 0

    def onQueryStarted(self, event) -> None:
        self.done = 0

    def onQueryProgress(self, event) -> None:
        self.done += 1
        self.report(self.done, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
