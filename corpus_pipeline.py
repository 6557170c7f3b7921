"""The corpus pipeline: toxicity, near duplicates, personal data, packing.

Each stage takes all rows that its predecessor kept and returns the columns of
documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import neardup, packing, pseudonym, toxicity
from cubeloom.llm.pieces import byte_level_encoder
from cubeloom.llm.queries import pseudonym_key, tokenizer_path
from cubeloom.llm.runtime import documents, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half; all labelled rows may train."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group, and those without one."""
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; n_chars follows the new text."""
    out = pseudonym.pseudonymise(docs, pseudonym_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.pack(docs, lambda: byte_level_encoder(path))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("private_data", hide_private), ("packing", pack)]
ORACLE_SQL = None  # tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = scratch(spark, "pipeline")  # goes when the driver ends
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
