"""The registered queries of the operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import ann, byte_bpe, fingerprint, hostextract, idstore, neardup, packing, pseudonym, suffix_lm, toxicity
from cubeloom.llm.pieces import byte_level_encoder, word_encoder
from cubeloom.llm.runtime import documents, scratch


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.pack(documents(spark, sf_dir), lambda: byte_level_encoder(path))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.coalesce(suffix_lm.crc_modulo("doc_id", 5) != 0, F.lit(False)))
    held_out = F.coalesce(suffix_lm.crc_modulo("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(suffix_lm.crc_modulo("doc_id", 7) == 2, F.lit(False))
    tree, unigrams = suffix_lm.fit(docs, ~held_out)
    return suffix_lm.score(docs, tree, unigrams, held_out)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def pseudonym_key(spark: SparkSession) -> str:
    """The secret of spark.cubeloom.pseudonym.key; a public one, for demonstration and
    tests only, where it is not set."""
    return spark.conf.get("spark.cubeloom.pseudonym.key", "cubeloom-demonstration-key")


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonym.pseudonymise(docs, pseudonym_key(spark), count="n_changed")


def op9_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return idstore.store(documents(spark, sf_dir), scratch(spark, "idstore"), lambda: word_encoder(path, parts=4), 2)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostextract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_toxicity": op2_toxicity,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_suffix_tree": op5_suffix_tree,
        "op6_nearest": op6_nearest,
        "op7_fingerprints": op7_fingerprints,
        "op8_pseudonyms": op8_pseudonyms,
        "op9_id_store": op9_id_store,
        "op10_main_text": op10_main_text,
    }


#: All pairs by a join on shingles, for small tables only.
NEAR_DUPLICATES_SQL = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as materialized (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
 n as materialized (select doc_id, count(*) as n from s group by doc_id),
 links as materialized (select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2) p
  join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * k >= 75 * (na.n + nb.n - k)),
 reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.c as component_id, d.doc_id = m.c as kept
 from documents d left join n using (doc_id) join (select a, min(b) as c from reach group by a) m on m.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": NEAR_DUPLICATES_SQL}
