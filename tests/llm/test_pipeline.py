"""The pipeline's stages against brute force, on a small corpus."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, check_packed, table


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(400)]
    docs, labels = [], []
    for k in range(300):
        w = rng.choices(words, k=rng.randint(8, 60))
        if k % 10 == 0:
            w.insert(3, rng.choice(["vexa", "grumo"]))
        if k % 17 == 1:
            w.append("ann.42@mail.example.com")
        docs.append((k, " ".join(w) + "."))
        labels.append((k, 1, int(k % 10 == 0)))
    docs += [(1000 + k, docs[k][1] + " more") for k in range(1, 300, 9)]
    folder = tmp_path_factory.mktemp("sf")
    table(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, str(folder)


def test_stages(spark, corpus):
    docs, folder = corpus
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    columns = kept.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "private_data", "packing"]

    clean = stages["toxicity"](spark, kept, folder)
    assert clean.columns == columns
    left = {r.doc_id: r.text for r in clean.collect()}
    toxic = {i for i, t in docs if re.search("vexa|grumo", t)}
    assert set(left) == {i for i, _ in docs} - toxic

    single = stages["near_duplicates"](spark, clean, folder)
    assert single.columns == columns
    want = brute_components(list(left.items()))
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if i == c}

    hidden = stages["private_data"](spark, single, folder)
    assert hidden.columns == columns
    rows = hidden.collect()
    assert all("ann.42@" not in r.text and r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in rows if "@mail.example.com" in r.text} == {i for i, (_, c) in want.items() if i == c and "ann.42@" in left[i]}

    packed = stages["packing"](spark, hidden, folder).collect()
    assert check_packed(packed, [(r.doc_id, r.text) for r in rows], 1024) == 0
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == sum(r.length for r in packed)


def test_odd_rows_and_no_rows(spark, tmp_path):
    docs = [(None, "a text of nobody with some words"), (None, "a text of nobody with some words"), (1, None), (2, ""), (3, " \t"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "one two three four five six seven")]
    labels = [(4, 1, 0), (5, 1, None), (None, 1, 1), (99, 1, 1)]
    for name, rows in (("odd", docs), ("none", [])):
        folder = f"{tmp_path}/{name}"
        table(spark, rows).write.parquet(f"{folder}/documents.parquet")  # further columns, some of whose names clash
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        stages = dict(corpus_pipeline.STAGES)
        for stage in list(stages)[:-1]:
            kept = stages[stage](spark, kept, folder)
            assert kept.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        left = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
        want = [(i or 0, t or "") for i, t in rows if i != 5]
        assert left == sorted(want)
        assert corpus_pipeline.run(spark, folder).where("start = 0").count() == len(want)
