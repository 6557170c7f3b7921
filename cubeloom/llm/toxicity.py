"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic function of a
bias and the weights of its words and word beginnings; the document's score joins
them by noisy-or, 1 - prod(1 - p). Weights are learned from document labels alone,
and the sentences that carry a document's score are located with their spans.

Fitting uses a bounded sample of the labelled rows: the MAX_LABELLED with the
smallest hash of doc_id, one row of each. Features are the words and word beginnings
whose document frequencies in the sample differ most between the labels (log odds over
their standard error, at least LEAST_Z), at most `max_features` of them. Scoring covers
every whole text.

Defined cases: null and empty texts, or texts without a word, are bags of no
sentences: score 0. Null doc_ids never train and are never held out. Labels that are
null do not train; a doc_id with several labels takes the largest. Rows that repeat
a doc_id are scored one by one. If all labels are alike the share of label 1 (0
without labels) is the score of every text. Further columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.runtime import relieved, ship, written

MAX_LABELLED, MAX_FEATURES, LEAST_Z = 20_000, 4_096, 3.0
BEGINNINGS = (4, 5)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
MEMO = 300_000


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked apart."""
    return [word] + [f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k]


class Model:
    """weights: feature -> weight; constant: the score of all texts, if not None."""

    def __init__(self, weights: dict[str, float], bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant
        self._memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self._memo.get(w)
        if got is None:
            if len(self._memo) > MEMO:
                self._memo.clear()
            get = self.weights.get
            got = self._memo[w] = sum(get(f, 0.0) for f in features(w))
        return got

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence with a word."""
        out = []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m.group().lower()))
            if words:
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-min(50.0, max(-50.0, self.bias + sum(map(self.word, words))))))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its sentences that score at least a half."""
        if self.constant is not None:
            return self.constant, []
        told = [w for w in set(WORD.findall(text.lower())) if self.word(w)]
        if not told:  # every sentence has the bias alone
            n = sum(1 for m in SENTENCE.finditer(text) if WORD.search(m.group()))
            return -math.expm1(-n * math.log1p(math.exp(self.bias))), []
        each = self.sentences(text)
        clean = sum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in each)
        return -math.expm1(clean), [x for x in each if x[2] >= 0.5]


def _counted(batches):
    """Document frequencies of features by label."""
    both = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(WORD.findall((text or "").lower()))
            both[toxic].update({f for w in words for f in features(w)})
    names = list(both[0].keys() | both[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.record_batch([pa.array(part, pa.string()), pa.array([both[1][f] for f in part], pa.int64()), pa.array([both[0][f] for f in part], pa.int64())], names=["feature", "pos", "neg"])


def _bags(number: dict[str, int]):
    """Of each document the features of its sentences, as one list with -1 between
    sentences, and how many sentences have none."""

    def run(batches):
        for batch in batches:
            lists, plain = [], []
            for text in batch.column(0).to_pylist():
                row, none = [], 0
                for m in SENTENCE.finditer(text or ""):
                    words = set(WORD.findall(m.group().lower()))
                    if not words:
                        continue
                    found = [number[f] for w in words for f in features(w) if f in number]
                    if found:
                        row += [*found, -1]
                    else:
                        none += 1
                lists.append(row)
                plain.append(none)
            yield pa.record_batch([batch.column(1), pa.array(lists, pa.list_(pa.int32())), pa.array(plain, pa.int64())], names=["toxic", "bag", "plain"])

    return run


def noisy_or(bags: list[list[int]], plain: np.ndarray, toxic: np.ndarray, n_features: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) that maximise the likelihood of the labels under noisy-or."""
    flat = np.array([x for b in bags for x in b], np.int64)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    stop = flat < 0
    sentence = np.cumsum(stop) - stop
    n_sentences = int(stop.sum())
    bag = owner[stop]
    feature, of = flat[~stop], sentence[~stop]
    w, bias = np.zeros(n_features), -5.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        s = bias + np.bincount(of, w[feature], n_sentences)
        p, p0 = 1 / (1 + np.exp(-s)), 1 / (1 + math.exp(-bias))
        a = np.bincount(bag, np.logaddexp(0, s), len(bags)) + plain * np.logaddexp(0, bias)
        pull = np.where(toxic == 1, -np.exp(-a) / -np.expm1(-np.maximum(a, 1e-9)), 1.0)
        g = pull[bag] * p
        grad = np.append(np.bincount(feature, g[of], n_features), g.sum() + (pull * plain).sum() * p0) / len(bags)
        grad[:-1] += decay * w / len(bags) * 10
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    """A model from the labelled rows for whose ids `training`, a condition on
    doc_id, holds."""
    ship(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if training is not None:
        marks = marks.where(training)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the bound of the sample
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = base.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    sample = written(one.select("text", "toxic"), "labelled")  # read three times below
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model({}, 0.0, 1.0 if 1 in n else 0.0)
    counts = sample.mapInArrow(relieved(_counted), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    odds = F.log((F.col("pos") + 0.5) / (n[1] + 1.0)) - F.log((F.col("neg") + 0.5) / (n[0] + 1.0))
    z = F.abs(odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
    top = counts.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(max_features).select("feature").collect()
    number = {r[0]: k for k, r in enumerate(top)}
    bags = sample.mapInArrow(relieved(_bags(number)), "toxic int, bag array<int>, plain long").toArrow()  # max_labelled rows, chosen features only
    w, bias = noisy_or(bags.column("bag").to_pylist(), bags.column("plain").to_numpy().astype(float), bags.column("toxic").to_numpy(), len(number))
    return Model({f: float(w[k]) for f, k in number.items()}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, offending: array of (start, end, score) of the
    sentences that score at least a half, in code points."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            found = [model.score(t or "") for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in found]
            value = [min(1.0, max(0.0, s)) for s, _ in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.record_batch([batch.column(0), pa.array(value, pa.float64()), pa.array([int(s >= 0.5) for s in value], pa.int32()), pa.array(spans, kind)], names=["doc_id", "score", "predicted", "offending"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(relieved(run), "doc_id long, score double, predicted int, offending array<struct<start: int, end: int, score: double>>")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with their own columns."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            keep = [model.score(t or "")[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(relieved(run), docs.schema)
