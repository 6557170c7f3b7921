"""Sequence packing by non-negative least squares over length combinations.

Every document (its ids and the end id) gives whole windows and one rest shorter
than a window. The histogram of rest lengths has at most `window` entries whatever
the corpus, so the plan is made on the driver: all combinations of up to three
lengths that fill a window exactly are enumerated, non-negative least squares finds
how often each should repeat to use up the histogram, counts are rounded down to
what is there, and what remains is packed greedily: laid end to end and cut at
window borders; the last, partly filled window is cut into powers of two, which
need no padding. Rests find their place from their rank among equal lengths, a sum
over counts per partition, so no task ever sees a whole length.

Defined cases: null or empty text: the end id alone. Null doc_id: packed as any
other row. Rows that repeat a doc_id are packed one by one. An empty table packs to
no rows. Further columns do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.runtime import relieved, ship, written

WINDOW, BROADCAST_PIECES = 1024, 100_000
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUT = "doc_id long, start long, length long, crc long, doc_tokens long, pid int, rank long, ids binary"


def combinations(window: int) -> np.ndarray:
    """All multisets of two or three lengths that sum to the window, as rows of
    three lengths, 0 for none."""
    a = np.arange(0, window // 3 + 1)
    rows = [np.stack([np.full(k, x), m := np.arange(max(x, 1), (window - x) // 2 + 1), window - x - m], 1) for x in a if (k := (window - x) // 2 + 1 - max(x, 1)) > 0]
    return np.concatenate(rows)


def nnls(rows: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """argmin over x >= 0 of |A x - target|^2, A the 0/1/2/3 matrix of how often a
    combination uses a length, by accelerated projected gradient."""
    n = len(target)
    used = np.where(rows > 0, rows, n)  # one more slot for "none"
    flat = used.ravel()

    def forward(x):
        return np.bincount(flat, np.repeat(x, rows.shape[1]), n + 1)[:n]

    def back(r):
        return np.append(r, 0.0)[used].sum(1)

    v = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(forward(v))
        v /= (norm := np.linalg.norm(v))
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def plan(histogram: np.ndarray, window: int) -> dict:
    """Repeat counts as intervals of rank for every length.

    lo, sequence, offset: sorted by (length, lo); first: where a length begins;
    used: ranks that a combination takes; at: where a length's remaining pieces
    begin in the greedy stream; base: its first sequence; bounds: cuts of the stream.
    """
    rows = combinations(window)
    rows = rows[(histogram[rows] > 0)[:, 1:].all(1) & ((rows[:, 0] == 0) | (histogram[rows[:, 0]] > 0))]
    left = histogram.copy()
    left[0] = left[window] = 0
    entries, sequence = [], int(histogram[window])
    if len(rows):
        x = nnls(rows, left.astype(float))
        for whole in (True, False):  # rounded down first, then up as far as pieces last
            for k in np.argsort(-x, kind="stable").tolist():
                if x[k] < 1e-3:
                    break
                parts = rows[k][rows[k] > 0].tolist()
                many = int(x[k]) if whole else 1
                many = min([many, *(int(left[p]) // parts.count(p) for p in parts)])
                if many < 1:
                    continue
                offset = 0
                for p in parts:
                    entries.append((p, int(histogram[p] - left[p]), sequence, offset))
                    left[p] -= many
                    offset += p
                sequence += many
                if whole:
                    x[k] -= many
    entries.sort()
    table = np.array(entries, np.int64).reshape(-1, 4)
    lengths = np.arange(window + 1)
    total = left * lengths
    stream = int(total.sum())
    bounds, tail = [], stream % window
    while tail:  # largest power of two first
        bounds.append(1 << (tail.bit_length() - 1))
        tail -= bounds[-1]
    return {
        "lo": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3],
        "first": np.searchsorted(table[:, 0], np.arange(window + 2)),
        "used": histogram - left, "at": np.cumsum(total) - total, "base": sequence,
        "whole": stream // window, "streamed": int(left.sum()), "bounds": np.concatenate([[0], np.cumsum(bounds)]).astype(np.int64),
    }


def _cut(encoder, end_id: int, window: int):
    def run(batches):
        encode = encoder().encode
        pid = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            out: list[list] = [[] for _ in range(8)]
            docs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, own in zip(docs, (ids[a:b] for _, ids, at in encode(texts) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))):
                ids = np.append(own, np.uint16(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    n = len(part)
                    raw = part.tobytes()
                    for col, v in zip(out, (doc, start, n, zlib.crc32(raw), len(ids), pid, int(seen[n]), part.astype("<u2").tobytes() if n < window else None)):
                        col.append(v)
                    seen[n] += 1
                if len(out[0]) > 5_000:
                    yield _batch(out)
                    out = [[] for _ in range(8)]
            yield _batch(out)

    return run


def _batch(out):
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "length", "crc", "doc_tokens", "pid", "rank", "ids"])


def _place(p: dict, window: int):
    """Pieces with the place that the plan has for them; those of the greedy stream get
    their position `at` in it instead."""

    def run(batches):
        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            length, rank = col["length"].to_numpy(), col["rank"].to_numpy() + col["before"].to_numpy()
            sequence, offset, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            full = length == window
            sequence[full] = rank[full]
            mine = ~full & (rank < p["used"][length])
            for n in np.unique(length[mine]):
                here = np.flatnonzero(mine & (length == n))
                lo, hi = p["first"][n], p["first"][n + 1]
                k = lo + np.searchsorted(p["lo"][lo:hi], rank[here], "right") - 1
                sequence[here] = p["sequence"][k] + rank[here] - p["lo"][k]
                offset[here] = p["offset"][k]
            rest = ~full & ~mine
            at[rest] = p["at"][length[rest]] + (rank[rest] - p["used"][length[rest]]) * length[rest]
            own = [batch.column(batch.schema.names.index(n)) for n in ("doc_id", "start", "length", "crc", "doc_tokens")]
            yield pa.record_batch([*own, pa.array(sequence), pa.array(offset), pa.array(at, mask=~rest), col["pid"], col["rank"]], names=[*_NAMES, "at", "pid", "rank"])

    return run


def _streamed(p: dict, window: int):
    """Cuts pieces of the greedy stream at the borders of its windows."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, start, n, tokens, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                begun = 0
                while begun < n:
                    w, o = divmod(at + begun, window)
                    if w < p["whole"]:
                        seq, off, room = p["base"] + w, o, window - o
                    else:
                        b = int(np.searchsorted(p["bounds"], o, "right")) - 1
                        seq, off, room = p["base"] + w + b, o - int(p["bounds"][b]), int(p["bounds"][b + 1]) - o
                    take = min(room, n - begun)
                    rows.append((doc, start + begun, take, zlib.crc32(ids[begun : begun + take].tobytes()), tokens, seq, off))
                    begun += take
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, names=_NAMES)

    return run


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, encoder, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. encoder() gives, in a worker, a pieces.Cutter with 16-bit
    ids."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = written(base.mapInArrow(relieved(_cut(encoder, end_id, window)), _CUT), "cut")
    counts = cut.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for n, many in counts.groupBy("length").agg(F.sum("n")).collect():  # a row for each length, at most `window`
        histogram[n] = many
    before = counts.selectExpr("pid", "length", "coalesce(sum(n) over (partition by length order by pid rows between unbounded preceding and 1 preceding), 0) as before")
    # Ids stay where they are: ranks move without them, and only what the plan leaves for
    # the greedy stream meets its ids again.
    ranked = cut.drop("ids").join(before, ["pid", "length"])
    settled = plan(histogram, window)
    placed = written(ranked.mapInArrow(_place(settled, window), f"{PLACED}, at long, pid int, rank long"), "placed")
    few = settled["streamed"] <= BROADCAST_PIECES  # a plan that combines well leaves few
    left = placed.where("at is not null").select("pid", "rank", "length", "doc_id", "start", "doc_tokens", "at")
    ids = cut.where("ids is not null").select("pid", "rank", "length", "ids")
    stream = (F.broadcast(left) if few else left).join(ids, ["pid", "rank", "length"]).select("doc_id", "start", "length", "doc_tokens", "at", "ids")
    return placed.where("at is null").select(*_NAMES).unionByName(stream.mapInArrow(_streamed(settled, window), PLACED))
