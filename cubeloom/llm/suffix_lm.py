"""A probabilistic suffix tree over words, grown level by level and used to score texts.

Root: add-one unigrams over the whole vocabulary of the training documents. Deeper
states: contexts of up to DEPTH words, fewer where no longer one could be retained. A context and the followers it keeps must occur
at least MIN_COUNT times, whatever the size of the corpus, so the levels grow with it;
they stay tables and nothing of their size is collected. A candidate is retained if the
distribution of its followers diverges from that of its longest retained suffix: twice
the log likelihood ratio G over its k kept followers exceeds k + 4 sqrt(2 k), four
standard deviations above what chance gives. A retained state gives a kept follower
(c - DISCOUNT) / c(state) and passes the rest of its mass to its suffix, renormalised
over what it does not keep, so every state is a distribution.

Runs of up to TOGETHER words are counted level by level; longer ones, which mostly stand
in repeated passages, in one more scan.

Counts travel as blocks: every task sums its own, deals them into buckets by the hash of
the run and sends each bucket's part as one compressed row; a bucket is summed in one go.
There are as many buckets as keep each of them small, whatever the corpus, and no run or
word fills one, for it is a single entry of every task's part. The most frequent words, at
most LOOKUPS, have numbers; a run of such words travels as these, any other as the keys of
its prefix and suffix.

Texts are scored by sums: what a state passes on and what it changes for a follower are
weights of the runs of words, and a text's score is its root score and the weights of
all its runs. The most frequent words and runs, at most LOOKUPS of each, are looked up
beside the texts, so no score depends on the bound: a task asks for what it lacks, once for each
key, in blocks of ascending keys; they meet the table's blocks, and the answers go
back to the task's rows, in WAVES parts of the keys, each of which is dropped when it is
summed. A bitmap of bounded size drops most of what would not be found.

Defined cases: null and empty texts are the end token alone. Null doc_ids are never
held out and train. Rows that repeat a doc_id are counted and scored one by one.
Without training tokens every token has c = 0 and N = V = 0. Further columns do not
matter.
"""

from __future__ import annotations

import gc
import time
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import texthash
from cubeloom.llm.runtime import discard, relieved, ship, written

MIN_COUNT, DISCOUNT, DEPTH, TOGETHER, LOOKUPS = 3, 0.5, 5, 3, 1_500_000
MOST_BITS = 1 << 28
FLUSH, BUCKETS, BUCKET_TOKENS = 1_500_000, 1024, 1_000_000
_CODEC = pa.Codec("zstd", compression_level=1)
END = np.uint64(0x3C79AC492BA7B653)
SLICE, WAVES = 600, 4
WIDE, PACKED = np.uint64(21), 3  # bits of a word's number, numbers in a column
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an END after each row; where rows begin: rows + 1."""
    h, at = texthash.words(column)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def _grouped(keys: np.ndarray, counts: np.ndarray | None, more) -> tuple[np.ndarray, ...]:
    """Distinct keys, how often (or the sum of counts), and the further columns of one
    row of each."""
    order = np.argsort(keys) if more or counts is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    many = np.diff(np.append(begin, len(keys))) if counts is None else np.add.reduceat(counts[order], begin) if len(begin) else counts[:0]
    return keys[begin], many, *(x[order[begin]] for x in more)


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second, ...: equal ones lie together."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, whose high bytes are mostly zero."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _stepped(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(raw, np.uint64), dtype=np.uint64)


def _range(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key by its size, so that ascending keys have ascending ones."""
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


class _Counts:
    """Counts of keys, merged as they grow and handed on in parts. Further columns are
    those of a key's first row. named: runs as numbers of words, k is handed on as -k."""

    def __init__(self, most: int = FLUSH, named: bool = False) -> None:
        self.parts, self.size, self.most, self.named = [], 0, most, named

    def add(self, keys: np.ndarray, *more: np.ndarray) -> None:
        self.parts.append(_grouped(keys, None, more))
        self.size += len(self.parts[-1][0])

    def full(self, k: int, buckets: int):
        if self.size > self.most:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
            if self.size > self.most // 2:
                yield self.blocks(k, buckets)

    def merged(self) -> tuple[np.ndarray, ...]:
        keys, counts, *more = map(np.concatenate, zip(*self.parts))
        return _grouped(keys, counts, more)

    def blocks(self, k: int, buckets: int) -> pa.RecordBatch:
        """A row for each bucket: the columns behind a key (the key, if there are none)
        and its count, ordered so that they compress well."""
        keys, c, *columns = self.merged() if self.parts else _grouped(np.zeros(0, np.uint64), None, ())
        by = texthash.mix(keys) if self.named and not columns else keys
        columns = columns or [keys]
        self.parts, self.size = [], 0
        bucket = (by >> np.uint64(32)) % np.uint64(buckets)
        if self.named:
            order = np.argsort(columns[0])
            order = order[np.argsort(bucket[order].astype(np.min_scalar_type(buckets)), kind="stable")]
        else:
            order = np.argsort(bucket << np.uint64(44) | columns[0] >> np.uint64(20))
        bucket, c, columns = bucket[order], c[order].astype(np.uint64), [x[order] for x in columns]
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
        data = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)]):
            first, *rest = (x[a:b] for x in (*columns, c))
            data.append(_pack(b"".join((_steps(first), *map(_planes, rest)) if self.named else (x.tobytes() for x in (first, *rest)))))
        return pa.record_batch([pa.array(np.full(len(begin), -k if self.named else k, np.int32)), pa.array(bucket[begin].astype(np.int32)), pa.array(data, pa.binary())], names=["k", "bucket", "data"])


def _summed(columns: int, least: int, names: np.ndarray | None = None):
    """Sums the blocks of each (k, bucket), which come one after the other: key, k, the
    columns and c of keys that reach `least`. names: the words that have numbers."""

    def close(k: int, data: list[bytes]):
        if k < 0:
            return close_named(-k, data)
        parts = [np.frombuffer(_unpack(d), np.uint64).reshape(columns + 1, -1) for d in data]
        *more, c = np.concatenate(parts, axis=1)
        keys = above(*more) if columns > 1 else more[0]
        keys, c, *more = _grouped(keys, c.astype(np.int64), more)
        enough = c >= least
        return shown(k, keys[enough], [x[enough] for x in (more if columns > 1 else [])], c[enough])

    def close_named(k: int, data: list[bytes]):
        wide, parts = -(-k // PACKED), []
        for raw in map(_unpack, data):
            n = len(raw) // (wide + 1)
            parts.append((_stepped(raw[:n]), *(_unplaned(raw[i * n : (i + 1) * n], np.uint64) for i in range(1, wide + 1))))
        *ids, c = map(np.concatenate, zip(*parts))
        keys, c, *more = _grouped(above(*ids) if wide > 1 else ids[0], c.astype(np.int64), ids if wide > 1 else [])
        enough = c >= least
        run = _named([x[enough] for x in more or [keys]], k, names)
        while len(run) > 2:
            run = [above(a, b) for a, b in zip(run, run[1:])]
        return shown(k, above(*run), run, c[enough])

    def shown(k: int, keys: np.ndarray, more: list[np.ndarray], c: np.ndarray) -> pa.RecordBatch:
        fields = [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), k, np.int32)), *(pa.array(x.view(np.int64)) for x in more), pa.array(c)]
        return pa.record_batch(fields, names=["key", "k", *["prefix", "suffix"][: len(more)], "c"])

    def run(batches):
        at, data = None, []
        for batch in batches:
            for k, bucket, d in zip(*(x.to_pylist() for x in batch.columns)):
                if (k, bucket) != at:
                    if data:
                        yield close(at[0], data)
                    at, data = (k, bucket), []
                data.append(d)
        if data:
            yield close(at[0], data)

    return run


def _numbered(ids: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The runs of k words at these places by their numbers, PACKED to a column."""
    out = []
    for first in range(0, k, PACKED):
        column = ids[at + first]
        for j in range(first + 1, min(first + PACKED, k)):
            column = column << WIDE | ids[at + j]
        out.append(column)
    return out


def _named(columns: list[np.ndarray], k: int, names: np.ndarray) -> list[np.ndarray]:
    """The words of runs from their numbers."""
    last = [min(PACKED, k - j // PACKED * PACKED) - 1 for j in range(k)]
    mask = (np.uint64(1) << WIDE) - np.uint64(1)
    return [names[(columns[j // PACKED] >> np.uint64(21 * (last[j] - j % PACKED)) & mask).astype(np.int64)] for j in range(k)]


class _Numbers:
    """The place of each word in `names`, by a table of hashes that are probed in turn."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.mask = np.uint64((1 << (2 * len(names) + 1).bit_length()) - 1)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(names)), (names & self.mask).astype(np.int64)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & int(self.mask)

    def of(self, h: np.ndarray) -> np.ndarray:
        """-1 for words without a number."""
        at = (h & self.mask).astype(np.int64)
        out = self.table[at].astype(np.int64)
        left = np.flatnonzero(out >= 0)
        left = left[self.names[out[left]] != h[left]]
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            out[left] = self.table[at[left]]
            left = left[out[left] >= 0]
            left = left[self.names[out[left]] != h[left]]
        return out


def _counted(texts: DataFrame, count, columns: int, least: int, names: np.ndarray | None = None) -> DataFrame:
    """The counts that `count` makes of texts, summed over all tasks."""
    dealt = texts.mapInArrow(relieved(count), "k int, bucket int, data binary").repartition("k", "bucket").sortWithinPartitions("k", "bucket")
    return dealt.mapInArrow(relieved(_summed(columns, least, names)), f"key long, k int, {'prefix long, suffix long, ' if columns > 1 else ''}c long")


def above(keys: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The key of a run of words from those of the run without its last and without
    its first word."""
    return texthash.mix(keys * np.uint64(0xD6E8FEB86659FD93) + after)


def _runs(h: np.ndarray, at: np.ndarray, longest: int):
    """(k, keys of the runs of k words at each position, whether the text goes on so far)."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])
    keys = h
    for k in range(1, longest + 1):
        if k > 1:
            keys = above(keys, np.append(keys[1:], np.uint64(0)))
        yield k, keys, left >= k


class Sieve:
    """A bitmap of keys that lets all of them pass, and few others: it only spares
    work, exact joins follow. At most MOST_BITS whatever the number of keys. A key has
    up to three bits, fewer where there are few for each key, all in one word of the map."""

    def __init__(self, keys: DataFrame, n: int):
        self.bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
        self.shifts = [0, 28, 34][: max(1, 7 * self.bits // (10 * max(1, n)))]
        at = F.col("key").bitwiseAND(F.lit(self.bits - 1))
        bit = " | ".join(f"shiftleft(1L, cast(shiftright(key, {by}) & 63L as int))" for by in self.shifts)
        with _cleaned(keys.sparkSession):
            got = keys.select(F.shiftright(at, 6).alias("at"), F.expr(bit).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
        self.map = np.zeros(self.bits >> 6, np.uint64)
        self.map[got.column("at").to_numpy()] = got.column("bit").to_numpy().astype(np.int64).view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, words = np.uint64(1), self.map[((keys & np.uint64(self.bits - 1)) >> np.uint64(6)).astype(np.int64)]
        out = words >> (keys & np.uint64(63)) & one > 0
        if len(self.shifts) > 1:
            met = np.flatnonzero(out)
            keys, words = keys[met], words[met]
            for by in self.shifts[1:]:
                words = words & -(words >> (keys >> np.uint64(by) & np.uint64(63)) & one)  # none where the bit is not set
            out[met] = words > 0
        return out


class Tree:
    """The tree as tables. states[k - 1]: the contexts of k words with what they pass on
    (log10). weights: (key, c, weight) of runs of up to `longest` words; a text's score is
    its root score and the weights of all runs in it."""

    def __init__(self, n: int, v: int):
        self.n, self.v, self.longest, self.states = n, v, 1, []
        self.weights: DataFrame | None = None


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, -1 if it is not there; keys are searched in their order, which
    spares the caches."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    order = np.argsort(keys)
    ascending = keys[order]
    at = np.minimum(np.searchsorted(sorted_keys, ascending), len(sorted_keys) - 1)
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(sorted_keys[at] == ascending, at, -1)
    return out


def _slices(batches, column: int):
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield part, *_tokens(part.column(column))


def _count_words(buckets: int):
    def run(batches):
        counts = _Counts()
        for _, h, _at in _slices(batches, 0):
            counts.add(h)
            yield from counts.full(1, buckets)
        yield counts.blocks(1, buckets)

    return run


def _count_runs(sieve: Sieve, short: int, lengths: range, buckets: int, names: np.ndarray):
    """Counts the runs of these lengths all of whose runs of `short` words are frequent."""

    def run(batches):
        numbers = _Numbers(names)
        counts = {(k, named): _Counts(FLUSH // len(lengths), named) for k in lengths for named in (False, True)}
        for _, h, at in _slices(batches, 0):
            ok = part = None
            ids = numbers.of(h)
            every = known = ids >= 0
            ids = ids.astype(np.uint64)
            for k, keys, whole in _runs(h, at, lengths[-1]):
                if k > 1:
                    every = known & np.append(every[1:], False)
                if k == short:
                    ok = sieve.has(keys) & whole
                elif k > short:
                    ok = whole & ok & np.append(ok[1:], False)
                    if k in lengths:
                        sel = np.flatnonzero(ok & every)
                        columns = _numbered(ids, sel, k)
                        counts[k, True].add(*columns if len(columns) == 1 else (above(*columns), *columns))
                        sel = np.flatnonzero(ok & ~every)
                        counts[k, False].add(keys[sel], part[sel], part[sel + 1])
                part = keys
            for (k, _), c in counts.items():
                yield from c.full(k, buckets)
        for (k, _), c in counts.items():
            yield c.blocks(k, buckets)

    return run


_DOC, _ASK = 0, 1
_SCORED = "kind int, pid int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, k int, bucket int, seq int, keys binary, rows binary"


def _scored(many: int, **columns) -> pa.RecordBatch:
    """Rows of _SCORED, null where no column is given."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in _SCORED.split(", ")]
    return pa.record_batch([columns[n].cast(kinds[t]) if n in columns else pa.nulls(many, kinds[t]) for n, t in fields], names=[n for n, _ in fields])


class _Asks:
    """What a task has to ask for: keys and the rows they stand in."""

    def __init__(self, pid: int, k: int, buckets: int):
        self.pid, self.k, self.buckets, self.seq, self.size, self.parts = pid, k, buckets, 0, 0, []

    def add(self, keys: np.ndarray, rows: np.ndarray):
        self.parts.append((keys, rows))
        self.size += len(keys)
        if self.size > FLUSH:
            yield self.blocks()

    def blocks(self) -> pa.RecordBatch:
        """For each bucket the distinct keys, and of every place whether it begins a key,
        and its row."""
        keys, rows = map(np.concatenate, zip(*self.parts)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order].astype(np.uint32)
        new = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
        bucket = _range(keys, self.buckets)
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), bucket[1:] != bucket[:-1])))
        one, two = [], []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]):
            one.append(_pack(_steps(keys[a:b][new[a:b]])))
            two.append(_pack(new[a:b].tobytes() + _planes(rows[a:b])))
        n, self.parts, self.size, self.seq = len(begin), [], 0, self.seq + 1
        same = {c: pa.array(np.full(n, v)) for c, v in (("kind", _ASK), ("pid", self.pid), ("k", self.k), ("seq", self.seq))}
        return _scored(n, **same, bucket=pa.array(bucket[begin].astype(np.int32)), keys=pa.array(one, pa.binary()), rows=pa.array(two, pa.binary()))


def _told(k: int, buckets: int):
    """A table (key, value) as blocks: k, bucket, and (keys, values)."""

    def blocks(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, values = map(np.concatenate, zip(*parts))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        bucket = _range(keys, buckets)
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        data = [_pack(_steps(keys[a:b]) + _planes(values[a:b])) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)])]
        return pa.record_batch([pa.array(np.full(len(begin), k, np.int32)), pa.array(bucket[begin].astype(np.int32)), pa.array(data, pa.binary())], names=["k", "bucket", "keys"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size > FLUSH:
                yield blocks(parts)
                parts, size = [], 0
        if parts:
            yield blocks(parts)

    return run


def _answered(batches):
    """Blocks of a table (pid -1, first) and of asks, by (k, bucket): for every ask the
    values of its keys, NaN where there is none."""
    at, told, table = None, [], None
    for batch in batches:
        out = []
        for k, bucket, pid, seq, data in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, bucket) != at:
                at, told, table = (k, bucket), [], None
            raw = _unpack(data)
            if pid < 0:
                told.append((_stepped(raw[: len(raw) // 2]), _unplaned(raw[len(raw) // 2 :], float)))
                continue
            if table is None:
                names, values = map(np.concatenate, zip(*told)) if told else (np.zeros(0, np.uint64), np.zeros(0))
                order = np.argsort(names)
                table = names[order], np.append(values[order], np.nan)
            out.append((k, bucket, pid, seq, _pack(_planes(table[1][lookup(table[0], _stepped(raw))]))))
        columns = list(zip(*out)) if out else [()] * 5
        yield pa.record_batch([*(pa.array(c, pa.int32()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["k", "bucket", "pid", "seq", "data"])


def _gathered(batches):
    """For each (pid, k, bucket, seq) the answers (side 0) and then the places (side 1):
    what every row of a task gets."""
    pid, sums, values = None, None, b""

    def close():
        rows = np.flatnonzero(sums[0] > 0)
        return pa.record_batch([pa.array(np.full(len(rows), pid, np.int32)), pa.array(rows), pa.array(sums[1][rows].astype(np.int64)), pa.array(sums[2][rows]), pa.array(sums[3][rows])], names=["pid", "row", "more", "gain", "deep"])

    for batch in batches:
        for p, k, side, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5))):
            if p != pid:
                if pid is not None:
                    yield close()
                pid, sums = p, np.zeros((4, 0))
            if side == 0:
                values = _unplaned(_unpack(data), float)
                continue
            raw = _unpack(data)
            n = len(raw) // 5
            rows = _unplaned(raw[n:], np.uint32)
            got = values[np.cumsum(np.frombuffer(raw[:n], bool)) - 1]
            rows, got = rows[~np.isnan(got)], got[~np.isnan(got)]
            if not len(rows):
                continue
            if rows.max() >= sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, int(rows.max()) + 1024 - sums.shape[1])))
            n = sums.shape[1]
            many = np.bincount(rows, minlength=n)
            sums[0] += many
            if k == 1:
                sums[1] += many
            sums[2 if k == 1 else 3] += np.bincount(rows, got, n)
    if pid is not None:
        yield close()


def _score(n: int, v: int, words: tuple, hot: tuple, sieves: tuple, longest: int, all_words: bool, all_runs: bool, buckets: int):
    """all_words, all_runs: nothing is left to ask for. sieves: of words, of runs."""
    known_words, c = words[0], words[1].astype(np.min_scalar_type(int(words[1].max(initial=0))))

    def run(batches):
        pid, begun, root = TaskContext.get().partitionId(), 0, np.log10((c + 1.0) / (n + v + 1))
        cold, far = _Asks(pid, 1, buckets), _Asks(pid, 2, buckets)
        for part, h, at in _slices(batches, 1):
            row = begun + np.repeat(np.arange(len(at) - 1), np.diff(at))
            w = lookup(known_words, h)
            known = w >= 0
            base = np.where(known, root[np.maximum(w, 0)] if len(root) else 0.0, 0.0)
            if not all_words:
                ask = np.flatnonzero(~known)
                ask = ask[sieves[0].has(h[ask])]
                yield from cold.add(h[ask], row[ask])
            total = base.copy()
            for _, keys, whole in _runs(h, at, longest):
                met = np.flatnonzero(whole & sieves[1].has(keys))
                found = lookup(hot[0], keys[met])
                hit = found >= 0
                total[met[hit]] += hot[1][found[hit]]
                if not all_runs:
                    yield from far.add(keys[met[~hit]], row[met[~hit]])
            sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base, total)]
            m = len(at) - 1
            yield _scored(
                m, kind=pa.array(np.full(m, _DOC)), pid=pa.array(np.full(m, pid)), row=pa.array(begun + np.arange(m)), doc_id=part.column(0), held_out=part.column(2),
                n_tokens=pa.array(np.diff(at)), n_known=pa.array(sums[0]), base=pa.array(sums[1]), score=pa.array(sums[2]),
            )
            begun += m
        yield cold.blocks()
        yield far.blocks()

    return run


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_count: int = MIN_COUNT) -> tuple[Tree, DataFrame]:
    """(the tree, the table (key, c) of all training tokens) from the rows of docs
    where `training` holds."""
    ship(docs.sparkSession)
    texts = docs.where(training).select(F.col(text_col).cast("string").alias("text"))
    unigrams = _stored(_counted(texts, _count_words(_buckets(texts)), 1, 1).select("key", "c"), "unigrams")
    n, v = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    buckets = max(BUCKETS, n // BUCKET_TOKENS)
    root = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    words = unigrams.where(F.col("c") >= min_count).select("key", "c", root.alias("logp"), F.lit(True).alias("live"))
    names = _arrays(words.where(_most(words, LOOKUPS)), "c")
    names = names[0][np.argsort(-names[1])]
    tree, weights, frequent, tables, levels = Tree(n, v), [], {1: words.select("key", "c")}, {}, []
    # Runs that may matter: their prefix and suffix runs (keys), count c, log10 probability
    # logp of the last word after the others, live: whether more words in front could still
    # change it.
    runs = words

    def counted(lengths: range) -> None:
        short = lengths[0] - 1
        sieve = Sieve(frequent[short].select("key"), frequent[short].count())
        made = _stored(_counted(texts, _count_runs(sieve, short, lengths, buckets, names), 2, min_count, names), "frequent")
        tables[lengths[-1]] = made
        frequent.update({k: made.where(F.col("k") == k).drop("k") for k in lengths})

    for length in range(2, depth + 2):
        if length not in frequent:
            counted(range(length, (length if length <= TOGETHER else depth + 1) + 1))
            _free(docs.sparkSession)
        tops = frequent[length - 1].select(F.col("key").alias("prefix"), F.col("c").alias("total"))
        lows = runs.where("live").select(F.col("key").alias("suffix"), F.col("logp").alias("below"))
        met = _stored(frequent[length].join(lows, "suffix").join(tops, "prefix"), "met")
        states = _stored(_states(met), "states")
        runs = _stored(_resolved(met, states), "level")
        discard(met)
        if length - 1 in tables:
            discard(tables.pop(length - 1))
        levels.append(runs)
        tree.longest = length
        tree.states.append(states)
        weights += [runs.where("delta is not null").select("key", "c", F.col("delta").alias("weight")), states.where("retained").select("key", "c", F.col("passed").alias("weight"))]
        del met
        _free(docs.sparkSession)
        if runs.where("live").isEmpty():
            break
    for made in tables.values():
        discard(made)
    if weights:
        tree.weights = _stored(reduce(DataFrame.unionByName, weights).groupBy("key").agg(F.max("c").alias("c"), F.sum("weight").alias("weight")), "weights")
    for made in levels:
        discard(made)
    del frequent, tables, levels, weights, runs
    _free(docs.sparkSession)
    return tree, unigrams


def _buckets(texts: DataFrame) -> int:
    """Enough buckets for the words of texts, at four characters a word at least."""
    return max(BUCKETS, (texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4) // BUCKET_TOKENS)


@contextmanager
def _cleaned(spark: SparkSession):
    """The shuffle files of what runs here go as it ends: a table takes those of several
    joins, and until a collection they would lie beside those of the next table."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _stored(df: DataFrame, name: str) -> DataFrame:
    with _cleaned(df.sparkSession):
        return written(df, name)


def _free(spark: SparkSession) -> None:
    """Lets Spark drop what plans hold that nothing refers to any more: above all the
    tables of a task's function, of which driver and executors have files. Shuffle files
    do not wait for it, see _cleaned."""
    for _ in range(2):  # what the first leaves, as the bridge or the cleaner lags, goes with the second
        gc.collect()
        time.sleep(1.5)  # the bridge to the JVM lets go of objects once a second
        spark.sparkContext._jvm.System.gc()


def _states(met: DataFrame) -> DataFrame:
    """The contexts of runs (prefix, c, total, below): retained or not, what they pass
    on, and whether a longer context could be retained. Its gain is at most that of
    all these followers, and a follower's own probability is what it had to beat."""
    c, total, below, ten = F.col("c"), F.col("total"), F.col("below"), float(np.log(10))
    each = met.groupBy(F.col("prefix").alias("key")).agg(
        F.max("total").alias("c"), F.count("*").alias("kept"), F.sum(2 * c * (F.log(c / total) - below * ten)).alias("gain"), F.sum(c - DISCOUNT).alias("given"),
        F.sum(F.pow(F.lit(10.0), below)).alias("mass"), F.sum(-2 * c * below * ten).alias("unretained"), F.sum(-2 * c * F.log((c - DISCOUNT) / total)).alias("after"),
    )
    left, rest = (F.col("c") - F.col("given")) / F.col("c"), 1 - F.col("mass")
    retained = (F.col("gain") > F.col("kept") + 4 * F.sqrt(2 * F.col("kept"))) & (left > 0) & (rest > 1e-9)
    each = each.withColumn("retained", retained)
    passed = F.when(F.col("retained"), F.log10(left / rest)).otherwise(0.0)
    alive = F.when(F.col("retained"), F.col("after")).otherwise(F.col("unretained")) > 1 + 4 * 2**0.5
    return each.select("key", "c", "retained", passed.alias("passed"), alive.alias("alive"))


def _resolved(met: DataFrame, states: DataFrame) -> DataFrame:
    """Runs with the log10 probability of their last word and what a retained state
    changes in it (delta)."""
    by = states.select(F.col("key").alias("prefix"), "retained", "passed", "alive")
    gives = F.log10((F.col("c") - DISCOUNT) / F.col("total"))
    return met.join(by, "prefix").select(
        "key", "c", F.when(F.col("retained"), gives).otherwise(F.col("below")).alias("logp"),
        F.col("alive").alias("live"), F.when(F.col("retained"), gives - F.col("passed") - F.col("below")).alias("delta"),
    )


def _most(table: DataFrame, bound: int) -> Column:
    """A condition for the rows of the highest counts, at most `bound` of them: those
    from some half power of two on."""
    level = F.floor(2 * F.log2("c"))
    rows = table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # a row for each level, few
    least, taken = 1 << 10, 0
    for r in rows:
        if (taken := taken + r.n) > bound:
            break
        least = r.level
    return level >= least


def _arrays(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    got = table.toArrow()
    keys = got.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column(value).to_numpy().astype(float)[order]


def score(docs: DataFrame, tree: Tree, unigrams: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lookups: int = LOOKUPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all rows.
    The most frequent words and runs, at most `lookups` of each, are looked up beside
    the texts, all others meet their tables by joins."""
    spark = docs.sparkSession
    weights = tree.weights if tree.weights is not None else spark.createDataFrame([], "key long, c long, weight double")
    many_words, many_runs = _most(unigrams, lookups), _most(weights, lookups)
    rare_words, rare_runs = unigrams.where(~many_words), weights.where(~many_runs)
    words, hot = _arrays(unigrams.where(many_words), "c"), _arrays(weights.where(many_runs), "weight")
    all_words, all_runs = rare_words.isEmpty(), rare_runs.isEmpty()
    buckets = max(BUCKETS, tree.n // BUCKET_TOKENS)
    sieves = Sieve(rare_words.select("key"), rare_words.count()), Sieve(weights.select("key"), weights.count())
    _free(spark)
    scoring = _score(tree.n, tree.v, words, hot, sieves, tree.longest, all_words, all_runs, buckets)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    first = _stored(base.mapInArrow(relieved(scoring), _SCORED), "scored")
    _free(spark)
    done = first.where(F.col("kind") == _DOC).select("pid", "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    nothing = [F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("deep")]
    if all_words and all_runs:
        done = done.select("*", *nothing)
    else:
        asks, sums = first.where(F.col("kind") == _ASK), []
        block = "k int, bucket int, keys binary"
        where = F.expr(f"shiftright(shiftrightunsigned(key, 32) * {buckets}L, 32)")
        for wave in range(WAVES):
            least, most = buckets * wave // WAVES, buckets * (wave + 1) // WAVES - 1
            told = rare_words.where(where.between(least, most)).select("key", F.log10(F.col("c") + 1).alias("value")).mapInArrow(_told(1, buckets), block)
            told = told.unionByName(rare_runs.where(where.between(least, most)).select("key", F.col("weight").alias("value")).mapInArrow(_told(2, buckets), block))
            some = asks.where(F.col("bucket").between(least, most))
            both = told.select("k", "bucket", F.lit(-1).alias("pid"), F.lit(-1).alias("seq"), "keys").unionByName(some.select("k", "bucket", "pid", "seq", "keys"))
            answers = both.repartition("k", "bucket").sortWithinPartitions("k", "bucket", "pid").mapInArrow(relieved(_answered), "k int, bucket int, pid int, seq int, data binary")
            places = some.select("k", "bucket", "pid", "seq", F.col("rows").alias("data"), F.lit(1).alias("side"))
            sides = answers.withColumn("side", F.lit(0)).unionByName(places).select("pid", "k", "bucket", "seq", "side", "data")
            gathered = sides.repartition("pid").sortWithinPartitions("pid", "k", "bucket", "seq", "side").mapInArrow(relieved(_gathered), "pid int, row long, more long, gain double, deep double")
            sums.append(_stored(gathered, "sums"))
            del told, some, both, answers, places, sides, gathered
            _free(spark)
        sums = reduce(DataFrame.unionByName, sums).groupBy("pid", "row").agg(*(F.sum(c).alias(c) for c in ("more", "gain", "deep")))
        done = done.join(sums, ["pid", "row"], "left")
    # words looked up have their root score; the others log10(c + 1) from the answers, 0 where unknown
    gain = F.coalesce("gain", F.lit(0.0)) - (F.col("n_tokens") - F.col("n_known")) * float(np.log10(tree.n + tree.v + 1))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(tree.n)).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), (F.col("score") + gain + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )


def crc_modulo(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
