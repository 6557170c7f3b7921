"""A content-addressed store of token ids.

A rolling hash of the last SPAN ids cuts every document's ids into chunks of MIN to
MAX ids, so equal passages give equal chunks wherever they stand. A chunk is stored
once, under its digest. A document is a recipe, the list of its chunks' digests, with
a Merkle root over them; recipes lie in ascending doc_id order with the position of
the document's first id in the whole stream; the manifest has, for each file of
recipes, the root over its documents and its range of ids.

    chunks/kind=chunk   digest, payload (ids as little-endian unsigned 16 bits), n
    recipes             doc_id, pid, local_start, n_tokens, recipe, root
    manifest            pid, first_id, last_id, docs, ids, base, root
    store               root, over the rows of the manifest

Reading checks every payload against its digest, every recipe against its root and
length, every manifest row against its recipes and the manifest against the store's
root; a difference, or a row or file that is gone, is an error.

Defined cases: null and empty texts are the end id alone. Null doc_ids come before
all others. Rows that repeat a doc_id are stored one by one, ordered by root. An
empty table gives an empty store. Further columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.runtime import relieved, ship
from cubeloom.llm.texthash import mix

SPAN, MIN, MAX, MASK, DIGEST = 16, 64, 2048, 0xFF, 16
_GEAR = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))


def cuts(ids: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each document ids[at[d]:at[d+1]], the ends of its chunks. A cut is never
    closer than MIN to the last one, so no hash spans two documents."""
    total = np.zeros(len(ids), np.uint64)
    g = _GEAR[ids]
    for k in range(min(SPAN, len(ids))):
        total[k:] += g[: len(ids) - k] << np.uint64(k)
    marks = np.flatnonzero((total >> np.uint64(20)) & np.uint64(MASK) == 0) + 1
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        own, last, ends = marks[np.searchsorted(marks, lo + MIN) : np.searchsorted(marks, hi)].tolist(), lo, []
        for m in own + [hi]:
            while m - last > MAX:
                last += MAX
                ends.append(last)
            if m - last >= MIN or m == hi:
                ends.append(m)
                last = m
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; leaves and inner nodes hash apart, an odd node moves up."""
    row = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves]
    while len(row) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=DIGEST).digest() for a, b in zip(row[::2], row[1::2])]
        row = pairs + row[2 * len(pairs) :]
    return row[0] if row else b""


class Forest:
    """merkle() of leaves that come one by one: holds one finished tree for each size."""

    def __init__(self) -> None:
        self.trees: list[tuple[int, bytes]] = []  # (height, root), heights descending

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.blake2b(b"\0" + leaf, digest_size=DIGEST).digest()
        while self.trees and self.trees[-1][0] == height:
            node = hashlib.blake2b(b"\1" + self.trees.pop()[1] + node, digest_size=DIGEST).digest()
            height += 1
        self.trees.append((height, node))

    def root(self) -> bytes:
        """A smaller tree at the end moves up until it meets a larger one."""
        trees = [node for _, node in self.trees]
        while len(trees) > 1:
            right = trees.pop()
            trees[-1] = hashlib.blake2b(b"\1" + trees[-1] + right, digest_size=DIGEST).digest()
        return trees[0] if trees else b""


_STAGE = "kind string, digest binary, payload binary, n int, doc_id long, recipe binary, root binary"


def _chunked(encoder, end_id: int):
    def run(batches):
        encode = encoder().encode
        pid, seen, row = TaskContext.get().partitionId(), set(), 0
        parts = ((b.column(0).slice(k, len(at) - 1), ids, at) for whole in batches for b in (whole.slice(x, 4000) for x in range(0, whole.num_rows, 4000)) for k, ids, at in encode([t or "" for t in b.column(1).to_pylist()]))
        for docs, own, ends_at in ((d.slice(k, 500), i, at[k : k + 501]) for d, i, at in parts for k in range(0, len(d), 500)):
            at = ends_at - ends_at[0] + np.arange(len(ends_at))
            ids = np.insert(own[ends_at[0] : ends_at[-1]], ends_at[1:] - ends_at[0], end_id)
            flat = ids.tobytes()
            out: list[tuple] = []
            for doc, lo, ends in zip(docs.to_pylist(), at.tolist(), cuts(ids, at)):
                last, digests = lo, []
                for e in ends:
                    payload = flat[2 * last : 2 * e]
                    digest = hashlib.blake2b(payload, digest_size=DIGEST).digest()
                    digests.append(digest)
                    if digest not in seen:  # once for each task; the window drops the rest
                        seen.add(digest)
                        out.append(("chunk", digest, payload, e - last, None, None, None))
                    last = e
                out.append(("doc", (pid << 40 | row).to_bytes(8, "little"), None, ends[-1] - lo, doc, b"".join(digests), merkle(digests)))
                row += 1
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["kind", "digest", "payload", "n", "doc_id", "recipe", "root"])

    return run


def _numbered(batches):
    pid, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy().astype(np.int64)
        start = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.record_batch([batch.column(0), pa.array(np.full(len(n), pid, np.int32)), pa.array(start), pa.array(n), batch.column(2), batch.column(3)], names=["doc_id", "pid", "local_start", "n_tokens", "recipe", "root"])


def _sealed(batches):
    """The manifest row of each file of recipes (pid, doc_id, n, root; by position): the
    Merkle root over its documents' roots."""
    pid, first, last, docs, ids, tree = -1, None, None, 0, 0, Forest()
    for batch in batches:
        for p, doc, n, root in zip(*(c.to_pylist() for c in batch.columns)):
            if p != pid and pid >= 0:
                yield _seal(pid, first, last, docs, ids, tree)
                docs, ids, tree, first = 0, 0, Forest(), None
            pid, first, last, docs, ids = p, doc if first is None else first, doc, docs + 1, ids + n
            tree.add(root)
    if pid >= 0:
        yield _seal(pid, first, last, docs, ids, tree)


def _seal(pid, first, last, docs, ids, tree):
    values = ((pid, pa.int32()), (first, pa.int64()), (last, pa.int64()), (docs, pa.int64()), (ids, pa.int64()), (tree.root(), pa.binary()))
    return pa.record_batch([pa.array([v], k) for v, k in values], names=["pid", "first_id", "last_id", "docs", "ids", "root"])


_SEAL = "pid int, first_id long, last_id long, docs long, ids long, root binary"


def write(docs: DataFrame, path: str, encoder, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of docs under path. encoder() gives, in a worker, a
    pieces.Cutter with 16-bit ids."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    staged = base.mapInArrow(relieved(_chunked(encoder, end_id)), _STAGE)
    dealt = staged.repartition("kind", "digest")  # so that rows are sorted once, after they moved
    once = dealt.selectExpr("*", "row_number() over (partition by kind, digest order by n) as copy").where("copy = 1").drop("copy")
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/chunks")
    rows = spark.read.schema(_STAGE).parquet(f"{path}/chunks").where("kind = 'doc'").select("doc_id", "n", "recipe", "root")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root")
    numbered = ordered.mapInArrow(_numbered, "doc_id long, pid int, local_start long, n_tokens long, recipe binary, root binary")
    numbered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    seals = _seals(spark, path)
    manifest = seals.selectExpr("*", "coalesce(sum(ids) over (order by pid rows between unbounded preceding and 1 preceding), 0) as base")
    manifest.write.parquet(f"{path}/manifest")  # a row for each file of recipes
    spark.createDataFrame([(_store_root(spark, path),)], "root binary").coalesce(1).write.parquet(f"{path}/store")


def _seals(spark: SparkSession, path: str) -> DataFrame:
    rows = _recipes(spark, path).select("pid", "local_start", "doc_id", "n_tokens", "root")
    return rows.repartition("pid").sortWithinPartitions("pid", "local_start").select("pid", "doc_id", "n_tokens", "root").mapInArrow(_sealed, _SEAL)


def _store_root(spark: SparkSession, path: str) -> bytes:
    """The Merkle root over the manifest, a row for each file of recipes."""
    tree = Forest()
    rows = spark.read.schema(_SEAL + ", base long").parquet(f"{path}/manifest").orderBy("pid").select("pid", "docs", "ids", "base", "root")
    for pid, docs, ids, base, root in rows.toLocalIterator():
        tree.add(b"%d %d %d %d " % (pid, docs, ids, base) + bytes(root))
    return tree.root()


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, pid int, local_start long, n_tokens long, recipe binary, root binary").parquet(f"{path}/recipes")


def _checked(batches):
    for batch in batches:
        digests, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for d, p in zip(digests, payloads):
            if hashlib.blake2b(p, digest_size=DIGEST).digest() != d:
                raise ValueError(f"chunk {d.hex()} does not match its digest")
        crc = [zlib.crc32(np.frombuffer(p, "<u2").astype("<u4").tobytes()) for p in payloads]
        yield pa.record_batch([batch.column(0), pa.array(crc, pa.int64()), pa.array([len(p) // 2 for p in payloads], pa.int64())], names=["digest", "crc", "n"])


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of crc32, bit-reversed as zlib has them."""
    out, a, b = np.zeros_like(b), a.copy(), b.copy()
    for _ in range(32):
        out ^= np.where(a & np.uint64(0x80000000), b, np.uint64(0))
        a = (a << np.uint64(1)) & np.uint64(0xFFFFFFFF)
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ _POLY, b >> np.uint64(1))
    return out


@lru_cache(1)
def _steps() -> np.ndarray:
    """[k, j, b]: byte j with value b of a crc32 after 2^k more bytes (they add up by XOR)."""
    power, out = np.array([0x00800000], np.uint64), np.empty((48, 4, 256), np.uint64)  # x^8
    bytes_at = (np.arange(256, dtype=np.uint64)[None, :] << (np.arange(4, dtype=np.uint64) * np.uint64(8))[:, None]).ravel()
    for k in range(len(out)):
        out[k] = _times(np.broadcast_to(power, 1024).copy(), bytes_at).reshape(4, 256)
        power = _times(power, power)
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The share of a part's crc32 in that of a whole with n_bytes after the part."""
    out, n = crc.astype(np.uint64), n_bytes.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        v, t = out[at].astype(np.int64), _steps()[k]
        out[at] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return out


def _joined(batches):
    """Rows (pid, local_start, parts) to (pid, local_start, crc, n, root)."""
    for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
        if not batch.num_rows:
            continue
        size = batch.column(2).value_lengths().to_numpy()
        parts = batch.column(2).flatten()
        order = np.lexsort((parts.field("pos").to_numpy(), np.repeat(np.arange(len(size)), size)))
        n = parts.field("n").to_numpy()[order]
        first = np.cumsum(size) - size
        total = np.add.reduceat(n, first)
        after = np.repeat(np.cumsum(total), size) - np.cumsum(n)
        crc = np.bitwise_xor.reduceat(shifted(parts.field("crc").to_numpy()[order], 4 * after), first)
        digests = parts.field("digest").take(pa.array(order)).to_pylist()
        root = [merkle(digests[a : a + k]) for a, k in zip(first.tolist(), size.tolist())]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(crc.astype(np.int64)), pa.array(total), pa.array(root, pa.binary())], names=["pid", "local_start", "ids_crc32", "read_tokens", "read_root"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files.
    The crc32 of a document is put together from those of its chunks, so payloads
    do not move."""
    ship(spark)
    chunks = spark.read.schema(_STAGE).parquet(f"{path}/chunks").where("kind = 'chunk'").select("digest", "payload").mapInArrow(relieved(_checked), "digest binary, crc long, n long")
    recipes = _recipes(spark, path)
    said = spark.read.schema(_SEAL + ", base long").parquet(f"{path}/manifest")
    if bytes(spark.read.schema("root binary").parquet(f"{path}/store").first()[0]) != _store_root(spark, path):
        raise ValueError("the manifest does not match the store's root")
    read_again = _seals(spark, path).select("pid", F.col("root").alias("read"), F.col("ids").alias("read_ids"), F.col("docs").alias("read_docs"))
    same = (F.col("root") == F.col("read")) & (F.col("ids") == F.col("read_ids")) & (F.col("docs") == F.col("read_docs"))
    base = said.join(read_again, "pid", "full").select("pid", F.when(F.coalesce(same, F.lit(False)), F.col("base")).otherwise(F.raise_error(F.lit("recipes do not match the manifest"))).alias("base"))
    digests = F.transform(F.sequence(F.lit(0), (F.length("recipe") / DIGEST).cast("int") - 1), lambda k: F.substring("recipe", k * DIGEST + 1, DIGEST))
    parts = recipes.select("pid", "local_start", F.posexplode(digests).alias("pos", "digest")).join(chunks, "digest", "left")
    whole = parts.groupBy("pid", "local_start").agg(F.collect_list(F.struct("pos", "digest", "crc", "n")).alias("parts"))
    made = whole.mapInArrow(relieved(_joined), "pid int, local_start long, ids_crc32 long, read_tokens long, read_root binary")
    full = recipes.select("doc_id", "pid", "local_start", "n_tokens", "root").join(made, ["pid", "local_start"], "left").join(base, "pid", "left")
    right = (F.col("root") == F.col("read_root")) & (F.col("n_tokens") == F.col("read_tokens"))
    return full.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", F.when(right, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document does not match its recipe"))).alias("ids_crc32"))


def store(docs: DataFrame, path: str, encoder, end_id: int) -> DataFrame:
    """write() and read()."""
    write(docs, path, encoder, end_id)
    return read(docs.sparkSession, path)
