"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i every shingle draws one coordinate and one
value; a coordinate keeps the smallest value of the first round that reached it, so
a set of n shingles fills its sketch after about T ln T / n rounds. Coordinates that
T random rounds leave empty are filled in rounds of their own, which guarantees that
every one fills and that agreement concentrates around the Jaccard similarity.

Documents with equal shingle sets collapse first. Sketches are cut into bands; sets
that share a band form candidate groups (connected components, no pair lists).
Inside a group every link is decided on whole sets with an inverted index. Groups
beyond BLOCK_SHINGLES are cut into blocks: all blocks meet the member with the most
company first, which ties most of a group of copies in linear time; only what it does
not tie meets the other blocks, pair by pair of blocks.

Defined cases: null or empty text, or only white space: no shingles, linked with
nothing, kept. Null doc_id: takes no part, component_id null, kept. Rows that repeat
a doc_id are one document and stay together. Further columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm import texthash
from cubeloom.llm.runtime import Forest, components, relieved, ship, written

T, ROWS, WORDS, PERCENT = 240, 5, 5, 75
BLOCK_SHINGLES = 3_000_000
SLICE = 400  # rows hashed at a time in a worker
HEAD = -1


def _draw(shingles: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    salt = texthash.mix(rounds.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB))
    return texthash.mix(shingles[None, :] ^ salt[:, None])


def sketch(shingles: np.ndarray, t: int = T) -> np.ndarray:
    """t values of 64 bits; equal positions agree with the probability of similarity."""
    low = np.uint64((1 << 48) - 1)
    empty = np.uint64((1 << 64) - 1)
    out = np.full(t, empty, np.uint64)
    done = 0
    step = min(t, math.ceil(1.3 * t * math.log(t) / len(shingles)) + 1)
    while done < t:
        rounds = np.arange(done, min(t, done + step))
        for part in np.array_split(rounds, max(1, len(rounds) * len(shingles) // 2_000_000)):
            h = _draw(shingles, part)
            where = ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
            np.minimum.at(out, where.astype(np.int64).ravel(), ((part.astype(np.uint64)[:, None] << np.uint64(48)) | (h & low & np.uint64((1 << 40) - 1))).ravel())
        done = int(rounds[-1]) + 1
        if not (out == empty).any():
            return out
    for j in np.flatnonzero(out == empty):
        out[j] = (np.uint64(t + j) << np.uint64(48)) | (_draw(shingles, np.array([t + j])).min() & low)
    return out


def _sketched(t: int, rows: int, n_words: int):
    def run(batches):
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            hashes, at = texthash.words(batch.column(1))
            n = len(at) - 1
            size, high, less, bands = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), []
            for d in range(n):
                s = texthash.shingles(hashes[at[d] : at[d + 1]], n_words)
                size[d] = len(s)
                if not len(s):
                    bands.append(None)
                    continue
                with np.errstate(over="ignore"):
                    high[d] = texthash.mix(s + np.uint64(1)).sum(dtype=np.uint64)
                    less[d] = texthash.mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
                k = sketch(s, t).reshape(-1, rows)
                total = np.arange(len(k), dtype=np.uint64)
                for c in range(rows):
                    total = texthash.mix(total * np.uint64(0x9FB21C651E98DF25) + k[:, c])
                bands.append(total.view(np.int64))
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(size), pa.array(high.view(np.int64)), pa.array(less.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "h1", "h2", "bands"],
            )

    return run


def links(ids: list[int], block: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of all pairs with 100 * common >= percent * union; with two
    blocks, of the pairs between them; with a block HEAD, of the pairs with its one
    set. Exact: every pair of sets that ends in different trees has been compared on
    whole sets."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    posting, begin = owner[order], np.concatenate(([0], np.cumsum(df)))
    first = np.concatenate(([0], np.cumsum(sizes)))
    shared = df > 1
    central = np.add.reduceat(np.where(shared, df, 0)[inverse], first[:-1])
    forest, found, member = Forest(), [], np.arange(n)
    between = len(set(block.tolist())) > 1

    def compare(i: int) -> None:
        mine = inverse[first[i] : first[i + 1]]
        mine = mine[shared[mine]]
        if not len(mine):
            return
        common = np.bincount(np.concatenate([posting[begin[v] : begin[v + 1]] for v in mine.tolist()]), minlength=n)
        ok = 100 * common >= percent * (sizes + sizes[i] - common)
        ok[i] = False
        if between:
            ok &= block != block[i]
        for j in np.flatnonzero(ok).tolist():
            if forest.join(i, j):
                found.append((ids[i], ids[j]))

    if (heads := np.flatnonzero(block == HEAD)).size:
        compare(int(heads[0]))
        return found
    done = np.zeros(n, bool)
    for i in np.argsort(-central, kind="stable")[:1].tolist():
        compare(i)
        done[i] = True
    roots = [forest.find(i) for i in range(n)]
    largest = Counter(roots).most_common(1)[0][0]
    # Pairs inside the largest tree need no test, all others have an end outside it.
    for i in (i for i in range(n) if roots[i] != largest and not done[i]):
        compare(i)
    return found


def _verify(n_words: int, percent: int):
    def of(rows):
        ids, block, texts = zip(*rows)
        hashes, at = texthash.words(pa.array(texts, pa.large_string()))
        sets = [texthash.shingles(hashes[at[d] : at[d + 1]], n_words) for d in range(len(ids))]
        return links(list(ids), np.array(block), sets, percent)

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for g, i, j, doc, block, text in zip(*cols):
                if (g, i, j) != key:
                    if len(rows) > 1:
                        out += of(rows)
                    key, rows = (g, i, j), []
                rows.append((doc, block, text))
            if len(out) > 20_000:
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
                out = []
        if len(rows) > 1:
            out += of(rows)
        yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = PERCENT, t: int = T, rows: int = ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = written(base.mapInArrow(relieved(_sketched(t, rows, n_words)), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "sketches")
    live = made.where("n_shingles > 0 and doc_id is not null")
    key = ["h1", "h2", "n_shingles"]
    # Written before it is joined: the join can then split a class of very many copies.
    reps = written(live.groupBy(*key).agg(F.min("doc_id").alias("rep")), "reps")
    classes = written(live.select("doc_id", *key).join(reps, key).select("doc_id", "n_shingles", "rep"), "classes")
    repeated = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    heads = classes.where("doc_id = rep").select("doc_id").distinct()

    banded = live.join(heads, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last"), F.count("*").alias("c")).where("b <> last").select("band", "b", "c")
    near = banded.join(shared, "band").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    groups = components(near)
    inside = written(groups.select(F.col("a").alias("doc_id"), F.col("b").alias("grp")).unionByName(groups.select(F.col("b").alias("doc_id"), F.col("b").alias("grp")).distinct()), "groups")

    weights = classes.where("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    blocks = inside.join(weights, "doc_id").groupBy("grp").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("nb"))
    placed = inside.join(blocks, "grp").select("doc_id", "grp", "nb", F.pmod(F.xxhash64("doc_id"), F.col("nb").cast("long")).cast("int").alias("block"))
    verify = relieved(_verify(n_words, percent))

    def decided(cells: DataFrame) -> DataFrame:
        full = cells.hint("merge").join(base, "doc_id").select("grp", "i", "j", "doc_id", "block", "text")  # members grow with the table
        return full.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(verify, "a long, b long")

    whole = placed.where("nb = 1").selectExpr("grp", "0 as i", "0 as j", "doc_id", "block")
    if blocks.where("nb > 1").isEmpty():
        found = decided(whole)
    else:
        # Large groups: everything meets the member with the most company first; what
        # it links needs no test among itself. The rest, cut into blocks of its own,
        # meets itself and what was linked, block by block.
        large = placed.where("nb > 1")
        company = banded.join(large, "doc_id", "left_semi").join(shared, "band").groupBy("doc_id").agg(F.sum("c").alias("c"))
        heads = large.join(company, "doc_id").groupBy("grp").agg(F.max_by("doc_id", F.struct("c", -F.col("doc_id"))).alias("head"), F.max("nb").alias("nb"))
        led = large.join(heads.select("grp", "head"), "grp").where("doc_id <> head")
        star = led.selectExpr("grp", "block as i", "-1 as j", "doc_id", "block").unionByName(heads.select("grp", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.lit(-1).alias("j"), F.col("head").alias("doc_id"), F.lit(HEAD).alias("block")))
        first = written(decided(star), "star")
        tied = first.select(F.col("b").alias("doc_id")).unionByName(first.select(F.col("a").alias("doc_id"))).distinct()
        rest = led.join(tied, "doc_id", "left_anti")
        parts = rest.join(weights, "doc_id").groupBy("grp").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("nu"))
        rest = written(rest.join(parts, "grp").select("grp", "doc_id", "nb", "nu", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("nu").cast("long")).cast("int").alias("u")), "rest")
        linked = large.join(tied, "doc_id", "left_semi").join(parts, "grp")
        among = rest.select("grp", "doc_id", "u", F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("o")).select("grp", F.least("u", "o").alias("i"), F.greatest("u", "o").alias("j"), "doc_id", F.col("u").alias("block"))
        one = rest.select("grp", F.col("u").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), "doc_id").selectExpr("grp", "i", f"{1 << 30} + b as j", "doc_id", "0 as block")
        other = linked.select("grp", F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("i"), "block", "doc_id").selectExpr("grp", "i", f"{1 << 30} + block as j", "doc_id", "1 as block")
        cells = whole.unionByName(among).unionByName(one).unionByName(other)
        found = decided(cells).unionByName(first)
    roots = components(found.unionByName(repeated)).select(F.col("a").alias("rep"), F.col("b").alias("root"))

    placed = classes.join(roots, "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    rest = made.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
