"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Coarse centres come from k-means over a bounded sample (SAMPLE rows with the smallest
hash of their id) and every vector is dealt to the list of its nearest centre. There are
about as many lists as the square root of the number of vectors, up to one for every
PER_CENTRE vectors of the sample. Lists are cut into blocks of at most twice the usual
list, and of BLOCK vectors at least, so no task holds a long list. Queries
probe the lists of their nearest centres. In a block vectors stand rotated by a fixed
random orthogonal matrix, in column blocks of WIDTH dimensions: after each column
block a hypothesis test on the partial distance (at d of D dimensions the full
distance is estimated as D / d times the partial one, with relative error EPSILON /
sqrt(d)) abandons candidates that are farther than the query's current K-th best in the
block, which is measured anew after every column block on the candidates that look nearest.
Survivors are measured on their original vectors in double precision.

How many lists to probe is fitted as well: the smallest number for which brute force
over the sample finds TARGET of all true neighbours of up to TRIALS sample queries.

Defined cases: vectors that are null, zero, or hold null or non-finite components or
another number of components than most of the sample take no part. Ids that are null
take no part. Rows that repeat an id are one candidate each; a query's own id is
never its neighbour. Fewer candidates than k: all of them. Further columns do not
matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.runtime import ship, written

SAMPLE, PER_CENTRE, BLOCK, WIDTH, EPSILON, TARGET, TRIALS = 20_000, 8, 512, 16, 4.0, 0.97, 200


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of every q to every x."""
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)


class Index:
    """centres (lists x D), rotation (D x D), probes."""

    def __init__(self, sample: np.ndarray, k: int, lists: int, target: float = TARGET, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        lists = max(1, min(lists, n // PER_CENTRE))
        self.centres = sample[rng.choice(n, lists, replace=False)]
        for _ in range(10):
            at = self.assign(sample)
            size = np.bincount(at, minlength=lists)
            total = np.zeros((lists, d))
            np.add.at(total, at, sample)
            self.centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], self.centres)
        at = self.assign(sample)
        tried = sample[:: max(1, n // TRIALS)]
        near = np.argsort(distances(tried, sample), axis=1, kind="stable")[:, 1 : k + 1]
        rank = np.argsort(np.argsort(distances(tried, self.centres), axis=1), axis=1)
        depth = np.sort(rank[np.arange(len(tried))[:, None], at[near]].ravel())
        self.probes = int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))))]) + 1 if len(depth) else lists

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([distances(x[k : k + 2048], self.centres).argmin(1) for k in range(0, max(1, len(x)), 2048)])

    def probe(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(distances(q, self.centres), axis=1, kind="stable")[:, : self.probes]


def scan(query: np.ndarray, rotated_query: np.ndarray, ids: np.ndarray, x: np.ndarray, columns: list[np.ndarray], k: int, own: int, width: int = WIDTH, epsilon: float = EPSILON) -> list[tuple[float, int]]:
    """The k nearest of a block to one query as (distance, id), ties to smaller ids."""
    alive = np.flatnonzero(ids != own)
    if not len(alive):
        return []
    best, total, d = np.inf, x.shape[1], 0
    partial, heads = np.zeros(len(alive)), [alive[:0]]
    for c in columns:
        step = c[alive] - rotated_query[d : d + c.shape[1]]
        partial = partial + np.einsum("ij,ij->i", step, step)
        d += c.shape[1]
        if len(alive) > k:
            head = alive[np.argpartition(partial, k - 1)[:k]]
            heads.append(head)
            best = min(best, ((x[head] - query) ** 2).sum(1).max())
        slack = (1 + epsilon / np.sqrt(d)) ** 2 if d < total else 1 + 1e-9
        keep = partial * (total / d) <= best * slack + 1e-300
        alive, partial = alive[keep], partial[keep]
    alive = np.union1d(alive, np.concatenate(heads))
    exact = np.sqrt(((x[alive] - query) ** 2).sum(1))
    order = np.lexsort((ids[alive], exact))[:k]
    return [(float(exact[o]), int(ids[alive[o]])) for o in order]


def _valid(width: int | None, vector: str) -> Column:
    v = F.col(vector)
    ok = v.isNotNull() & F.expr(f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & F.expr(f"exists({vector}, x -> x <> 0)")
    return ok & (F.size(v) == width) if width else ok


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, lists: int | None = None, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of every row for which `queries`,
    a condition on vec_id, holds. All rows are indexed."""
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _valid(None, "v"))
    schema = "query_id long, rank int, vec_id long, score double"
    n = base.count()
    share = max(1, min(1 << 20, int(1.5 * sample / max(n, 1) * (1 << 20))))  # few more than the sample are sorted
    drawn = base.where(F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 44) < share)
    rows = drawn.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").toArrow().column("v").to_pylist()  # the bound of the sample
    if not rows:
        return spark.createDataFrame([], schema)
    sizes = [len(r) for r in rows]
    width = max(set(sizes), key=sizes.count)
    index = Index(np.array([r for r in rows if len(r) == width]), k, lists or int(n**0.5))
    block = block or max(BLOCK, 2 * n // len(index.centres))

    def deal(batches):
        for batch in batches:
            ids, x = batch.column(0), _matrix(batch.column(1), width)
            yield pa.record_batch([ids, batch.column(1), pa.array(index.assign(x) if len(x) else [], pa.int32())], names=["vec_id", "v", "list"])

    def ask(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            p = index.probe(x) if len(x) else np.zeros((0, 1), int)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(p), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    good = base.where(F.size("v") == width)
    dealt = written(good.mapInArrow(deal, "vec_id long, v array<double>, list int"), "lists")
    blocks = dealt.groupBy("list").agg(F.ceil(F.count("*") / block).alias("blocks"))  # a row for each list
    placed = dealt.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "v")
    asked = good.where(queries).mapInArrow(ask, "query_id long, q array<double>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list"))
    asked = asked.join(F.broadcast(blocks), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), F.lit(1).alias("side"), F.col("query_id").alias("vec_id"), F.col("q").alias("v"))
    both = placed.unionByName(asked).repartition("list", "block").sortWithinPartitions("list", "block", "side", "vec_id")

    def run(batches):
        key, ids, vecs, built, out = None, [], [], None, []
        for batch in batches:
            matrix = _matrix(batch.column(4), width)
            for at, (lst, blk, side, i) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if (lst, blk) != key:
                    key, ids, vecs, built = (lst, blk), [], [], None
                if side == 0:
                    ids.append(i)
                    vecs.append(matrix[at])
                    continue
                if not ids:
                    continue
                if built is None:
                    x = np.array(vecs)
                    turned = x @ index.rotation
                    built = (np.array(ids), x, [np.ascontiguousarray(turned[:, c : c + WIDTH]) for c in range(0, width, WIDTH)])
                q = matrix[at]
                out += [(i, j, s) for s, j in scan(q, q @ index.rotation, *built, k, i)]
            if len(out) > 50_000:
                yield _found(out)
                out = []
        yield _found(out)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score, vec_id) as int) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width) if len(column) else np.zeros((0, width))


def _found(out):
    q, i, s = zip(*out) if out else ((), (), ())
    return pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])
