"""Percentiles of spectra and images: exact, sketched, and by the P2 recurrence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.cube import Cube
from cubeloom.shipping import ship


def steps(b: int) -> list[float]:
    return [k / b for k in range(b + 1)]


def exact(cube: Cube, over: list[str], b: int = 4) -> DataFrame:
    """b + 1 percentiles of all cells of the other dimensions, absent cells as zeros:
    a row of weight N - n stands for them, so nothing is densified."""
    keep = [d for d in cube.dims if d not in over]
    cells = 1
    for d in over:
        cells *= cube.size(d)
    value = F.col(cube.value).cast("double")
    weighted = cube.df.select(*keep, value.alias("v"), F.lit(1).cast("long").alias("w"))
    absent = cube.df.groupBy(*keep).agg((F.lit(cells).cast("long") - F.count("*")).alias("w")).where("w > 0").select(*keep, F.lit(0.0).alias("v"), "w")
    q = F.expr(f"percentile(v, array({', '.join(map(str, steps(b)))}), w)")
    return weighted.unionByName(absent).groupBy(*keep).agg(q.alias("percentiles"))


def sketched(cube: Cube, over: list[str], b: int = 4, accuracy: int = 10_000) -> DataFrame:
    """The same of stored cells, approximate with a mergeable sketch."""
    keep = [d for d in cube.dims if d not in over]
    return cube.df.groupBy(*keep).agg(F.percentile_approx(F.col(cube.value).cast("double"), steps(b), accuracy).alias("percentiles"))


class P2:
    """The P-squared algorithm of Jain and Chlamtac (1985) for b equal cells, over an
    array of independent streams at once. State: heights, positions, samples seen."""

    def __init__(self, b: int = 4, shape: tuple[int, ...] = (), state: tuple | None = None):
        self.b, self.shape = b, shape
        self.heights = np.zeros((b + 1, *shape))
        self.places = np.broadcast_to(np.arange(b + 1.0).reshape(-1, *[1] * len(shape)), self.heights.shape).copy()
        self.seen = 0
        if state is not None:
            self.heights, self.places, self.seen = np.array(state[0], float), np.array(state[1], float), int(state[2])

    def state(self) -> tuple[list, list, int]:
        return self.heights.tolist(), self.places.tolist(), self.seen

    def add(self, x) -> None:
        x = np.asarray(x, float)
        b, q, n = self.b, self.heights, self.places
        if self.seen <= b:
            q[self.seen] = x
            self.seen += 1
            if self.seen == b + 1:
                q.sort(axis=0)
            return
        q[0], q[b] = np.minimum(q[0], x), np.maximum(q[b], x)
        n += x < q
        n[0], n[b] = 0, self.seen
        wanted = (np.arange(b + 1.0) * self.seen / b).reshape(-1, *[1] * len(self.shape))
        lag = (wanted - n)[1:-1]
        above, below = n[2:] - n[1:-1], n[1:-1] - n[:-2]
        move = np.where((lag >= 1) & (above > 1), 1.0, np.where((lag <= -1) & (below > 1), -1.0, 0.0))
        rise, fall = q[2:] - q[1:-1], q[1:-1] - q[:-2]
        with np.errstate(divide="ignore", invalid="ignore"):
            curve = q[1:-1] + move / (above + below) * ((below + move) * rise / above + (above - move) * fall / below)
            line = q[1:-1] + np.where(move > 0, rise / above, -fall / below)
        new = np.where((q[:-2] < curve) & (curve < q[2:]), curve, line)
        q[1:-1] = np.where(move != 0, new, q[1:-1])
        n[1:-1] += move
        self.seen += 1

    def percentiles(self) -> np.ndarray:
        """b + 1 heights; before there are as many samples, exact percentiles."""
        if self.seen == 0:
            return np.full_like(self.heights, np.nan)
        if self.seen <= self.b:
            return np.percentile(self.heights[: self.seen], np.linspace(0, 100, self.b + 1), axis=0)
        return self.heights.copy()


def p2(df: DataFrame, keys: list[str], order: list[str], value: str, b: int = 4) -> DataFrame:
    """P2 percentiles of each group's values in order. The recurrence depends on the
    order and does not merge, so a group is one task; it streams through constant
    state; groups that a batch holds whole advance together. Use sketched() where
    groups are large."""
    ship(df.sparkSession)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def run(batches):
        key, state = None, None
        for pdf in batches:
            columns, v = [pdf[c] for c in keys], pdf[value].to_numpy(float)
            change = np.arange(len(pdf)) == 0
            for c in columns:
                change[1:] |= c.to_numpy()[1:] != c.to_numpy()[:-1]
            starts = np.append(np.flatnonzero(change), len(pdf))
            sizes = np.diff(starts)
            inner = starts[1:-2]  # groups that begin and end in this batch
            for size in np.unique(sizes[1:-1]):
                of = inner[sizes[1:-1] == size]
                many = P2(b, (len(of),))
                for row in v[of + np.arange(size)[:, None]]:
                    many.add(row)
                yield pd.DataFrame({**{k: c.iloc[of].to_numpy() for k, c in zip(keys, columns)}, "percentiles": many.percentiles().T.tolist()})
            for k in sorted({0, len(sizes) - 1}) if len(pdf) else ():
                own = tuple(c.iloc[starts[k]] for c in columns)
                if own != key:
                    if state is not None:
                        yield _row(keys, key, state)
                    key, state = own, P2(b)
                for x in v[starts[k] : starts[k + 1]]:
                    state.add(x)
        if state is not None:
            yield _row(keys, key, state)

    ordered = df.select(*dict.fromkeys([*keys, *order, value])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, f"{fields}, percentiles array<double>")


def _row(keys, key, state):
    return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "percentiles": [state.percentiles().tolist()]})


def min_max(df: DataFrame, value: str, keys: list[str], ticks: int = 6) -> DataFrame:
    """min, max and evenly spaced ticks of each image."""
    made = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return made.withColumn("ticks", F.transform(F.sequence(F.lit(0), F.lit(ticks - 1)), lambda k: F.col("min") + (F.col("max") - F.col("min")) * k / F.lit(float(ticks - 1))))
