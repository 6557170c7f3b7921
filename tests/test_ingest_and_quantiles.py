import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubeloom.cube import Cube
from cubeloom.operators import ingest, quantiles

#: The sample of the P-squared paper (Jain and Chlamtac, 1985) and its quartile markers.
PAPER = [0.02, 0.15, 0.74, 3.39, 0.83, 22.37, 10.15, 15.43, 38.62, 15.92, 34.60, 10.28, 1.47, 0.40, 0.05, 11.39, 0.27, 0.42, 0.09, 11.37]


def test_paper():
    p = quantiles.P2(4)
    for x in PAPER:
        p.add(x)
    assert np.allclose(p.percentiles(), [0.02, 0.5232, 4.402, 11.29, 38.62], rtol=1e-3)


def test_streams_side_by_side_and_few_samples():
    one, many = quantiles.P2(4), quantiles.P2(4, (2, 3))
    for x in PAPER:
        one.add(x)
        many.add(np.full((2, 3), x))
    assert np.allclose(many.percentiles(), one.percentiles()[:, None, None])
    few = quantiles.P2(2)
    few.add(1.0)
    few.add(3.0)
    assert few.percentiles().tolist() == [1.0, 2.0, 3.0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=6, max_size=200))
def test_ordered_and_bounded(values):
    p = quantiles.P2(4)
    for x in values:
        p.add(x)
    got = p.percentiles()
    assert got[0] == min(values) and got[-1] == max(values) and (np.diff(got) >= -1e-9).all()


def test_p2_of_groups(spark):
    df = spark.createDataFrame([(g, i, x) for g in (1, 2) for i, x in enumerate(PAPER)], "g int, i int, v double")
    got = quantiles.p2(df, ["g"], ["i"], "v").collect()
    assert len(got) == 2 and all(np.allclose(r.percentiles, [0.02, 0.5232, 4.402, 11.29, 38.62], rtol=1e-3) for r in got)


def test_p2_of_groups_of_many_sizes(spark):
    rng = np.random.default_rng(6)
    groups = {g: rng.normal(size=rng.choice([1, 4, 5, 9, 64])) for g in range(300)} | {300: rng.normal(size=25_000)}
    df = spark.createDataFrame([(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)], "g int, i int, v double")
    got = {r.g: r.percentiles for r in quantiles.p2(df, ["g"], ["i"], "v").collect()}
    assert len(got) == 301
    for g, v in groups.items():
        p = quantiles.P2(4)
        for x in v:
            p.add(x)
        assert got[g] == pytest.approx(p.percentiles())


def test_exact_counts_absent_cells(spark):
    rng = np.random.default_rng(5)
    block = rng.integers(0, 4, (3, 7, 9)) * rng.integers(0, 50, (3, 7, 9))
    rows = [(*map(int, c), int(block[c])) for c in zip(*np.nonzero(block))]
    cube = Cube(spark.createDataFrame(rows, "l int, x int, mz int, signal long"), ("l", "x", "mz"), block.shape)
    got = {r.l: r.percentiles for r in quantiles.exact(cube, ["x", "mz"]).collect()}
    for k in range(3):
        assert np.allclose(got[k], np.percentile(block[k], [0, 25, 50, 75, 100]))


def test_bins_match_search(spark):
    edges = [0.0, 1.0, 2.0, 4.0, 8.0, 16.0]
    values = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.9, 4.0, 7.0, 8.0, 9.0, 99.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(ingest.bin_left(F.col("v"), edges)).collect()]
    assert got == np.searchsorted(edges[:-2], values).tolist()
    even = [float(k) for k in range(6)]
    pairs = df.select(ingest.bin_left(F.col("v"), even), ingest.bin_uniform(F.col("v"), even)).collect()
    assert all(a == b for a, b in pairs)


def test_merge(spark):
    df = spark.createDataFrame([(0, 1, 5, 2.0), (0, 1, 7, 1.0), (1, 1, 1, 3.0)], "x int, y int, signal short, exact double")
    got = {(r.x, r.y): (r.signal, r.exact, r.n) for r in ingest.merge_duplicates(df, ["x", "y"], count="n").collect()}
    assert got == {(0, 1): (12, 2.0, 2), (1, 1): (1, 3.0, 1)}
    with pytest.raises(KeyError):
        ingest.merge_duplicates(df, ["x", "y"], {"exact": "median"})
    with pytest.raises(IndexError):
        ingest.check_sparse(["x"], {"z": "z_exact"}, ["z_exact"])
    with pytest.raises(ValueError):
        ingest.check_sparse(["x"], {"x": "x_exact"}, [])


def test_accumulations_validate(spark):
    cube = Cube(spark.createDataFrame([(0, 0, 1)], "x int, mz int, signal int"), ("x", "mz"), (1, 1))
    for named in ({"": ("x",)}, {"a": ("z",)}, {"a": ("x",), "b": ("x",)}):
        with pytest.raises(ValueError):
            ingest.accumulations(cube, named)


@pytest.mark.parametrize("many", [3, 200, 1000])
def test_bins_by_search(spark, many):
    edges = sorted(np.random.default_rng(many).uniform(0, 10, many).tolist())
    values = [*np.random.default_rng(1).uniform(-1, 11, 200).tolist(), *edges[:20], None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ingest.bin_left(F.col("v"), edges).alias("k"), ingest.upper_edge(ingest.bin_left(F.col("v"), edges), edges).alias("e")).collect()
    for r in rows:
        k = 0 if r.v is None else int(np.searchsorted(edges[:-2], r.v))
        assert r.k == k and r.e == edges[k + 1]
