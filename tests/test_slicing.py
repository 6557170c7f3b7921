import numpy as np
import pytest

from cubeloom.cube import Axis, Cube, same_structure
from cubeloom.operators import slicing as S


@pytest.fixture(scope="module")
def block():
    rng = np.random.default_rng(3)
    return rng.integers(-5, 9, (4, 5, 6))


@pytest.fixture(scope="module")
def cube(spark, block):
    rows = [(i, j, k, int(block[i, j, k])) for i, j, k in np.ndindex(block.shape)]
    axes = (Axis("x", "x"), Axis("y", "y"), Axis("mz", "mz", 0, 0.1, dtype="float"), Axis("time", "x", 0, 1.0))
    return Cube(spark.createDataFrame(rows, "x int, y int, mz int, signal int"), ("x", "y", "mz"), block.shape, axes=axes)


def run(cube, *axes, **more):
    bound = S.bind(S.GroupSpec("g", ("s",), axes=axes, **more), {"s": cube})
    return S.slice_cube(cube, bound), bound


def test_sum_of_a_range(cube, block):
    df, _ = run(cube, S.AxisSpec("y", S.Action.SUM), S.AxisSpec("mz", None, S.parse_slice("range 0.1 0.4")))
    got = {(r.x, r.mz): r.signal for r in df.collect()}
    labels = np.float32(0.1) * 0 + (np.arange(6) * 0.1).astype(np.float32)
    lo, hi = np.searchsorted(labels.astype(float), [0.1, 0.4])
    want = block[:, :, lo:hi].sum(1)
    assert got == {(i, lo + k): want[i, k] for i, k in np.ndindex(want.shape)}


def test_true_maximum(cube, block):
    df, _ = run(cube, default_action=S.Action.MAX)
    assert df.collect()[0].signal == block.max()
    df, _ = run(cube, S.AxisSpec("x", S.Action.MAX), S.AxisSpec("mz", S.Action.LOOP))
    assert {(r.y, r.mz): r.signal for r in df.collect()} == {(j, k): block[:, j, k].max() for j in range(5) for k in range(6)}


def test_value_takes_first_not_smaller(cube):
    _, bound = run(cube, S.AxisSpec("time", None, S.parse_slice("1.5")))
    assert bound.ranges[0] == (2, 3)
    with pytest.raises(S.SliceError, match="past the last"):
        run(cube, S.AxisSpec("time", None, S.parse_slice("9")))


def test_errors(cube):
    with pytest.raises(S.MissingArgumentError, match="paths"):
        S.bind(S.GroupSpec("g"), {"s": cube})
    with pytest.raises(S.MissingArgumentError, match="type"):
        S.bind(S.GroupSpec("g", ("s",), type=None), {"s": cube})
    with pytest.raises(S.MissingArgumentError, match="action"):
        run(cube, default_action=None)
    with pytest.raises(S.MissingArgumentError, match="slice"):
        run(cube, default_slice=None)
    with pytest.raises(S.SliceError, match="one dimension"):
        run(cube, S.AxisSpec("x"), S.AxisSpec("time"))
    with pytest.raises(NotImplementedError):
        run(cube, S.AxisSpec("x", S.Action.SUM), S.AxisSpec("y", S.Action.MAX))
    with pytest.raises(S.NoDataError):
        run(cube, S.AxisSpec("x", None, S.parse_slice("range 2 2")))
    with pytest.raises(S.SliceError):
        S.parse_slice("range 1")
    with pytest.raises(S.SliceError):
        S.parse_slice("range 1 two")


def test_labels_of_loops(cube):
    _, bound = run(cube, S.AxisSpec("x", S.Action.LOOP, S.parse_slice("range 1 3")), S.AxisSpec("mz", S.Action.LOOP, S.parse_slice("0.2")))
    assert [n for n, _ in S.loop_steps(cube, bound)] == ["x_1-mz_0.2", "x_2-mz_0.2"]


def test_surviving_axes(cube):
    _, bound = run(cube, S.AxisSpec("y", S.Action.SUM))
    assert [a.name for a in S.surviving_axes(cube, bound)] == ["x", "time", "mz"]


def test_index_slices():
    assert S.resolve_index(10, -3, None) == (7, 10)
    assert S.closed_bounds([1.0, 2.0, 2.0, 3.0], 2.0, 3.0) == (1, 4)
    with pytest.raises(IndexError):
        S.resolve_index(10, 0, 11)


def test_structure(cube):
    same_structure(cube, cube)
    with pytest.raises(ValueError, match="shapes"):
        same_structure(cube, Cube(cube.df, cube.dims, (4, 5, 7)))
