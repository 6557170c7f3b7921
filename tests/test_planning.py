import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom.functions import text
from cubeloom.plans import chunking as K

CUBE = (100, 100, 100)
shapes = st.lists(st.integers(1, 60), min_size=2, max_size=4).map(tuple)


@pytest.mark.parametrize(("priorities", "items", "want"), [((1, 2, 3), 10, (10, 1, 1)), ((1, 2, 3), 200, (100, 2, 1)), ((1, 1, 2), 10, (3, 3, 1)), ((1, 1, 2), 200, (14, 14, 1)), ((1, 1, 1), 10, (2, 2, 2)), ((1, 1, 1), 200, (5, 5, 5))])
def test_max_items(priorities, items, want):
    assert K.from_max_items(CUBE, items, priorities).chunk == want


@pytest.mark.parametrize(("shape", "items", "want"), [((100,) * 3, 10, (10, 1, 1)), ((100,) * 3, 200, (50, 4, 1)), ((10,) * 3, 1000, (5, 5, 5)), ((10,) * 3, 5, (5, 1, 1))])
def test_max_items_of_at_least_two_chunks(shape, items, want):
    assert K.from_max_items(shape, items, (1, 2, 3), (2, 2, 2)).chunk == want


def test_extents_share_in_proportion():
    assert K.from_max_items((10, 3), 8, (1, 1)).chunk == (4, 2)


def test_slices_as_ranges():
    assert K.slice_range(slice(5)) == range(5) and K.slice_range(slice(1, 5, 2)) == range(1, 5, 2) and K.slice_range(slice(None, 6, 2)) == range(0, 6, 2)
    assert (K.slice_len(slice(5)), K.slice_len(slice(1, 5)), K.slice_len(slice(1, 5, 2))) == (5, 4, 2)
    with pytest.raises(ValueError):
        K.slice_range(slice(3, None))


@pytest.mark.parametrize(("priorities", "least", "want"), [((1, 2, 3), 10, (10, 1, 1)), ((1, 2, 3), 200, (100, 2, 1)), ((1, 1, 2), 10, (4, 4, 1)), ((1, 1, 2), 200, (15, 15, 1)), ((1, 1, 1), 200, (6, 6, 6))])
def test_min_chunks(priorities, least, want):
    assert K.from_min_chunks(CUBE, least, priorities).counts == want


@settings(max_examples=100, deadline=None)
@given(shapes, st.integers(1, 1000), st.data())
def test_budgets_hold(shape, n, data):
    priorities = tuple(data.draw(st.lists(st.integers(1, 3), min_size=len(shape), max_size=len(shape))))
    chunk = K.from_max_items(shape, n, priorities)
    assert math.prod(chunk.chunk) <= n and all(1 <= c <= s for c, s in zip(chunk.chunk, shape))
    assert math.prod(K.from_min_chunks(shape, n, priorities).counts) >= min(n, math.prod(shape))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=3).map(tuple), st.data())
def test_boxes_tile_the_shape(shape, data):
    chunk = tuple(data.draw(st.integers(1, s)) for s in shape)
    seen = np.zeros(shape, int)
    chunks = K.Chunks(shape, chunk)
    for box in chunks.boxes():
        seen[tuple(slice(a, b) for a, b in box)] += 1
    assert (seen == 1).all()
    assert chunks.covering(tuple((0, s) for s in shape)) == math.prod(chunks.counts)
    assert chunks.normalised().counts == chunks.counts
    seen[:] = 0
    for box in chunks.halves():
        seen[tuple(slice(a, b) for a, b in box)] += 1
    assert (seen == 1).all() and len(chunks.halves()) <= 2 ** len(shape)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_contained(data):
    outer = data.draw(st.lists(st.integers(1, 30), min_size=1, max_size=3).map(tuple))
    inner = tuple(data.draw(st.integers(1, o)) for o in outer)
    offset = tuple(data.draw(st.integers(0, o - i)) for o, i in zip(outer, inner))
    box = K.Contained(outer, offset, inner)
    position = tuple(data.draw(st.integers(-i, i - 1)) for i in inner)
    assert box.to_inner(box.to_outer(position)) == tuple(p % i for p, i in zip(position, inner))
    seen = np.zeros(outer, int)
    for b in box.boxes(tuple(max(1, o // 3) for o in outer)):
        seen[tuple(slice(x, y) for x, y in b)] += 1
    assert seen.sum() == math.prod(inner) and seen.max() == 1
    with pytest.raises(K.NotContained):
        box.to_outer(inner)


def test_small_tools():
    assert K.choose_layout({"spectra": K.Chunks((10, 10), (1, 10)), "images": K.Chunks((10, 10), (10, 1))}, ((0, 10), (3, 4))) == "images"
    assert K.Chunks((10, 9), (7, 7)).normalised().chunk == (5, 5)
    assert K.uniform(((4, 4, 2), (3,))) == (4, 3)
    assert K.reduced((2, 3, 4), (-1, 0)) == (3,)
    name, chunk = K.memory_layout({"a": K.Chunks((8, 8), (1, 8)), "b": K.Chunks((8, 8), (8, 1))}, 4, 4 * 32)
    assert name == "a" and math.prod(chunk.chunk) <= 32
    for bad in (((4, 3, 4),), ((3, 4),), ((),)):
        with pytest.raises(ValueError):
            K.uniform(bad)
    assert text.parse_bytes("1.5Kb") == 1536 and text.parse_bytes("7b") == 7 and text.parse_bytes("2Mb") == 2 << 20 and text.parse_bytes("0.1b") == 1
    edges = text.piecewise_edges(0, 100, 1000)
    assert edges[0] == 0 and edges[-1] == 100 and len(edges) == 101 and (np.diff(edges) > 0).all()
    with pytest.raises(ValueError):
        text.piecewise_edges(0, 1, 100, (50, 90), (1, 2))
