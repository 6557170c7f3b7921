"""Chunk planning: shapes of chunks, their enumeration, and which layout to read."""

from __future__ import annotations

import bisect
import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Box = tuple[tuple[int, int], ...]


def ties(priorities: tuple[int, ...]) -> list[list[int]]:
    """Dimensions in ascending order of priority, equal ones together."""
    return [[d for d, p in enumerate(priorities) if p == level] for level in sorted(set(priorities))]


def chunks_to_cover(shape, chunk) -> tuple[int, ...]:
    return tuple(-(-s // c) for s, c in zip(shape, chunk))


@dataclass(frozen=True)
class Chunks:
    """A shape cut into chunks of one shape, the last of each dimension clipped."""

    shape: tuple[int, ...]
    chunk: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.shape) != len(self.chunk) or any(not 1 <= c for c in self.chunk):
            raise ValueError(f"chunk {self.chunk} does not fit shape {self.shape}")

    @property
    def counts(self) -> tuple[int, ...]:
        return chunks_to_cover(self.shape, self.chunk)

    def normalised(self) -> Chunks:
        """Chunks as equal as can be, as many as before."""
        return Chunks(self.shape, tuple(-(-s // n) for s, n in zip(self.shape, self.counts)))

    def edges(self, dim: int, lo: int = 0, hi: int | None = None) -> list[int]:
        """Chunk borders of a dimension inside lo..hi, with both ends."""
        hi = self.shape[dim] if hi is None else hi
        inner = range((lo // self.chunk[dim] + 1) * self.chunk[dim], hi, self.chunk[dim])
        return [lo, *inner, hi]

    def box_of(self, index: tuple[int, ...]) -> Box:
        """The box of the chunk with that number in each dimension."""
        if any(not 0 <= i < n for i, n in zip(index, self.counts)):
            raise IndexError(index)
        return tuple((i * c, min((i + 1) * c, s)) for i, c, s in zip(index, self.chunk, self.shape))

    def box_at(self, position: tuple[int, ...]) -> Box:
        """The box that holds a cell."""
        return self.box_of(tuple(p // c for p, c in zip(position, self.chunk)))

    def boxes(self):
        """All boxes, the first dimension fastest."""
        for index in itertools.product(*[range(n) for n in reversed(self.counts)]):
            yield self.box_of(tuple(reversed(index)))

    def covering(self, box: Box) -> int:
        """How many chunks a box touches."""
        return math.prod((b - 1) // c - a // c + 1 if b > a else 0 for (a, b), c in zip(box, self.chunk))

    def clipped(self, box: Box):
        """The parts of a box that lie in one chunk each."""
        cuts = [self.edges(d, a, b) for d, (a, b) in enumerate(box)]
        return itertools.product(*[list(zip(c[:-1], c[1:])) for c in cuts])

    def halves(self) -> list[Box]:
        """At most 2^n boxes on chunk borders."""
        cuts = []
        for s, c, n in zip(self.shape, self.chunk, self.counts):
            middle = min(s, -(-n // 2) * c)
            cuts.append([(0, middle), (middle, s)] if middle < s else [(0, s)])
        return [tuple(b) for b in itertools.product(*cuts)]

    def id_column(self, dims: list[str]) -> Column:
        """Row-major number of a cell's chunk, for repartitioning and statistics."""
        out = F.lit(0).cast("long")
        for d, c, n in zip(dims, self.chunk, self.counts):
            out = out * n + F.floor(F.col(d) / c)
        return out


def from_max_items(shape: tuple[int, ...], items: int, priorities: tuple[int, ...], least_chunks: tuple[int, ...] | None = None) -> Chunks:
    """The chunk with at most `items` cells: dimensions of the smallest priority number
    take what they can, equal ones in proportion to their extents."""
    if items < 1 or len(priorities) != len(shape):
        raise ValueError(f"no chunk of {items} items with priorities {priorities} of shape {shape}")
    most = [s // min(max(n, 1), s) for s, n in zip(shape, least_chunks or (1,) * len(shape))]
    chunk = [1] * len(shape)
    for tie in ties(priorities):
        longest = max(most[d] for d in tie)
        room = items // math.prod(chunk)

        def scaled(k: int) -> list[int]:  # all extents as k is to the longest
            return [-(-most[d] * k // longest) for d in tie]

        k = bisect.bisect_right(range(1, longest + 1), room, key=lambda k: math.prod(scaled(k)))
        for d, length in zip(tie, scaled(max(k, 1))):
            chunk[d] = length
    return Chunks(tuple(shape), tuple(chunk))


def from_min_chunks(shape: tuple[int, ...], least: int, priorities: tuple[int, ...]) -> Chunks:
    """At least `least` chunks (as far as there are cells): dimensions of the smallest
    priority number are cut first, equal ones into equally many parts."""
    if len(priorities) != len(shape):
        raise ValueError("a priority for each dimension is needed")
    count, target = [1] * len(shape), float(least)
    for group in ties(priorities):
        open_ = list(group)
        while open_ and target > 1:
            share = math.ceil(round(target ** (1 / len(open_)), 9))
            small = [d for d in open_ if shape[d] <= share]
            for d in small or open_:
                count[d] = shape[d] if small else share
                target /= count[d]
            open_ = [d for d in open_ if d not in small] if small else []
        if target <= 1:
            break
    chunk = []
    for s, n in zip(shape, count):
        c = -(-s // n)
        while c > 1 and -(-s // c) < n:  # rounding up must not lose a chunk
            c -= 1
        chunk.append(c)
    return Chunks(tuple(shape), tuple(chunk))


def largest_multiple(base: Chunks, items: int, priorities: tuple[int, ...] | None = None) -> Chunks:
    """The largest multiple of a chunk shape within an item budget, given priorities
    or the best of all."""
    if math.prod(base.chunk) > items:
        return base
    orders = [priorities] if priorities else list(itertools.product(range(1, len(base.shape) + 1), repeat=len(base.shape)))
    best = None
    for order in orders:
        room = items // math.prod(base.chunk)
        many = from_max_items(base.counts, room, order).chunk
        made = Chunks(base.shape, tuple(min(c * m, s) for c, m, s in zip(base.chunk, many, base.shape)))
        if best is None or math.prod(made.chunk) > math.prod(best.chunk):
            best = made
    return best


def memory_layout(layouts: dict[str, Chunks], item_bytes: int, memory: int, density: float = 1.0) -> tuple[str, Chunks]:
    """The layout whose chunk multiple within the memory budget needs fewest reads."""
    items = max(1, int(memory / (item_bytes * max(density, 1e-9))))
    options = {n: largest_multiple(c, items) for n, c in layouts.items()}
    name = min(options, key=lambda n: math.prod(options[n].counts))
    return name, options[name]


def choose_layout(layouts: dict[str, Chunks], box: Box) -> str:
    """The copy of a cube that covers a box with fewest chunks, the first on ties."""
    return min(layouts, key=lambda n: layouts[n].covering(box))


def chunk_table(spark: SparkSession, chunks: Chunks, dims: list[str]) -> DataFrame:
    """All boxes as rows: <dim>_lo, <dim>_hi."""
    out = None
    for d, s, c in zip(dims, chunks.shape, chunks.chunk):
        line = spark.range(-(-s // c)).select((F.col("id") * c).cast("int").alias(f"{d}_lo"), F.least((F.col("id") + 1) * c, F.lit(s)).cast("int").alias(f"{d}_hi"))
        out = line if out is None else out.crossJoin(line)  # the chunk grid, bounded by the shape
    return out


@dataclass(frozen=True)
class Contained:
    """An inner box inside an outer shape; positions translate between the two."""

    outer: tuple[int, ...]
    offset: tuple[int, ...]
    inner: tuple[int, ...]

    def __post_init__(self) -> None:
        for o, a, i in zip(self.outer, self.offset, self.inner):
            if i < 1:
                raise NoData(f"an extent of {i}")
            if a < 0 or a + i > o:
                raise NotContained(f"{a}..{a + i} is not in 0..{o}")

    def to_outer(self, position: tuple[int, ...]) -> tuple[int, ...]:
        """Of an inner position; negative ones count from the inner end."""
        out = []
        for p, a, i in zip(position, self.offset, self.inner):
            p = p + i if p < 0 else p
            if not 0 <= p < i:
                raise NotContained(f"{p} is not in 0..{i}")
            out.append(p + a)
        return tuple(out)

    def to_inner(self, position: tuple[int, ...]) -> tuple[int, ...]:
        out = []
        for p, a, i, o in zip(position, self.offset, self.inner, self.outer):
            p = p + o if p < 0 else p
            if not a <= p < a + i:
                raise NotContained(f"{p} is not in {a}..{a + i}")
            out.append(p - a)
        return tuple(out)

    def box(self) -> Box:
        return tuple((a, a + i) for a, i in zip(self.offset, self.inner))

    def boxes(self, chunk: tuple[int, ...]):
        """Parts on chunk borders of the outer shape, clipped to the inner box."""
        return Chunks(self.outer, chunk).clipped(self.box())


class NoData(ValueError):
    pass


class NotContained(IndexError):
    pass


def uniform(chunks: tuple[tuple[int, ...], ...]) -> tuple[int, ...]:
    """The chunk shape of per-dimension chunk lists; all but the last must be equal
    and the last no larger."""
    out = []
    for sizes in chunks:
        if not sizes or any(s != sizes[0] for s in sizes[:-1]) or sizes[-1] > sizes[0]:
            raise ValueError(f"chunks {sizes} are not uniform")
        out.append(sizes[0])
    return tuple(out)


def reduced(shape: tuple[int, ...], axes: tuple[int, ...]) -> tuple[int, ...]:
    """The shape without some axes; negative ones count from the end."""
    gone = {a + len(shape) if a < 0 else a for a in axes}
    if not gone <= set(range(len(shape))):
        raise IndexError(axes)
    return tuple(s for d, s in enumerate(shape) if d not in gone)


def slice_length(s: slice) -> int:
    return len(range(s.start or 0, s.stop, s.step or 1))


def slice_range(cut: slice) -> range:
    """The indices of a slice that has an end."""
    if cut.stop is None:
        raise ValueError(f"{cut} has no end")
    return range(cut.start or 0, cut.stop, cut.step or 1)


def slice_len(cut: slice) -> int:
    """How many whole steps a slice has."""
    return (cut.stop - (cut.start or 0)) // (cut.step or 1)
