"""The slicing algebra: per axis an action and a slice, per group a result.

A group names the cubes it reads (paths of one file, equal in structure) and one
AxisSpec for each axis it cares about; every other dimension takes its default axis
and the group's default action and slice. Slices of labels are half-open; `value`
takes the first label that is not smaller.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.cube import Axis, Cube, same_structure


class Action(Enum):
    LEAVE = "leave"
    LOOP = "loop"
    SUM = "sum"
    MAX = "max"


class GroupType(Enum):
    DATA = "data"
    VIEW = "view"
    SUMMARY = "summary"


class SliceError(ValueError):
    """A slice does not fit the cube."""


class NoDataError(SliceError):
    """Nothing is left of a dimension."""


class MissingArgumentError(SliceError):
    """A group or axis lacks an argument that has no default."""


@dataclass(frozen=True)
class Slice:
    """all | range lo hi | centred c w | value v."""

    kind: str
    args: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        need = {"all": 0, "range": 2, "centred": 2, "value": 1}
        if self.kind not in need:
            raise SliceError(f"unknown slice {self.kind!r}")
        if len(self.args) != need[self.kind]:
            raise SliceError(f"slice {self.kind} takes {need[self.kind]} numbers, not {len(self.args)}")

    def bounds(self, labels: list[float]) -> tuple[int, int]:
        """The half-open index range over ascending labels."""
        if self.kind == "all":
            return 0, len(labels)
        if self.kind == "value":
            at = bisect.bisect_left(labels, self.args[0])
            if at == len(labels):
                raise SliceError(f"value {self.args[0]} is past the last label {labels[-1] if labels else None}")
            return at, at + 1
        low, high = self.args if self.kind == "range" else (self.args[0] - self.args[1] / 2, self.args[0] + self.args[1] / 2)
        return bisect.bisect_left(labels, low), bisect.bisect_left(labels, high)


def parse_slice(words: str | list[str]) -> Slice:
    """'range 1 2' and the like; a lone number is a value."""
    words = words.split() if isinstance(words, str) else list(words)
    if not words:
        raise MissingArgumentError("a slice is empty")
    try:
        return Slice("value", (float(words[0]),)) if len(words) == 1 and words[0] != "all" else Slice(words[0], tuple(map(float, words[1:])))
    except ValueError as e:
        raise e if isinstance(e, SliceError) else SliceError(f"not a number in slice {' '.join(words)!r}") from None


@dataclass(frozen=True)
class AxisSpec:
    name: str
    action: Action | None = None
    slice: Slice | None = None


@dataclass(frozen=True)
class GroupSpec:
    name: str
    paths: tuple[str, ...] = ()
    type: GroupType | None = GroupType.DATA
    axes: tuple[AxisSpec, ...] = ()
    default_action: Action | None = Action.LEAVE
    default_slice: Slice | None = field(default_factory=lambda: Slice("all"))


@dataclass(frozen=True)
class Bound:
    """A group bound to a cube: for each dimension the axis, action and index range."""

    axes: tuple[Axis, ...]
    actions: tuple[Action, ...]
    ranges: tuple[tuple[int, int], ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(b - a for a, b in self.ranges)


def bind(group: GroupSpec, cubes: dict[str, Cube]) -> Bound:
    """Resolves a group against the cubes of a file."""
    if group.type is None:
        raise MissingArgumentError(f"group {group.name}: type is missing")
    if not group.paths:
        raise MissingArgumentError(f"group {group.name}: paths are missing")
    for path in group.paths:
        if path not in cubes:
            raise SliceError(f"group {group.name}: no path {path}")
    cube = cubes[group.paths[0]]
    for path in group.paths[1:]:
        same_structure(cube, cubes[path])
    named: dict[str, AxisSpec] = {}
    for spec in group.axes:
        try:
            dim = cube.axis(spec.name).dim
        except KeyError:
            raise SliceError(f"group {group.name}: no axis {spec.name}") from None
        if dim in named:
            raise SliceError(f"group {group.name}: axes {named[dim].name} and {spec.name} span one dimension")
        named[dim] = spec
    axes, actions, ranges = [], [], []
    for dim in cube.dims:
        spec = named.get(dim)
        axis = cube.axis(spec.name) if spec else cube.default_axis(dim)
        action = (spec and spec.action) or group.default_action
        cut = (spec and spec.slice) or group.default_slice
        if action is None or cut is None:
            raise MissingArgumentError(f"group {group.name}, axis {axis.name}: {'action' if action is None else 'slice'} is missing")
        axes.append(axis)
        actions.append(action)
        ranges.append(cut.bounds(axis.labels(cube.size(dim))))
    if Action.SUM in actions and Action.MAX in actions:
        raise NotImplementedError(f"group {group.name}: sum and max in one group")
    for axis, (a, b) in zip(axes, ranges):
        if b <= a:
            raise NoDataError(f"group {group.name}: nothing of axis {axis.name} is left")
    return Bound(tuple(axes), tuple(actions), tuple(ranges))


def box(dims: tuple[str, ...], ranges: tuple[tuple[int, int], ...], shape: tuple[int, ...]) -> Column:
    """The predicate of an index box; whole dimensions need none."""
    out = F.lit(True)
    for dim, (a, b), size in zip(dims, ranges, shape):
        if a > 0:
            out = out & (F.col(dim) >= a)
        if b < size:
            out = out & (F.col(dim) < b)
    return out


def surviving_axes(cube: Cube, bound: Bound) -> list[Axis]:
    """Axes of the dimensions that stay, the chosen one of each dimension first;
    dimensions are numbered anew by their order."""
    out = []
    for dim, axis, action in zip(cube.dims, bound.axes, bound.actions):
        if action is Action.LEAVE:
            out += [axis, *(a for a in cube.axes if a.dim == dim and a.name != axis.name)]
    return out


def slice_cube(cube: Cube, bound: Bound, group_type: GroupType = GroupType.DATA) -> DataFrame:
    """Rows of the result: indices and labels of left and looped dimensions and the
    value; sums and maxima run over the stored cells of their dimensions (a maximum
    is a true one). SUMMARY gives count, min, max, mean and stddev instead."""
    inside = cube.df.where(box(cube.dims, bound.ranges, cube.shape))
    keep = [d for d, a in zip(cube.dims, bound.actions) if a in (Action.LEAVE, Action.LOOP)]
    value = F.col(cube.value)
    if group_type is GroupType.SUMMARY:
        numbers = [F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev")]
        loops = [d for d, a in zip(cube.dims, bound.actions) if a is Action.LOOP]
        return inside.groupBy(*loops).agg(*numbers)
    if Action.SUM in bound.actions:
        inside = inside.groupBy(*keep).agg(F.sum(value).alias(cube.value))
    elif Action.MAX in bound.actions:
        inside = inside.groupBy(*keep).agg(F.max(value).alias(cube.value))
    labels = []
    for axis in surviving_axes(cube, bound):
        labels.append(axis.label(F.col(axis.dim)).alias(f"{axis.name}_label"))
    for dim, axis, action in zip(cube.dims, bound.axes, bound.actions):
        if action is Action.LOOP:
            labels.append(axis.label(F.col(dim)).alias(f"{axis.name}_label"))
    return inside.select(*keep, *labels, cube.value)


def squeeze(df: DataFrame, bound: Bound, cube: Cube) -> DataFrame:
    """Without the index columns of dimensions of which one index is left."""
    return df.drop(*[d for d, (a, b) in zip(cube.dims, bound.ranges) if b - a == 1])


def loop_label(bound: Bound, values: dict[str, float]) -> str:
    """The name of one step of the loops: axis_value joined by -, three digits."""
    return "-".join(f"{axis.name}_{values[axis.name]:.3g}" for axis, action in zip(bound.axes, bound.actions) if action is Action.LOOP)


def loop_steps(cube: Cube, bound: Bound):
    """(label, predicate) of every step, without reading data."""
    steps: list[tuple[dict[str, float], Column]] = [({}, F.lit(True))]
    for dim, axis, action, (a, b) in zip(cube.dims, bound.axes, bound.actions, bound.ranges):
        if action is Action.LOOP:
            labels = axis.labels(cube.size(dim))
            steps = [({**v, axis.name: labels[k]}, p & (F.col(dim) == k)) for v, p in steps for k in range(a, b)]
    return [(loop_label(bound, v), p) for v, p in steps]


def write_slices(cube: Cube, bound: Bound, path: str) -> None:
    """One file tree: looped dimensions become partition folders."""
    loops = [d for d, a in zip(cube.dims, bound.actions) if a is Action.LOOP]
    slice_cube(cube, bound).write.mode("overwrite").partitionBy(*loops).parquet(path)


def resolve_index(size: int, start: int | None, stop: int | None) -> tuple[int, int]:
    """An index slice; negative counts from the end, None is the border."""
    a = 0 if start is None else start + size if start < 0 else start
    b = size if stop is None else stop + size if stop < 0 else stop
    if not (0 <= a <= size and 0 <= b <= size):
        raise IndexError(f"slice {start}:{stop} is outside of {size}")
    return a, b


def closed_bounds(labels: list[float], low: float, high: float) -> tuple[int, int]:
    """Indices of low <= label <= high."""
    return bisect.bisect_left(labels, low), bisect.bisect_right(labels, high)


def iterate(cube: Cube, dims: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """A row for every index of the chosen dimensions that has cells, with aggregates
    over its part of the cube."""
    return cube.df.groupBy(*dims).agg(*[c.alias(n) for n, c in aggregates.items()])
