"""Small scalar functions: byte sizes, digits, bin edges."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("b", "Kb", "Mb", "Gb", "Tb", "Pb", "Eb")


def format_bytes(n: Column, digits: int = 2, largest: str = UNITS[-1]) -> Column:
    """1024-based size with a unit, `largest` at most; whole numbers have no decimals, others
    `digits`, halves to even. Whole is told by n itself, as a double rounds past 2⁵³."""
    size = F.abs(n.cast("double"))
    unit, name = F.lit(1), F.lit(UNITS[0])
    for k in range(1, UNITS.index(largest) + 1):
        unit, name = F.when(size >= 1024.0**k, F.lit(1024**k)).otherwise(unit), F.when(size >= 1024.0**k, F.lit(UNITS[k])).otherwise(name)
    value = size / unit
    whole = F.floor(value)
    # Apart from `whole`, so that no digit is lost; without digits an odd `whole` takes halves up.
    rest = F.bround(value - whole, digits) if digits else F.rint(value) - whole
    decimals = F.when(n % unit == 0, F.lit("")).otherwise(F.substring(F.format_string(f"%.{digits}f", rest), 2, digits + 1))
    number = F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), (whole + F.when(rest == 1, F.lit(1)).otherwise(F.lit(0))).cast("string"), decimals)
    return F.when(n.isNotNull(), F.concat(number, name))


def parse_bytes(text: str) -> int:
    """The number of bytes of '1.5Kb' and the like, rounded up; a unit is needed."""
    m = re.fullmatch(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\s*([A-Z]?b)\s*", text)
    if not m or m.group(2) not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return math.ceil(float(m.group(1)) * 1024 ** UNITS.index(m.group(2)))


def count_digits(n: Column) -> Column:
    return F.length(F.abs(n).cast("string"))


def padded(n: Column, width: Column) -> Column:
    """n with zeros in front, as layer names have it."""
    return F.lpad(n.cast("string"), width, "0")


#: Where the pieces of an axis end (percent of its span), their shares of
#: the edges (percent), and how many bins become one.
PIECE_ENDS, PIECE_SHARES, BINS_A_PIECE = (15, 85, 100), (5, 90, 5), 10


def piecewise_edges(low: float, high: float, count: int, ends: tuple[float, ...] = PIECE_ENDS, shares: tuple[float, ...] = PIECE_SHARES, downsample: int = BINS_A_PIECE) -> list[float]:
    """Bin edges that lie closer where an axis matters: the k-th edge belongs to the
    piece whose cumulated share holds k and lies linearly inside it; `high` closes."""
    if len(ends) != len(shares) or max(ends, default=0) != 100:
        raise ValueError(f"pieces that end at {ends} percent cannot share {shares}")
    many = (count // downsample * np.asarray(shares, float) / 100).astype(int)
    before = np.cumsum(many) - many
    begin, length = np.concatenate(([0], ends[:-1])) / 100, np.diff(ends, prepend=0) / 100
    k = np.arange(many.sum())
    piece = np.repeat(np.arange(len(many)), many)
    inside = begin[piece] + length[piece] * (k - before[piece]) / many[piece]
    return [*(low + (high - low) * inside).tolist(), high]
