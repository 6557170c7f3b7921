"""Image tools: axis spacing, weighted histograms, resampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.shipping import ship


def spacing(df: DataFrame, value: str, keys: list[str] | None = None, choose: Callable[[Column], Column] | None = None) -> DataFrame:
    """The median (or what `choose` makes) of the differences of an axis's ascending
    distinct values."""
    keys = keys or []
    part = f"partition by {', '.join(keys)} " if keys else ""
    steps = df.select(*keys, value).distinct().selectExpr(*keys, f"{value} - lag({value}) over ({part}order by {value}) as step").where("step is not null")
    made = (choose or (lambda c: F.percentile(c, 0.5)))(F.col("step"))
    return steps.groupBy(*keys).agg(made.alias("spacing"))


def histogram2d(df: DataFrame, x: str, y: str, weight: str, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Weights summed over cells of dx by dy."""
    cell = lambda c, o, d: F.floor((F.col(c) - o) / d).cast("int")
    return df.select(cell(x, x0, dx).alias("ix"), cell(y, y0, dy).alias("iy"), weight).groupBy("ix", "iy").agg(F.sum(weight).alias("weight"))


def zoom_nearest(df: DataFrame, factor: int, keys: list[str], value: str) -> DataFrame:
    """Order 0: every pixel becomes factor x factor pixels."""
    cut = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = df.select(*keys, "x", "y", value, F.explode(cut).alias("i"))
    return wide.select(*keys, (F.col("x") * factor + F.col("i")).alias("x"), F.explode(cut).alias("j"), "y", value).select(*keys, "x", (F.col("y") * factor + F.col("j")).alias("y"), value)


def spline(image: np.ndarray, factor: float, order: int) -> np.ndarray:
    """An image resampled by a B-spline of order 0 to 5, zero outside."""
    if not 0 <= order <= 5:
        raise ValueError("order is 0 to 5")
    if abs(factor - 1) < 1e-2:
        return image
    for axis in (0, 1):
        image = np.moveaxis(_line(np.moveaxis(np.asarray(image, float), axis, 0), factor, order), 0, axis)
    return image


def _basis(t: np.ndarray, order: int) -> np.ndarray:
    """The centred B-spline, by its recurrence."""
    if order == 0:
        return ((t >= -0.5) & (t < 0.5)).astype(float)
    h = (order + 1) / 2
    return ((h + t) * _basis(t + 0.5, order - 1) + (h - t) * _basis(t - 0.5, order - 1)) / order


def _line(data: np.ndarray, factor: float, order: int) -> np.ndarray:
    n = len(data)
    m = max(1, round(n * factor))
    return _at(data, 0, np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0), order)


def _at(data: np.ndarray, low: int, at: np.ndarray, order: int) -> np.ndarray:
    """The spline through samples at low, low + 1, ... at the places `at`."""
    n = len(data)
    knots = np.arange(n)
    weights = data
    if order > 1:  # coefficients that interpolate the samples
        weights = np.linalg.solve(_basis(knots[:, None] - knots[None, :], order), data.reshape(n, -1)).reshape(data.shape)
    if order == 0:
        return data[np.minimum(n - 1, np.floor(at - low + 0.5).astype(int))]
    return np.tensordot(_basis(at[:, None] - (low + knots[None, :]), order), weights, 1)


def zoom(df: DataFrame, factor: float, order: int, width: int, height: int, keys: list[str], value: str, rows: int = 256, halo: int = 48) -> DataFrame:
    """Images of width x height resampled in blocks of rows, each read with a halo: what
    a sample changes in a cubic falls by 0.27 a row, at order 5 by 0.43. A block is bounded
    by width x (rows + 2 halo)."""
    if not 0 <= order <= 5:
        raise ValueError("order is 0 to 5")
    ship(df.sparkSession)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    same = abs(factor - 1) < 1e-2
    last = max(0, height - 1) // rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        low, high = max(0, block * rows - halo), min(height, (block + 1) * rows + halo)
        image, cells = np.zeros((width, high - low)), pdf[pdf["x"].notna()]
        image[cells["x"].astype(int), cells["y"].astype(int) - low] = cells[value]
        m = height if same else max(1, round(height * factor))
        at = np.arange(m) * ((height - 1) / (m - 1) if m > 1 else 0)
        begin, end = np.searchsorted(at, [block * rows, (block + 1) * rows])
        end = m if block == last else end
        if same:
            made = image[:, begin - low : end - low]
        else:
            made = _at(_line(image, factor, order).T, low, at[begin:end], order).T
        x, y = np.indices(made.shape)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * made.size for k in keys}, "x": x.ravel(), "y": y.ravel() + begin, value: made.ravel()})

    edge = lambda c: F.least(F.lit(last), F.greatest(F.lit(0), F.floor(c / rows))).cast("int")
    cells = df.select(*keys, "x", "y", value, F.explode(F.sequence(edge(F.col("y") - halo), edge(F.col("y") + halo))).alias("block"))
    cells = cells.where(F.col("y").between(F.col("block") * rows - halo, (F.col("block") + 1) * rows + halo - 1))
    empty = df.select(*keys).distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    every = cells.unionByName(empty, allowMissingColumns=True)
    return every.groupBy(*keys, "block").applyInPandas(run, f"{fields}, x int, y int, {value} double")
