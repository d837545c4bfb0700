"""Scoring expressions: squashes, robust scores, priors and calibrations as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the robust score.
MAD_SCALE = 1.4826
Z_LOW, Z_HIGH, SCALE_FLOOR = -4.0, 8.0, 1e-6


def clip(x: Column, low: float, high: float) -> Column:
    """x held within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def robust_z(x: Column, median: Column, mad: Column, low: float = Z_LOW, high: float = Z_HIGH) -> Column:
    return clip((x - median) / F.greatest(F.lit(SCALE_FLOOR), mad * MAD_SCALE), low, high)


def squash(x: Column, half: float) -> Column:
    """x / (x + half): 0 at 0, one half at half."""
    return x / (x + F.lit(half))


def saturate(z: Column, top: float = 6.0) -> Column:
    """1 - exp(-z / 2) of a score held within [0, top]."""
    return 1 - F.exp(-clip(z, 0.0, top) / 2)


def sigmoid(x: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -limit, limit)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def linear(features: Column, mean: list[float], scale: list[float], weights: list[float], bias: float) -> Column:
    """(x - mean) / scale . weights + bias for an array column of features."""
    parts = F.arrays_zip(features.alias("x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, scale)).alias("s"), F.array(*map(F.lit, weights)).alias("w"))
    return F.aggregate(parts, F.lit(float(bias)), lambda acc, p: acc + (p["x"] - p["m"]) / p["s"] * p["w"])


def platt(raw: Column, a: float, b: float) -> Column:
    return sigmoid(raw * a + b)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation through points in ascending order, flat outside them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(points[-1][1]))


def hook_score(energy: Column, burst: Column, chat: Column, judge: Column | None = None, lead: float = 0.70) -> Column:
    """Blend of squashed energy and chat with the burst; a judge's score leads when there is one.

    Weights are fixed values: .68, .20, .12, half points 1 and 2.5.
    """
    signal = 0.68 * squash(F.greatest(energy, F.lit(0.0)), 1.0) + 0.20 * burst + 0.12 * squash(F.greatest(chat, F.lit(0.0)), 2.5)
    if judge is None:
        return signal
    return F.coalesce(lead * judge + (1 - lead) * signal, signal)


def rank_prior(rank: Column, weight: float = 2.0) -> Column:
    return F.lit(weight) / (1 + rank)


def decibel_byte(linear_: Column, floor_db: float = -60.0) -> Column:
    """Amplitude 0..1 as 0..255 over floor_db..0 dB."""
    db = 20 * F.log10(F.greatest(linear_, F.lit(1e-9)))
    return F.rint(clip((db - floor_db) / -floor_db, 0.0, 1.0) * 255).cast("int")


def words_per_second_change(first_half: Column, second_half: Column, seconds: Column) -> Column:
    half = F.greatest(seconds, F.lit(SCALE_FLOOR)) / 2
    return second_half / half - first_half / half


def blend(*parts: tuple[float, Column]) -> Column:
    """Weighted mean over the parts that are not null; null when none is present."""
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, c in parts[1:]), F.when(parts[0][1].isNotNull(), F.lit(parts[0][0])).otherwise(F.lit(0.0)))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for w, c in parts[1:]), F.coalesce(parts[0][1] * parts[0][0], F.lit(0.0)))
    return F.when(weight > 0, total / weight)
