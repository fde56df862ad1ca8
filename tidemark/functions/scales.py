"""Positions of values on charts, as Column expressions; rounded to two decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.units import round_half_up_2

#: Shares of a bullet bar that end at the warning and the critical mark (fixed values).
BULLET_WARN, BULLET_CRIT = 0.6, 0.99


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` in [low, high]; ``low`` if it is not finite."""
    v = x.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(float(low))).otherwise(F.greatest(F.least(v, F.lit(float(high))), F.lit(float(low))))


def bullet_x(value: Column, warn: float, crit: float, width: float) -> Column:
    """Place on a bar whose healthy range takes 60 %, the range up to critical 39 %, and the rest its end."""
    w = max(width, 0.0)
    upper = (F.lit(BULLET_WARN) + (value - warn) / (crit - warn) * (BULLET_CRIT - BULLET_WARN)) * w
    return F.when(value <= 0, F.lit(0.0)).when(value <= warn, round_half_up_2(value / warn * BULLET_WARN * w)).when(value <= crit, round_half_up_2(upper)).otherwise(round_half_up_2(F.lit(w)))


def x_at(i: Column, count: Column, width: float) -> Column:
    """Place of sample ``i`` of ``count``; a lone sample is at 0."""
    return F.when(count > 1, round_half_up_2(i * float(width) / (count - 1))).otherwise(0.0)


def nearest_index(x: Column, count: Column, width: float) -> Column:
    """Sample nearest to a place; null without samples."""
    return F.when(count > 0, F.floor(clamp(x / float(width), 0, 1) * (count - 1) + 0.5).cast("long"))


def series_opacity(i: Column) -> Column:
    return round_half_up_2(F.greatest(F.lit(0.8) - i * 0.25, F.lit(0.15)))


def lines(samples: DataFrame, by: str, t: str, v: str, width: float, height: float, pad: float) -> DataFrame:
    """(by, points): ``x,y`` pairs of each series, its own range over the height; a constant series lies in the middle."""
    w = Window.partitionBy(by)
    low, high, n = F.min(v).over(w), F.max(v).over(w), F.count("*").over(w)
    inner = max(height - 2 * pad, 0.0)
    y = F.when(high == low, round_half_up_2(F.lit(height / 2))).otherwise(round_half_up_2(F.lit(float(pad)) + (high - F.col(v)) / (high - low) * inner))
    x = x_at(F.row_number().over(w.orderBy(t)) - 1, n, width)
    at = samples.select(by, F.col(t).alias("t"), x.alias("x"), y.alias("y"))
    pair = F.transform(F.sort_array(F.collect_list(F.struct("t", "x", "y"))), lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string")))
    return at.groupBy(by).agg(F.array_join(pair, " ").alias("points"))


def ring_segments(rings: DataFrame, n: str, radius: float, gap: float) -> DataFrame:
    """Adds segment, length and offset: ``n`` equal arcs of a circle with a gap; none for n < 1."""
    circle = 2 * 3.141592653589793 * max(radius, 0.0)
    each = rings.where(F.col(n) >= 1).withColumn("segment", F.explode(F.sequence(F.lit(0), F.floor(n).cast("int") - 1)))
    step = F.lit(circle) / F.floor(n)
    length = F.when(F.floor(n) == 1, F.lit(circle)).otherwise(F.greatest(step - max(gap, 0.0), F.lit(0.0)))
    return each.withColumn("length", round_half_up_2(length)).withColumn("offset", round_half_up_2(-F.col("segment") * step))
