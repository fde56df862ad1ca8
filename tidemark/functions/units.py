"""Byte, time and count formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def _half_up(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def _by_unit(x: Column, text) -> Column:
    """``text(value, unit)`` with the largest unit that leaves a value of 1 or more."""
    out = text(x, _UNITS[0])
    for i in range(1, len(_UNITS)):
        out = F.when(x >= float(1024**i), text(x / float(1024**i), _UNITS[i])).otherwise(out)
    return out


def humanize_bytes(n: Column) -> Column:
    """One decimal from 1 KiB on, ties to even: 512 B, 7.5 GiB, 30.0 GiB."""
    return _by_unit(n.cast("double"), lambda v, u: F.concat(F.floor(v).cast("string"), F.lit(" B")) if u == "B" else F.concat(F.format_string("%.1f", F.bround(v, 1)), F.lit(f" {u}")))


def format_bytes(n: Column) -> Column:
    """One decimal below 10 (no .0), else whole: 512 B, 7.5 GiB, 30 GiB; 0 B for what is not positive or not finite."""
    x = n.cast("double")

    def text(v: Column, u: str) -> Column:
        if u == "B":
            return F.concat(F.floor(v + 0.5).cast("long").cast("string"), F.lit(" B"))
        small = F.regexp_replace(F.format_string("%.1f", _half_up(v, 1)), r"\.0$", "")
        return F.concat(F.when(v < 10, small).otherwise(F.floor(v + 0.5).cast("long").cast("string")), F.lit(f" {u}"))

    return F.when(F.isnan(x) | (x <= 0) | (x == float("inf")), F.lit("0 B")).otherwise(_by_unit(x, text))


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def plain_number(x: Column) -> Column:
    """All digits of a number without exponent or closing .0: 50, 0.0005, 61234567, 12345678.5.

    As Spark writes it below 0.0001, from 1e37 on and where it is not finite.
    """
    v = x.cast("double")
    size = F.abs(v)
    whole = F.when((size < 1e37) & (v == F.rint(v)), v.try_cast("decimal(38,0)").cast("string"))
    part = F.when((size >= 1e-4) & (size < 1e16), F.regexp_replace(v.try_cast("decimal(38,22)").cast("string"), "0+$", ""))
    return F.coalesce(whole, part, v.cast("string"))


def format_percent(ratio: Column) -> Column:
    whole = F.floor(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5)
    return F.when((ratio > 0) & (ratio < 0.01), F.lit("<1%")).otherwise(F.concat(whole.cast("long").cast("string"), F.lit("%")))


def format_duration(seconds: Column) -> Column:
    """Largest whole unit: 45 s, 16 min, 5 h, 3 d."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    of = lambda size, unit: F.concat(F.floor(s / size).cast("long").cast("string"), F.lit(f" {unit}"))
    return F.when(s < 60, of(1, "s")).when(s < 3600, of(60, "min")).when(s < 86400, of(3600, "h")).otherwise(of(86400, "d"))


def format_millis(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.greatest(F.floor(ms + 0.5), F.lit(0)).cast("long").cast("string"), F.lit(" ms"))).otherwise(format_duration(ms / 1000))


def format_skew(ms: Column) -> Column:
    sign = F.when(ms > 0, "+").when(ms < 0, "-").otherwise("")
    return F.concat(sign, format_count(F.abs(ms)), F.lit(" ms"))


def format_ago(seconds: Column) -> Column:
    return F.when(seconds < 5, F.lit("now")).otherwise(F.concat(format_duration(seconds), F.lit(" ago")))


def format_in(seconds: Column) -> Column:
    return F.when(seconds < 5, F.lit("due")).otherwise(F.concat(F.lit("in "), format_duration(seconds)))


def format_interval(seconds: Column) -> Column:
    return F.when(seconds <= 0, F.lit("none")).otherwise(F.concat(F.lit("every "), format_duration(seconds)))


def format_used_of(used: Column, total: Column, between: str = " / ") -> Column:
    """The first unit is left out if both are equal."""
    u, t = format_bytes(used), format_bytes(total)
    same = F.split_part(u, F.lit(" "), F.lit(2)) == F.split_part(t, F.lit(" "), F.lit(2))
    return F.concat(F.when(same, F.split_part(u, F.lit(" "), F.lit(1))).otherwise(u), F.lit(between), t)


def format_rate(n: Column, per: str) -> Column:
    if per == "s":
        return F.concat(format_bytes(n), F.lit("/s"))
    sign = F.when(n > 0, "+").when(n < 0, "-").otherwise("")
    return F.concat(sign, format_bytes(F.abs(n)), F.lit("/h"))


def format_horizon(seconds: Column) -> Column:
    """16 h, 12 d, 9 mo (of 30 days), 3 y (of 365)."""
    d = seconds / 86400
    of = lambda days, unit: F.concat(F.floor(d / days).cast("long").cast("string"), F.lit(f" {unit}"))
    return F.when(d < 60, format_duration(seconds)).when(d < 730, of(30, "mo")).otherwise(of(365, "y"))


def format_compact(n: Column) -> Column:
    """312, 41K, 4.2M: one decimal below 100 of a unit, none beyond, no .0."""
    x = n.cast("double")

    def text(v: Column, u: str) -> Column:
        return F.concat(F.when(v < 100, F.regexp_replace(F.format_string("%.1f", _half_up(v, 1)), r"\.0$", "")).otherwise(F.floor(v + 0.5).cast("long").cast("string")), F.lit(u))

    return F.when(x >= 1e12, text(x / 1e12, "T")).when(x >= 1e9, text(x / 1e9, "B")).when(x >= 1e6, text(x / 1e6, "M")).when(x >= 1e3, text(x / 1e3, "K")).otherwise(text(x, ""))


def humanize_age(seconds: Column) -> Column:
    """Age with units s, m, h, d; a negative age is ``just now``."""
    of = lambda size, unit: F.concat(F.floor(seconds / size).cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 0, F.lit("just now")).when(seconds < 60, of(1, "s")).when(seconds < 3600, of(60, "m")).when(seconds < 86400, of(3600, "h")).otherwise(of(86400, "d"))


def capacity_summary(used: Column, capacity: Column) -> Column:
    """used/capacity (percent), a dash for an unknown capacity."""
    pct = F.format_string("%.0f", F.bround(used.cast("double") / capacity * 100, 0))
    return F.when(capacity > 0, F.concat(humanize_bytes(used), F.lit("/"), humanize_bytes(capacity), F.lit(" ("), pct, F.lit("%)"))).otherwise("—")


def round_half_up_2(x: Column) -> Column:
    """Two decimals, half towards plus infinity; 0 for what is not finite."""
    v = x.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(F.floor(v * 100 + 0.5) / 100)


def backoff_ms(attempt: Column) -> Column:
    """2 s doubled for each attempt after the first, 30 s at most."""
    return F.least(F.lit(2000.0) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(30000.0)).cast("long")
