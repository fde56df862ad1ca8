"""Health levels and state labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds (fixed values).
FILL_WARN, FILL_CRIT = 0.8, 0.9
SKEW_WARN_MS, SKEW_CRIT_MS = 500, 2000
OVERDUE_GRACE_MS = 15 * 60 * 1000
STATES = ("alive", "suspect", "dead", "left")
LEVELS = ("healthy", "attention", "degraded")


def state_label(code: Column) -> Column:
    """alive, suspect, dead, left; other codes stay visible as state(n)."""
    out = F.concat(F.lit("state("), code.cast("string"), F.lit(")"))
    for i, name in enumerate(STATES):
        out = F.when(code == i, F.lit(name)).otherwise(out)
    return out


def rank(level: Column) -> Column:
    return F.when(level == "degraded", 2).when(level == "attention", 1).otherwise(0)


def level_of(r: Column) -> Column:
    return F.when(r == 2, "degraded").when(r == 1, "attention").otherwise("healthy")


def usage_ratio(used: Column, capacity: Column) -> Column:
    """used / capacity in [0, 1]; null if the capacity is not known."""
    return F.when(capacity > 0, F.least(F.greatest(used.cast("double") / capacity, F.lit(0.0)), F.lit(1.0)))


def fill_level(ratio: Column) -> Column:
    return F.when(ratio >= FILL_CRIT, "degraded").when(ratio >= FILL_WARN, "attention").otherwise("healthy")


def node_level(state: Column) -> Column:
    return F.when(state == "dead", "degraded").when(state.isin("suspect", "unknown"), "attention").otherwise("healthy")


def skew_level(ms: Column) -> Column:
    return F.when(F.abs(ms) >= SKEW_CRIT_MS, "degraded").when(F.abs(ms) >= SKEW_WARN_MS, "attention").otherwise("healthy")


def replication_kind(alive: Column, factor: Column) -> Column:
    """Null if no replication factor is known."""
    return F.when(factor > 0, F.when(alive >= factor, "healthy").otherwise("degraded"))


def gc_outcome(error: Column) -> Column:
    return F.when(error == "", "ok").when(F.startswith(error, F.lit("skipped:")), "skipped").otherwise("failed")


def gc_skip_reason(error: Column) -> Column:
    return F.when(F.startswith(error, F.lit("skipped:")), F.ltrim(F.substring(error, 9, 1 << 30))).otherwise(error)


def gc_kind(enabled: Column, running: Column, error: Column, last_run: Column) -> Column:
    return F.when(~enabled, "off").when(running, "running").when(error != "", gc_outcome(error)).when(last_run.isNotNull(), "ok").otherwise("never")


def backup_kind(configured: Column, running: Column, run_ok: Column, finished_ms: Column, next_ms: Column, interval_s: Column, now_ms: Column) -> Column:
    """unconfigured, running, failed, overdue, ok or never; ``run_ok`` is null if there was no run."""
    missed = F.coalesce(now_ms - next_ms > OVERDUE_GRACE_MS, F.lit(False))
    old = F.coalesce((interval_s > 0) & (now_ms - finished_ms > 2000 * interval_s), F.lit(False))
    return (
        F.when(~configured, "unconfigured").when(running, "running").when(run_ok.isNotNull() & ~run_ok, "failed")
        .when(missed | old, "overdue").when(run_ok.isNotNull(), "ok").otherwise("never")
    )


def version_class(theirs: Column, ours: int, oldest: int) -> Column:
    """compatible, newer or too-old; 0 counts as 1."""
    v = F.when(theirs == 0, 1).otherwise(theirs)
    return F.when(v < oldest, "too-old").when(v > ours, "newer").otherwise("compatible")


def may_write(capacity: Column, available: Column, size: Column, hard: float = 0.95) -> Column:
    """Write admission: room above the hard mark stays free; unknown usage admits."""
    return F.when(F.coalesce(capacity, F.lit(0)) <= 0, True).otherwise(F.coalesce((available - size) >= capacity * (1 - hard), F.lit(True)))
