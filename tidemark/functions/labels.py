"""Small validators, labels and keys of the storage model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of a run's stamp; least grace in seconds of a retention pass; access modes with one node (fixed values).
STAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z"
MIN_GRACE = 86400
SINGLE_NODE_MODES = ("SINGLE_NODE_WRITER", "SINGLE_NODE_READER_ONLY", "SINGLE_NODE_SINGLE_WRITER", "SINGLE_NODE_MULTI_WRITER")


def inode_type(code: Column) -> Column:
    """0 file, 1 dir, 2 volume; everything else is a file."""
    return F.when(code == 1, "dir").when(code == 2, "volume").otherwise("file")


def hard_exceeded(fraction: Column, hard: Column) -> Column:
    return fraction >= hard


def valid_thresholds(clear: Column, high: Column, hard: Column) -> Column:
    """All in (0, 1], clear below high below hard."""
    return F.coalesce((clear > 0) & (clear < high) & (high < hard) & (hard <= 1), F.lit(False))


def new_capacity(capacity: Column, used: Column, pressured: Column, old_capacity: Column, old_used: Column, old_pressured: Column) -> Column:
    """Whether an event carries a capacity, and one that differs from what is known."""
    same = capacity.eqNullSafe(old_capacity) & used.eqNullSafe(old_used) & pressured.eqNullSafe(old_pressured)
    return F.coalesce(capacity > 0, F.lit(False)) & ~same


def stale(now: Column, next_update: Column) -> Column:
    return F.coalesce(now > next_update, F.lit(False))


def single_node(mode: Column) -> Column:
    return F.coalesce(mode.isin(*SINGLE_NODE_MODES), F.lit(False))


def clean_version(version: Column) -> Column:
    """Characters that manifests do not take become ``_``; at most 64 are kept."""
    return F.substring(F.regexp_replace(version, r"[^A-Za-z0-9.+_-]", "_"), 1, 64)


def run_stamp(name: Column) -> Column:
    """Stamp of ``<stamp>.json`` or ``<stamp>/<file>``; '' for other names."""
    return F.regexp_extract(name, rf"^({STAMP})(?:\.json$|/)", 1)


def stamp(at: Column) -> Column:
    """UTC with milliseconds, as runs are named; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stamp_time(text: Column) -> Column:
    """Inverse of stamp; null for what is no stamp."""
    return F.when(text.rlike(f"^{STAMP}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))


def prune_grace(interval_s: Column) -> Column:
    """Seconds that an object stays without a manifest: twice the interval, a day at least."""
    return F.greatest(2 * interval_s, F.lit(MIN_GRACE)).cast("long")


def duration(seconds: Column) -> Column:
    """Largest unit only: 59s, 3m, 7h, 12d; 0s for less than nothing."""
    of = lambda size, unit: F.concat(F.floor(seconds / size).cast("long").cast("string"), F.lit(unit))
    return F.when(seconds <= 0, "0s").when(seconds < 60, of(1, "s")).when(seconds < 3600, of(60, "m")).when(seconds < 86400, of(3600, "h")).otherwise(of(86400, "d"))


def until(seconds: Column) -> Column:
    """A time to come in its largest unit."""
    return F.when(seconds <= 0, "due now").otherwise(F.concat(F.lit("in "), duration(seconds)))


def switch(text: Column) -> Column:
    """true or false of the usual words; null for others."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False)


def to_int32(n: Column) -> Column:
    """Held to 0 .. 2^31 - 1."""
    return F.greatest(F.least(n, F.lit((1 << 31) - 1)), F.lit(0)).cast("int")


def requested_capacity(required: Column, limit: Column) -> Column:
    """The required bytes, else the limit, of those above 0; 0 without either."""
    return F.coalesce(F.when(required > 0, required), F.when(limit > 0, limit), F.lit(0)).cast("long")


def prefer(a: Column, b: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(F.when(a != "", a), b)


def index_of(items: Column, item: Column) -> Column:
    """Place in an array from 0; -1 if it is absent."""
    return F.coalesce(F.array_position(items, item) - 1, F.lit(-1)).cast("int")


def object_key(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"), name))


def extent_key(node: Column, at: Column, volume: Column) -> Column:
    return F.concat(F.lit("extents/"), node, F.lit("/"), at, F.lit("/"), volume, F.lit(".json"))


def summary(alive: Column, suspect: Column, dead: Column, left: Column) -> Column:
    """Counts per state in a fixed order without zeroes, e.g. `` — 2 alive, 1 suspect``; '' without nodes."""
    parts = F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"))) for n, name in ((alive, "alive"), (suspect, "suspect"), (dead, "dead"), (left, "left"))))
    text = F.array_join(F.array_compact(parts), ", ")
    return F.when(text == "", "").otherwise(F.concat(F.lit(" — "), text))
