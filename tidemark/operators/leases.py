"""Single-writer leases as a log of requests: acquire, renew, release, release at a stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lease_outcomes(requests: DataFrame, by: str = "volume", order: str = "seq") -> DataFrame:
    """Adds ``outcome`` and the lease after each request of (by, order, op, holder, stamp, at).

    ``op`` is acquire, renew, release or release_at; ``stamp`` is the clock of the
    request, ``at`` the stamp that release_at asks for. Acquiring always wins.
    Renewing and releasing need the lease's own holder, else the outcome is
    ``held``. release_at frees the lease only if holder and stamp are still the
    lease's; otherwise it is ``kept``, which is no error. Everything else is
    ``ok``. ``lease_holder`` is '' and ``lease_stamp`` the freeing request's once the
    lease is vacant; a vacant lease has no holder that could renew it. Before
    the first acquisition the lease is vacant with a null stamp.

    The fold is two windows: acquisitions cut a volume's requests in terms, and
    a term ends with its first valid release.
    """
    op, holder = F.col("op"), F.col("holder")
    so_far = Window.partitionBy(by).orderBy(order)
    term = Window.partitionBy(by, "__term").orderBy(order)
    whole = term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = term.rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("__term", F.count_if(op == "acquire").over(so_far))
    rows = rows.withColumn("__owner", F.max(F.when(op == "acquire", holder)).over(whole))
    mine = F.col("__owner").isNotNull() & (holder == F.col("__owner")) & (holder != "")
    rows = rows.withColumn("__mine", F.coalesce(mine, F.lit(False)))
    fresh = F.when((op == "acquire") | ((op == "renew") & F.col("__mine")), F.col("stamp"))
    rows = rows.withColumn("__last", F.last(fresh, True).over(before)).withColumn("__fresh", fresh)
    frees = F.col("__mine") & ((op == "release") | ((op == "release_at") & (F.col("at") == F.col("__last"))))
    rows = rows.withColumn("__freed", F.min(F.when(frees, F.struct(F.col(order).alias("o"), F.col("stamp").alias("s")))).over(whole))
    held = F.col("__owner").isNotNull() & (F.col("__freed").isNull() | (F.col(order) <= F.col("__freed.o")))
    done = (op == "acquire") | (F.col("__mine") & held & ((op != "release_at") | (F.col(order) == F.col("__freed.o"))))
    outcome = F.when(F.coalesce(done, F.lit(False)), "ok").when(op == "release_at", "kept").otherwise("held")
    free = F.col("__freed").isNotNull() & (F.col(order) >= F.col("__freed.o"))
    after = F.coalesce(F.col("__fresh"), F.col("__last"))
    rows = rows.withColumns({
        "outcome": outcome,
        "lease_holder": F.when(F.col("__owner").isNull() | free, "").otherwise(F.col("__owner")),
        "lease_stamp": F.when(free, F.col("__freed.s")).otherwise(after),
    })
    return rows.drop("__term", "__owner", "__mine", "__last", "__fresh", "__freed")


def current_leases(requests: DataFrame, by: str = "volume", order: str = "seq") -> DataFrame:
    """(by, lease_holder, lease_stamp) after the last request of each volume."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return lease_outcomes(requests, by, order).withColumn("__i", F.row_number().over(w)).where("__i = 1").select(by, "lease_holder", "lease_stamp")


def idle(leases: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Leases (lease_holder, lease_stamp) with a holder that has not renewed for ``ttl``: a peer may take them over."""
    return leases.where((F.col("lease_holder") != "") & (now - F.col("lease_stamp") > ttl))
