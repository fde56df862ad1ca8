"""Membership: an ordered fold of change events per node, its timers and summaries.

Events are rows (id, seq, state, incarnation, address, capacity, used,
pressured); states are 0 alive, 1 suspect, 2 dead, 3 left. The fold depends on
arrival order, so a node's events are folded in one task, in order of seq;
nodes run in parallel. The streaming twin is in tidemark.streaming.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.levels import version_class

from tidemark.functions.levels import STATES

DEAD = 2
SCHEMA = "id string, state int, incarnation long, address string, capacity long, used long, pressured boolean, changed_seq long, changes long"


class Member(NamedTuple):
    state: int
    incarnation: int
    address: str
    capacity: int
    used: int
    pressured: bool
    changed_seq: int
    changes: int = 1


def folded(cur: Member | None, ev, local: bool = False) -> Member | None:
    """The member after one event; the same object if the event changes nothing.

    A node that is not known is not learned from a report of its end. Of two
    claims the greater incarnation wins, then the worse state; an equal claim
    only brings capacity figures. Empty addresses and zero capacities keep what
    is known. The local node outbids every claim about itself.
    """
    if local and cur is not None:
        if ev.state == 0 and ev.incarnation <= cur.incarnation:
            return cur
        return cur._replace(state=0, incarnation=max(cur.incarnation, ev.incarnation + 1), changed_seq=ev.seq, changes=cur.changes + 1)
    if cur is None:
        if ev.state >= DEAD:
            return None
        return Member(ev.state, ev.incarnation, ev.address or "", ev.capacity, ev.used, bool(ev.pressured), ev.seq)
    newer = ev.incarnation > cur.incarnation or (ev.incarnation == cur.incarnation and ev.state > cur.state)
    figures = (ev.capacity, ev.used, bool(ev.pressured)) if ev.capacity > 0 else (cur.capacity, cur.used, cur.pressured)
    if newer:
        return Member(ev.state, ev.incarnation, ev.address or cur.address, *figures, ev.seq, cur.changes + 1)
    if (ev.incarnation, ev.state) == (cur.incarnation, cur.state) and figures != (cur.capacity, cur.used, cur.pressured):
        return cur._replace(capacity=figures[0], used=figures[1], pressured=figures[2], changes=cur.changes + 1)
    return cur


def fold_events(events: DataFrame, local: str | None = None) -> DataFrame:
    """Member table after all events. Events with a null or empty id are ignored."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cur = None
        for ev in pdf.sort_values("seq").itertuples():
            cur = folded(cur, ev, ev.id == local)
        rows = [] if cur is None else [(pdf["id"].iloc[0], *cur)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return events.where("id <> ''").groupBy("id").applyInPandas(run, SCHEMA)


def latest_claims(events: DataFrame) -> DataFrame:
    """(id, incarnation, state): the part of the fold that does not depend on order, as one aggregation.

    Exact where no node's first event reports its end.
    """
    return events.where("id <> ''").groupBy("id").agg(F.max(F.struct("incarnation", "state")).alias("c")).select("id", "c.incarnation", "c.state")


def prune(members: DataFrame, cutoff: Column, local: str | None = None) -> DataFrame:
    """Members without those that ended before ``cutoff`` (by changed_at); the local node stays."""
    gone = (F.col("state") >= DEAD) & (F.col("changed_at") < cutoff)
    return members.where(~gone | (F.col("id") == F.lit(local or "")))


def alive_peers(members: DataFrame, local: str) -> DataFrame:
    return members.where((F.col("state") == 0) & (F.col("id") != local))


def state_counts(members: DataFrame) -> DataFrame:
    """(state, n) for all four states, 0 where there is none."""
    spark = members.sparkSession
    every = spark.createDataFrame([(i, s) for i, s in enumerate(STATES)], "state int, label string")
    return every.join(members.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def capacity_skew(members: DataFrame) -> DataFrame:
    """One row: largest minus smallest used share of members with a capacity; 0 for fewer than two."""
    share = F.when(F.col("capacity") > 0, F.col("used") / F.col("capacity"))
    return members.agg(F.when(F.count(share) >= 2, F.max(share) - F.min(share)).otherwise(0.0).alias("skew"))


def admitted(messages: DataFrame, me: str, ours: int, oldest: int) -> tuple[DataFrame, DataFrame]:
    """(events, verdicts) of gossip messages (id, sender, proto, incarnation, events).

    A message that bears this node's own name, or comes from a protocol under
    ``oldest``, is dropped whole. Of the others all events are taken, and the
    sender itself as alive. Verdicts are impersonation, too-old, newer and compatible.
    """
    verdict = F.when(F.col("sender") == me, "impersonation").otherwise(version_class(F.col("proto"), ours, oldest))
    judged = messages.withColumn("verdict", verdict)
    taken = judged.where(~F.col("verdict").isin("impersonation", "too-old"))
    carried = taken.select(F.col("id").alias("message"), F.inline("events"))
    own = taken.where("sender <> ''").select(F.col("id").alias("message"), F.col("sender").alias("node"), F.lit(0).alias("state"), "incarnation")
    return carried.select("message", "node", "state", "incarnation").unionByName(own), judged.select("id", "verdict")


def with_self(members: DataFrame, me: str) -> DataFrame:
    """Alive members and the node itself, whatever its state; placement sees these, by id."""
    return members.where((F.col("state") == 0) | (F.col("id") == me)).orderBy("id")


def ring_signature(members: DataFrame) -> DataFrame:
    """One row: ids in order with their weights above 1; changes when the ring has to be built again."""
    each = F.concat("id", F.when(F.coalesce("weight", F.lit(1)) > 1, F.concat(F.lit(":"), F.col("weight").cast("string"))).otherwise(""), F.lit(","))
    return members.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", each.alias("t")))), lambda x: x["t"]), "").alias("signature"))  # the member list
