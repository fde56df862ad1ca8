"""Consistent-hash placement: ring points, replica walks, weights, steering, quorums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import fnv1a64, fnv1a64_batch, unsigned_order

#: Points per unit of weight, and the largest weight (fixed values).
VNODES = 128
MAX_WEIGHT = 16
#: Rings of up to this many points are sent to every task (16 bytes a point).
MAX_POINTS = 4_000_000


def capacity_weights(nodes: DataFrame, capacity: str = "capacity") -> DataFrame:
    """Adds weight: capacity over the least known one, rounded half up, 1 to 16; 1 where it is not known."""
    known = F.when(F.col(capacity) > 0, F.col(capacity))
    one_row = nodes.agg(F.min(known).alias("__least"))
    weight = F.least(F.lit(MAX_WEIGHT), F.floor((known + F.floor(F.col("__least") / 2)) / F.col("__least")))
    return nodes.crossJoin(F.broadcast(one_row)).withColumn("weight", F.when(F.col(capacity) > 0, weight).otherwise(1).cast("int")).drop("__least")


def ring_points(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(node, vnode, hash) of distinct non-empty nodes; a weight column multiplies their points."""
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(1)), F.lit(1)) if "weight" in nodes.columns else F.lit(1)
    members = nodes.where("node <> ''").groupBy("node").agg(F.max(weight).alias("w"))
    points = members.select("node", F.explode(F.sequence(F.lit(0), F.col("w") * vnodes - 1)).alias("vnode"))
    return points.withColumn("hash", fnv1a64(F.concat("node", F.lit("#"), F.col("vnode").cast("string"))))


def replicas(keys: DataFrame, key: str, points: DataFrame, n: int, out: str = "replicas") -> DataFrame:
    """Adds the first ``n`` distinct nodes clockwise from each key's hash (fewer if the ring has fewer).

    The ring is the cluster's member list times its points: its size is checked
    before it is broadcast (12 bytes a point) to the tasks, where a batch of keys
    is hashed, finds its places by bisection and walks on together. A null key has null.
    """
    spark = keys.sparkSession
    ring = points.orderBy(unsigned_order(F.col("hash")), "node").select("hash", "node").limit(MAX_POINTS + 1).collect()
    if len(ring) > MAX_POINTS:
        raise ValueError(f"the ring has more than {MAX_POINTS} points")
    names, index = np.unique(np.array([r["node"] for r in ring], dtype=object).astype(str), return_inverse=True) if ring else (np.zeros(0, str), np.zeros(0, np.int64))
    sent = spark.sparkContext.broadcast((np.array([r["hash"] for r in ring], np.int64).view(np.uint64), index.astype(np.int32), names.astype(object)))
    wanted = min(n, len(names))

    @F.arrow_udf("array<string>")
    def walk(texts: pa.Array) -> pa.Array:
        hashes, nodes, called = sent.value
        at = np.searchsorted(hashes, fnv1a64_batch(texts), "left") % max(1, len(hashes))
        found = walks(at, nodes, wanted) if wanted else np.zeros((len(at), 0), np.int32)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * wanted
        return pa.ListArray.from_arrays(ends, pa.array(called, pa.string()).take(pa.array(found.ravel())), mask=texts.is_null())

    once = walk.asNondeterministic()  # else a filter that Spark derives from an explode walks a second time
    return keys.withColumn(out, once(F.col(key).cast("string")))


def walks(at: np.ndarray, nodes: np.ndarray, n: int) -> np.ndarray:
    """First ``n`` distinct entries of the circular array ``nodes`` (numbers from 0 without gaps) from each place of ``at``.

    All places step on together; those that still lack nodes after 4 n + 64 steps
    rank all nodes by their next place instead, so a full order costs no walk around the ring.
    """
    size = len(nodes)
    found, count, open_ = np.full((len(at), n), -1, np.int32), np.zeros(len(at), np.int64), np.arange(len(at))
    for step in range(min(4 * n + 64, size)):
        here = nodes[(at[open_] + step) % size]
        new = ~(found[open_] == here[:, None]).any(axis=1)
        found[open_[new], count[open_[new]]] = here[new]
        count[open_[new]] += 1
        open_ = open_[count[open_] < n]
        if not len(open_):
            return found
    order = np.argsort(nodes, kind="stable")
    own = np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1)  # places of each node, ascending
    for a in range(0, len(open_), 1024):
        part = open_[a : a + 1024]
        ahead = np.empty((len(part), len(own)), np.int64)
        for i, places in enumerate(own):
            k = np.searchsorted(places, at[part])
            ahead[:, i] = np.where(k < len(places), places[k % len(places)], places[0] + size)
        found[part] = np.argsort(ahead, axis=1, kind="stable")[:, :n]
    return found


def steer(ordered: Column, n: int, pressured: Column) -> Column:
    """``n`` nodes of a ring order away from pressured ones, keeping a quorum of the natural owners.

    Healthy naturals in order, then pressured naturals until n // 2 + 1 naturals
    are kept, then healthy others, then whatever is left.
    """
    size = F.least(F.lit(n), F.size(ordered))
    natural, rest = F.slice(ordered, 1, F.greatest(size, F.lit(0))), F.slice(ordered, size + 1, F.size(ordered))
    bad = lambda x: F.array_contains(pressured, x)
    healthy = F.filter(natural, lambda x: ~bad(x))
    kept = F.slice(F.filter(natural, bad), 1, F.greatest(F.floor(size / 2).cast("int") + 1 - F.size(healthy), F.lit(0)))
    chosen = F.concat(healthy, kept)
    spare = F.slice(F.filter(rest, lambda x: ~bad(x)), 1, F.greatest(size - F.size(chosen), F.lit(0)))
    first = F.concat(chosen, spare)
    return F.slice(F.array_union(first, ordered), 1, size)


def shortfall(expected: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, rank, node, leader) of missing copies; ``expected`` has replicas arrays, ``held`` rows (key, node).

    The leader is the first holder in placement order; keys without a holder have none.
    """
    holders = held.groupBy(key).agg(F.collect_set("node").alias("__held"))  # at most the nodes of the ring
    both = expected.select(key, "replicas").join(holders, key, "left").withColumn("__held", F.coalesce("__held", F.array().cast("array<string>")))
    has = lambda node: F.array_contains("__held", node)
    each = both.select(key, "__held", F.get(F.filter("replicas", has), F.lit(0)).alias("leader"), F.posexplode("replicas").alias("rank", "node"))
    return each.where(~has(F.col("node"))).select(key, "rank", "node", "leader")


def quorum(acks: DataFrame, key: str) -> DataFrame:
    """(key, acked, targets, committed) of rows (key, ok): a majority of the resolved targets commits."""
    return acks.groupBy(key).agg(F.count_if("ok").alias("acked"), F.count("*").alias("targets")).withColumn("committed", F.col("acked") >= F.floor(F.col("targets") / 2) + 1)


def first_success(reads: DataFrame, key: str, rank: str, ok: str, value: str) -> DataFrame:
    """Value of the lowest-ranked success per key; null if all fail."""
    return reads.groupBy(key).agg(F.min_by(value, F.when(F.col(ok), F.col(rank))).alias("found"), F.bool_or(ok).alias("any_ok")).select(key, F.when(F.col("any_ok"), F.col("found")).alias(value))
