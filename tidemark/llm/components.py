"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for edges (a, b) of longs; comp is the smallest node of the component.

    Null ends, loops and repeated edges are ignored; nodes without an edge do
    not appear. Every round is written to the shared folder, so the plan stays
    short and lost executors cost one round. Rounds grow with the logarithm of
    the longest path.
    """
    e = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == (mark["n"], mark["x"]) or mark["n"] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        seen = (mark["n"], mark["x"])
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        e = written(small.where("a != b").distinct(), "stars")
