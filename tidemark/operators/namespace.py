"""Tree namespaces: name conflicts, closure, paths, listings and live references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import hlc_text
from tidemark.sources.shared import cut


def resolved_children(claims: DataFrame) -> DataFrame:
    """Adds display to live claims (dir, name, inode, tag): the newest claim keeps the name, others get a conflict suffix.

    Equal tags are ordered by inode, so the order is total.
    """
    w = Window.partitionBy("dir", "name").orderBy(F.desc("tag"), F.desc("inode"))
    return claims.withColumn("rank", F.row_number().over(w)).withColumn(
        "display", F.when(F.col("rank") == 1, F.col("name")).otherwise(F.concat("name", F.lit(".conflict-"), hlc_text(F.col("tag"))))
    )


def primary_children(claims: DataFrame) -> DataFrame:
    """(dir, name, inode) that a raw name resolves to."""
    return claims.groupBy("dir", "name").agg(F.max_by("inode", F.struct("tag", "inode")).alias("inode"))


def closure(edges: DataFrame, roots: DataFrame, most_levels: int = 64) -> DataFrame:
    """(node, depth) of everything reachable from ``roots`` (node) over edges (parent, child), with the least depth.

    Breadth first, one join per level; each level is checkpointed, and nodes
    seen before are not followed again, so cycles end. A tree that is deeper than
    ``most_levels`` is an error.
    """
    seen = roots.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for level in range(1, most_levels + 2):
        front = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        front = cut(front)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise ValueError(f"the tree is deeper than {most_levels} levels")


def paths(edges: DataFrame, root: str, most_levels: int = 64) -> DataFrame:
    """(node, path, depth) of all paths from ``root`` over edges (parent, child, name), one join per level.

    The nodes of a path are carried along until the level is done, so cycles
    end. A path of more than ``most_levels`` steps is an error, none is left out.
    """
    spark = edges.sparkSession
    front = spark.createDataFrame([(root, "", 0, [root])], "node string, path string, depth int, chain array<string>")
    found = front.where("depth > 0")
    for _ in range(most_levels + 1):
        step = front.join(edges, front["node"] == edges["parent"]).where(~F.array_contains("chain", F.col("child")))
        front = cut(step.select(F.col("child").alias("node"), F.concat("path", F.lit("/"), "name").alias("path"), (F.col("depth") + 1).alias("depth"), F.array_append("chain", F.col("child")).alias("chain")))
        if front.isEmpty():
            return found.drop("chain")
        found = found.unionByName(front)
    raise ValueError(f"the tree is deeper than {most_levels} levels")


def unreachable(inodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Inodes that no path leads to."""
    return inodes.join(reached.select(F.col("node").alias("inode")).distinct(), "inode", "left_anti")


def live_refs(reached: DataFrame, manifests: DataFrame, extents: DataFrame) -> DataFrame:
    """Distinct chunk ids of reachable manifests (inode, chunk_id) and mapped extents (inode, chunk_id)."""
    keep = reached.select(F.col("node").alias("inode")).distinct()
    refs = manifests.select("inode", "chunk_id").union(extents.where("chunk_id <> ''").select("inode", "chunk_id"))
    return refs.join(keep, "inode", "left_semi").select("chunk_id").distinct()


def listing(claims: DataFrame, directory: Column | str) -> DataFrame:
    """Children of one directory by display name."""
    return resolved_children(claims.where(F.col("dir") == directory)).orderBy("display")
