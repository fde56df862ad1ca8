"""Readers and writers: object catalogs, manifests, status snapshots, exposition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import labels_text

#: Bytes that an encrypted chunk has beyond its plain text (fixed value).
OVERHEAD = 96
MANIFEST = "format int, node string, stamp string, started_at string, volumes array<struct<id:string,key:string,size:bigint,sha256:string>>, chunks array<struct<id:string,size:bigint,sha256:string>>"
STATUS = (
    "respondingNodeId string, nodes array<struct<id:string,state:string,address:string,capacityBytes:string,usedBytes:string,pressured:boolean,clockSkewMs:string,lastChangeUnix:string>>, "
    "volumes array<struct<path:string,sizeBytes:string,extents:string,extentSize:string,replicas:array<string>,mapDamaged:boolean,attached:boolean>>, "
    "health struct<aliveNodes:int,replicationFactor:int,isolated:boolean,clockSkewMs:string>, gc struct<enabled:boolean,running:boolean,lastError:string,lastRunUnix:string>"
)


def objects(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(name, size, mtime[, content]) of the files under a path of any Hadoop file system; content is read only if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))


def chunk_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(id, plain_bytes, stored_bytes, created_at) of ``*.chunk`` files."""
    found = objects(spark, root, "*.chunk")
    return found.select(F.regexp_replace("name", r"\.chunk$", "").alias("id"), (F.col("size") - OVERHEAD).alias("plain_bytes"), F.col("size").alias("stored_bytes"), F.col("mtime").alias("created_at"))


def read_capped(spark: SparkSession, root: str, most: int) -> DataFrame:
    """Contents of files of at most ``most`` bytes."""
    return objects(spark, root, content=True).where(F.col("size") <= most)


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (name, content) with ok: size and SHA-256 as in rows (name, size, sha256)."""
    want = expected.select("name", F.col("size").alias("__size"), F.col("sha256").alias("__sha"))
    return files.join(want, "name").withColumn("ok", (F.length("content") == F.col("__size")) & (F.sha2("content", 256) == F.col("__sha"))).drop("__size", "__sha")


def write_manifests(rows: DataFrame, root: str) -> None:
    """Writes manifest rows as JSON, one a line, in a folder for each node: files follow the tasks, not the manifests."""
    rows.select(F.col("node").alias("of"), F.to_json(F.struct("*")).alias("value")).write.partitionBy("of").text(root)


def manifests(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Manifest rows with their key; one unreadable file fails the read.

    A file holds one manifest and the key is its own; with ``lines`` it holds one
    a line, as ``write_manifests`` leaves them, and those of a file share the key.
    """
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("multiLine", not lines).option("recursiveFileLookup", True).json(root).withColumn("key", F.input_file_name())


def entries_with_damage(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, damaged) rows of JSON snapshots and logs; damaged ones keep their text and file."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(root).withColumn("file", F.input_file_name())
    read = read.cache()  # the corrupt-record column alone cannot be queried otherwise
    return read.where("_corrupt_record is null").drop("_corrupt_record"), read.where("_corrupt_record is not null").select("file", F.col("_corrupt_record").alias("text"))


def status(snapshots: DataFrame, column: str = "value") -> DataFrame:
    """Status snapshots from JSON text; 64-bit numbers arrive as strings and malformed snapshots fail."""
    return snapshots.select(F.from_json(column, STATUS, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def status_nodes(decoded: DataFrame) -> DataFrame:
    """Rows (id, state, capacity, used, pressured, skew_ms); states that are not known are ``unknown``."""
    n = decoded.select(F.explode("nodes").alias("n")).select("n.*")
    state = F.lower(F.regexp_replace("state", "^NODE_STATE_", ""))
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    return n.select("id", F.when(state.isin("alive", "suspect", "dead", "left"), state).otherwise("unknown").alias("state"), number("capacityBytes").alias("capacity"), number("usedBytes").alias("used"), F.coalesce("pressured", F.lit(False)).alias("pressured"), number("clockSkewMs").alias("skew_ms"))


def status_volumes(decoded: DataFrame) -> DataFrame:
    """Rows (path, size, written, replicas, map_damaged): written is clamped to the size."""
    v = decoded.select(F.explode("volumes").alias("v")).select("v.*")
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    return v.select("path", number("sizeBytes").alias("size"), F.least(number("extents") * number("extentSize"), number("sizeBytes")).alias("written"), F.coalesce("replicas", F.array().cast("array<string>")).alias("replicas"), F.coalesce("mapDamaged", F.lit(False)).alias("map_damaged"))


def exposition(metrics: DataFrame, order: Column | None = None) -> DataFrame:
    """Text lines (position, line) of metrics (name, kind, help, labels, value): HELP and TYPE once per run of a name."""
    w = Window.orderBy(order if order is not None else F.col("name"), F.to_json("labels"))  # one page of text has one order
    first = F.coalesce(F.lag("name").over(w) != F.col("name"), F.lit(True))
    head = F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"))
    line = F.concat("name", labels_text(F.col("labels")), F.lit(" "), F.col("value").cast("string"))
    numbered = metrics.select(F.row_number().over(w).alias("position"), F.when(first, F.concat(head, F.array(line))).otherwise(F.array(line)).alias("lines"))
    return numbered.select("position", F.explode("lines").alias("line"))


def put_if_absent(new: DataFrame, existing: DataFrame, key: str, path: str) -> DataFrame:
    """Append the rows whose key is not there yet; returns them with the created flag."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    fresh.write.mode("append").parquet(path)
    return fresh.withColumn("created", F.lit(True))
