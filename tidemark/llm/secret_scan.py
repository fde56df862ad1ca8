"""Secret scan over an incremental ledger of blobs (operator 4), DataFrame functions only.

Every version of every file is named by the SHA-256 of its text. The ledger is a
Parquet table in the shared folder with one row per blob and rule version that
was scanned, with or without findings. Pairs that it holds are not scanned
again; of the other blobs one copy is scanned by the rules that it lacks,
however many paths hold it, and the ledger grows by these pairs. Findings are
joined back to all paths.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.sources.shared import shared_dir


class Rule(NamedTuple):
    kind: str
    #: Cheap condition that any match fulfils.
    hint: str
    #: The whole match; its first group, if any, is the value.
    pattern: str
    #: Least length of the value (of the match without a group).
    least: int
    has_value: bool = False
    #: A change of the rule needs a new version: every blob is then scanned by it again.
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}-{self.version}"


#: Rules in the order in which kinds are listed.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
)
#: The first BASE rules are the fixed ones.
BASE = 3
#: Findings of up to this many blobs are broadcast to the paths; more are joined by shuffle.
BROADCAST_BLOBS = 100_000
SPANS = "array<struct<start:int,kind:int,end:int>>"
LEDGER = f"blob string, spans {SPANS}, rule string"
#: Parts in which the query brings its table to the ledger, as a history arrives.
INCREMENTS = 2


def rule_spans(text: Column, kind: int, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end) in code points; matches that are too short are dropped.

    The text is taken as what stands before a match, then the match, again and
    again (each match starts where the last one ended); lengths add up to places.
    """
    step = rf"\G((?s:.*?))({rule.pattern})"
    before, match = F.regexp_extract_all(text, F.lit(step), F.lit(1)), F.regexp_extract_all(text, F.lit(step), F.lit(2))
    value = F.regexp_extract_all(text, F.lit(step), F.lit(3)) if rule.has_value else match
    parts = F.zip_with(F.arrays_zip(before.alias("b"), match.alias("m")), value, lambda x, v: F.struct(F.char_length(x["b"]).alias("b"), F.char_length(x["m"]).alias("m"), F.char_length(v).alias("v")))
    none = F.array().cast(SPANS)
    found = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["b"] + x["m"]).alias("at"),
            F.when(x["v"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["b"] + x["m"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(rule.hint), found).otherwise(none)


def new_ledger(spark: SparkSession) -> str:
    """Path of a ledger that is empty yet."""
    return f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows (blob, spans, rule); none if nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan_unseen(versions: DataFrame, ledger: DataFrame, key: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one for each pair of a blob of ``versions`` and a rule version that ``ledger`` lacks.

    A null text is the empty blob. Copies are one blob; repeated rows of the
    copy that is scanned can repeat ledger rows, which readers take as one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = versions.select(F.col(key).alias("key"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    names = F.array(*(F.lit(r.name) for r in rules))
    seen = ledger.where(F.col("rule").isin(*(r.name for r in rules))).groupBy(F.col("blob").alias("known")).agg(F.collect_set("rule").alias("had"))  # a few rules
    blobs = named.groupBy("blob").agg(F.min("key").alias("rep")).join(seen, F.col("blob") == F.col("known"), "left")
    lacks = F.array_except(names, F.coalesce("had", F.array().cast("array<string>")))
    blobs = blobs.select(F.col("blob").alias("unseen"), "rep", lacks.alias("lacks")).where(F.size("lacks") > 0)
    one = named.join(blobs.hint("shuffle_hash"), (F.col("blob") == F.col("unseen")) & F.col("key").eqNullSafe(F.col("rep")))
    done = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.when(F.array_contains("lacks", r.name), rule_spans(F.col("text"), i, r)).alias("spans")) for i, r in enumerate(rules)))
    each = one.select("blob", F.explode(F.filter(done, lambda x: x["spans"].isNotNull())).alias("x"))
    return each.select("blob", "x.spans", "x.rule")


def extend_ledger(versions: DataFrame, path: str, key: str = "doc_id", text_col: str = "text") -> None:
    """Scan what the ledger at ``path`` lacks of ``versions`` and append it."""
    spark = versions.sparkSession
    scan_unseen(versions, read_ledger(spark, path), key, text_col).write.mode("append").partitionBy("rule").parquet(path)


def with_findings(versions: DataFrame, keep: list[str], ledger: str | None = None, key: str = "doc_id", text_col: str = "text", increments: int = 1) -> DataFrame:
    """Columns ``keep`` and __spans for every row of ``versions``: findings of its blob, new or from the ledger.

    ``ledger`` is the path of a ledger, which is extended; without one a new
    ledger is kept in the shared folder. With more ``increments`` the versions
    come to the ledger in so many parts, by a hash of ``key``; the result is the same.
    """
    spark = versions.sparkSession
    path = ledger or new_ledger(spark)
    for i in range(increments):
        extend_ledger(versions if increments == 1 else versions.where(F.pmod(F.xxhash64(key), F.lit(increments)) == i), path, key, text_col)
    found = read_ledger(spark, path).where(F.col("rule").isin(*(r.name for r in RULES)) & (F.size("spans") > 0))
    known = found.groupBy("blob", "rule").agg(F.first("spans").alias("spans")).groupBy(F.col("blob").alias("__blob")).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("__spans"))
    paths = versions.select(*keep, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__of"))
    side = F.broadcast(known) if found.count() <= BROADCAST_BLOBS else known
    return paths.join(side, F.col("__of") == F.col("__blob"), "left").select(*keep, F.coalesce("__spans", F.array().cast(SPANS)).alias("__spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All documents with secrets replaced and n_chars brought up to date; a null text stays null."""
    got = with_findings(docs, docs.columns)
    text = redacted(F.col("text"), F.col("__spans"))
    return got.withColumn("text", text).withColumn("n_chars", F.when(F.size("__spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every document."""
    got = with_findings(table(spark, sf_dir, "documents"), ["doc_id"], increments=INCREMENTS)
    n = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("__spans", lambda s: s["kind"] < BASE)
    counts = [n(i).alias(f"n_{RULES[i].kind}") for i in range(BASE)]
    return got.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"))
