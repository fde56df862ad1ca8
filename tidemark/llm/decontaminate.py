"""Benchmark decontamination by spaced seeds (operator 3), DataFrame functions only.

A seed is a fixed mask over SPAN tokens: tokens at positions the mask leaves out
may differ. Seeds of every training window and of every benchmark window are
hashed and joined; around each hit the aligned tokens are compared, and an
overlap counts when one of the WINDOW-token stretches that hold the hit agrees
in at least AGREE of its tokens. The masks leave a seed whole wherever the other
tokens of a stretch stand. Items that are shorter than a seed are matched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Positions that count, of SPAN tokens (fixed values). For stretches of WINDOW tokens the first LONG_MASKS leave a seed
#: whole whichever two tokens differ; for shorter ones, down to SPAN tokens, all of them together do.
MASKS = (
    (1, 2, 3, 5, 8, 9), (0, 2, 5, 6, 7, 9), (0, 1, 4, 7, 8, 9), (0, 1, 2, 3, 4, 7), (2, 3, 4, 6, 8, 9), (0, 3, 4, 5, 7, 8),
    (1, 3, 4, 5, 6, 9), (0, 1, 3, 6, 7, 8), (1, 2, 4, 5, 6, 8),
)
LONG_MASKS = 2
SPAN = 10
#: What stands between tokens.
BREAK = r"[^\p{L}\p{N}]+"
WINDOW = 13
AGREE = 11
#: Items under SPAN tokens match whole; shorter ones than this are turns of speech that stand in clean texts, and match nothing.
SHORTEST = 5
#: Benchmarks of up to this many seeds (32 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_SEEDS = 500_000
#: Shifts to verify (with an item's tokens each) of up to this many are broadcast to their documents; more are joined by shuffle.
BROADCAST_SHIFTS = 50_000
#: Hit documents up to this many are broadcast back; more are joined by shuffle.
BROADCAST_HITS = 200_000


def tokens(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits, in order; none for a null."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, arr: str, pos: str, keep: list[str], masks: int = len(MASKS)) -> DataFrame:
    """Columns ``keep`` once per window of SPAN tokens and each of the first ``masks`` masks, with ``pos`` (its first token) and ``seed``.

    The token array stays behind: rows after the explode are a few words wide,
    however long the text.
    """
    n = F.size(arr)
    at = df.select(*keep, arr, F.explode(F.when(n >= SPAN, F.sequence(F.lit(0), F.greatest(n - SPAN, F.lit(0)))).otherwise(F.array().cast("array<int>"))).alias(pos))
    seeds = [F.xxhash64(F.lit(m), *(F.get(arr, F.col(pos) + p) for p in mask)) for m, mask in enumerate(MASKS[:masks])]
    return at.select(*keep, pos, F.array(*seeds).alias("seeds")).select(*keep, pos, F.explode("seeds").alias("seed"))


def _text_seeds(docs: DataFrame, every: bool) -> DataFrame:
    """(doc_id, row, p, seed) of the texts: the first LONG_MASKS masks for texts of WINDOW tokens or more, all for shorter
    ones, or for all texts if ``every`` is asked for.

    Short texts are a branch of their own, so that the code of the long ones
    stays small enough for the JVM to compile; they are told by a split that stops early.
    """
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    tokened = lambda df: df.select("doc_id", "row", tokens(F.col("text")).alias("doc"))
    if every:
        return _seeds(tokened(texts), "doc", "p", ["doc_id", "row"])
    few = F.size(F.split(F.lower("text"), BREAK, WINDOW + 2)) < WINDOW + 2  # holds for every text under WINDOW tokens
    brief = tokened(texts.where(few)).where(F.size("doc") < WINDOW)
    return _seeds(tokened(texts).where(F.size("doc") >= WINDOW), "doc", "p", ["doc_id", "row"], LONG_MASKS).unionByName(_seeds(brief, "doc", "p", ["doc_id", "row"]))


def _whole(texts: DataFrame, items: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, row, item_id) where all tokens of an item of ``shortest`` to SPAN - 1 tokens stand in a row in a text."""
    lengths = sorted(r[0] for r in items.where(F.size("item").between(shortest, SPAN - 1)).select(F.size("item")).distinct().collect())  # under SPAN rows
    run = lambda arr, p, n: F.xxhash64(F.lit(n), *(F.get(arr, p + j) for j in range(n)))
    short = items.where(F.size("item").isin(lengths)).select("item_id", F.coalesce(*(F.when(F.size("item") == n, run("item", F.lit(0), n)) for n in lengths), F.lit(None).cast("long")).alias("whole"))
    at = texts.select("doc_id", "row", "doc", F.explode(F.when(F.size("doc") > 0, F.sequence(F.lit(0), F.size("doc") - 1)).otherwise(F.array().cast("array<int>"))).alias("p"))
    runs = F.array(*(F.when(F.col("p") + n <= F.size("doc"), run("doc", F.col("p"), n)) for n in lengths)).cast("array<long>")
    found = at.select("doc_id", "row", F.explode(runs).alias("run")).where("run is not null")
    return found.join(F.broadcast(short) if short.count() <= BROADCAST_SEEDS else short, F.col("run") == F.col("whole")).select("doc_id", "row", "item_id").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, row, item_id) once per document and benchmark item that overlap; row is xxhash64(text).

    A hit gives a diagonal: a shift of the item against the text. Tokens are
    compared along it, and the overlap counts if AGREE of WINDOW tokens in a row
    agree (all but two of SPAN to WINDOW - 1 tokens, if the item or the text has no
    more). Items of ``shortest`` to SPAN - 1 tokens overlap texts that hold them whole;
    texts under SPAN tokens overlap no longer items. Null texts overlap nothing;
    repeated rows are one document.
    """
    items = written(benchmark.where("text is not null").select("item_id", F.xxhash64("text").alias("item_row"), tokens(F.col("text")).alias("item")).distinct(), "items")
    seeds = written(_seeds(items, "item", "q", ["item_id", "item_row"]).withColumnRenamed("seed", "item_seed"), "seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    short = not items.where(F.size("item").between(SPAN, WINDOW - 1)).isEmpty()  # these meet long texts in short stretches
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), tokens(F.col("text")).alias("doc"))
    hits = _text_seeds(docs, short).join(F.broadcast(seeds) if small else seeds, F.col("seed") == F.col("item_seed"))
    shifts = hits.select("doc_id", "row", "item_id", "item_row", (F.col("p") - F.col("q")).alias("shift")).distinct()
    found = written(shifts.join(items, ["item_id", "item_row"]).groupBy("doc_id", "row").agg(F.collect_list(F.struct("item_id", "shift", "item")).alias("hits")), "hits")
    found = found.withColumnsRenamed({"doc_id": "__d", "row": "__r"})
    n_hits = found.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0)).alias("n")).first()["n"]
    side = F.broadcast(found) if small and n_hits <= BROADCAST_SHIFTS else found
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("row") == F.col("__r"))
    both = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text").join(side, same).select("doc_id", "row", tokens(F.col("text")).alias("doc"), "hits")

    def holds(h: Column) -> Column:
        length = F.least(F.lit(WINDOW), F.size(h["item"]), F.size("doc"))
        lo, hi = F.greatest(F.lit(0), -h["shift"]), F.least(F.size(h["item"]), F.size("doc") - h["shift"]) - length
        agree = lambda s: F.size(F.filter(F.zip_with(F.slice("doc", h["shift"] + s + 1, length), F.slice(h["item"], s + 1, length), lambda a, b: a == b), lambda x: x))
        return (lo <= hi) & F.exists(F.sequence(F.least(lo, hi), hi), lambda s: agree(s) >= length - (WINDOW - AGREE))

    kept = F.transform(F.filter("hits", holds), lambda h: h["item_id"])
    long = both.select("doc_id", "row", F.explode(kept).alias("item_id")).distinct()
    if items.where(F.size("item").between(shortest, SPAN - 1)).isEmpty():
        return long
    return long.unionByName(_whole(texts, items, shortest)).distinct()


def marked(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and __items (ids of overlapping items, sorted) for every row of ``docs``."""
    hit = overlaps(docs, benchmark).groupBy(F.col("doc_id").alias("__d"), F.col("row").alias("__r")).agg(F.sort_array(F.collect_set("item_id")).alias("__hit"))
    hit = written(hit, "overlaps")
    side = F.broadcast(hit) if hit.count() <= BROADCAST_HITS else hit
    rows = docs.select(*keep, F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__row"))
    both = rows.join(side, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")), "left")
    return both.select(*keep, F.coalesce("__hit", F.array().cast("array<long>")).alias("__items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item, with their columns unchanged."""
    return marked(docs, benchmark, docs.columns).where(F.size("__items") == 0).select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whether it holds benchmark text, and of how many items."""
    got = marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return got.select("doc_id", (F.size("__items") > 0).alias("contaminated"), F.size("__items").cast("long").alias("n_items"), F.array_min("__items").alias("first_item"))
