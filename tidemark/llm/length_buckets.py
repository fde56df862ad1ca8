"""Optimal length buckets and token-budget batches (operator 7).

The global histogram of token counts goes to the driver: one row per length up
to FINE and per cell beyond, with the greatest length in it, under 11,000 rows
for lengths of any size. Dynamic programming chooses the bucket bounds that
minimise padding; they are lengths that occur, so the optimum is exact where no
document is longer than FINE. Batches of at most a token budget are then formed inside each
bucket, in parallel: a bucket is cut in parts of about equal size, rows are
numbered within their part, and the sizes of the parts before it complete the
number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import token_lengths
from tidemark.llm.common import table, written

#: Lengths up to FINE are cells of the histogram; beyond, a cell is 1/32 of a power of two.
FINE = 8192
BUCKETS = 16
TOKEN_BUDGET = 65536
#: Rows of a part of a bucket.
PART_ROWS = 20_000


def cell_of(length: Column) -> Column:
    """Lower end of the histogram cell of a length."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 5)
    return F.when(length <= FINE, length).otherwise(F.floor(length / step) * step).cast("long")


def optimal_bounds(cells: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets of ascending ``cells`` with the least padded size.

    Padded size is the sum over buckets of rows times bound. Costs satisfy the
    quadrangle inequality, so each layer is solved by divide and conquer. Ties
    take the earliest split; fewer buckets are used if more do not help.
    """
    n = len(cells)
    if n == 0:
        return []
    upto = np.concatenate([[0], np.cumsum(rows.astype(np.int64))])
    best = cells * upto[1:]
    back = [np.zeros(n, np.int64)]
    layers = [best]
    for _ in range(1, min(buckets, n)):
        new, arg = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            mid = (a + b) // 2
            js = np.arange(lo, min(hi, mid) + 1)  # the last bucket holds cells j..mid
            before = np.where(js > 0, layers[-1][js - 1], 0)
            cost = before + cells[mid] * (upto[mid + 1] - upto[js])
            k = int(np.argmin(cost))
            new[mid], arg[mid] = cost[k], js[k]
            todo += [(a, mid - 1, lo, int(js[k])), (mid + 1, b, int(js[k]), hi)]
        layers.append(new)
        back.append(arg)
    layer = int(np.argmin([x[-1] for x in layers]))
    out, at = [], n - 1
    while at >= 0:
        out.append(int(cells[at]))
        at, layer = int(back[layer][at]) - 1, layer - 1
        if layer < 0:
            break
    return out[::-1]


def length_buckets(docs: DataFrame, keep: list[str], length: Column, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Columns ``keep`` with __length, __bucket (padded length) and __batch for every row.

    A batch has one bucket and at most ``budget`` padded tokens, or one row that
    is longer by itself. Batch numbers start at 0 in each bucket. A null length
    counts as 0. Rows that are equal in ``keep`` and length are interchangeable.
    An empty table gives an empty result.
    """
    sized = written(docs.select(*keep, F.coalesce(length, F.lit(0)).cast("long").alias("__length")), "lengths")
    cells = sized.groupBy(cell_of(F.col("__length")).alias("cell")).agg(F.max("__length").alias("most"), F.count("*").alias("n"))
    histogram = sorted((r["most"], r["n"]) for r in cells.collect())
    bounds = optimal_bounds(np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64), buckets)
    rows_in = {b: sum(n for c, n in histogram if lo < c <= b) for lo, b in zip([-1, *bounds], bounds)}
    bucket = F.lit(None).cast("long")
    parts = F.lit(1)
    for b in reversed(bounds):
        bucket = F.when(F.col("__length") <= b, F.lit(b)).otherwise(bucket)
        parts = F.when(F.col("__bucket") == b, F.lit(-(-rows_in[b] // PART_ROWS))).otherwise(parts)
    dealt = sized.withColumn("__bucket", bucket.cast("long")).withColumn("__part", F.pmod(F.xxhash64(*keep, "__length"), parts.cast("long")))
    before = Window.partitionBy("__bucket").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy("__bucket", "__part").agg(F.count("*").alias("__n")).select("__bucket", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__bucket", "__part").orderBy("__length", *keep)
    numbered = dealt.withColumn("__i", F.row_number().over(within) - 1).join(start, ["__bucket", "__part"])
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("__bucket"), F.lit(1))))
    return numbered.select(*keep, "__length", "__bucket", F.floor((F.col("__i") + F.col("__start")) / per_batch).cast("long").alias("__batch"))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE tokens (with one end token), bucket and batch of every document."""
    got = length_buckets(token_lengths(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"], F.col("__n_tokens"))
    return got.select("doc_id", F.col("__length").alias("n_tokens"), F.col("__bucket").alias("bucket_length"), F.col("__batch").alias("batch"))
