"""Quality rules whose thresholds follow the corpus (operator 1).

Every document gets a few measures, each (part + 1) / (whole + 1) of two counts,
so that none is 0. For each measure a quantile sketch is kept per (language,
source): counts over cells whose width grows with the value (its six leading
bits), so a quantile is exact to one part in 32 wherever the values lie, and
sketches of partitions merge by adding counts, in any order, to the same result.

Thresholds come from the sketch's quartiles alone, on a logarithmic scale: a
measure is too high beyond q50 (q50 / q25)^SPREADS and too low under
q50 (q50 / q75)^SPREADS. Each side looks at the other half of the group, so a
fence holds while less than half of a group is junk. Quartiles of small groups
are drawn towards their language's, and a small language's towards the whole
corpus'. The fences are joined back to the documents, which are then filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit as tk
from tidemark.llm.common import small_batches, table, written

#: Measures: part, whole, and the sides that are bounded: "hi", "lo" or both.
MEASURES = {
    "symbols": ("n_symbols", "word_chars", "hi"),
    "dup_lines": ("n_dup_lines", "n_words", "hi"),
    "repeats": ("n_repeat_words", "n_words", "hi"),
    "capitals": ("n_upper", "word_chars", "hi"),
    "marks": ("n_marks", "word_chars", "hi"),
    "word_length": ("word_chars", "n_words", "hi lo"),
    "line_length": ("n_words", "n_lines", "lo"),
}
#: Measures are kept as whole numbers of 1 / SCALE.
SCALE = 1 << 20
#: Spreads (from the median to a quartile, as a factor) between the median and a fence; if measures were log-normal, four standard deviations.
SPREADS = 6
#: Documents that the level above a group weighs as much as.
PRIOR = 50
MIN_WORDS = 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'-"]] = True


def _repeated(key: np.ndarray, later_only: bool) -> np.ndarray:
    """Which entries of ``key`` occur twice or more; with later_only, all but the first of each."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    if not later_only:
        out[order[:-1][same]] = True
    return out


def count_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of _COUNTS for each text of an Arrow array; a null counts as empty."""
    w = tk.words(texts)
    n, n_words = len(w.text_at) - 1, np.diff(w.first)
    h, doc = tk.word_hashes(w), w.doc()
    code_points = ~w.space & ((w.data & 0xC0) != 0x80)
    salt = tk.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    wh, at = tk.window_hashes(h, w.first, 3)
    hit = at[_repeated(wh + salt[doc[at]], later_only=False)]
    repeat = tk.covered(hit, 3, len(h))
    # lines end at a newline or at the end of their text
    newline = np.append(np.flatnonzero(w.data == 10), len(w.data))
    starts = np.union1d(newline[:-1] + 1, w.text_at[:-1])
    starts = starts[starts < len(w.data)]
    line_doc = np.searchsorted(w.text_at, starts, "right") - 1
    ends = np.minimum(newline[np.searchsorted(newline, starts)], w.text_at[line_doc + 1])
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[has_word], ends[has_word], line_doc[has_word]
    dup = _repeated(tk.span_hashes(w.data, starts, ends) + salt[line_doc], later_only=True)
    per_byte = lambda x: tk.sums_in(x, w.text_at)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": per_byte(code_points),
        "n_symbols": per_byte(_SYMBOL[w.data]),
        "n_dup_lines": np.bincount(line_doc[dup], minlength=n).astype(np.int64),
        "n_repeat_words": tk.sums_in(repeat, w.first),
        "n_lines": np.bincount(line_doc, minlength=n).astype(np.int64),
        "n_upper": per_byte(_UPPER[w.data]),
        "n_marks": per_byte(_MARK[w.data]),
    }


#: Fence tables up to this many groups are broadcast (a few MB); larger ones are joined by shuffle.
BROADCAST_GROUPS = 50_000


def quality_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and a struct ``__q`` with the counts of every document.

    Null and empty texts count as no words. Rows are neither merged nor
    dropped, whatever their ids; other columns of ``docs`` may have any names.
    """
    small = docs.select(*keep, F.col(text_col).alias("__text"))
    counts = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])
    schema = T.StructType([*small.schema.fields[:-1], T.StructField("__q", counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.pieces(batches, "__text"):
            got = count_features(b.column("__text"))
            q = pa.StructArray.from_arrays([pa.array(got[c], pa.int64()) for c in _COUNTS], names=list(_COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], q], names=[*keep, "__q"])

    small_batches(docs.sparkSession)
    return small.mapInArrow(run, schema)


def measure(name: str) -> Column:
    """A measure of ``__q`` in 1 / SCALE, 1 at least."""
    part, whole, _ = MEASURES[name]
    return F.expr(f"greatest(((__q.{part} + 1) * {SCALE}L) div (__q.{whole} + 1), 1L)")


def cell_of(value: Column) -> Column:
    """The least value of the sketch's cell: six leading bits are kept."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def base_failed() -> Column:
    """The fixed rules: under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("__q.n_words") < MIN_WORDS) | (100 * F.col("__q.n_repeat_words") > 50 * F.col("__q.n_words"))


def sketches(features: DataFrame) -> DataFrame:
    """Rows (lang, source, measure, cell, n) over documents that pass the fixed rules.

    Partial sums are made before the shuffle, so a hot source sends at most some
    hundred rows per measure and task. Sketches of two corpora merge by adding n.
    """
    cells = F.array(*(F.struct(F.lit(m).alias("measure"), cell_of(measure(m)).alias("cell")) for m in MEASURES))
    return (
        features.where(~base_failed())
        .select("lang", "source", F.explode(cells).alias("c"))
        .groupBy("lang", "source", F.col("c.measure").alias("measure"), F.col("c.cell").alias("cell"))
        .agg(F.count("*").alias("n"))
    )


def _quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, mid, up, down): logarithms of the median and of its ratios to the lower and from the upper quartile."""
    cells = counts.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    run = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("total", F.sum("n").over(w))
    q = lambda p: F.ln(F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("cell"))).cast("double"))
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("n"), q(0.5).alias("mid"), (q(0.5) - q(0.25)).alias("up"), (q(0.75) - q(0.5)).alias("down"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_hi, <measure>_lo): the greatest and least value that stays.

    Null languages and sources are groups of their own.
    """
    own, of_lang, of_all = (_quartiles(sketch, keys).alias(a) for keys, a in ((["lang", "source"], "o"), (["lang"], "l"), ([], "a")))
    both = own.join(of_lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure"))).join(of_all, F.col("o.measure") == F.col("a.measure"))

    def drawn(c: str) -> Column:
        upper = (F.col("l.n") * F.col(f"l.{c}") + PRIOR * F.col(f"a.{c}")) / (F.col("l.n") + PRIOR)
        return (F.col("o.n") * F.col(f"o.{c}") + PRIOR * upper) / (F.col("o.n") + PRIOR)

    width = F.ln(F.lit(33 / 32))  # a spread is not known better than a cell's width
    hi = F.floor(F.exp(drawn("mid") + SPREADS * F.greatest(drawn("up"), width)) + 0.3)
    lo = F.floor(F.exp(drawn("mid") - SPREADS * F.greatest(drawn("down"), width)) + 0.3)
    each = both.select("o.lang", "o.source", "o.measure", hi.alias("hi"), lo.alias("lo"))
    return each.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m, (_, _, sides) in MEASURES.items() for side in sides.split()))


def _judged(features: DataFrame, keep: list[str], fence: DataFrame) -> DataFrame:
    """Columns ``keep``, __q, __base_failed and __kept of features with __lang and __source."""
    fence = fence.withColumnsRenamed({c: f"__f_{c}" for c in fence.columns})
    side = F.broadcast(fence) if fence.count() <= BROADCAST_GROUPS else fence
    ok = ~base_failed()
    for m, (_, _, sides) in MEASURES.items():
        if "hi" in sides:
            ok = ok & (measure(m) <= F.coalesce(F.col(f"__f_{m}_hi"), measure(m)))
        if "lo" in sides:
            ok = ok & (measure(m) >= F.coalesce(F.col(f"__f_{m}_lo"), measure(m)))
    on = F.col("__lang").eqNullSafe(F.col("__f_lang")) & F.col("__source").eqNullSafe(F.col("__f_source"))
    return features.join(side, on, "left").select(*keep, "__q", base_failed().alias("__base_failed"), ok.alias("__kept"))


def quality_verdicts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, ``__q`` (counts), ``__base_failed`` and ``__kept`` of every row of ``docs``.

    Texts are read once; ``keep`` is written with the counts, so it should be
    narrow. ``docs`` needs lang and source. Groups without a document that
    passes the fixed rules have no fence; their documents all fail anyway. An
    empty table gives an empty result.
    """
    keyed = docs.select(*keep, F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col(text_col).alias("__whole"))
    feats = written(quality_features(keyed, [*keep, "__lang", "__source"], "__whole"), "features")
    sketch = sketches(feats.select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), "__q"))
    return _judged(feats, keep, written(fences(sketch), "fences"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns unchanged. Texts are read twice rather than written a second time."""
    fence = written(fences(sketches(quality_features(docs, ["lang", "source"]))), "fences")
    cols = docs.columns
    keyed = docs.select(*cols, F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("text").alias("__whole"))
    return _judged(quality_features(keyed, [*cols, "__lang", "__source"], "__whole"), cols, fence).where("__kept").select(*cols)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    got = quality_verdicts(table(spark, sf_dir, "documents"), ["doc_id"])
    q = [F.col(f"__q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return got.select("doc_id", *q, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))
