"""Token counts that follow edits (operator 6).

A document is kept as blocks of about BLOCK pre-tokens with their sizes in
characters and tokens, summed in a segment tree. An edit re-encodes the blocks
it touches, with a few characters of context before it and until a new pre-token
ends where an old block ended; from there on nothing can have changed. The
blocks' sums, and those of their ancestors, are then updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe
from tidemark.llm import textkit as tk
from tidemark.llm.common import small_batches, table, written
from tidemark.llm.secret_scan import Rule, rule_spans

#: Pre-tokens of a block when it is built.
BLOCK = 64
INTS = T.ArrayType(T.IntegerType())
#: Characters before an edit that a pre-token's end can depend on.
CONTEXT = 3
EDITS = "array<struct<start:int,end:int,text:string>>"


def block_sums(text: str, counts: bpe.Counts) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each block of a text."""
    parts = bpe.PRE_TOKEN.findall(text)
    if not parts:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    at = np.arange(0, len(parts), BLOCK)
    chars = np.fromiter(map(len, parts), np.int32, len(parts))
    tokens = np.fromiter(map(counts.__getitem__, parts), np.int32, len(parts))
    return np.add.reduceat(chars, at), np.add.reduceat(tokens, at)


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Segment tree of sums: node i has children 2i and 2i + 1; leaves fill the last level, padded with 0."""
    size = 1 << max(0, int(len(leaves) - 1).bit_length())
    tree = np.zeros(2 * size, np.int32)
    tree[size : size + len(leaves)] = leaves
    while size > 1:
        level = tree[size : 2 * size]
        tree[size // 2 : size] = level[::2] + level[1::2]
        size //= 2
    return tree


class CountedText:
    """A text with the segment trees of its blocks; ``edit`` keeps both right."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, counts: bpe.Counts) -> None:
        self.text, self.chars, self.tokens, self.counts, self.reencoded = text, chars.copy(), tokens.copy(), counts, 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _find(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character): the block with character ``offset``, the last non-empty one beyond the end."""
        at, first, half = 1, 0, len(self.chars) // 2
        offset = max(0, min(offset, int(self.chars[1]) - 1))
        while at < half:
            at *= 2
            if offset - first >= self.chars[at]:
                first += int(self.chars[at])
                at += 1
        return at, first

    def _put(self, leaf: int, chars: int, tokens: int) -> None:
        dc, dt = chars - int(self.chars[leaf]), tokens - int(self.tokens[leaf])
        while leaf:
            self.chars[leaf] += dc
            self.tokens[leaf] += dt
            leaf >>= 1

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) by ``new``."""
        leaf, first = self._find(start - CONTEXT)
        shift = len(new) - (end - start)
        old = self.text
        self.text = old[:start] + new + old[end:]
        last, bound = leaf, first + int(self.chars[leaf])  # old end of the last block that is re-encoded
        at, tokens, most = first, 0, len(self.chars)
        for m in bpe.PRE_TOKEN.finditer(self.text, first):
            at = m.end()
            tokens += self.counts[m.group()]
            while last + 1 < most and (bound < end or bound + shift < at):  # the edit or a pre-token reaches past this block
                last += 1
                bound += int(self.chars[last])
            if bound >= end and at == bound + shift:
                break
        else:  # up to the end of the text
            while last + 1 < most:
                last += 1
        self.reencoded += at - first
        for i in range(leaf + 1, last + 1):
            if self.chars[i]:
                self._put(i, 0, 0)
        self._put(leaf, at - first, tokens)


def _keyed(docs: DataFrame):
    return docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__r"), F.coalesce("text", F.lit("")).alias("__text"))


def build_trees(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, row, chars, tokens) of every row: segment trees over blocks; element 1 is the total.

    ``row`` is xxhash64(text). Null and empty texts have one empty block.
    """
    keyed = _keyed(docs)
    schema = keyed.drop("__text").withColumnsRenamed({"__d": "doc_id", "__r": "row"}).schema.add("chars", INTS).add("tokens", INTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bpe.Counts(vocabulary)
        for b in tk.pieces(batches, "__text", 1 << 20):
            sums = [block_sums(t, counts) for t in b.column("__text").to_pylist()]
            trees = [pa.array([tree_of(s[i]) for s in sums], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("__d"), b.column("__r"), *trees], names=["doc_id", "row", "chars", "tokens"])

    small_batches(docs.sparkSession)
    return keyed.mapInArrow(run, schema)


def apply_edits(docs: DataFrame, trees: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, row, text, chars, tokens, n_edits, reencoded) of the rows of ``docs`` (doc_id, text, edits) with edits.

    ``edits`` are arrays of EDITS by ascending start that do not overlap, in
    places of the old text. Only texts with edits are shuffled to their trees.
    Repeated rows are one document; documents without a tree are left out.
    """
    same = F.col("d.__d").eqNullSafe(F.col("t.doc_id")) & F.col("d.__r").eqNullSafe(F.col("t.row"))
    keyed = docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__r"), F.coalesce("text", F.lit("")).alias("__text"), F.col("edits").cast(EDITS).alias("edits"))
    keyed = keyed.where(F.size("edits") > 0).dropDuplicates(["__d", "__r"])
    both = keyed.alias("d").join(trees.dropDuplicates(["doc_id", "row"]).alias("t"), same).select("d.__d", "d.__r", "d.__text", "t.chars", "t.tokens", "d.edits")
    schema = both.select(F.col("__d").alias("doc_id"), F.col("__r").alias("row"), F.col("__text").alias("text"), "chars", "tokens").schema.add("n_edits", "long").add("reencoded", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bpe.Counts(vocabulary)
        for b in tk.pieces(batches, "__text", 1 << 20):
            done = []
            for text, chars, tokens, todo in zip(*(b.column(c).to_pylist() for c in ("__text", "chars", "tokens", "edits")), strict=True):
                doc = CountedText(text, np.array(chars, np.int32), np.array(tokens, np.int32), counts)
                for e in reversed(todo):  # from the end, so that earlier places stay as they were
                    doc.edit(e["start"], e["end"], e["text"] or "")
                done.append(doc)
            ints = pa.list_(pa.int32())
            cols = [pa.array([d.text for d in done]), pa.array([d.chars for d in done], ints), pa.array([d.tokens for d in done], ints), pa.array([len(x) for x in b.column("edits").to_pylist()], pa.int64()), pa.array([d.reencoded for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("__d"), b.column("__r"), *cols], names=schema.names)

    small_batches(docs.sparkSession)
    return both.mapInArrow(run, schema)


#: Personal data that the query's edits mask. The hints hold for every match of the patterns.
EMAIL = Rule("email", r"@[A-Za-z0-9.-]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 5)
PHONE = Rule("phone", r"[0-9][0-9 .()-]{7}", r"\+?[0-9][0-9 .()-]{7,}[0-9]", 9)


def mask_edits(text: Column) -> Column:
    """Edits (EDITS) that replace e-mail addresses and telephone numbers; of overlapping ones the first."""
    spans = F.sort_array(F.concat(rule_spans(text, 0, EMAIL), rule_spans(text, 1, PHONE)))
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast(EDITS).alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == 0, "[EMAIL]").otherwise("[PHONE]").alias("text")))).alias("out"))),
        lambda acc: acc["out"],
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as it is and with personal data masked, and how many characters were encoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = written(build_trees(docs), "trees")
    maybe = F.col("text").rlike(EMAIL.hint) | F.col("text").rlike(PHONE.hint)
    changed = apply_edits(docs.where(maybe).withColumn("edits", mask_edits(F.col("text"))), trees)
    n = F.get("tokens", F.lit(1)).cast("long")
    after = changed.select(F.col("doc_id").alias("a_d"), F.col("row").alias("a_r"), n.alias("after"), "n_edits", "reencoded")
    got = trees.select("doc_id", "row", n.alias("n_tokens")).join(after, F.col("doc_id").eqNullSafe(F.col("a_d")) & F.col("row").eqNullSafe(F.col("a_r")), "left")
    return got.select("doc_id", "n_tokens", F.coalesce("n_edits", F.lit(0)).alias("n_edits"), F.coalesce("after", "n_tokens").alias("n_tokens_edited"), F.coalesce("reencoded", F.lit(0)).alias("chars_reencoded"))
