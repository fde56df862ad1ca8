"""Byte-level BPE by a public vocabulary file; the path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.common import small_batches

#: Pre-token pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id after the last rank ends a document.
END = 50256
PRE_TOKEN = regex.compile(PATTERN)
_LONG_BLANK = regex.compile(r"\s{5000}")
_CUT = regex.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The encoding of a vocabulary file, once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Token ids of a whole text. Runs of white space too long for the fast pattern are cut into pre-tokens here."""
    e = encoding(path)
    if not _LONG_BLANK.search(text):
        return e.encode_to_numpy(text, disallowed_special=())
    parts = [e.encode_single_token(p) if len(p) == 1 and p.isascii() else e._encode_single_piece(p) for p in PRE_TOKEN.findall(text)]
    return np.array([i for p in parts for i in (p if isinstance(p, list) else [p])], np.uint32)


class Counts(dict):
    """Tokens of each pre-token, kept up to a bound."""

    def __init__(self, path: str = VOCABULARY, most: int = 500_000) -> None:
        self.encoding, self.most = encoding(path), most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = len(self.encoding._encode_single_piece(piece)) if len(piece) > 1 else len(self.encoding.encode_ordinary(piece))
        self[piece] = n
        return n


def token_lengths(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and __n_tokens of every row: tokens of the whole text and one that ends it. Null and empty texts have 1.

    Every executor reads the vocabulary from ``vocabulary``.
    """
    small = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("__text"))
    schema = small.select(*keep).schema.add("__n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.pieces(batches, "__text", 1 << 20):
            n = [len(encode(t, vocabulary)) + 1 for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    small_batches(docs.sparkSession)
    return small.mapInArrow(run, schema)
