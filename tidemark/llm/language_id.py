"""Language identification by a byte convolutional network (operator 9).

Filters of several widths slide over the bytes of fixed-length windows; each
filter's maximum over a window (never below 0) goes into a softmax layer. A
filter is kept as one table per position, byte by channel, so a convolution is
a sum of table rows. The network is trained in numpy with Adam on a bounded
sample of labelled documents; every document is then read whole, window by
window, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.common import small_batches, table, written

WIDTHS = (2, 3, 4)
FILTERS = 20
WINDOW = 128
#: Bound of the training sample: about so many documents per language, windows of each, and documents in all. Every
#: labelled language is learned; with more than SAMPLE_ROWS / SAMPLE_DOCS of them, from fewer documents each.
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 6
SAMPLE_ROWS = 60_000
EPOCHS = 6
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


class Network(NamedTuple):
    langs: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    weights: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    bias: np.ndarray


def _pooled(net: Network, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maxima of all filters for windows ``x`` (n, WINDOW), and where they are."""
    best, where = [], []
    for k, t in zip(WIDTHS, net.tables, strict=True):
        span = x.shape[1] - k + 1
        out = t[0].take(x[:, :span], axis=0)
        for j in range(1, k):
            out += t[j].take(x[:, j : j + span], axis=0)
        at = out.argmax(axis=1)
        where.append(at)
        best.append(np.take_along_axis(out, at[:, None, :], axis=1)[:, 0, :])
    return np.maximum(np.concatenate(best, axis=1), 0), where


def scores(net: Network, x: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages for windows ``x``."""
    best = []
    for k, t in zip(WIDTHS, net.tables, strict=True):
        span = x.shape[1] - k + 1
        out = t[0].take(x[:, :span], axis=0)
        for j in range(1, k):
            out += t[j].take(x[:, j : j + span], axis=0)
        best.append(out.max(axis=1))
    z = np.maximum(np.concatenate(best, axis=1), 0) @ net.weights + net.bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def sample_windows(text: bytes) -> list[bytes]:
    """Up to SAMPLE_WINDOWS windows of a text, evenly spread."""
    n = max(1, -(-len(text) // WINDOW))
    return [text[a * WINDOW : (a + 1) * WINDOW] for a in sorted({i * n // SAMPLE_WINDOWS for i in range(SAMPLE_WINDOWS)})]


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(weighted log loss, its gradients by tables, weights and bias) for windows ``x`` with languages ``y``."""
    pooled, where = _pooled(net, x)
    z = pooled @ net.weights + net.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -float((np.log(p[np.arange(len(y)), y]) * weight).sum())
    p[np.arange(len(y)), y] -= 1
    p *= weight[:, None]
    back = (p @ net.weights.T) * (pooled > 0)
    grads = []
    for i, k in enumerate(WIDTHS):
        g = np.zeros_like(net.tables[i])
        own = back[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(k):
            np.add.at(g[j], (np.take_along_axis(x, where[i] + j, axis=1), np.arange(FILTERS)[None, :]), own)
        grads.append(g)
    return loss, [*grads, pooled.T @ p, p.sum(axis=0)]


def train(windows: list[bytes], langs: list[str], seed: int = 7) -> Network:
    """Fit a network on labelled windows of at most WINDOW bytes; the same windows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    index = {v: i for i, v in enumerate(names)}
    xs, ys = [], []
    for window, lang in zip(windows, langs, strict=True):
        part = _LOWER[np.frombuffer(window[:WINDOW], np.uint8)]
        if len(part) > 24 and rng.random() < 0.3:  # short texts occur too
            part = part[: rng.integers(8, len(part))]
        x = np.full(WINDOW, 32, np.uint8)
        x[: len(part)] = part
        xs.append(x)
        ys.append(index[lang])
    x, y = np.stack(xs), np.array(ys)
    tables = [rng.normal(0, 0.3 / k, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
    weights = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32)
    net = Network(names, tables, weights, np.zeros(len(names), np.float32))
    params = [*tables, weights, net.bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(y, minlength=len(names))
    balance = (len(y) / (len(names) * np.maximum(share, 1))).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 64):
            at = order[a : a + 64]
            grads = _gradients(net, x[at], y[at], balance[y[at]] / len(at))[1]
            step += 1
            for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= 0.01 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return net


def document_scores(net: Network, texts: pa.Array, rows: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """(best language's index, its probability) of each text; every byte is read."""
    data, at = tk.buffers(texts)
    n = np.diff(at)
    windows = np.maximum(1, -(-n // WINDOW))
    first = np.concatenate([[0], np.cumsum(windows)])
    doc = np.repeat(np.arange(len(n)), windows)
    start = at[:-1][doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    size = np.minimum(at[1:][doc] - start, WINDOW)
    padded = np.concatenate([_LOWER[data], np.full(WINDOW, 32, np.uint8)])
    total = np.zeros((len(n), len(net.langs)))
    inside = np.arange(WINDOW)
    for a in range(0, len(doc), rows):
        s, z = start[a : a + rows], size[a : a + rows]
        x = np.where(inside < z[:, None], padded[s[:, None] + inside], np.uint8(32))
        np.add.at(total, doc[a : a + rows], scores(net, x) * (z / WINDOW)[:, None])
    mean = total / np.maximum(n / WINDOW, 1e-9)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1)


def held_out():
    """Documents that are never learned from: crc32 of the id as text is divisible by 5. False for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """Labelled windows of about SAMPLE_DOCS documents of each language that are not held out, chosen by a hash of the id.

    Tasks cut the windows, so what comes to the driver is bounded in bytes too.
    """
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.col("text") != "") & ~held_out())
    able = able.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = written(able.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")), "languages")
    langs = counts.count()
    quota = max(1, min(SAMPLE_DOCS, SAMPLE_ROWS // max(langs, 1)))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("n") < F.lit(quota << 30)
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, i, x, lang) for d, lang, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True) for i, x in enumerate(sample_windows(t.encode()))]
            cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["doc_id", "place", "window", "lang"])

    picked = able.join(F.broadcast(counts) if langs <= SAMPLE_ROWS else counts, F.col("lang") == F.col("of")).where(pick).select("doc_id", "lang", "text")
    rows = sorted(picked.mapInArrow(cut, "doc_id long, place int, window binary, lang string").collect())
    return [bytes(r["window"]) for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, keep: list[str], net: Network) -> DataFrame:
    """Columns ``keep`` with __lang and __score for every row; null texts and texts without a letter are ``und`` with score 0."""
    small = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__has"), F.coalesce("text", F.lit("")).alias("__text"))
    schema = small.select(*keep).schema.add("__lang", "string").add("__score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.langs, UNKNOWN], dtype=object)
        for b in tk.pieces(batches, "__text"):
            has = b.column("__has").to_numpy(zero_copy_only=False)
            best, p = document_scores(net, b.column("__text")) if net.langs else (np.zeros(len(has), np.int64), np.zeros(len(has)))
            known = has & bool(net.langs)
            best, p = np.where(known, best, len(net.langs)), np.where(known, p, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(names[best], pa.string()), pa.array(p, pa.float64())], names=schema.names)

    small_batches(docs.sparkSession)
    return small.mapInArrow(run, schema)


def fitted(docs: DataFrame) -> Network:
    """The network for a table with doc_id, text and lang; without labelled texts one that knows no language."""
    windows, langs = training_sample(docs)
    return train(windows, langs) if windows else Network([], [], np.zeros((0, 0)), np.zeros(0))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    got = identify(docs.withColumn("held_out", held_out()), ["doc_id", "held_out"], fitted(docs))
    return got.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
