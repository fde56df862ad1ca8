"""Jaccard join on word n-gram sets, as a blocked sparse product (operator 5).

The document by n-gram incidence matrix X is never multiplied out. Columns are
put in one order for all documents, rare n-grams first (frequencies from a
count-min sketch, ties by hash), and split in two blocks: a document's *head*,
its first n - ceil(t n) + 1 n-grams, and the rest. Two sets with Jaccard >= t
share an n-gram of both heads, so the head block alone finds every pair; pairs
are discarded whose sizes and places no longer allow the overlap they need, and
the overlap over all blocks is counted for the pairs that are left.

Documents with equal sets are one row of X. Groups of near copies would still
fill the product with the square of their size, and only components are wanted:

1. Overlaps of the head block are counted for each row and the first row of
   each of its columns. Rows that share several columns with such a row form
   clusters around it. A cluster's *centre* is the set of n-grams that most of
   its members have. A row is then known by its difference from the centre, and
   an overlap within a cluster by two differences: |x ^ y| = |dx| + |dy| - 2 |dx & dy|.
   Pairs that are close without a shared difference are linked through the
   cluster's closest row; others need many shared differences, which a product
   over the (short) differences finds, rare ones first.
2. Pairs of different clusters come from the product of the head block.

Both products run in two rounds: first each row of a column meets one row of it,
and what links is contracted; then rows meet that are still in different
components. A column in m near copies so costs m pairs, not their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import countmin as cm
from tidemark.llm import textkit as tk
from tidemark.llm.common import small_batches, table, written
from tidemark.llm.components import components

MAX_WIDTH = 1 << 24
#: Ids of documents whose sets are needed are broadcast up to this many (some 32 MB); beyond, texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a cluster that one task compares with its pivot.
PART_ROWS = 2_000
#: Labels (24 bytes) are broadcast up to this many; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, node): each text's sorted set, its range in ``hashes`` and a 64-bit name of the set.

    A text with 1 to k - 1 words has one n-gram, all its words; one without has none.
    """
    w = tk.lower_ascii(tk.words(texts))
    h, n = tk.word_hashes(w), np.diff(w.first)
    wh, at = tk.window_hashes(h, w.first, k)
    doc = w.doc()[at]
    short = np.flatnonzero((n > 0) & (n < k))
    for i in short:
        acc = np.uint64(n[i])
        for x in h[w.first[i] : w.first[i + 1]]:
            acc = tk.mix(np.array([acc ^ x], np.uint64))[0]
        wh, doc = np.append(wh, acc), np.append(doc, i)
    order = np.lexsort((wh, doc))
    wh, doc = wh[order], doc[order]
    new = np.ones(len(wh), dtype=bool)
    new[1:] = (wh[1:] != wh[:-1]) | (doc[1:] != doc[:-1])
    wh, doc = wh[new], doc[new]
    first = np.searchsorted(doc, np.arange(len(n) + 1))
    sums = np.zeros(len(wh) + 1, np.uint64)
    np.cumsum(tk.mix(wh ^ np.uint64(0x9FB21C651E98DF25)), out=sums[1:])
    size = np.diff(first)
    node = tk.mix(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return wh, first, node.view(np.int64)


def head_length(n: np.ndarray, t: int) -> np.ndarray:
    """n-grams of a set of n that every partner with 100 * Jaccard >= t shares at least one of."""
    return n - (t * n + 99) // 100 + 1


def _packed(x: np.ndarray) -> bytes:
    """The upper 48 bits of a sorted set's hashes, as compressed gaps."""
    return cm.pack(np.diff(x >> np.uint64(16), prepend=np.uint64(0)))


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(cm.unpack(data, n, np.uint64), dtype=np.uint64)


class Sets:
    """The n-gram sets of nodes, computed again from one document of each where they are needed."""

    def __init__(self, texts: DataFrame, reps: DataFrame, k: int) -> None:
        self.texts, self.reps, self.k = texts.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "text"), reps, k

    def of(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (node and other columns) with ``n`` and ``grams``, the packed set of the node; repeated documents repeat rows."""
        k, other = self.k, [c for c in wanted.columns if c != "node"]
        ids = written(wanted.join(self.reps, "node").select(F.coalesce("doc_id", F.lit(0)).alias("id"), "node", *other), "wanted")
        both = self.texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id").select("node", *other, "text")
        schema = both.drop("text").schema.add("n", "long").add("grams", "binary")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in tk.pieces(batches, "text"):
                wh, first, node = shingle_sets(b.column("text"), k)
                own = np.flatnonzero(node == b.column("node").to_numpy())  # another text may have the same doc_id
                grams = pa.array([_packed(wh[first[i] : first[i + 1]]) for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in b.columns[:-1]), pa.array(np.diff(first)[own]), grams], names=schema.names)

        return both.mapInArrow(run, schema)

    def verified(self, pairs: DataFrame, t: int) -> DataFrame:
        """The pairs (a, b) whose sets overlap enough."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = self.of(nodes)
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "b").select("a", "b", "na", "nb", "ga", "gb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = []
                for i, (m, n, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ga", "gb")), strict=True)):
                    x, y = _unpacked(x, m), _unpacked(y, n)
                    both = np.sort(np.concatenate([x, y]), kind="stable")  # merges two sorted runs
                    n = int((both[1:] == both[:-1]).sum())
                    if 100 * n >= t * (len(x) + len(y) - n):
                        hit.append(i)
                at = pa.array(hit, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

        return both.mapInArrow(run, "a long, b long")


def _pivots(head: DataFrame) -> DataFrame:
    """(node, cluster) of rows that share two columns of the head block or more with the first row of these, ``hub``; ``cluster`` is a row too."""
    counts = head.where("hub != node").groupBy("node", "hub").agg(F.count("*").alias("c")).where("c > 1")
    best = written(counts.groupBy("node").agg(F.max_by("hub", F.struct("c", F.bitwise_not("hub"))).alias("hub")), "hubs")
    pairs = best.select("node", F.col("hub").alias("cluster"))
    for _ in range(2):  # a pivot's own pivot, twice: members of a group mostly meet in one
        up = best.select(F.col("node").alias("cluster"), F.col("hub").alias("up"))
        pairs = pairs.join(up, "cluster", "left").select("node", F.coalesce("up", "cluster").alias("cluster"))
    pairs = pairs.where("node != cluster").unionByName(pairs.select(F.col("cluster").alias("node"), "cluster").distinct())
    return written(pairs.groupBy("node").agg(F.min_by("cluster", F.col("node") != F.col("cluster")).alias("cluster")), "pivots")


def _differences(pairs: DataFrame, sets: Sets) -> DataFrame:
    """(node, cluster, n, diff) of rows that differ in less than half from their pivot.

    Clusters are cut in parts of PART_ROWS members; each part has the pivot once,
    and a task holds one part's pivot and reads the members one after another.
    """
    sizes = pairs.groupBy("cluster").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    got = sets.of(pairs.join(sizes, "cluster").select("node", "cluster", "parts"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = got.select("node", "cluster", "n", "grams", F.explode(F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)).alias("part"))
    dealt = dealt.repartition("cluster", "part").sortWithinPartitions("cluster", "part", F.col("node") != F.col("cluster"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, pivot = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for node, cluster, part, n, grams in zip(*(batch.column(c).to_pylist() for c in ("node", "cluster", "part", "n", "grams")), strict=True):
                x = _unpacked(grams, n)
                if (cluster, part) != at:
                    at, last, pivot = (cluster, part), None, x
                if node == last or (node == cluster and part):  # a repeated document, or a pivot that its first part sends
                    continue
                last, diff = node, np.setxor1d(x, pivot, assume_unique=True)
                if 2 * len(diff) <= len(x) + len(pivot):  # the pivot is of use
                    rows.append((node, cluster, n, diff.view(np.int64)))
            cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["node", "cluster", "n", "diff"])

    return written(dealt.mapInArrow(run, "node long, cluster long, n long, diff array<long>"), "differences")


def _members(pairs: DataFrame, sets: Sets, t: int) -> DataFrame:
    """(node, cluster, n, diff, far, closest, m) of rows in clusters; ``diff`` is the difference from the cluster's centre.

    n-grams in the differences of more than half of the members change sides:
    the centre so has what most members have. ``far`` is (100 + t) |diff| - (100 - t) n:
    two rows of a cluster that share no difference link when their ``far`` add up
    to 0 or less. ``closest`` is the least (far, node) of the cluster, ``m`` its members.
    """
    found = _differences(pairs, sets)
    sizes = found.groupBy("cluster").agg(F.count("*").alias("m"))
    large = written(sizes.where("m > 2"), "large")  # of two rows, one is the pivot without differences
    common = found.join(_small(large), "cluster").select("cluster", "m", F.explode("diff").alias("gram")).groupBy("cluster", "m", "gram").agg(F.count("*").alias("c"))
    flips = common.where("2 * c > m").groupBy("cluster").agg(F.collect_list("gram").alias("flip"))  # at most twice the mean difference
    flips = written(flips, "flips")
    moved = F.when(F.col("flip").isNull(), F.col("diff")).otherwise(F.concat(F.array_except("diff", "flip"), F.array_except("flip", "diff")))
    member = found.join(flips, "cluster", "left").select("node", "cluster", "n", moved.alias("diff"))
    member = written(member.withColumn("far", (100 + t) * F.size("diff") - (100 - t) * F.col("n")), "centred")
    least = member.groupBy("cluster").agg(F.min(F.struct("far", "node")).alias("closest"), F.count("*").alias("m"))
    return written(member.join(least, "cluster"), "members")


def _near_links(member: DataFrame) -> DataFrame:
    """Links of each row to its cluster's closest row, where these two alone are enough.

    Rows that are close to each other without shared differences are both close
    to that row, so their component is complete.
    """
    return member.where((F.col("far") + F.col("closest.far") <= 0) & (F.col("node") != F.col("closest.node"))).select(F.col("node").alias("a"), F.col("closest.node").alias("b"))


def _small(labels: DataFrame) -> DataFrame:
    """``labels`` for a join, broadcast if they are few."""
    return F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels


def _merged(comp: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comp, over): ``comp`` (node, comp) with the links (a, b) added; ``over`` (label, top) are the labels that changed."""
    if links.isEmpty():
        return comp, comp.sparkSession.createDataFrame([], "label long, top long")
    of = lambda end, to: comp.select(F.col("node").alias(end), F.col("comp").alias(to))
    more = links.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    over = written(components(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "over").select(F.col("node").alias("label"), F.col("comp").alias("top"))
    up = comp.join(over, F.col("comp") == F.col("label"), "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return written(up.unionByName(over.select(F.col("label").alias("node"), F.col("top").alias("comp"))), "comps"), over


def _product(rows: DataFrame, key: list[str], first: list[Column], able: Callable[[str, str], Column], verified: Callable[[DataFrame], DataFrame], comp: DataFrame) -> DataFrame:
    """``comp`` with the links of the product of ``rows`` (key, node, comp, other columns) added.

    First every row of a column meets the column's row that is least by ``first``;
    links found are contracted. Then rows meet across components, all but those
    of a column's largest component with each other. ``able`` tells from the
    columns of two rows, by their prefixes, if their overlap can be enough;
    ``verified`` keeps the pairs whose overlap is.
    """
    other = [c for c in rows.columns if c not in key]
    named = lambda side, df: df.select(*key, *(F.col(c).alias(f"{side}{c}") for c in df.columns if c not in key))
    pair = lambda df: df.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    column = Window.partitionBy(*key)
    rank = F.struct(*(c.alias(f"rank{i}") for i, c in enumerate(first)), *other)
    rows = rows.withColumns({"r": F.min(rank).over(column), "lo": F.min("comp").over(column), "hi": F.max("comp").over(column), "m": F.count("*").over(column)})
    rows = written(rows.where("lo < hi").drop("lo", "hi"), "columns")
    if rows.isEmpty():
        return comp
    star = rows.select(*(F.col(c).alias(f"x_{c}") for c in other), *(F.col(f"r.{c}").alias(f"y_{c}") for c in other))
    done = written(pair(star.where((F.col("x_comp") != F.col("y_comp")) & able("x_", "y_"))), "star")
    comp, over = _merged(comp, written(verified(done), "links"))
    rest = rows.where((F.col("m") > 2) & (F.col("node") != F.col("r.node"))).select(*key, *other)  # the column's first row has met all
    rest = rest.join(_small(over), F.col("comp") == F.col("label"), "left").withColumn("comp", F.coalesce("top", "comp")).drop("label", "top")
    top = rest.groupBy(*key, "comp").agg(F.count("*").alias("m")).groupBy(*key).agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count("*").alias("comps"))
    rest = written(rest.join(top.where("comps > 1").drop("comps"), key), "crossing")
    x, y = named("x_", rest.where("comp != most")), named("y_", rest)
    across = (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("y_most")) | (F.col("x_node") < F.col("y_node")))
    left = written(pair(x.join(y, key).where(across & able("x_", "y_"))).join(done, ["a", "b"], "left_anti"), "crossed")
    return comp if left.isEmpty() else _merged(comp, written(verified(left), "links"))[0]


def _difference_links(member: DataFrame, comp: DataFrame, t: int) -> DataFrame:
    """``comp`` with the links within clusters that need shared differences; clusters of two, and those in one component, need none."""
    labelled = member.where("m > 2").join(_small(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = written(labelled.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("cluster"), "apart")
    labelled = labelled.join(_small(apart), "cluster")
    shared = lambda a, b: F.ceil((F.col(a) + F.col(b)) / (2.0 * (100 + t)))  # noqa: E731  so many at least
    each = labelled.select("cluster", "node", "comp", "far", F.size("diff").alias("d"), F.col("closest.far").alias("low"), F.explode("diff").alias("gram"))
    each = each.withColumn("df", F.count("*").over(Window.partitionBy("cluster", "gram")))
    each = each.withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("df", "gram")) - 1)
    each = each.where((F.col("df") > 1) & (F.col("pos") <= F.col("d") - shared("far", "low"))).select("cluster", "gram", "node", "comp", "far", "d", "pos")
    known = member.select("node", "diff", "far")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(known.select(F.col("node").alias("a"), F.col("diff").alias("da"), F.col("far").alias("fa")), "a").join(known.select(F.col("node").alias("b"), F.col("diff").alias("db"), F.col("far").alias("fb")), "b")
        return both.where(F.col("fa") + F.col("fb") <= 2 * (100 + t) * F.size(F.array_intersect("da", "db"))).select("a", "b")

    def able(x: str, y: str) -> Column:
        need = shared(f"{x}far", f"{y}far")
        return (F.col(f"{x}pos") <= F.col(f"{x}d") - need) & (F.col(f"{y}pos") <= F.col(f"{y}d") - need)

    return _product(each, ["cluster", "gram"], [F.col("far"), F.col("node")], able, verified, comp)


def _head_links(head: DataFrame, member: DataFrame, sets: Sets, comp: DataFrame, t: int) -> DataFrame:
    """``comp`` with the links between rows of different clusters, or without one."""
    own = member.select("node", "cluster").unionByName(member.select(F.col("cluster").alias("node"), "cluster")).distinct()
    own = written(own.join(comp, "node", "full"), "labels")
    rows = head.join(_small(own), "node", "left")
    rows = rows.select("gram", "node", "n", "pos", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("comp", "node").alias("comp"))

    def able(x: str, y: str) -> Column:
        xn, yn = F.col(f"{x}n"), F.col(f"{y}n")
        need = F.ceil(t * (xn + yn) / F.lit(100.0 + t))
        fits = (need <= F.least(xn, yn) - (xn == yn).cast("int")) & (F.col(f"{x}pos") <= xn - need) & (F.col(f"{y}pos") <= yn - need)
        return fits & (F.col(f"{x}cluster") != F.col(f"{y}cluster"))

    return _product(rows, ["gram"], [F.col("node") != F.col("cluster"), F.col("node")], able, lambda pairs: sets.verified(pairs, t), comp)


def jaccard_components(docs: DataFrame, k: int = 3, t: int = 90) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) of every row; documents link when 100 * Jaccard >= t.

    component_id is the smallest doc_id that links lead to. Null and texts
    without words have no n-grams and no links. Rows of one doc_id count each
    by its own text. A row without doc_id takes its group's smallest doc_id,
    null if there is none. ``row`` is xxhash64(text). Sets and n-grams are told
    apart by 64-bit hashes, by 48 bits of them within a pair.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    width = cm.width_for((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6, MAX_WIDTH)

    def keys(b: pa.RecordBatch) -> np.ndarray:
        w = tk.lower_ascii(tk.words(b.column("text")))
        return tk.window_hashes(tk.word_hashes(w), w.first, k)[0]

    codes = spark.sparkContext.broadcast(cm.gathered(texts.select("text"), "text", keys, width, cm.as_codes, depth=1))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets that this task has sent; copies are sent once a task
        for b in tk.pieces(batches, "text"):
            wh, first, node = shingle_sets(b.column("text"), k)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((wh, cm.code_of(codes.value, wh, width), doc))
            pos = np.arange(len(wh)) - first[doc]
            fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], dtype=bool)
            able = fresh & (t * (n + 1) <= 100 * n)  # smaller sets have no partner but their copies
            take = (pos < head_length(n, t)[doc]) & able[doc]
            at = np.concatenate([[0], np.cumsum(np.bincount(doc[take], minlength=len(n)))]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(at), pa.array(wh[order][take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n), pa.array(node, mask=n == 0), grams], names=["doc_id", "row", "n", "node", "head"])

    rows = written(texts.mapInArrow(heads, "doc_id long, row long, n long, node long, head array<long>"), "rows")
    head = rows.select("node", F.col("n").cast("int").alias("n"), F.posexplode("head").alias("pos", "gram")).select("gram", "node", "n", "pos")
    head = head.repartition("gram").dropDuplicates(["gram", "node"])
    by_gram = Window.partitionBy("gram")
    head = head.withColumns({"df": F.count("*").over(by_gram), "hub": F.min("node").over(by_gram)})
    head = written(head.where("df > 1").drop("df"), "heads")
    reps = written(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "reps")
    sets = Sets(texts, reps, k)

    member = _members(_pivots(head), sets, t)
    comp = written(components(_near_links(member)), "comps")
    comp = _difference_links(member, comp, t)
    comp = _head_links(head, member, sets, comp, t)
    label = reps.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "comp").select("node", "component_id")
    return rows.select("doc_id", "row", "n", "node").join(label, "node", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicate_filter(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; columns are unchanged.

    Rows without doc_id stay, and so do repeated rows of the document that stays.
    """
    gone = jaccard_components(docs, k, t).where("component_id < doc_id").select(F.col("doc_id").alias("__d"), F.col("row").alias("__r")).distinct()
    keyed = docs.withColumn("__row", F.xxhash64("text"))
    return keyed.join(gone, (F.col("doc_id") == F.col("__d")) & (F.col("__row") == F.col("__r")), "left_anti").select(*docs.columns)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 3-word shingles, Jaccard at least 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90).drop("row")
