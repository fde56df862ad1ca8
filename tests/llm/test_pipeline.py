"""The corpus pipeline against a brute-force version of its stages."""

import collections

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_text_operators import WORD, plain_components
from tidemark.llm import bpe, queries, token_packing
from tidemark.llm.common import table


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else None
    data = sorted(kept["quality"].items())
    groups = {d: c for d, _, c in plain_components(data, 5, 80)}
    assert set(kept["near_duplicates"]) == set(groups.values())
    bench = {tuple(WORD.findall(r["text"].lower())[i : i + 13]) for r in table(spark, sf_dir, "benchmark").collect() for i in range(len(WORD.findall(r["text"])) - 12)}
    exact = {d for d, t in kept["near_duplicates"].items() if any(tuple(WORD.findall(t.lower())[i : i + 13]) in bench for i in range(len(WORD.findall(t)) - 12))}
    assert not exact & set(kept["decontamination"]) and len(kept["near_duplicates"]) - len(kept["decontamination"]) < 2 * len(exact) + 3
    assert set(kept["secrets"]) == set(kept["decontamination"])
    packed = docs.collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in packed) == sorted((d, len(bpe.encode(t)) + 1) for d, t in kept["secrets"].items())
    sizes = collections.Counter((r["bucket_length"], r["batch"]) for r in packed)
    assert all(b * n <= 65536 or n == 1 for (b, _), n in sizes.items())
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, packed)) and ran.where(F.col("batch") < 0).count() == 0


def test_stages_on_awkward_tables(spark, sf_dir, tmp_path):
    """Nulls in any column, empty texts, repeated rows, extra columns with clashing names, and an empty table."""
    from tests.llm.test_text_operators import awkward, docs_of

    import random

    data = awkward(random.Random(5))
    for name, docs in (("awkward", docs_of(spark, data, "clash").withColumns({"item_id": F.lit("x"), "blob": F.lit(0)})), ("empty", docs_of(spark, []))):
        before = docs.count()
        for step, stage in corpus_pipeline.STAGES:
            cols = docs.columns
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{name}-{step}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{step}"))
            assert docs.count() <= before and (step == "packing" or docs.columns == cols)
            before = docs.count()


def test_queries_of_tokens_equal_plain_encoding(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = queries.QUERIES["op6_token_counts"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: len(bpe.encode(t)) for d, t in texts.items()} and len(got) == len(texts)
    edited = [r for r in got if r["n_edits"]]
    assert edited and all(r["chars_reencoded"] > 0 for r in edited) and all(r["n_tokens_edited"] == r["n_tokens"] for r in got if not r["n_edits"])
    rows = queries.QUERIES["op2_token_packing"](spark, sf_dir).collect()
    parts = collections.defaultdict(dict)
    for r in rows:
        ids, places = np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["positions"], np.uint16)
        assert len(ids) == token_packing.CAPACITY and list(r["cu_seqlens"])[0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        for d, k, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            parts[d][k] = ids[a:b]
            assert list(places[a:b]) == list(range(b - a))
    back = {d: np.concatenate([p[k] for k in sorted(p)]) for d, p in parts.items()}
    assert all((back[d] == np.append(bpe.encode(t), bpe.END)).all() for d, t in texts.items()) and len(back) == len(texts)
