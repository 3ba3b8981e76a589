"""The stored inverted index against ranking without one."""

from __future__ import annotations

import random

import pytest

from quirelake.operators import bm25, inverted_index
from quirelake.sources.library import Library


def corpus(spark, n, seed=3, start=0):
    """Texts of a skewed vocabulary with copies, blank and null ones."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(40 * n)]
    texts = [" ".join(words[40 * k : 40 * k + rng.randint(1, 40)]) for k in range(n)]
    texts[3], texts[5], texts[7] = None, "", texts[9]
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "passage_id long, text string")


def ask(spark, *more):
    return spark.createDataFrame(list(enumerate(["w1 w2 w3", "w40 w1", "w999999 nothing", "", "w7 w7 w12 w300", "w1", *more])), "query_id long, query string")


def library(spark, tmp_path):
    store = Library(spark, f"file://{tmp_path}/library")
    store.initialise()
    return store


def same(index, passages, questions, **options):
    got = inverted_index.retrieve(index, questions, **options)
    want = bm25.retrieve(passages, questions, **options)
    assert got.columns == want.columns
    left = sorted(map(tuple, got.collect()))
    assert left == sorted(map(tuple, want.collect()))
    return left


@pytest.mark.parametrize("options", [{"k": 3}, {"k": 10, "k1": 0.4, "b": 0.0}, {"k": 2, "deduplicate": False, "b": 1.0}])
def test_index_ranks_as_the_corpus(spark, tmp_path, monkeypatch, options):
    monkeypatch.setattr(inverted_index, "BLOCK", 8)
    monkeypatch.setattr(inverted_index, "SEEDS", 2)
    passages, store = corpus(spark, 300), library(spark, tmp_path)
    inverted_index.extend(store, passages)
    assert same(store, passages, ask(spark), **options)


def test_grown_and_shrunk_index(spark, tmp_path, monkeypatch):
    """Built in three batches, one of them repeated, with passages that come and go: as if built at once."""
    monkeypatch.setattr(inverted_index, "BLOCK", 16)
    passages, other, store = corpus(spark, 200), corpus(spark, 60, seed=8, start=1000), library(spark, tmp_path)
    inverted_index.extend(store, passages.filter("passage_id < 70"))
    inverted_index.extend(store, other)
    inverted_index.extend(store, passages)
    rows = store.table("indexed").count()
    inverted_index.extend(store, passages)
    assert store.table("indexed").count() == rows == 260
    same(store, passages.union(other), ask(spark), k=5)
    before = {f["path"] for f in store.files("postings")}
    inverted_index.remove(store, other)
    inverted_index.remove(store, other)
    assert before < {f["path"] for f in store.files("postings")}  # nothing rewritten
    same(store, passages, ask(spark), k=5)
    with pytest.raises(ValueError):
        inverted_index.extend(store, spark.createDataFrame([(1, "another text")], passages.schema))
    with pytest.raises(ValueError):
        inverted_index.remove(store, spark.createDataFrame([(1, "another text")], passages.schema))


def test_empty_index(spark, tmp_path):
    store = library(spark, tmp_path)
    assert inverted_index.retrieve(store, ask(spark)).count() == 0
    inverted_index.extend(store, corpus(spark, 20).limit(0))
    assert inverted_index.retrieve(store, ask(spark)).count() == 0
    only = spark.createDataFrame([("a", "x y"), ("b", None)], "passage_id string, text string")
    other = library(spark, tmp_path / "other")
    inverted_index.extend(other, only)
    assert [(r.passage_id, r["rank"]) for r in inverted_index.retrieve(other, ask(spark, "x")).collect()] == [("a", 1)]


def test_blocks_are_passed_over(spark, tmp_path, monkeypatch):
    """Passages that repeat a rare word stand in few blocks: the blocks of a common word beside it are not scored."""
    monkeypatch.setattr(inverted_index, "BLOCK", 8)
    rows = [(k, "common filler text " * 5 + ("rare rare rare" if 100 <= k < 104 else "")) for k in range(400)]
    passages, store = spark.createDataFrame([(k, f"{t} u{k}") for k, t in rows], "passage_id long, text string"), library(spark, tmp_path)
    inverted_index.extend(store, passages)
    scored = []
    monkeypatch.setattr(inverted_index, "_scored", lambda index, pairs, *rest, f=inverted_index._scored: (scored.append(pairs.count()), f(index, pairs, *rest))[1])
    asked = ask(spark).limit(0).union(spark.createDataFrame([(1, "common rare")], "query_id long, query string"))
    found = inverted_index.retrieve(store, asked, 3).collect()
    assert sorted(r.passage_id for r in found) == [100, 101, 102]
    assert sum(scored) == inverted_index.SEEDS < 50


def read_bytes(spark):
    return sum(s.getBytesRead() for s in spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_a_batch_reads_its_terms_only(spark, tmp_path):
    """25 questions of rare words read a small part of what the corpus holds."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(60)) for _ in range(8000)]
    passages = spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")
    passages.write.parquet(f"{tmp_path}/corpus")
    passages, store = spark.read.parquet(f"{tmp_path}/corpus"), library(spark, tmp_path)
    inverted_index.extend(store, passages)
    asked = spark.createDataFrame([(k, " ".join(texts[300 * k].split()[:4])) for k in range(25)], "query_id long, query string")
    size = sum(f.stat().st_size for f in (tmp_path / "corpus").rglob("*.parquet"))
    start = read_bytes(spark)
    found = inverted_index.retrieve(store, asked, 1).collect()
    took = read_bytes(spark) - start
    assert {r.query_id: r.passage_id for r in found} == {k: 300 * k for k in range(25)}
    print("read", took, "of", size)
    assert took < size


def test_pushed_filters(spark, tmp_path):
    store = library(spark, tmp_path)
    inverted_index.extend(store, corpus(spark, 50))
    keys = spark.createDataFrame([(f"w{k}",) for k in range(35)], "term string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = store.matching("postings", keys, "term")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.split("PushedFilters: ")[1].split("ReadSchema")[0].count("In(term") == 4
    rows = store.matching("postings", keys, "term").select("term").distinct()
    assert rows.count() == store.table("postings").join(keys, "term", "left_semi").select("term").distinct().count()


def test_a_batch_is_weighed_in_the_blocks(spark, tmp_path, monkeypatch):
    """a batch that may travel is never joined with its postings, of which there are passages times questions; a larger one is, with equal results."""
    passages, store = corpus(spark, 300), library(spark, tmp_path)
    inverted_index.extend(store, passages)
    joined = getattr(inverted_index, "_joined", None)
    monkeypatch.setattr(inverted_index, "_joined", None)
    rows = same(store, passages, ask(spark), k=4)
    monkeypatch.setattr(inverted_index, "_joined", joined)
    monkeypatch.setattr(bm25, "DENSE_CELLS", 0)
    assert rows == same(store, passages, ask(spark), k=4)
