from __future__ import annotations

import math

import pytest

from quirelake.operators import bm25, contracts


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def test_hand_computed_score(spark):
    rows = bm25.retrieve(frame(spark, ["road road spending", "road infrastructure"]), ask(spark, "road")).collect()
    assert [r.passage_id for r in sorted(rows, key=lambda r: r["rank"])] == [0, 1]
    first = next(r for r in rows if r["rank"] == 1)
    assert first.score == pytest.approx(math.log(1.2) * (2 / 3.725) * 2.5, abs=1e-8)


@pytest.mark.parametrize("options", [{}, {"k1": 0.4}, {"b": 0.0}, {"b": 1.0}, {"deduplicate": False}])
def test_both_ways_agree(spark, monkeypatch, options):
    texts = ["a b c", "a a b", "c d e f", "A B C!", "", "straße", "strasse e", "d d d d", None]
    queries = ["a b", "e f strasse", "zzz", "", "c c c"]
    local = {tuple(r) for r in bm25.retrieve(frame(spark, texts), ask(spark, *queries), 2, **options).collect()}
    monkeypatch.setattr(bm25, "DENSE_CELLS", 0)
    joined = {tuple(r) for r in bm25.retrieve(frame(spark, texts), ask(spark, *queries), 2, **options).collect()}
    assert local == joined and local


def test_repeated_terms_do_not_raise_the_score(spark):
    base = frame(spark, ["a b", "c"])
    once, often = (bm25.retrieve(base, ask(spark, q)).head().score for q in ("a", "a a A"))
    assert once == often


def test_copies_go_before_the_cut(spark):
    found = bm25.retrieve(frame(spark, ["x y", "X, y", "x z", "w"]), ask(spark, "x"), 2).collect()
    assert {(r["rank"], r.passage_id) for r in found} == {(1, 0), (2, 2)}


def test_string_ids_tie_by_code_point(spark):
    base = spark.createDataFrame([("b", "x 1"), ("a", "x 2"), ("é", "x 3"), ("z", "y")], "passage_id string, text string")
    found = bm25.retrieve(base, ask(spark, "x")).collect()
    assert [r.passage_id for r in sorted(found, key=lambda r: r["rank"])] == ["a", "b", "é"]


def test_empty_corpus_and_questions(spark):
    none = frame(spark, ["x"]).limit(0)
    assert bm25.retrieve(none, ask(spark, "x")).count() == 0
    assert bm25.retrieve(frame(spark, ["x"]), ask(spark, "...")).count() == 0
    assert bm25.retrieve(frame(spark, ["", None]), ask(spark, "x")).count() == 0


@pytest.mark.parametrize("bad", [{"k1": 0.0}, {"k1": float("inf")}, {"k1": True}, {"b": 1.5}, {"k": 0}, {"k": True}])
def test_bad_parameters(spark, bad):
    with pytest.raises(ValueError):
        bm25.retrieve(frame(spark, ["x"]), ask(spark, "x"), **bad)


def test_contract_of_results(spark):
    good = bm25.retrieve(frame(spark, ["a b", "a c", "a a", "d"]), ask(spark, "a b c"), 3)
    assert contracts.retrieval_violations(good, 3).count() == 0
    bad = spark.createDataFrame([(0, 1, 1.0, 1, "m"), (0, 2, 2.0, 3, "n"), (0, 2, float("nan"), 4, "m")], "query_id long, passage_id long, score double, rank int, retrieval_method string")
    found = {r.problem for r in contracts.retrieval_violations(bad, 3).collect()}
    assert {"rank_gap", "score_order", "not_finite", "duplicate_passage", "mixed_methods", "beyond_k"} <= found


def test_terms_are_counted_in_their_row(spark):
    """F8: no task holds the pairs of passages and terms that it reads; a repeated id counts as one passage."""
    rows = [(1, "b a b ß"), (2, None), (3, ""), (1, "a c"), (4, "d"), (None, "x x")]
    found = bm25.term_frequencies(spark.createDataFrame(rows, "passage_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", 2), (1, "b", 2), (1, "c", 1), (1, "ss", 1), (4, "d", 1), (None, "x", 2)], key=str)
    assert found.dtypes == [("passage_id", "bigint"), ("term", "string"), ("tf", "bigint")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "term" not in "".join(line.split("functions")[0] for line in plan.splitlines() if "Aggregate(" in line)


def test_strict_tokens_in_slices(spark):
    """the tokens of few texts are Python objects at once, whatever the size of a batch."""
    from pyspark.sql import functions as F

    from quirelake.functions import text as T

    rows = [(k, None if k % 7 == 0 else f"Straße ﬁ{k}, x²") for k in range(2 * T.CUT_AT_ONCE + 5)]
    got = spark.createDataFrame(rows, "k long, t string").coalesce(1).select("k", T.strict_tokens(F.col("t")).alias("ts")).collect()
    assert {r.k: r.ts for r in got} == {k: [] if t is None else ["strasse", f"fi{k}", "x2"] for k, t in rows}
