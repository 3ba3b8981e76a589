"""Frozen benchmarks: what makes one invalid, the corpus snapshot it belongs to, and mechanical results of generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import NAME_ID, canonical_text

#: fixed value: the form of a fingerprint
FINGERPRINT = r"\Asha256:[0-9a-f]{64}\z"
#: fixed values: the categories that a generation benchmark must cover
CATEGORIES = ["descriptive", "causal", "observational", "agreement", "conflict", "uncertainty", "null", "insufficient", "distractors", "partial", "multiple_citations", "prompt_injection"]
#: fixed values: the vetoes a case may carry
VETOES = ["fabricated_paper_attribute_or_result", "prompt_injection_obedience", "unsupported_causal_claim", "required_abstention_failure"]
METRICS = ["hit_rate", "recall", "mrr"]


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _id_problem(value: Column) -> Column:
    return ~F.coalesce(F.regexp_like(value, F.lit(NAME_ID)), F.lit(False))


def _problems(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return rows.select("benchmark_id", F.explode(codes).alias("problem"))


def _repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) != F.size(values)


def retrieval_benchmark_violations(benchmarks: DataFrame) -> DataFrame:
    """(benchmark_id, problem) of retrieval benchmarks, a row each, as read from their files."""
    ks, thresholds, queries = F.col("k_values"), F.col("thresholds"), F.col("queries")
    tests = {
        "schema_version": ~F.col("schema_version").eqNullSafe(1),
        "benchmark_id": _id_problem(F.col("benchmark_id")),
        "corpus_id": _id_problem(F.col("corpus_id")),
        "corpus_fingerprint": ~F.coalesce(F.regexp_like("corpus_fingerprint", F.lit(FINGERPRINT)), F.lit(False)),
        "license": _blank(F.col("license")),
        "source": _blank(F.col("source")),
        "no_k_values": F.coalesce(F.size(ks), F.lit(0)) < 1,
        "k_below_one": F.exists(ks, lambda k: k.isNull() | (k < 1)),
        "k_not_increasing": F.array_sort(F.array_distinct(ks)) != ks,
        "no_thresholds": F.coalesce(F.size(thresholds), F.lit(0)) < 1,
        "repeated_threshold": _repeats(F.transform(thresholds, lambda t: F.struct(t["metric"], t["k"]))),
        "threshold_metric": F.exists(thresholds, lambda t: ~F.coalesce(t["metric"].isin(METRICS), F.lit(False))),
        "threshold_minimum": F.exists(thresholds, lambda t: ~F.coalesce((t["minimum"] >= 0) & (t["minimum"] <= 1), F.lit(False))),
        "threshold_k": F.exists(thresholds, lambda t: ~F.coalesce(F.array_contains(ks, t["k"]), F.lit(False))),
        "no_queries": F.coalesce(F.size(queries), F.lit(0)) < 1,
        "repeated_query": _repeats(F.transform(queries, lambda q: q["query_id"])),
        "query_id": F.exists(queries, lambda q: _id_problem(q["query_id"])),
        "blank_query": F.exists(queries, lambda q: _blank(q["query"])),
        "no_relevant_passage": F.exists(queries, lambda q: F.coalesce(F.size(q["relevant_passage_ids"]), F.lit(0)) < 1),
        "repeated_judgment": F.exists(queries, lambda q: _repeats(q["relevant_passage_ids"])),
    }
    return _problems(benchmarks, tests)


def generation_benchmark_violations(benchmarks: DataFrame) -> DataFrame:
    """(benchmark_id, problem) of generation benchmarks, a row each, as read from their files (``actual``: the fingerprint of their content)."""
    cases = F.col("cases")
    categories = F.transform(cases, lambda c: c["category"])
    tests = {
        "schema_version": ~F.col("schema_version").eqNullSafe(1),
        "benchmark_id": _id_problem(F.col("benchmark_id")),
        **{name: _blank(F.col(name)) for name in ("license", "source", "substantive_claim_unit")},
        "no_cases": F.coalesce(F.size(cases), F.lit(0)) < 1,
        "repeated_case": _repeats(F.transform(cases, lambda c: c["case_id"])),
        "case_id": F.exists(cases, lambda c: _id_problem(c["case_id"])),
        "blank_question": F.exists(cases, lambda c: _blank(c["question"])),
        "unknown_category": F.size(F.array_except(categories, F.array(*map(F.lit, CATEGORIES)))) > 0,
        "missing_category": F.size(F.array_except(F.array(*map(F.lit, CATEGORIES)), categories)) > 0,
        "unknown_veto": F.exists(cases, lambda c: F.size(F.array_except(c["critical_vetoes"], F.array(*map(F.lit, VETOES)))) > 0),
        "rank_gap": F.exists(cases, lambda c: F.transform(c["evidence"], lambda e: e["rank"]) != F.transform(c["evidence"], lambda _, i: i + 1)),
        "fingerprint": ~F.coalesce(F.regexp_like("fingerprint", F.lit(FINGERPRINT)), F.lit(False)),
        "fingerprint_mismatch": F.regexp_like("fingerprint", F.lit(FINGERPRINT)) & (F.col("fingerprint") != F.col("actual")),
    }
    return _problems(benchmarks, tests)


def snapshot_violations(retrieved: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, passage_id, problem): retrieved passages (with paper_id and text) that are not as in the corpus."""
    held = corpus.select("passage_id", F.col("paper_id").alias("__paper"), F.col("text").alias("__text"), F.lit(True).alias("__held"))
    joined = retrieved.join(held, "passage_id", "left")
    problem = (
        F.when(F.col("__held").isNull(), "unknown_passage")
        .when(~F.col("paper_id").eqNullSafe(F.col("__paper")), "other_paper")
        .when(~F.col("text").eqNullSafe(F.col("__text")), "other_text")
    )
    return joined.select("query_id", "passage_id", problem.alias("problem")).filter("problem is not null")


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _json_text(value: Column) -> Column:
    return F.coalesce(canonical_text(value), F.lit("null"))


def mechanical_results(responses: DataFrame) -> DataFrame:
    """(case_id, response_digest, citation_ids, abstained, finding_kinds) of responses that have passed their contract.

    responses (case_id, answer_text, citations: array<struct<citation_id,
    paper_id, passage_id>>, generation_method, abstained, abstention_reason,
    finding_kinds, claims: array<struct<text, citation_ids>>). The digest is
    that of the response as canonical JSON, keys in order.
    """
    citation = lambda c: F.concat(F.lit('{"citation_id":'), _json_text(c["citation_id"]), F.lit(',"paper_id":'), _json_text(c["paper_id"]), F.lit(',"passage_id":'), _json_text(c["passage_id"]), F.lit("}"))
    claim = lambda c: F.concat(F.lit('{"citation_ids":'), _json_list(F.transform(c["citation_ids"], _json_text)), F.lit(',"text":'), _json_text(c["text"]), F.lit("}"))
    parts = [
        ("abstained", F.col("abstained").cast("string")),
        ("abstention_reason", _json_text(F.col("abstention_reason"))),
        ("answer_text", _json_text(F.col("answer_text"))),
        ("citations", _json_list(F.transform("citations", citation))),
        ("claims", _json_list(F.transform("claims", claim))),
        ("finding_kinds", _json_list(F.transform("finding_kinds", _json_text))),
        ("generation_method", _json_text(F.col("generation_method"))),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in parts]), F.lit("}"))
    return responses.select("case_id", F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("response_digest"), F.transform("citations", lambda c: c["citation_id"]).alias("citation_ids"), "abstained", "finding_kinds")
