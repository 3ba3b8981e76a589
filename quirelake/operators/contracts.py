"""Constraints as queries: each returns the violations, so none is the expected result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _duplicates(rows: DataFrame, keys: list[str], problem: str) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.select(F.lit(problem).alias("problem"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("subject"))


def corpus_violations(papers: DataFrame, passages: DataFrame) -> DataFrame:
    """(problem, subject): repeated ids and ordinals, passages of unknown papers, empty tables."""
    orphans = passages.join(papers.select("paper_id"), "paper_id", "left_anti").select(F.lit("unknown_paper").alias("problem"), F.col("passage_id").cast("string").alias("subject"))
    out = _duplicates(papers, ["paper_id"], "duplicate_paper").union(_duplicates(passages, ["passage_id"], "duplicate_passage")).union(_duplicates(passages, ["paper_id", "ordinal"], "duplicate_ordinal")).union(orphans)
    for rows, name in ((papers, "no_papers"), (passages, "no_passages")):
        out = out.union(rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(name).alias("problem"), F.lit("").alias("subject")))
    return out


def retrieval_violations(results: DataFrame, k: int) -> DataFrame:
    """(query_id, problem) of results (query_id, passage_id, score, rank, retrieval_method)."""
    order = Window.partitionBy("query_id").orderBy("rank")
    row = results.withColumn("nth", F.row_number().over(order)).withColumn("last_score", F.lag("score").over(order)).withColumn("last_id", F.lag("passage_id").over(order))
    tests = {
        "rank_gap": F.col("rank") != F.col("nth"),
        "beyond_k": F.col("rank") > k,
        "not_finite": F.isnan("score") | F.col("score").isin(float("inf"), float("-inf")) | F.col("score").isNull(),
        "score_order": F.col("score") > F.col("last_score"),
        "tie_order": (F.col("score") == F.col("last_score")) & (F.col("passage_id") < F.col("last_id")),
    }
    codes = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    single = row.select("query_id", F.explode(codes).alias("problem"))
    repeated = results.groupBy("query_id", "passage_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("query_id", F.lit("duplicate_passage").alias("problem"))
    mixed = results.groupBy("query_id").agg(F.count_distinct(F.coalesce("retrieval_method", F.lit(""))).alias("n")).filter("n > 1").select("query_id", F.lit("mixed_methods").alias("problem"))
    return single.union(repeated).union(mixed).distinct()


def response_violations(responses: DataFrame, citations: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request_id, problem) of generated responses.

    responses (request_id, answer_text, abstained, abstention_reason); citations
    (request_id, position, citation_id, paper_id, passage_id); claims (request_id,
    claim_index, text, citation_ids); evidence (request_id, rank, paper_id,
    passage_id), cited as ``e`` and its rank.
    """
    named = evidence.select("request_id", "rank", F.concat(F.lit("e"), F.col("rank").cast("string")).alias("citation_id"), F.col("paper_id").alias("true_paper"), F.col("passage_id").alias("true_passage"))
    joined = citations.join(named, ["request_id", "citation_id"], "left")
    order = Window.partitionBy("request_id").orderBy("position")
    joined = joined.withColumn("last_rank", F.lag("rank").over(order))
    tests = {
        "unknown_citation": F.col("rank").isNull(),
        "wrong_paper": F.col("paper_id") != F.col("true_paper"),
        "wrong_passage": F.col("passage_id") != F.col("true_passage"),
        "rank_order": F.col("rank") < F.col("last_rank"),
    }
    out = joined.select("request_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("problem"))
    for keys, name in ((["request_id", "citation_id"], "duplicate_citation"), (["request_id", "paper_id", "passage_id"], "duplicate_reference")):
        out = out.union(citations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("request_id", F.lit(name).alias("problem")))
    used = claims.select("request_id", F.explode("citation_ids").alias("citation_id"))
    out = out.union(used.join(citations.select("request_id", "citation_id"), ["request_id", "citation_id"], "left_anti").select("request_id", F.lit("claim_cites_unknown").alias("problem")))
    out = out.union(claims.filter(F.size("citation_ids") == 0).select("request_id", F.lit("uncited_claim").alias("problem")))
    counts = citations.groupBy("request_id").agg(F.count(F.lit(1)).alias("cited"))
    state = responses.join(counts, "request_id", "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    coupling = {
        "abstained_with_citations": F.col("abstained") & (F.col("cited") > 0),
        "abstained_without_reason": F.col("abstained") & (F.trim(F.coalesce("abstention_reason", F.lit(""))) == ""),
        "reason_without_abstention": ~F.col("abstained") & F.col("abstention_reason").isNotNull(),
        "answer_without_citations": ~F.col("abstained") & (F.col("cited") == 0),
        "empty_answer": F.trim(F.coalesce("answer_text", F.lit(""))) == "",
    }
    return out.union(state.select("request_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in coupling.items()]))).alias("problem"))).distinct()


def stage_violations(analyses: DataFrame, stages: list[str]) -> DataFrame:
    """Analyses whose completed, failed and skipped stages do not partition all stages."""
    listed = F.array_sort(F.concat("completed_stages", "failed_stages", "skipped_stages"))
    return analyses.filter(listed != F.array_sort(F.array(*map(F.lit, stages)))).select("analysis_id")
