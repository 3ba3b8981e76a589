"""Claim grounding: wording that a claim shares only with papers it does not cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import tokens

METHOD = "cross-paper-leakage-v1"  # fixed value: the label of a verdict

#: fixed values: function words, which identify no paper
FUNCTION_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just may me might more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
).split()
#: fixed values: words in which research talks about itself
DISCOURSE_WORDS = (
    "analysis analyze analyzed analyses approach article author authors conclude concludes data dataset describe described describes discuss discussed discusses document documents effect "
    "effects estimate estimated estimates evidence examine examined examines explore explores find finding findings finds found impact impacts indicate indicates investigate investigates "
    "literature measure measured measures method methods outcome outcomes paper papers provide provides report reported reports research result results review sample show shows showed studied "
    "studies study suggest suggests using work"
).split()


def leaked_terms(claims: DataFrame, evidence: DataFrame, questions: DataFrame, max_source_papers: int = 1) -> DataFrame:
    """(request_id, claim_index, term, position, papers): what leaks into each claim.

    claims (request_id, claim_index, text, citation_ids); evidence (request_id,
    citation_id, paper_id, text); questions (request_id, question). A term leaks
    if no cited paper and not the question has it, and one to
    ``max_source_papers`` other retrieved papers have it. Numerals count.
    """
    if isinstance(max_source_papers, bool) or max_source_papers < 1:
        raise ValueError("max_source_papers must be at least 1")
    ignored = F.array(*map(F.lit, FUNCTION_WORDS + DISCOURSE_WORDS))
    said = claims.select("request_id", "claim_index", F.posexplode(tokens(F.col("text"))).alias("position", "term"))
    said = said.filter(~F.array_contains(ignored, F.col("term"))).groupBy("request_id", "claim_index", "term").agg(F.min("position").alias("position"))
    known = evidence.select("request_id", "paper_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    cited = claims.select("request_id", "claim_index", F.explode("citation_ids").alias("citation_id")).join(evidence.select("request_id", "citation_id", "paper_id"), ["request_id", "citation_id"]).select("request_id", "claim_index", "paper_id").distinct()
    own = cited.join(known, ["request_id", "paper_id"]).select("request_id", "claim_index", "term")
    asked = questions.select("request_id", F.explode(tokens(F.col("question"))).alias("term")).distinct()
    open_ = said.join(own, ["request_id", "claim_index", "term"], "left_anti").join(asked, ["request_id", "term"], "left_anti")
    elsewhere = open_.join(known, ["request_id", "term"])  # papers it cites cannot have it any more
    gathered = elsewhere.groupBy("request_id", "claim_index", "term", "position").agg(F.array_sort(F.collect_set("paper_id")).alias("papers"))
    return gathered.filter(F.size("papers") <= max_source_papers)


def verdicts(claims: DataFrame, leaks: DataFrame) -> DataFrame:
    """(request_id, claim_index, grounded, leaked_terms in claim order, leaked_from_papers sorted, method)."""
    listed = leaks.groupBy("request_id", "claim_index").agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("papers")))).alias("leaked_from_papers"))
    joined = claims.select("request_id", "claim_index").join(listed, ["request_id", "claim_index"], "left")
    papers = dict(leaks.dtypes)["papers"]
    return joined.select(
        "request_id",
        "claim_index",
        F.col("t").isNull().alias("grounded"),
        F.coalesce(F.transform("t", lambda x: x["term"]), F.array().cast("array<string>")).alias("leaked_terms"),
        F.coalesce("leaked_from_papers", F.array().cast(papers)).alias("leaked_from_papers"),
        F.lit(METHOD).alias("method"),
    )


def surviving(claims: DataFrame, citations: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answer of each request from its grounded claims, and the citations that those use."""
    kept = claims.join(judged.filter("grounded").select("request_id", "claim_index"), ["request_id", "claim_index"], "left_semi")
    answer = kept.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_index", "text"))), lambda c: c["text"]), " ").alias("answer_text"))
    used = kept.select("request_id", F.explode("citation_ids").alias("citation_id")).distinct()
    return answer, citations.join(used, ["request_id", "citation_id"], "left_semi")


def citations_by_paper(evidence: DataFrame) -> DataFrame:
    """(request_id, paper_order, paper_id, best_rank, ranks): cited papers by best rank, their passages by rank."""
    grouped = evidence.groupBy("request_id", "paper_id").agg(F.min("rank").alias("best_rank"), F.array_sort(F.collect_list("rank")).alias("ranks"))
    return grouped.withColumn("paper_order", F.row_number().over(Window.partitionBy("request_id").orderBy("best_rank", "paper_id")))


def chat_outcome(requests: DataFrame) -> DataFrame:
    """``requests`` (library_size, matches, abstained, claims, grounded_claims) with outcome and exit_code."""
    outcome = (
        F.when(F.col("library_size") == 0, "empty_library")
        .when(F.col("matches") == 0, "no_matches")
        .when(F.col("abstained"), "abstained")
        .when((F.col("claims") > 0) & (F.col("grounded_claims") == 0), "withheld")
        .otherwise("answered")
    )
    return requests.withColumn("outcome", outcome).withColumn("exit_code", F.when(F.col("outcome") == "answered", 0).otherwise(1))
