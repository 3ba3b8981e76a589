"""JSON corpora and benchmarks, and files with their digests."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirelake.functions import text as T
from quirelake.operators import benchmarks
from quirelake.shipping import ship_package

PAPER = "paper_id string, title string, authors array<string>, year int, abstract string, source_name string, source_identifier string, source_url string"
PASSAGE = "passage_id string, paper_id string, text string, section_heading string, page_start int, page_end int, ordinal_position int"

def _struct(fields: str) -> str:
    return "struct<" + ",".join(f"{f.split()[0]}:{f.split()[1]}" for f in fields.split(", ")) + ">"


RETRIEVAL_BENCHMARK = (
    "schema_version int, benchmark_id string, corpus_id string, corpus_fingerprint string, license string, source string, k_values array<int>, "
    "thresholds array<struct<metric:string,k:int,minimum:double>>, queries array<struct<query_id:string,question_type:string,query:string,relevant_passage_ids:array<string>,rationale:string>>"
)


GENERATION_BENCHMARK = (
    "schema_version int, benchmark_id string, license string, source string, substantive_claim_unit string, fingerprint string, "
    "cases array<struct<case_id:string,category:string,question:string,"
    "evidence:array<struct<passage:" + _struct(PASSAGE) + ",score:double,rank:int,retrieval_method:string>>,"
    "semantic_expectations:array<string>,prohibited_claims:array<string>,critical_vetoes:array<string>>>"
)
MANIFEST = (
    "schema_version int, artifact_id string, kind string, version string, source string, license string, redistribution_status string, "
    "expected_size_bytes long, sha256 string, update_policy string, contains_copyrighted_full_text boolean, local_path string"
)


def _objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every file below ``path`` as one object of ``schema``, with file, content and problem: encoding, invalid_json, schema_version or null.

    A path that does not exist is a FileNotFoundError; a file that cannot be
    read fails the job, as its rows would be missing unseen.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem.getCondition()):
            raise FileNotFoundError(path) from problem
        raise
    text = files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = text.withColumn("o", F.when(F.is_valid_utf8("text"), F.from_json("text", schema + ", _corrupt string", options)))
    problem = (
        F.when(~F.is_valid_utf8("text"), "encoding")
        .when(F.col("o").isNull() | F.col("o._corrupt").isNotNull() | ~F.regexp_like("text", F.lit(r"\A\s*\{")), "invalid_json")
        .when(~F.col("o.schema_version").eqNullSafe(F.lit(1)), "schema_version")
    )
    names = [f.split()[0] for f in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", schema)))).split(", ")]
    return read.select("file", "text", *[F.col(f"o.{n}").alias(n) for n in names], problem.alias("problem"))


def _corpus_problem() -> Column:
    """The first constraint that a corpus breaks, or null."""
    papers, passages = F.coalesce("papers", F.array().cast(f"array<{_struct(PAPER)}>")), F.coalesce("passages", F.array().cast(f"array<{_struct(PASSAGE)}>"))
    paper_ids, passage_ids = F.transform(papers, lambda p: p["paper_id"]), F.transform(passages, lambda p: p["passage_id"])
    places = F.transform(passages, lambda p: F.struct(p["paper_id"], p["ordinal_position"]))
    distinct = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    return (
        F.when(~T.is_id(F.col("corpus_id"), T.NAME_ID), "corpus_id")
        .when(F.size(papers) == 0, "no_papers")
        .when(F.size(passages) == 0, "no_passages")
        .when(F.exists(paper_ids, lambda x: ~T.is_id(x, T.PAPER_ID)), "paper_id")
        .when(F.exists(passage_ids, lambda x: ~T.is_id(x, T.PASSAGE_ID)), "passage_id")
        .when(F.exists(passages, lambda p: ~F.regexp_like(F.coalesce(p["text"], F.lit("")), F.lit(rf"(?U)(?!{T.SPACE})[\s\S]"))), "blank_text")
        .when(F.exists(passages, lambda p: ~F.coalesce(p["ordinal_position"] >= 0, F.lit(False))), "ordinal_position")
        .when(~distinct(paper_ids), "duplicate_paper")
        .when(~distinct(passage_ids), "duplicate_passage")
        .when(F.size(F.array_except(F.transform(passages, lambda p: p["paper_id"]), paper_ids)) > 0, "unknown_paper")
        .when(~distinct(places), "duplicate_ordinal")
    )


def read_corpora(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, passages, problems) of all JSON corpora under ``path``.

    problems (file, problem) names what is wrong with a file: encoding,
    invalid_json, schema_version, or the constraint that its content breaks.
    Such files give no rows.
    """
    objects = _objects(spark, path, f"schema_version int, corpus_id string, papers array<{_struct(PAPER)}>, passages array<{_struct(PASSAGE)}>")
    objects = objects.withColumn("problem", F.coalesce("problem", _corpus_problem()))
    good = objects.filter("problem is null")
    return good.select("corpus_id", F.inline("papers")), good.select("corpus_id", F.inline("passages")), objects.filter("problem is not null").select("file", "problem")


def _with_violations(objects: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects without a problem, and (file, problem) of the others."""
    found = objects.filter("problem is null").select("file", "benchmark_id").join(violations.withColumnRenamed("benchmark_id", "__id"), F.col("benchmark_id").eqNullSafe(F.col("__id"))).select("file", "problem")
    problems = objects.filter("problem is not null").select("file", "problem").union(found).distinct()
    return objects.join(problems.select("file"), "file", "left_anti"), problems


def read_retrieval_benchmarks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries, judgments, thresholds, problems) of all JSON retrieval benchmarks under ``path``; files with a problem give no other rows."""
    objects = _objects(spark, path, RETRIEVAL_BENCHMARK)
    good, problems = _with_violations(objects, benchmarks.retrieval_benchmark_violations(objects.filter("problem is null")))
    queries = good.select("benchmark_id", "corpus_id", "corpus_fingerprint", F.inline("queries"))
    judgments = queries.select("benchmark_id", "query_id", F.explode("relevant_passage_ids").alias("passage_id"))
    return queries.drop("relevant_passage_ids"), judgments, good.select("benchmark_id", F.inline("thresholds")), problems


@F.pandas_udf(StringType())
def _content_fingerprint(text: pd.Series) -> pd.Series:
    """sha256 of a benchmark's content, its own fingerprint left out, as canonical JSON. One row a file."""

    def digest(value: str) -> str:
        content = {k: v for k, v in json.loads(value).items() if k != "fingerprint"}
        return "sha256:" + hashlib.sha256(json.dumps(content, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()

    return text.map(digest)


def read_generation_benchmarks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, problems) of all JSON generation benchmarks under ``path``."""
    ship_package(spark)
    objects = _objects(spark, path, GENERATION_BENCHMARK)
    valid = objects.filter("problem is null").withColumn("actual", _content_fingerprint("text"))
    good, problems = _with_violations(objects, benchmarks.generation_benchmark_violations(valid))
    return good.select("benchmark_id", F.inline("cases")), problems


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, problems) of all JSON artifact manifests under ``path``."""
    objects = _objects(spark, path, MANIFEST)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    problem = (
        F.when(~T.is_id(F.col("artifact_id"), T.NAME_ID), "artifact_id")
        .when(blank("version"), "version")
        .when(blank("source"), "source")
        .when(blank("license"), "license")
        .when(~F.coalesce(F.col("expected_size_bytes") > 0, F.lit(False)), "expected_size_bytes")
        .when(~T.is_id(F.col("sha256"), r"\A[0-9a-f]{64}\z"), "sha256")
        .when(blank("local_path") | F.startswith("local_path", F.lit("/")) | F.regexp_like("local_path", F.lit(r"(?:^|/)\.\.(?:/|$)")), "local_path")
    )
    judged = objects.withColumn("problem", F.coalesce("problem", problem))
    return judged.filter("problem is null").drop("problem", "text", "file"), judged.filter("problem is not null").select("file", "problem")


def inspect_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, size, sha256) of all files below ``path``; the content is read, not returned."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def discover_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the PDF files below ``path``, by path."""
    return inspect_files(spark, path, "*.[pP][dD][fF]").orderBy("path")
