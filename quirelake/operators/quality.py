"""Text quality of paged documents: counters, warnings, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import page_counters, ratio

#: fixed values: the thresholds of quality policy 1
EMPTY_RATIO, MIN_TEXT, SPARSE_PAGE, CHARACTER_RATIO, RUN, IMBALANCE_PAGES, IMBALANCE_RATIO, GARBAGE_RATIO, GARBAGE_REPEAT = 0.5, 200, 80, 0.01, 12, 4, 0.8, 0.1, 0.2

#: fixed values: warnings in canonical order
WARNINGS = [
    "no_pages",
    "all_pages_empty",
    "empty_pages",
    "high_empty_page_ratio",
    "very_low_text_volume",
    "sparse_pages",
    "control_characters",
    "replacement_characters",
    "repeated_characters",
    "severe_page_imbalance",
    "extraction_garbage",
]
COUNTERS = ("characters", "non_whitespace", "printable", "controls", "replacements", "repeated")


def page_quality(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """One row a page: the six counters, is_empty and is_sparse."""
    counted = pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page_number"), *[c.cast("long").alias(n) for n, c in page_counters(F.col(text), RUN).items()])
    return counted.withColumns({"is_empty": F.col("non_whitespace") == 0, "is_sparse": (F.col("non_whitespace") > 0) & (F.col("non_whitespace") < SPARSE_PAGE)})


def document_quality(measured: DataFrame) -> DataFrame:
    """One row a document: sums, page counts, extremes and ratios of ``page_quality``."""
    out = measured.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("is_empty").alias("empty_pages"),
        F.count_if("is_sparse").alias("sparse_pages"),
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.min("non_whitespace").alias("min_page"),
        F.max("non_whitespace").alias("max_page"),
    )
    return out.withColumns(
        {
            "empty_ratio": ratio(F.col("empty_pages"), F.col("pages")),
            "control_ratio": ratio(F.col("controls"), F.col("characters")),
            "replacement_ratio": ratio(F.col("replacements"), F.col("characters")),
            "repeated_ratio": ratio(F.col("repeated"), F.col("non_whitespace")),
            "imbalance_ratio": ratio(F.col("max_page"), F.col("non_whitespace")),
            "printable_ratio": ratio(F.col("printable"), F.col("characters")),
        }
    )


def _rules(none: Column) -> list[tuple[str, Column]]:
    all_empty = (F.col("pages") > 0) & (F.col("empty_pages") == F.col("pages"))
    some = (F.col("empty_pages") > 0) & ~all_empty
    return [
        ("no_pages", none),
        ("all_pages_empty", all_empty),
        ("empty_pages", some),
        ("high_empty_page_ratio", some & (F.col("empty_ratio") >= EMPTY_RATIO)),
        ("very_low_text_volume", ~all_empty & (F.col("non_whitespace") < MIN_TEXT)),
        ("sparse_pages", F.col("sparse_pages") > 0),
        ("control_characters", F.col("control_ratio") >= CHARACTER_RATIO),
        ("replacement_characters", F.col("replacement_ratio") >= CHARACTER_RATIO),
        ("repeated_characters", F.col("repeated") > 0),
        ("severe_page_imbalance", (F.col("pages") >= IMBALANCE_PAGES) & (F.col("imbalance_ratio") >= IMBALANCE_RATIO)),
        ("extraction_garbage", (F.col("control_ratio") >= GARBAGE_RATIO) | (F.col("replacement_ratio") >= GARBAGE_RATIO) | (F.col("repeated_ratio") >= GARBAGE_REPEAT)),
    ]


def quality_status(documents: DataFrame) -> DataFrame:
    """``document_quality`` with warnings (canonical order) and status.

    A document with no pages at all has pages = 0 (or null) and only that warning.
    """
    none = F.coalesce(F.col("pages"), F.lit(0)) == 0
    codes = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)) & (test if name == "no_pages" else ~none), F.lit(name)) for name, test in _rules(none)]))
    flagged = documents.withColumn("warnings", codes)
    has = lambda *names: F.arrays_overlap("warnings", F.array(*map(F.lit, names)))
    status = (
        F.when(has("no_pages", "extraction_garbage"), "unusable")
        .when(has("all_pages_empty", "high_empty_page_ratio"), "likely_needs_ocr")
        .when(F.size("warnings") > 0, "usable_with_warnings")
        .otherwise("usable")
    )
    return flagged.withColumn("status", status)


def warning_pages(measured: DataFrame, assessed: DataFrame) -> DataFrame:
    """(doc_id, warning, pages): the ascending pages that each warning names; document-wide ones name none."""
    joined = measured.join(assessed.select("doc_id", "warnings", "max_page"), "doc_id")
    tests = {
        "empty_pages": F.col("is_empty"),
        "all_pages_empty": F.col("is_empty"),
        "high_empty_page_ratio": F.col("is_empty"),
        "sparse_pages": F.col("is_sparse"),
        "control_characters": F.col("controls") > 0,
        "replacement_characters": F.col("replacements") > 0,
        "repeated_characters": F.col("repeated") > 0,
        "severe_page_imbalance": F.col("non_whitespace") == F.col("max_page"),
    }
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    rows = joined.select("doc_id", "page_number", F.explode(F.array_intersect("warnings", named)).alias("warning"))
    listed = rows.groupBy("doc_id", "warning").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))
    codes = assessed.select("doc_id", F.explode("warnings").alias("warning"))
    none = F.array().cast(dict(listed.dtypes)["pages"])
    return codes.join(listed, ["doc_id", "warning"], "left").withColumn("pages", F.coalesce("pages", none))
