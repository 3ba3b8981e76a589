"""Analysing papers in five stages, one plan for a whole batch of files.

preflight, extraction, quality, sections, question: every file carries its
status through the stages; a file that fails or halts is filtered out of the
later ones, so it never stops the batch.

``analyze`` computes a batch. ``analyze_into`` keeps what it computes in a
library, each stage's results under the file's checksum and the fingerprint of
the settings up to that stage, and works only on what is not there yet.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.operators import generate, passages, quality, sections
from quirelake.operators.preflight import library_eligibility, preflight, reuse_decision
from quirelake.sources import pdf
from quirelake.sources.library import Library

STAGES = ["preflight", "extraction", "quality", "sections", "question"]
#: parts of the settings, in the order of the stages that they belong to
PARTS = ("extraction", "quality", "sections", "question")


def analysis_fingerprint(settings: dict, upto: str | None = None) -> str:
    """sha256 of the settings as canonical JSON; ``upto`` a stage, without those of later stages."""
    if upto is not None:
        later = PARTS[PARTS.index(upto) + 1 :]
        settings = {k: v for k, v in settings.items() if k not in later}
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def analysis_id(checksum: Column, fingerprint: str) -> Column:
    return F.concat(F.lit("analysis-"), F.sha2(F.concat(F.lower(checksum), F.lit(":" + fingerprint)), 256))


def _stages(reached: int, failed: bool) -> tuple[Column, Column, Column]:
    """Completed, failed and skipped stages of a file that ended in stage ``reached``."""
    lists = (STAGES[:reached], STAGES[reached : reached + 1] if failed else [], STAGES[reached + failed :])
    return tuple(F.array(*map(F.lit, x)).cast("array<string>") for x in lists)


def extracted(files: DataFrame, extractor: pdf.Extractor) -> DataFrame:
    """(checksum, page_number, text, error): the pages of files (checksum, content)."""
    return pdf.pages_of(files.select(F.col("checksum").alias("path"), "content"), extractor).select(F.col("path").alias("checksum"), "page_number", "text", "error")


def assessed(pages: DataFrame) -> DataFrame:
    """(checksum, error, quality, quality_warnings, sections, section_warnings) from the pages that ``extracted`` gave."""
    broken = pages.filter("error is not null").select("checksum", "error")
    texts = pages.filter("error is null and page_number is not null").select(F.col("checksum").alias("doc_id"), "page_number", "text")
    pageless = pages.filter("error is null and page_number is null").select(F.col("checksum").alias("doc_id"))
    measured = quality.document_quality(quality.page_quality(texts))
    rated = durable(quality.quality_status(measured).select(F.col("doc_id").alias("checksum"), F.col("status").alias("quality"), F.col("warnings").alias("quality_warnings")).union(pageless.select("doc_id", F.lit("unusable"), F.array(F.lit("no_pages")))))
    usable = rated.filter(F.col("quality").isin("usable", "usable_with_warnings")).select(F.col("checksum").alias("doc_id"))
    found = sections.detect_sections(texts.join(usable, "doc_id", "left_semi")).select(F.col("doc_id").alias("checksum"), "sections", F.col("warnings").alias("section_warnings"))
    return rated.withColumn("error", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True).join(found, "checksum", "left").select("checksum", "error", "quality", "quality_warnings", "sections", "section_warnings")


def asked(rated: DataFrame, generator: generate.Generator) -> DataFrame:
    """(checksum, question, question_kind, question_warnings) of the rows of ``assessed`` that have sections."""
    found = rated.filter("sections is not null").select(F.col("checksum").alias("paper_id"), F.explode_outer("sections").alias("s"))
    first = F.get("s.spans", F.lit(0))
    spans = found.select("paper_id", "s.kind", F.coalesce("s.text", F.lit("")).alias("text"), first["page"].alias("page"), first["start"].alias("start"), first["end"].alias("end"))
    return generate.research_question(spans, generator).select(F.col("paper_id").alias("checksum"), "question", F.col("kind").alias("question_kind"), F.col("warnings").alias("question_warnings"))


def _with_outcome(rows: DataFrame) -> DataFrame:
    """``rows`` with status and completed, failed and skipped stages."""
    cases = [
        (F.col("is_batch_duplicate"), "duplicate", 0, False),
        (F.col("size") == 0, "failed", 0, True),
        (F.col("error").isNotNull(), "failed", 1, True),
        (F.col("quality").isin("unusable", "likely_needs_ocr"), "halted", 3, False),
    ]
    columns = []
    for k in range(4):
        chosen = None
        for test, name, reached, failing in cases:
            value = F.lit(name) if k == 0 else _stages(reached, failing)[k - 1]
            chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
        columns.append(chosen.otherwise(F.lit("completed") if k == 0 else _stages(len(STAGES), False)[k - 1]))
    return rows.withColumns(dict(zip(("status", "completed_stages", "failed_stages", "skipped_stages"), columns, strict=True)))


RESULT = ["status", "completed_stages", "failed_stages", "skipped_stages", "error", "quality", "quality_warnings", "sections", "section_warnings", "question", "question_kind", "question_warnings"]


def analyze(files: DataFrame, stored: DataFrame, extractor: pdf.Extractor, generator: generate.Generator, settings: dict | None = None) -> DataFrame:
    """One row a file (path, size, sha256, content): its status, stages and results.

    status: completed, halted (the text is unusable or needs OCR), failed,
    duplicate (of an earlier file of the batch). ``stored`` (checksum) only
    marks files as stored; ``analyze_into`` reuses what is stored.
    """
    fingerprint = analysis_fingerprint(settings or {})
    checked = durable(preflight(files.select("path", "size", "sha256"), stored))
    fresh = files.join(checked.filter(~F.col("is_batch_duplicate")).select("path"), "path", "left_semi").filter("size > 0")
    rated = durable(assessed(durable(extracted(fresh.select(F.lower("sha256").alias("checksum"), "content"), extractor))))
    questions = durable(asked(rated, generator))
    own = checked.withColumn("checksum", F.when(~F.col("is_batch_duplicate"), F.lower("sha256")))
    rows = _with_outcome(own.join(rated, "checksum", "left").join(questions, "checksum", "left"))
    return rows.select(analysis_id(F.col("sha256"), fingerprint).alias("analysis_id"), "path", F.lower("sha256").alias("checksum"), "is_stored", "duplicate_of", *RESULT)


_PAGES = "page_number int, text string, error string"
_RATED = f"error string, quality string, quality_warnings array<string>, {sections.FOUND}, section_warnings {sections.WARNING_ROWS}"
_RECORD = f"analysis_id string, updated_at timestamp, status string, completed_stages array<string>, failed_stages array<string>, skipped_stages array<string>, {_RATED}, question string, question_kind string, question_warnings array<string>"
PAPERS = "paper_id string, checksum string, title string, source_path string, conversion string"


def analyze_into(library: Library, files: DataFrame, extractor: pdf.Extractor, generator: generate.Generator, settings: dict | None = None, budget: int = passages.BUDGET, stamp: Column | None = None) -> DataFrame:
    """Analyses files (path, size, sha256, content) and keeps the results; one row a file: path, sha256, action, status, outcome, error.

    action: ``reuse`` (the analysis is stored and so are its passages, or it has none), ``backfill``
    (its passages are cut anew from the stored sections, for instance for another ``budget``; neither
    extractor nor generator is called), ``new``, or ``duplicate`` (of an earlier file of the batch).
    A file that was not analysed under these settings still reuses its stored pages, if the extraction
    settings are the same, and its sections, if those up to the sections are.

    outcome: ``stored`` (passages are in the library), ``not_eligible`` or ``no_usable_sections``.
    Results that say a file failed or halted are results too and are reused. An empty file is not
    analysed. All that is new becomes one version of the library; what was stored stays.
    """
    settings = settings or {}
    keys = {part: analysis_fingerprint(settings, part) for part in PARTS}
    fingerprint, conversion = keys["question"], analysis_fingerprint({"budget": budget})
    papers = library.table("papers", PAPERS)
    checked = durable(preflight(files.select("path", "size", "sha256"), papers.select("checksum")))
    # one row a checksum, also where a path is given more than once
    originals = checked.filter("not is_batch_duplicate and size > 0").groupBy(F.lower("sha256").alias("checksum"))
    first = durable(originals.agg(F.min("path").alias("path"), F.min("size").alias("size")).withColumn("is_batch_duplicate", F.lit(False)))

    def known(name: str, wanted: DataFrame, stage: str, schema: str) -> DataFrame:
        found = library.matching(name, wanted.select("checksum"), "checksum", f"checksum string, stage string, {schema}")
        return found.filter(F.col("stage") == stage).drop("stage")

    # what is stored under these very settings
    analyses = durable(known("analyses", first, fingerprint, _RECORD))
    ids = first.select(F.concat(F.lit("paper-"), F.col("checksum")).alias("paper_id"))
    held = library.matching("papers", ids, "paper_id", PAPERS).filter(F.col("conversion") == conversion)
    judged = library_eligibility(analyses.select("checksum", F.col("completed_stages").alias("stages"), "quality", F.size(F.coalesce("sections", F.array())).alias("sections")))
    settled = judged.filter("outcome <> 'stored'").select("checksum").union(held.select("checksum"))
    candidates = first.select(F.col("checksum").alias("sha256"), F.lit(fingerprint).alias("fingerprint"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("checksum").alias("sha256"), F.lit(fingerprint).alias("fingerprint"))

    decided = durable(reuse_decision(candidates, named(analyses), named(settled)).select(F.col("sha256").alias("checksum"), "action"))
    counts = {r["action"]: r["count"] for r in decided.groupBy("action").count().collect()}
    also, current = {}, analyses

    if counts.get("new"):
        # stage by stage, only what no earlier batch has left
        fresh = first.join(decided.filter("action = 'new'"), "checksum", "left_semi")
        old_rated = durable(known("assessments", fresh, keys["sections"], _RATED))
        unrated = durable(fresh.join(old_rated, "checksum", "left_anti"))
        old_pages = known("pages", unrated, keys["extraction"], _PAGES)
        unread = unrated.join(old_pages.select("checksum").distinct(), "checksum", "left_anti").select("path", "checksum")
        # by checksum, too: files of one path are not taken for one another
        wanted = files.select("path", F.lower("sha256").alias("checksum"), "content").join(unread, ["path", "checksum"]).dropDuplicates(["path", "checksum"])
        new_pages = durable(extracted(wanted.select("checksum", "content"), extractor))
        new_rated = durable(assessed(old_pages.unionByName(new_pages)))
        rated = old_rated.unionByName(new_rated)
        made = _with_outcome(fresh.join(rated, "checksum", "left").join(asked(rated, generator), "checksum", "left"))
        records = durable(made.select(analysis_id(F.col("checksum"), fingerprint).alias("analysis_id"), "checksum", (F.current_timestamp() if stamp is None else stamp).cast("timestamp").alias("updated_at"), *RESULT))
        also = {"pages": new_pages.withColumn("stage", F.lit(keys["extraction"])), "assessments": new_rated.withColumn("stage", F.lit(keys["sections"])), "analyses": records.withColumn("stage", F.lit(fingerprint))}
        also = {name: rows for name, rows in also.items() if rows.head(1)}
        current = analyses.unionByName(records)

    if counts.get("new") or counts.get("backfill"):
        due = decided.filter("action <> 'reuse'").join(first.select("checksum", "path"), "checksum")
        papers, cut = library_rows(due.select("checksum", "path").join(current, "checksum"), budget)
        library.save_papers(durable(papers.withColumn("conversion", F.lit(conversion))), {"passages": durable(cut)}, also=also)

    outcomes = library_eligibility(current.select("checksum", "status", "error", F.col("completed_stages").alias("stages"), "quality", F.size(F.coalesce("sections", F.array())).alias("sections")))
    own = checked.withColumn("checksum", F.lower("sha256")).join(decided, "checksum", "left").join(outcomes.select("checksum", "status", "outcome", "error"), "checksum", "left")
    is_copy, empty = F.col("is_batch_duplicate"), F.col("size") == 0
    return own.select(
        "path",
        "sha256",
        F.when(is_copy, "duplicate").when(empty, "new").otherwise(F.col("action")).alias("action"),
        F.when(is_copy, "duplicate").when(empty, "failed").otherwise(F.col("status")).alias("status"),
        F.when(is_copy, None).when(empty, "not_eligible").otherwise(F.col("outcome")).alias("outcome"),
        F.when(~is_copy & empty, "the file is empty").when(~is_copy, F.col("error")).alias("error"),
    )


def library_rows(analysed: DataFrame, budget: int = passages.BUDGET) -> tuple[DataFrame, DataFrame]:
    """(papers, passages) of the completed analyses that have a section; the rest is not eligible."""
    eligible = analysed.filter((F.col("status") == "completed") & (F.size("sections") > 0))
    papers = eligible.select(F.concat(F.lit("paper-"), F.col("checksum")).alias("paper_id"), "checksum", pdf.title_or_stem(F.lit(""), F.col("path")).alias("title"), F.col("path").alias("source_path"))
    cut = passages.convert_sections(eligible.select(F.concat(F.lit("paper-"), F.col("checksum")).alias("doc_id"), "sections"), budget)
    return papers, cut
