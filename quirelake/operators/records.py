"""Stored records read strictly: every constraint is a query for what breaks it.

A record is a paper with its passages, their source fragments and a Markdown
text. ``record_violations`` names what is inconsistent; readers leave such
papers out, so that one damaged record never hides the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.passages import convert_sections, passage_id, settings_fingerprint
from quirelake.sources.library import differences

#: fixed values: the order of section kinds
SECTION_ORDER = ("abstract", "introduction")


class NoValidRecordError(RuntimeError):
    """There are records, and none of them is valid."""


def _named(rows: DataFrame, tests: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, problem) for every test that holds of a row; a null test does not hold."""
    codes = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return rows.select(*keys, F.explode(codes).alias("problem"))


def markdown_digest(markdown: Column) -> Column:
    return F.sha2(markdown.cast("binary"), 256)


def _text_digest(text: Column) -> Column:
    """32 bytes that stand for a text where texts are compared."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def section_rank(kind: Column) -> Column:
    """The place of a section kind; kinds out of the order come last."""
    out = F.lit(len(SECTION_ORDER))
    for place, name in reversed(list(enumerate(SECTION_ORDER))):
        out = F.when(kind == name, place).otherwise(out)
    return out


def record_violations(records: DataFrame, passages: DataFrame, fragments: DataFrame, budget: int, pieces: int | None = None) -> DataFrame:
    """(paper_id, problem) of stored conversions, each problem once a paper.

    records (paper_id, checksum, source_name, source_identifier, fingerprint,
    markdown, markdown_sha256); passages (paper_id, passage_id, ordinal, kind,
    heading, page_start, page_end, text); fragments (passage_id, page, start,
    end, passage_start, passage_end, text), offsets of the page and of the
    passage, half open. What is asked of a text is asked where it is read: of all
    texts only the passages' are shuffled, once, and meet digests of their fragments.
    They meet in as many ``pieces`` as are asked for, else in Spark's number of
    shuffle partitions, which does not grow with the texts.
    """
    dealt = lambda rows: rows if pieces is None else rows.repartition(pieces, "passage_id")
    order = Window.partitionBy("passage_id").orderBy("passage_start", "passage_end")
    placed = dealt(fragments.select("passage_id", "page", "start", "end", "passage_start", "passage_end")).withColumns({"reach": F.lag("passage_end", 1, 0).over(order), "before_page": F.lag("page").over(order), "before_end": F.lag("end").over(order)})
    spans = placed.groupBy("passage_id").agg(
        F.bool_or(F.col("passage_start") != F.col("reach")).alias("gap"),
        F.bool_or((F.col("end") - F.col("start")) != (F.col("passage_end") - F.col("passage_start"))).alias("uneven"),
        F.bool_or((F.col("page") < F.col("before_page")) | ((F.col("page") == F.col("before_page")) & (F.col("start") < F.col("before_end")))).alias("unordered"),
        F.max("passage_end").alias("covered"),
        F.min(F.struct("passage_start", "page", "start")).alias("first"),
        F.max(F.struct("passage_end", "page", "end")).alias("last"),
    )
    digests = fragments.select("passage_id", "passage_start", "passage_end", _text_digest(F.col("text")).alias("held"))
    inside = dealt(digests).join(dealt(passages.select("passage_id", "text")), "passage_id")
    part = F.substring("text", F.col("passage_start") + 1, F.col("passage_end") - F.col("passage_start"))
    torn = inside.filter(~F.col("held").eqNullSafe(_text_digest(part))).select("passage_id").distinct().withColumn("torn", F.lit(True))

    expected = passage_id(F.col("paper_id"), F.col("ordinal"), F.col("text"), settings_fingerprint(budget), F.col("kind"))
    plain = passages.select(
        "paper_id", "passage_id", "ordinal", "kind", "page_start", "page_end", F.length("text").alias("length"),
        (~F.col("heading").eqNullSafe(F.initcap("kind"))).alias("wrong_heading"), (~F.col("passage_id").eqNullSafe(expected)).alias("wrong_id"),
    )
    own = dealt(plain).join(spans, "passage_id", "left").join(torn, "passage_id", "left").join(records.select("paper_id"), "paper_id", "left")
    in_paper = Window.partitionBy("paper_id").orderBy("ordinal", "passage_id")
    own = own.withColumns(
        {
            "nth": F.row_number().over(in_paper) - 1,
            "last_rank": F.lag(section_rank(F.col("kind"))).over(in_paper),
            "last_place": F.lag(F.struct(F.col("last.page").alias("page"), F.col("last.end").alias("at"))).over(in_paper),
        }
    )
    tests = {
        "ordinal_gap": F.col("ordinal") != F.col("nth"),
        "too_long": F.col("length") > budget,
        "wrong_heading": F.col("wrong_heading"),
        "no_fragments": F.col("covered").isNull(),
        "fragment_gap": F.col("gap") | (F.col("covered") != F.col("length")),
        "fragment_length": F.col("uneven"),
        "fragment_order": F.col("unordered"),
        "fragment_text": F.col("torn"),
        "wrong_first_page": ~F.col("page_start").eqNullSafe(F.col("first.page")),
        "wrong_last_page": ~F.col("page_end").eqNullSafe(F.col("last.page")),
        "wrong_id": F.col("wrong_id"),
        "section_order": section_rank(F.col("kind")) < F.col("last_rank"),
        "source_overlap": F.struct(F.col("first.page").alias("page"), F.col("first.start").alias("at")) < F.col("last_place"),
    }
    out = _named(own, tests, "paper_id")
    repeated = passages.groupBy("paper_id", "passage_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("paper_id", F.lit("duplicate_passage").alias("problem"))
    whole = {
        "wrong_fingerprint": F.col("fingerprint") != settings_fingerprint(budget),
        "wrong_digest": ~F.col("markdown_sha256").eqNullSafe(markdown_digest(F.col("markdown"))),
        "blank_markdown": F.trim(F.coalesce("markdown", F.lit(""))) == "",
        "wrong_source": (F.col("source_name") != "local-pdf") | ~F.col("source_identifier").eqNullSafe(F.col("checksum")),
    }
    empty = records.join(passages.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", F.lit("no_passages").alias("problem"))
    return out.union(repeated).union(_named(records, whole, "paper_id")).union(empty).distinct()


def measure_violations(measured: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, problem): stored document measures that the page measures do not add up to, and gaps in the page numbers.

    measured: rows of ``page_quality``; stored: rows of ``document_quality``.
    """
    counters = ("characters", "non_whitespace", "printable", "controls", "replacements", "repeated")
    truth = measured.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("is_empty").alias("empty_pages"),
        F.count_if("is_sparse").alias("sparse_pages"),
        *[F.sum(c).alias(c) for c in counters],
        F.min("non_whitespace").alias("min_page"),
        F.max("non_whitespace").alias("max_page"),
        F.min("page_number").alias("first"),
        F.max("page_number").alias("last"),
        F.count_distinct("page_number").alias("numbers"),
    )
    fields = ("pages", "empty_pages", "sparse_pages", *counters, "min_page", "max_page")
    joined = stored.select("doc_id", *[F.col(c).alias(f"__{c}") for c in fields]).join(truth, "doc_id", "left")
    tests = {c: ~F.col(f"__{c}").eqNullSafe(F.coalesce(c, F.lit(0))) for c in fields}
    tests["page_numbers"] = (F.col("first") != 1) | (F.col("last") != F.col("pages")) | (F.col("numbers") != F.col("pages"))
    return _named(joined, tests, "doc_id")


#: fixed values: by section kind, the warnings that speak against it (the first group) and those that explain its absence
_AGAINST = {
    "abstract": ("ambiguous_abstract_candidates", "ambiguous_implicit_abstract_boundary", "unresolved_abstract_boundary", "empty_abstract_body", "missing_abstract"),
    "introduction": ("ambiguous_introduction_candidates", "ambiguous_implicit_introduction_boundary", "empty_introduction_body", "missing_introduction"),
}
#: fixed values: pairs of warnings that exclude each other
_EXCLUSIVE = [
    ("ambiguous_implicit_abstract_boundary", "unresolved_abstract_boundary"),
    ("ambiguous_implicit_abstract_boundary", "ambiguous_abstract_candidates"),
    ("ambiguous_implicit_introduction_boundary", "ambiguous_introduction_candidates"),
    ("unresolved_abstract_boundary", "missing_abstract"),
    ("unresolved_abstract_boundary", "ambiguous_abstract_candidates"),
    ("empty_abstract_body", "missing_abstract"),
    ("empty_abstract_body", "unresolved_abstract_boundary"),
    ("empty_abstract_body", "ambiguous_abstract_candidates"),
    ("empty_introduction_body", "missing_introduction"),
    ("empty_introduction_body", "ambiguous_introduction_candidates"),
]
#: fixed values: warnings that need one candidate of their kind on the pages they name, and ones that need two and name all their pages
_NEED_ONE = {"unresolved_abstract_boundary": "abstract", "empty_abstract_body": "abstract", "empty_introduction_body": "introduction"}
_NEED_TWO = {f"{word}_{kind}_candidates": kind for kind in _AGAINST for word in ("ambiguous", "duplicate")}


def section_violations(detected: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, problem) of detected sections (doc_id, sections, candidates, warnings) whose parts contradict each other.

    ``order`` is the canonical order of the warning codes.
    """
    codes = F.transform("warnings", lambda w: w["code"])
    kinds = F.transform("sections", lambda s: s["kind"])
    rank = lambda c: F.array_position(F.array(*map(F.lit, order)), c)
    has = lambda code: F.array_contains(codes, code)
    held = lambda kind: F.array_contains(kinds, kind)
    pages_of = lambda code: F.get(F.filter("warnings", lambda w: w["code"] == code), F.lit(0))["pages"]
    candidates = lambda kind: F.filter("candidates", lambda c: c["kind"] == kind)
    candidate_pages = lambda kind: F.array_sort(F.array_distinct(F.transform(candidates(kind), lambda c: c["page"])))
    anything = F.size("sections") > 0
    tests = {
        "repeated_warning": F.size(F.array_distinct(codes)) != F.size(codes),
        "warning_order": F.array_sort(F.transform(codes, rank)) != F.transform(codes, rank),
        "repeated_candidate": F.size(F.array_distinct("candidates")) != F.size("candidates"),
        "repeated_section": F.size(F.array_distinct(kinds)) != F.size(kinds),
        "sections_without_pages": anything & (has("no_pages") | has("all_pages_empty")),
    }
    for kind, against in _AGAINST.items():
        for code in against:
            tests[f"{code}_with_{kind}"] = has(code) & held(kind)
        explained = has("no_pages") | has("all_pages_empty")
        for code in against:
            explained = explained | has(code)
        tests[f"{kind}_not_accounted_for"] = ~held(kind) & ~explained
    for one, other in _EXCLUSIVE:
        tests[f"{one}_with_{other}"] = has(one) & has(other)
    for code, kind in _NEED_ONE.items():
        named = pages_of(code)
        tests[f"{code}_ungrounded"] = has(code) & ((F.size(candidates(kind)) == 0) | (F.size(named) == 0) | (F.size(F.array_except(named, candidate_pages(kind))) > 0))
    for code, kind in _NEED_TWO.items():
        tests[f"{code}_ungrounded"] = has(code) & ((F.size(F.array_distinct(candidates(kind))) < 2) | (pages_of(code) != candidate_pages(kind)))
    for kind in _AGAINST:
        code = f"ambiguous_implicit_{kind}_boundary"
        tests[f"{code}_without_page"] = has(code) & (F.size(pages_of(code)) == 0)
    first = lambda s: F.struct(F.get(s["spans"], F.lit(0))["page"].alias("page"), F.get(s["spans"], F.lit(0))["start"].alias("at"))
    last = lambda s: F.struct(F.element_at(s["spans"], -1)["page"].alias("page"), F.element_at(s["spans"], -1)["end"].alias("at"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("sections") - 1), lambda k: first(F.get("sections", k)) < last(F.get("sections", k - 1)))
    tests["section_overlap"] = F.when(F.size("sections") > 1, F.exists(pairs, lambda x: x))
    return _named(detected, tests, "doc_id")


def reconversion_differences(stored: DataFrame, detected: DataFrame, budget: int) -> DataFrame:
    """Rows (side, paper_id, passage_id, kind, ordinal, text) that only the stored passages or only a conversion run anew have: none if the record stands for its source."""
    columns = ["paper_id", "passage_id", "kind", "ordinal", "text"]
    return differences(stored.select(*columns), convert_sections(detected, budget).select(*columns))


def completion_violations(records: DataFrame, passages: DataFrame, warnings: DataFrame) -> DataFrame:
    """(paper_id, problem): records (paper_id, passage_count, warning_count) whose counts differ from the stored rows."""
    counts = records
    for rows, name in ((passages, "passages"), (warnings, "warnings")):
        counts = counts.join(rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias(name)), "paper_id", "left")
    tests = {"passage_count": F.col("passage_count") != F.coalesce("passages", F.lit(0)), "warning_count": F.col("warning_count") != F.coalesce("warnings", F.lit(0))}
    return _named(counts, tests, "paper_id")


def valid_records(records: DataFrame, violations: DataFrame) -> DataFrame:
    """The records without a violation; an error if there are records and all have one. That is asked of their ids alone."""
    good = records.join(violations.select("paper_id"), "paper_id", "left_anti")
    if good.isEmpty() and not records.isEmpty():
        raise NoValidRecordError("no stored record is valid")
    return good


def assembled(records: DataFrame, passages: DataFrame, fragments: DataFrame, fingerprint: str | None = None, pieces: int | None = None) -> DataFrame:
    """Records with their passages in order, each with its fragments in order, as nested columns.

    With a ``fingerprint``, only records made with those settings. Both
    children come by one join each; a record without passages has an empty list.
    Texts meet in as many ``pieces`` as are asked for, else in Spark's number of
    shuffle partitions.
    """
    dealt = lambda rows, key: rows if pieces is None else rows.repartition(pieces, key)
    kept = records if fingerprint is None else records.filter(F.col("fingerprint") == fingerprint)
    parts = dealt(fragments, "passage_id").groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("passage_start", "passage_end", "page", "start", "end", "text"))).alias("fragments"))
    nested = dealt(dealt(passages, "passage_id").join(parts, "passage_id", "left"), "paper_id").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "passage_id", "kind", "page_start", "page_end", "text", "fragments"))).alias("passages"))
    out = kept.join(nested, "paper_id", "left")
    return out.withColumn("passages", F.coalesce("passages", F.array().cast(dict(out.dtypes)["passages"])))


def by_checksum(records: DataFrame, checksum: str) -> DataFrame:
    """The records of a file digest, whatever its letter case."""
    return records.filter(F.lower("checksum") == checksum.lower())


def resolved_citations(citations: DataFrame, papers: DataFrame, passages: DataFrame) -> DataFrame:
    """``citations`` (request_id, citation_id, paper_id, passage_id, text) with title and a problem, null if they stand.

    unknown_paper and unknown_passage: the library has none of that id;
    changed: it has one whose paper or text differs.
    """
    held = passages.select("passage_id", F.col("paper_id").alias("__paper"), F.col("text").alias("__text"))
    joined = citations.join(papers.select("paper_id", "title", F.lit(True).alias("__known")), "paper_id", "left").join(held, "passage_id", "left")
    problem = (
        F.when(F.col("__known").isNull(), "unknown_paper")
        .when(F.col("__paper").isNull(), "unknown_passage")
        .when((F.col("__paper") != F.col("paper_id")) | ~F.col("__text").eqNullSafe(F.col("text")), "changed")
    )
    return joined.select(*citations.columns, "title", problem.alias("problem"))


def titles_of_claims(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """(request_id, claim_index, titles): the distinct titles that a claim cites, in the order of its citations."""
    cited = claims.select("request_id", "claim_index", F.posexplode("citation_ids").alias("position", "citation_id"))
    joined = cited.join(resolved.select("request_id", "citation_id", "title"), ["request_id", "citation_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"])
    return joined.groupBy("request_id", "claim_index").agg(F.array_distinct(listed).alias("titles"))


def evidence_violations(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """(paper_id, problem, page, start): evidence that no span of its section contains, or whose text is not that slice.

    evidence (paper_id, kind, page, start, end, text); spans (paper_id, kind,
    page, start, end, text), offsets of the page. An equi-join on the page, with
    the containment as a condition.
    """
    e, s = evidence.alias("e"), spans.alias("s")
    inside = (F.col("s.start") <= F.col("e.start")) & (F.col("e.end") <= F.col("s.end")) & (F.col("e.start") < F.col("e.end"))
    same = (F.col("e.paper_id") == F.col("s.paper_id")) & (F.col("e.kind") == F.col("s.kind")) & (F.col("e.page") == F.col("s.page"))
    joined = e.join(s, same & inside, "left")
    cut = F.substring(F.col("s.text"), F.col("e.start") - F.col("s.start") + 1, F.col("e.end") - F.col("e.start"))
    problem = F.when(F.col("s.start").isNull(), "outside").when(~F.col("e.text").eqNullSafe(cut), "wrong_text")
    return joined.select("e.paper_id", problem.alias("problem"), "e.page", "e.start").filter("problem is not null").distinct()
