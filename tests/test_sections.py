from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirelake.operators import passages, sections


def detect(spark, *pages):
    rows = spark.createDataFrame([("d", n, t) for n, t in enumerate(pages, 1)], "doc_id string, page_number int, text string")
    row = sections.detect_sections(rows).head()
    return {s.kind: s for s in row.sections}, [w.code for w in row.warnings], row


BODY = "We look at prices in many towns.\nThey move a good deal over time.\n"


def test_explicit_headings(spark):
    found, warnings, row = detect(spark, "A Title\n\nAbstract\nShort summary of it all.\n\n1. Introduction\n" + BODY + "\n2. Data\nMore text.\n")
    assert found["abstract"].text == "Short summary of it all.\n\n"
    assert found["introduction"].text == BODY + "\n"
    assert found["introduction"].heading == "1. Introduction" and found["abstract"].method == "explicit_heading"
    assert warnings == []
    text = "A Title\n\nAbstract\nShort summary of it all.\n\n1. Introduction\n" + BODY
    for s in found.values():
        assert "".join(text[p.start : p.end] for p in s.spans).startswith(s.text[:10])
    assert [c.kind for c in row.candidates] == ["abstract", "introduction"]


def test_no_next_heading(spark):
    found, warnings, _ = detect(spark, "Abstract\nSummary.\n\nIntroduction\n" + BODY)
    assert found["introduction"].text == BODY and warnings == ["missing_next_section_boundary"]


def test_missing_everything(spark):
    found, warnings, _ = detect(spark, "just some words\nand more of them\n")
    assert not found and warnings == ["missing_abstract", "missing_introduction"]


def test_blank_and_absent_pages(spark):
    _, warnings, row = detect(spark, " \n", "")
    assert warnings == ["all_pages_empty", "missing_abstract", "missing_introduction"]
    assert row.warnings[0].pages == [1, 2]
    pages = spark.createDataFrame([("d", 1, "x")], "doc_id string, page_number int, text string")
    known = spark.createDataFrame([("d",), ("none",)], "doc_id string")
    out = {r.doc_id: [w.code for w in r.warnings] for r in sections.detect_sections(pages, documents=known).collect()}
    assert out["none"] == ["no_pages"]


def test_ambiguous_headings(spark):
    found, warnings, _ = detect(spark, "Abstract\n\nOne.\n\nAbstract\n\nTwo.\n\nIntroduction\n" + BODY)
    assert "abstract" not in found and "ambiguous_abstract_candidates" in warnings


def test_introduction_before_abstract(spark):
    found, warnings, _ = detect(spark, "Introduction\n" + BODY + "\nAbstract\nLate summary.\n")
    assert "unresolved_abstract_boundary" in warnings and "abstract" not in found


def test_implicit_abstract_by_keywords(spark):
    found, _, _ = detect(spark, "A Title Of Note\nWe find that rain falls.\nIt falls on roofs.\nKeywords: rain, roofs\n\n1 Rain And Roofs\nBody text goes here.\n\n2 Results\nMore.\n")
    assert found["abstract"].method == "implicit_front_matter"
    assert found["abstract"].text == "We find that rain falls.\nIt falls on roofs.\n"
    assert [e.type for e in found["abstract"].evidence] == ["title_block", "jel_classification_terminator"]


def test_inline_codes_stay_inside(spark):
    found, _, _ = detect(spark, "A Title\nWe find inflows of labour.\nThey last. (JEL J24, J31)\n\n1 Inflows\nText of it.\n")
    assert found["abstract"].text.endswith("They last. (JEL J24, J31)\n")


def test_abstract_without_introduction_heading(spark):
    found, warnings, _ = detect(spark, "Title\n\nAbstract\nA summary.\nKeywords: a, b\nBody starts here.\n\n2 Data\nText.\n")
    assert found["abstract"].text == "A summary.\n" and "introduction" not in found
    assert warnings == ["missing_introduction"]


def test_running_headers_and_page_numbers_go(spark):
    page = "Journal Of Tests\n\n{}\n\n{}\n"
    found, _, _ = detect(spark, page.format("Abstract\nSummary.\n\nIntroduction\nFirst page text.", 1), page.format("Second page text.", 2), page.format("Third page text.\n\n2. Data\nEnd.", 3))
    assert found["introduction"].text.split() == "First page text. 1 Second page text. Third page text.".split()
    assert {s.page for s in found["introduction"].spans} == {1, 2, 3}


def test_blocks_of_front_matter_go(spark):
    found, _, _ = detect(spark, "Abstract\nSummary.\n\nIntroduction\nPrices rise over time here.\nDepartment of Economics,\nEmail: a@b.c\nOur framework derives bilateral migration flows.\n\n2 Data\nx\n")
    assert found["introduction"].text == "Prices rise over time here.\nOur framework derives bilateral migration flows.\n\n"


@pytest.mark.parametrize(
    ("line", "want"),
    [("2 Data", True), ("II. Data And Methods", True), ("2 The model predicts higher wages", False), ("2 Utility = income", False), ("2 Smith (2020)", False), ("3 Results in Table 4", False), ("2 lower case", False), ("1 Introduction", False), ("2. One two three four.", False), ("SECTION 3 RESULTS", True), ("2 A b c d e f g", False)],
)
def test_heading_titles(spark, line, want):
    row = spark.createDataFrame([(line,)], "t string").select(sections.heading_title(F.col("t"), False).alias("x")).head()
    assert row.x is want


def test_cover_sheet_is_skipped(spark):
    found, _, _ = detect(spark, "This content downloaded from 1.2.3.4\n", "A Title\nWe find rain.\nIt is wet.\nKeywords: rain\n\n1 Rain\nText.\n")
    assert found["abstract"].spans[0].page == 2


def test_conversion_fragments_point_at_the_page(spark):
    pages = ["Abstract\nOne two three four five.\n\nIntroduction\nSix seven.\n", "Eight nine ten.\n\n2 Data\nx\n"]
    rows = spark.createDataFrame([("d", n, t) for n, t in enumerate(pages, 1)], "doc_id string, page_number int, text string")
    out = passages.convert_sections(sections.detect_sections(rows), 12).orderBy("ordinal").collect()
    assert [r.ordinal for r in out] == list(range(len(out)))
    for r in out:
        assert len(r.text) <= 12
        assert "".join(pages[f.page - 1][f.start : f.end] for f in r.fragments) == r.text
        assert [f.passage_start for f in r.fragments][0] == 0 and r.fragments[-1].passage_end == len(r.text)


def test_documents_are_read_on_end_in_batches_of_lines(spark):
    """No Python call and no new reading of the lines behind for each document: both outgrew the input; batches may end within a document."""
    texts = [(k, n, t) for k in range(20) for n, t in ((1, "A Title\n\nAbstract\nShort summary.\n\nIntroduction\n" + BODY), (2, f"Journal of Towns\n\nRest {k}.\n\n2. Data\nMore.\n"), (3, "Journal of Towns\n\nEnd.\n"))]
    pages = spark.createDataFrame([*texts, (20, 1, " \n\n")], "doc_id long, page_number int, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = sections.detect_sections(pages)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {r.doc_id: r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "1, unboundedfollowing" not in plan.lower()
    assert len(rows) == 21 and [w.code for w in rows[20].warnings] == ["all_pages_empty", "missing_abstract", "missing_introduction"]
    for k in range(20):
        assert {s.kind: s.text for s in rows[k].sections} == {"abstract": "Short summary.\n\n", "introduction": f"{BODY}\nRest {k}.\n\n"}
