"""Front-matter sections: where a paper's abstract and introduction stand.

Spark computes a table of lines with everything that can be said of a line and
its neighbours: offsets, blankness, page edges, running headers, pattern flags,
column width. Python then only chooses boundaries and collects runs of lines,
a document after the other as they come in batches of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.functions.text import SPACE, lines
from quirelake.shipping import shipped

#: fixed values: patterns of front matter, matched against trimmed lines, without regard to case unless they say so
ABSTRACT = r"^\s*(?:(?:SECTION\s+)?(?:1|I|A)(?:[\.\:]|\s*\|\s*)?\s+)?ABSTRACT[\.\:]?\s*$"
INTRODUCTION = r"^\s*(?:(?:SECTION\s+)?(?:1|1\.0|I)(?:[\.\:]|\s*\|\s*)?\s+)?INTRODUCTION[\.\:]?\s*$"
NEXT_TITLE = r"^\s*(?:(?:SECTION\s+)?(?:[2-9]|\d{2,}|II|III|IV|V|VI|VII|VIII|IX|X)(?:[\.\:]|\s*\|\s*)?\s+)(.+)$"
FIRST_TITLE = r"^\s*(?:(?:SECTION\s+)?(?:[1-9]|\d{2,}|I{1,3}|IV|V|VI|VII|VIII|IX|X)(?:[\.\:]|\s*\|\s*)?\s+)(.+)$"
DOT_LEADERS = r"\.{4,}"
CITATION = r"(?-i)\b[A-Z][a-zA-Z]+(?:\s+et\s+al\.)?\s*\(\d{4}\)|\(\s*[A-Z][a-zA-Z]+(?:\s+et\s+al\.)?,\s*\d{4}\s*\)|\[\d+\]"
CROSS_REFERENCE = r"\b(?:Section|Table|Figure|Fig|Equation|Eq|Appendix|Column|Row)\s+\d+"
DEMONSTRATIVE = r"^(?:This|The|These|Those|That|Here|There|Each|Every|All|Some|Many|Most|Several|We|It|A|An|In|Under|For)\b"
COVER_SHEET = r"(?=[TJDN])(?:This\s+content\s+downloaded\s+from|JSTOR\s+is\s+a\s+not-for-profit|Downloaded\s+from\s+http|NBER\s+Working\s+Paper\s+Series)"
KEYWORDS = r"^\s*\(?\s*(?:JEL\s+Classification|JEL\s+codes?|JEL\b|Keywords?|Key\s+words?)\s*[\:\.]?\s*"
INLINE_JEL = r"\(\s*JEL\b[^)]*\)\s*$"
ARTICLE_HISTORY = r"^\s*(?:ARTICLE\s+INFO|ARTICLE\s+HISTORY|Received\s+\d|Accepted\s+\d|Available\s+online|doi\.org|\bDOI\:)\b"
#: the class before the affiliation means asterisk, dagger or digit, and reads as asterisk, digit or one of the letters a, g, e, r
AFFILIATION_START = r"^(?:[\*\dagger\d]\s*)?(?:Department\s+of|Faculty\s+of|School\s+of|University\s+of|Email\:|Corresponding\s+author|Financial\s+support)"
FUNDING = r"^\s*Financial\s+support\b"
AFFILIATION = r"@|\bemail\b|\bdepartment\s+of\b|\buniversity\s+of\b|\bschool\s+of\b"
FOOTNOTE = r"^\s*[*†‡§¶]\s*\S"
CONTACT = r"@|\bemail\b|https?://|\bdoi\.org\b|\bUniversity\b|\bSchool\s+of\b|\bDepartment\s+of\b|\bCollege\b|\bInstitute\b"
SENTENCE_END = r"[.!?][\"'”’)\]]*$"
ACKNOWLEDGMENTS = r"^\s*(?:We\s+thank|Thanks\s+to|Financial\s+support|The\s+authors\s+thank|Acknowledge?ments?)\b"
#: fixed values: verbs that betray prose
VERBS = "studies predicts implies shows reports found finds suggests indicates varies converges increases decreases differs depends contains presents examines describes thank thanks acknowledge acknowledges were was are is have has".split()

#: fixed values: warnings in canonical order
WARNINGS = [
    "no_pages",
    "all_pages_empty",
    "missing_abstract",
    "missing_introduction",
    "ambiguous_abstract_candidates",
    "ambiguous_introduction_candidates",
    "duplicate_abstract_candidates",
    "duplicate_introduction_candidates",
    "empty_abstract_body",
    "empty_introduction_body",
    "unresolved_abstract_boundary",
    "missing_next_section_boundary",
]

#: lines that are Python objects at once, besides those of a document
ROWS_AT_ONCE = 1024

_SPAN = "struct<page:int,start:int,end:int>"
_EVIDENCE = "struct<page:int,start:int,end:int,type:string,description:string>"
FOUND = f"sections array<struct<kind:string,method:string,heading:string,start_page:int,end_page:int,spans:array<{_SPAN}>,text:string,evidence:array<{_EVIDENCE}>>>"
WARNING_ROWS = "array<struct<code:string,pages:array<int>>>"
RESULT = f"doc_id {{key}}, {FOUND}, candidates array<struct<kind:string,heading:string,page:int,start:int,end:int>>, warnings {WARNING_ROWS}"


#: a character that is no white space
NO_SPACE = SPACE.replace("[", "[^", 1)


def _has(text: Column, pattern: str, fold: bool = True) -> Column:
    return F.regexp_like(text, F.lit(("(?iuU)" if fold else "(?U)") + pattern))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def _words_from(text: Column, least: int) -> Column:
    """Whether a text has ``least`` words or more, two at least, without taking them out."""
    return _has(text, rf"^{SPACE}*+(?:{NO_SPACE}++{SPACE}++){{{least - 1}}}{NO_SPACE}", False)


def _then(test: Column, *more: Column) -> Column:
    """All of the tests, each evaluated only where those before it hold; in an ``&`` what occurs twice in a row's flags is evaluated for every row."""
    return F.when(test, _then(*more)).otherwise(F.lit(False)) if more else test


def body_sentence(text: Column) -> Column:
    """A capitalised, ended line of four words or more without an affiliation."""
    return _then(_has(text, r"^\p{Lu}", False), _words_from(text, 4), _has(text, SENTENCE_END), ~_has(text, AFFILIATION))


def continues_block(text: Column) -> Column:
    """A line that goes on with an excluded block: no capital, short, or an affiliation."""
    return (text != "") & (~_has(text, r"^\p{Lu}", False) | ~_words_from(text, 6) | _has(text, AFFILIATION))


def heading_title(text: Column, first: bool) -> Column:
    """Whether a numbered line has the shape of a top-level heading; ``first``: it may be the first section."""
    pattern = FIRST_TITLE if first else NEXT_TITLE
    title = trimmed(F.regexp_extract(text, "(?iuU)" + pattern, 1))
    dotted = F.endswith(title, F.lit("."))
    bare = F.when(dotted, trimmed(F.regexp_replace(title, r"\.$", ""))).otherwise(title)
    words = _words(bare)
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[.,;:]+$", ""))
    verbs = F.array(*map(F.lit, VERBS))
    all_caps = _has(bare, r"\p{Lu}", False) & ~_has(bare, r"\p{Ll}", False)
    prose = (_has(bare, DEMONSTRATIVE) & F.arrays_overlap(plain, verbs)) | (~all_caps & F.arrays_overlap(F.slice(plain, 2, 1000), verbs))
    tests = [
        _has(text, pattern),
        title != "",
        F.length(title) <= 60,
        ~dotted | (F.size(words) <= 3),
        F.size(words).between(1, 6),
        _has(bare, r"^[\p{Lu}\d]", False),
        ~F.contains(bare, F.lit("=")) & ~F.contains(bare, F.lit("+")),
        ~_has(bare, CITATION, False),
        ~_has(bare, CROSS_REFERENCE),
        ~prose,
    ]
    if first:
        tests.append(F.lower(title) != "introduction")
    return _then(*tests)


def line_table(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, page, no, idx, start, end, end_nl, raw, trimmed) for each line; offsets within the page. ``keep``: further columns of the page."""
    rows = pages.select(F.col(doc).alias("doc_id"), F.col(page).cast("int").alias("page"), F.explode(lines(F.col(text))).alias("l"), *(keep or []))
    raw = F.regexp_replace(F.col("l.text"), r"\r?\n\z", "")
    rows = rows.select("doc_id", "page", F.col("l.no").alias("no"), F.col("l.start").alias("start"), (F.col("l.start") + F.length(raw)).alias("end"), F.col("l.end").alias("end_nl"), F.col("l.text").alias("raw"), trimmed(F.col("l.text")).alias("trimmed"), *(keep or []))
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "no")) - 1).cast("int"))


def neighbours(table: DataFrame) -> DataFrame:
    """Adds blankness of and page edges at the neighbouring lines."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    before, after = F.lag("trimmed").over(order), F.lead("trimmed").over(order)
    return table.withColumns(
        {
            "prev_blank": F.coalesce(before == "", F.lit(True)),
            "next_blank": F.coalesce(after == "", F.lit(True)),
            "first_on_page": F.coalesce(F.lag("page").over(order) != F.col("page"), F.lit(True)),
            "last_on_page": F.coalesce(F.lead("page").over(order) != F.col("page"), F.lit(True)),
        }
    )


def without_frame_digits(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)^\d+\s*|\s*\d+$", ""))


def running_headers(table: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc_id, header): short lines at an edge or a gap on two pages or more and over 30 % of the pages.

    ``table``: lines with their neighbours. A line counts with and without the
    digits that frame it.
    """
    total = pages.groupBy(F.col(doc).alias("doc_id")).agg(F.count(F.lit(1)).alias("page_count"))
    edge = F.col("prev_blank") | F.col("next_blank") | F.col("first_on_page") | F.col("last_on_page")
    short = table.filter((F.col("trimmed") != "") & (F.length("trimmed") < 100) & edge).withColumn("bare", without_frame_digits(F.col("trimmed"))).filter("bare <> ''")
    both = short.select("doc_id", "page", F.explode(F.array_distinct(F.array("trimmed", "bare"))).alias("header"))
    counted = both.groupBy("doc_id", "header").agg(F.count_distinct("page").alias("n"))
    return counted.join(total, "doc_id").filter((F.col("n") >= 2) & (F.col("n") > F.col("page_count") * 0.3)).select("doc_id", "header")


def _around(table: DataFrame) -> DataFrame:
    """Adds __around: the lengths of the filled lines within eight lines, the line itself left out."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    length = F.when(F.col("trimmed") != "", F.length("trimmed"))
    return table.withColumn("__above", F.collect_list(length).over(order.rowsBetween(-8, -1))).withColumn("__below", F.collect_list(length).over(order.rowsBetween(1, 8)))


def _width() -> Column:
    around = F.sort_array(F.concat("__above", "__below"))
    return F.when(F.size("__above") + F.size("__below") >= 4, F.get(around, F.floor((F.size("__above") + F.size("__below")) * 3 / 4).cast("int")))


def column_width(table: DataFrame) -> DataFrame:
    """Adds width: the 75th-percentile length of the filled lines within eight lines, the line itself left out; null under four."""
    return _around(table).withColumn("width", _width()).drop("__above", "__below")


def _neighbourhood(table: DataFrame) -> DataFrame:
    """Adds to ``_around`` __prev, the filled line before, and __next, the text of the filled line behind."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    filled = F.when(F.col("trimmed") != "", F.struct("trimmed", "page"))
    held = _around(table).withColumn("__prev", F.last(filled, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # a frame that ends with the document would be read anew for every line
    return held.withColumn("__next", F.expr("lead(nullif(trimmed, '')) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY idx)"))


def _breaks() -> Column:
    """Of a line of ``_neighbourhood``: it interrupts wrapped text as a heading would."""
    width = _width()
    ok = _then(
        F.coalesce(F.col("__prev.page") == F.col("page"), F.lit(False)),
        _has(F.col("__prev.trimmed"), SENTENCE_END),
        ~F.coalesce(_has(F.col("__next"), r"^\p{Ll}", False), F.lit(False)),
        F.length("trimmed") <= F.when(width > 0, width * 0.7),
    )
    return F.coalesce(ok, F.lit(False))


def paragraph_breaks(table: DataFrame) -> DataFrame:
    """Adds width, and breaks: the line interrupts wrapped text as a heading would."""
    return _neighbourhood(table).withColumn("width", _width()).withColumn("breaks", _breaks()).drop("__above", "__below", "__prev", "__next")


def headers_of(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """(doc_id, headers): the running headers of each document that has any."""
    found = running_headers(neighbours(line_table(pages, doc, page, text)), pages, doc)
    return found.groupBy("doc_id").agg(F.collect_set("header").alias("headers"))


def described_lines(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text", several: DataFrame | None = None) -> DataFrame:
    """The line table with every flag that the choice of boundaries needs; a document's lines are in one partition.

    ``several`` (doc_id): documents of more than one page, which alone can have
    running headers; if it is not given, headers are looked for in all.
    boundary is told of lines that look like a heading, block_goes_on of lines
    behind one that begins a block.
    """
    rows = pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page"), F.col(text).alias("text"))
    paged = rows if several is None else rows.join(several.select("doc_id"), "doc_id", "left_semi")
    rows = rows.join(headers_of(paged, page="page"), "doc_id", "left").repartition("doc_id")
    return _flagged(_neighbourhood(neighbours(line_table(rows, page="page", keep=["headers"]))))


def _flagged(table: DataFrame) -> DataFrame:
    t, raw = F.col("trimmed"), F.col("raw")
    running, running_bare = (F.coalesce(F.array_contains("headers", x), F.lit(False)) for x in (t, without_frame_digits(t)))
    lower = F.lower(t)
    verb = _has(F.concat(F.lit(" "), lower, F.lit(" ")), " (?:" + "|".join(VERBS) + ") ", False)
    sentence = body_sentence(t)
    short = (t != "") & (F.length(t) <= 80) & ~_has(raw, DOT_LEADERS)
    edge = F.col("first_on_page") | F.col("last_on_page")
    late = edge & (F.col("page") > 1)
    cover = _has(raw, COVER_SHEET)
    starts = (
        _then(_has(t, KEYWORDS) | _has(t, ARTICLE_HISTORY), ~(verb | sentence))
        | _then(_has(t, AFFILIATION_START), ~_then(_has(t, FUNDING), sentence))
        | _then(_has(t, FOOTNOTE, False), _has(t, CONTACT))
    )
    score = F.when(_then(late, running), 0).when(F.col("prev_blank") | F.col("next_blank") | edge, 3).otherwise(2)
    flags = {
        "abstract_score": F.when(_then(short, _has(t, ABSTRACT)), score),
        "introduction_score": F.when(_then(short, _has(t, INTRODUCTION)), score),
        "next_heading": _then(short, heading_title(t, False), ~running),
        "first_heading": _then(short, heading_title(t, True), ~running),
        "keywords": _has(t, KEYWORDS),
        "inline_jel": _has(t, INLINE_JEL),
        "thanks": _has(t, ACKNOWLEDGMENTS),
        "cover": _then(F.col("idx") == 0, cover),
        "furniture": _then(late, running | running_bare | _has(t, r"^\d+$", False)) | _then(F.col("page") == 1, cover),
        "block_starts": starts,
        "thanks_block": _then(_has(t, ACKNOWLEDGMENTS), ~(F.contains(lower, F.lit("in this paper")) | F.contains(lower, F.lit("we show")))),
        "open_end": _has(t, "[,;-]$", False),
    }
    headed = _then(F.col("next_heading") | F.col("first_heading"), F.col("prev_blank") | F.col("next_blank") | edge | _breaks())
    # a line goes on with a block only if one has begun before it
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    out = table.withColumns(flags).withColumn("boundary", headed).withColumn("__begun", F.coalesce(F.bool_or(F.col("block_starts") | F.col("thanks_block")).over(before), F.lit(False)))
    out = out.withColumn("block_goes_on", _then(F.col("__begun"), continues_block(t)))
    return out.select("doc_id", "page", "idx", "start", "end", "end_nl", "raw", "trimmed", *flags, "boundary", "block_goes_on")


class _Document:
    """Choosing boundaries in one document's described lines."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = rows
        self.warnings: dict[str, set[int]] = {}
        self.sections: list[dict] = []

    def warn(self, code: str, *pages: int) -> None:
        self.warnings.setdefault(code, set()).update(pages)

    def heading_after(self, start: int, first: bool) -> int | None:
        flag = "first_heading" if first else "next_heading"
        for k in range(start, len(self.rows)):
            row = self.rows[k]
            if row[flag] and (k == start or row["boundary"]):
                return k
        return None

    def candidates(self, kind: str) -> list[tuple[int, int]]:
        column = f"{kind}_score"
        return [(k, r[column]) for k, r in enumerate(self.rows) if r[column] is not None]

    def choose(self, kind: str, found: list[tuple[int, int]]) -> int | None:
        best = max((s for _, s in found), default=0)
        if best == 0:
            return None
        pages = {self.rows[k]["page"] for k, _ in found}
        top = [k for k, s in found if s == best]
        if len(top) > 1:
            self.warn(f"ambiguous_{kind}_candidates", *pages)
            return None
        if len(found) > 1:
            self.warn(f"duplicate_{kind}_candidates", *pages)
        return top[0]

    def kept_runs(self, kind: str, start: int, end: int) -> list[list[dict]]:
        """Runs of lines of one page, without running headers, page numbers and blocks of front matter."""
        runs: list[list[dict]] = []
        page, inside, open_end, going = None, False, False, False
        for row in self.rows[start:end]:
            if row["page"] != page:
                page, inside, open_end, going = row["page"], False, False, False
            if row["block_starts"] or (kind == "abstract" and row["thanks_block"]):
                inside = dropped = True
            else:
                inside = inside and row["trimmed"] != "" and (open_end or row["block_goes_on"])
                dropped = inside or row["furniture"]
            if dropped:
                open_end, going = row["open_end"], False
            elif going:
                runs[-1].append(row)
            else:
                runs.append([row])
                going = True
        return runs

    def add(self, kind: str, start: int, end: int, heading: int | None, evidence: list[tuple[int, str, str]]) -> bool:
        runs = self.kept_runs(kind, start, end)
        text = "".join(r["raw"] for run in runs for r in run)
        if not text.strip():
            return False
        marks = [(self.rows[k]["page"], self.rows[k]["start"], self.rows[k]["end"], name, said) for k, name, said in evidence]
        self.sections.append(
            {
                "kind": kind,
                "method": "implicit_front_matter" if heading is None else "explicit_heading",
                "heading": None if heading is None else self.rows[heading]["trimmed"],
                "start_page": runs[0][0]["page"],
                "end_page": runs[-1][0]["page"],
                "spans": [{"page": run[0]["page"], "start": run[0]["start"], "end": run[-1]["end_nl"]} for run in runs],
                "text": text,
                "evidence": [dict(zip(("page", "start", "end", "type", "description"), m, strict=True)) for m in sorted(set(marks))],
            }
        )
        return True

    def implied_abstract(self, top: int, introduction: int | None) -> None:
        """An abstract without a heading: from below the title to the keywords, the thanks or the introduction."""
        stop = introduction
        if stop is None:
            stop = self.heading_after(top, first=True)
        reach = range(top, len(self.rows) if stop is None else stop)
        coded = next((k for k in reach if self.rows[k]["keywords"] or self.rows[k]["inline_jel"]), None)
        thanks = next((k for k in reach if self.rows[k]["thanks"]), None)
        title = (top, "title_block", "below the title")
        if coded is not None and coded > top + 1:
            prose = not self.rows[coded]["keywords"]  # the codes end the abstract's last sentence
            self.add("abstract", top + 1, coded + prose, None, [title, (coded, "jel_classification_terminator", "up to the classification or keywords")])
        elif thanks is not None and thanks > top + 1:
            self.add("abstract", top + 1, thanks, None, [title, (thanks, "acknowledgments_start", "up to the acknowledgments")])
        elif introduction is not None and introduction > top + 1:
            self.add("abstract", top + 1, introduction, None, [title, (introduction, "first_section_heading", "up to the introduction")])

    def implied_introduction(self, top: int) -> None:
        """An introduction without a heading: from the abstract's end, or below the title, to the first numbered heading."""
        start = top + 1
        if self.sections and self.sections[-1]["kind"] == "abstract":
            page, offset = self.sections[-1]["end_page"], self.sections[-1]["spans"][-1]["end"]
            start = next((k for k, r in enumerate(self.rows) if r["page"] >= page and r["start"] >= offset), start)
        stop = self.heading_after(start, first=True)
        if stop is not None and stop > start:
            self.add("introduction", start, stop, None, [(stop, "first_section_heading", "up to the first numbered heading")])

    def detect(self) -> None:
        rows = self.rows
        body = self.heading_after(0, first=True)
        abstracts = [(k, s if body is None or k < body else 0) for k, s in self.candidates("abstract")]
        introductions = self.candidates("introduction")
        self.found = [("abstract", k) for k, _ in abstracts] + [("introduction", k) for k, _ in introductions]
        abstract, introduction = self.choose("abstract", abstracts), self.choose("introduction", introductions)
        chosen = introduction
        if abstract is not None and introduction is not None and introduction <= abstract:
            introduction = None
            self.warn("unresolved_abstract_boundary", rows[abstract]["page"])
        top = 0
        if rows[0]["cover"]:
            top = next((k for k, r in enumerate(rows) if r["page"] > 1), 0)
        settled = False
        if abstract is not None:
            page = rows[abstract]["page"]
            if introduction is not None:
                if not self.add("abstract", abstract + 1, introduction, abstract, []):
                    self.warn("empty_abstract_body", page)
            else:
                limit = self.heading_after(abstract + 1, first=True)
                reach = range(abstract + 1, len(rows) if limit is None else limit)
                stop = next((k for k in reach if rows[k]["keywords"] or rows[k]["thanks"]), None)
                settled = stop is not None and stop > abstract + 1 and self.add("abstract", abstract + 1, stop, abstract, [])
                if not settled:
                    self.warn("unresolved_abstract_boundary", page)
        elif "ambiguous_abstract_candidates" not in self.warnings:
            self.implied_abstract(top, introduction)
        if introduction is not None:
            stop = self.heading_after(introduction + 1, first=False)
            if stop is None:
                self.warn("missing_next_section_boundary")
            if not self.add("introduction", introduction + 1, len(rows) if stop is None else stop, introduction, []):
                self.warn("empty_introduction_body", rows[introduction]["page"])
        elif chosen is None and not settled and not {"ambiguous_introduction_candidates", "unresolved_abstract_boundary"} & self.warnings.keys():
            self.implied_introduction(top)
        kinds = {s["kind"] for s in self.sections}
        if "abstract" not in kinds and not {"ambiguous_abstract_candidates", "unresolved_abstract_boundary", "empty_abstract_body"} & self.warnings.keys():
            self.warn("missing_abstract")
        if "introduction" not in kinds and not {"ambiguous_introduction_candidates", "empty_introduction_body"} & self.warnings.keys():
            self.warn("missing_introduction")

    def result(self) -> dict:
        named = [{"kind": kind, "heading": self.rows[k]["trimmed"], "page": self.rows[k]["page"], "start": self.rows[k]["start"], "end": self.rows[k]["end"]} for kind, k in self.found]
        said = [{"code": code, "pages": sorted(self.warnings[code])} for code in WARNINGS if code in self.warnings]
        return {"doc_id": self.rows[0]["doc_id"], "sections": self.sections, "candidates": named, "warnings": said}


def _arrow_schema(key: pa.DataType) -> pa.Schema:
    """RESULT as an Arrow schema."""
    place = [("page", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    evidence = pa.struct([*place, ("type", pa.string()), ("description", pa.string())])
    section = pa.struct([("kind", pa.string()), ("method", pa.string()), ("heading", pa.string()), ("start_page", pa.int32()), ("end_page", pa.int32()), ("spans", pa.list_(pa.struct(place))), ("text", pa.string()), ("evidence", pa.list_(evidence))])
    candidate = pa.struct([("kind", pa.string()), ("heading", pa.string()), *place])
    warning = pa.struct([("code", pa.string()), ("pages", pa.list_(pa.int32()))])
    return pa.schema([("doc_id", key), ("sections", pa.list_(section)), ("candidates", pa.list_(candidate)), ("warnings", pa.list_(warning))])


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RESULT from described lines in the order of documents and lines; a document may go on in the next batch, and a blank one gives none."""
    rows: list[dict] = []
    shape, out = None, []

    def close() -> None:
        if any(r["trimmed"] for r in rows):
            document = _Document(rows)
            document.detect()
            out.append(document.result())

    for batch in batches:
        shape = shape or _arrow_schema(batch.schema.field("doc_id").type)
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            for row in batch.slice(at, ROWS_AT_ONCE).to_pylist():
                if rows and rows[0]["doc_id"] != row["doc_id"]:
                    close()
                    rows = []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)
                out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, shape)


def detect_sections(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text", documents: DataFrame | None = None) -> DataFrame:
    """Sections, heading candidates and warnings of every document of ``pages``.

    Documents whose pages are all blank get their warnings without a search, as
    do documents (key column ``doc``) of ``documents`` that have no pages.
    """
    kind = dict(pages.dtypes)[doc]
    schema = RESULT.format(key=kind)
    filled = durable(pages.groupBy(F.col(doc).alias("__doc")).agg(F.bool_or(_has(F.coalesce(F.col(text), F.lit("")), NO_SPACE, False)).alias("filled"), F.array_sort(F.collect_list(F.col(page).cast("int"))).alias("pages")))
    several = filled.filter("filled and size(pages) > 1").select(F.col("__doc").alias("doc_id"))
    # blank documents have lines, too, and are left out where theirs are read
    found = shipped(described_lines(pages, doc, page, text, several)).sortWithinPartitions("doc_id", "idx").mapInArrow(_detect, schema)
    types = dict(found.dtypes)
    none = [F.array().cast(types[c]).alias(c) for c in ("sections", "candidates")]

    def only(*codes: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("code"), p.alias("pages")) for c, p in codes]).cast(types["warnings"]).alias("warnings")

    no_pages = F.array().cast("array<int>")
    blank = filled.filter("not filled").select(F.col("__doc").alias("doc_id"), *none, only(("all_pages_empty", F.col("pages")), ("missing_abstract", no_pages), ("missing_introduction", no_pages)))
    out = found.union(blank)
    if documents is not None:
        absent = documents.join(filled.select("__doc"), F.col(doc) == F.col("__doc"), "left_anti").select(F.col(doc).alias("doc_id"), *none, only(("no_pages", no_pages)))
        out = out.union(absent)
    return out
