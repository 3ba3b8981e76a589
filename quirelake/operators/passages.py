"""Passages: greedy packing of paragraphs into a character budget, with provenance."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import canonical_text, oversized_pieces, paragraphs

BUDGET = 1200  # fixed value: the default budget of conversion
_RANGES = "array<struct<start:int,end:int>>"


def split_oversized(text: Column, budget: int) -> Column:
    """Lengths of the pieces of a text longer than the budget."""
    return F.transform(F.regexp_extract_all(text, F.lit(oversized_pieces(budget)), F.lit(0)), lambda p: F.length(p))


def packed_ranges(text: Column, budget: int = BUDGET) -> Column:
    """Half-open ranges of at most ``budget`` characters, packed from whole paragraphs where they fit.

    A paragraph that fits neither the open range nor the budget closes the
    range and is split by itself. Ranges of white space only are left out.
    """
    empty = F.array().cast(_RANGES)
    zero = F.struct(empty.alias("out"), F.lit(-1).alias("open"), F.lit(0).alias("end"))

    def close(acc: Column) -> Column:
        return F.when(acc["open"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])

    def alone(p: Column) -> Column:
        start = F.struct(empty.alias("out"), p["start"].alias("at"))

        def take(acc: Column, n: Column) -> Column:
            piece = F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"))
            return F.struct(F.concat(acc["out"], F.array(piece)).alias("out"), (acc["at"] + n).alias("at"))

        return F.aggregate(split_oversized(p["text"], budget), start, take, lambda acc: acc["out"])

    def step(acc: Column, p: Column) -> Column:
        long = p["end"] - p["start"] > budget
        fits = (acc["open"] >= 0) & (p["end"] - acc["open"] <= budget)
        return (
            F.when(long, F.struct(F.concat(close(acc), alone(p)).alias("out"), F.lit(-1).alias("open"), p["end"].alias("end")))
            .when(fits, F.struct(acc["out"].alias("out"), acc["open"].alias("open"), p["end"].alias("end")))
            .otherwise(F.struct(close(acc).alias("out"), p["start"].alias("open"), p["end"].alias("end")))
        )

    ranges = F.aggregate(paragraphs(text), zero, step, close)
    return F.filter(ranges, lambda r: F.regexp_like(F.substring(text, r["start"] + 1, r["end"] - r["start"]), F.lit(r"(?Us)[^\s\x1c-\x1f]")))


def passage_id(paper: Column, ordinal: Column, text: Column, settings: str, kind: Column) -> Column:
    """A content address: sha256 of the canonical JSON of five keys in sorted order."""
    parts = [
        F.lit('{"ordinal_position":'),
        ordinal.cast("string"),
        F.lit(',"paper_id":'),
        canonical_text(paper.cast("string")),
        F.lit(',"section_kind":'),
        canonical_text(kind),
        F.lit(f',"settings_fingerprint":"{settings}","text":'),
        canonical_text(text),
        F.lit("}"),
    ]
    return F.concat(F.lit("passage-"), F.sha2(F.concat(*parts), 256))


def settings_fingerprint(budget: int = BUDGET) -> str:
    return hashlib.sha256(json.dumps({"budget": budget, "method": "greedy-paragraphs"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def split_passages(docs: DataFrame, budget: int = BUDGET, key: str = "doc_id", text: str = "text", kind: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(paper_id, passage_id, kind, ordinal, start, end, text) for every passage of every text, and the columns of ``docs`` in ``keep``.

    With ``kind`` a paper may have several texts, its sections; passages never
    cross them and ordinals run over all of them, abstract first.
    """
    if isinstance(budget, bool) or budget < 2:
        raise ValueError("the budget must be at least 2 characters")
    named = F.lit("document") if kind is None else kind
    rows = docs.select(F.col(key).alias("paper_id"), named.alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("whole"), *(keep or []))
    cut = rows.select("paper_id", "kind", "whole", *(keep or []), F.posexplode(packed_ranges(F.col("whole"), budget)).alias("ordinal", "r"))
    if kind is not None:
        order = Window.partitionBy("paper_id").orderBy(F.when(F.col("kind") == "abstract", 0).otherwise(1), "kind", "ordinal")
        cut = cut.withColumn("ordinal", F.row_number().over(order) - 1)
    cut = cut.select("paper_id", "kind", "ordinal", *(keep or []), F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.substring(F.col("whole"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("text"))
    return cut.withColumn("passage_id", passage_id(F.col("paper_id"), F.col("ordinal"), F.col("text"), settings_fingerprint(budget), F.col("kind")))


#: width of the bins in which intervals meet
BIN = 4096


def binned(intervals: DataFrame, width: int = BIN) -> DataFrame:
    """``intervals`` (with start and end) once for each bin of ``width`` that they reach into, as ``bin``."""
    if width < 1:
        raise ValueError("a bin must be at least 1 wide")
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))


def page_fragments(passages: DataFrame, pages: DataFrame, width: int = BIN) -> DataFrame:
    """Intersections of passages (paper_id, passage_id, start, end) with pages (paper_id, page_number, start, end).

    Offsets are those of the document; each fragment also has its offset in its
    page and in its passage. Both are dealt out over bins of the document and
    meet by (paper_id, bin), so a long document is many small joins; two that
    share several bins are taken in the one where the later of them starts.
    """
    p, q = binned(passages, width).alias("p"), binned(pages, width).alias("q")
    start, end = F.greatest("p.start", "q.start"), F.least("p.end", "q.end")
    overlap = (F.col("p.start") < F.col("q.end")) & (F.col("q.start") < F.col("p.end")) & (F.floor(start / width) == F.col("p.bin"))
    return p.join(q, (F.col("p.paper_id") == F.col("q.paper_id")) & (F.col("p.bin") == F.col("q.bin")) & overlap).select(
        "p.paper_id",
        "p.passage_id",
        "q.page_number",
        (start - F.col("q.start")).alias("page_start"),
        (end - F.col("q.start")).alias("page_end"),
        (start - F.col("p.start")).alias("passage_start"),
        (end - F.col("p.start")).alias("passage_end"),
    )


def fragment_violations(fragments: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages whose fragments do not cover them from 0 without gap or overlap."""
    listed = fragments.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("passage_start", "passage_end"))).alias("f"))
    joined = passages.select("passage_id", (F.col("end") - F.col("start")).alias("size")).join(listed, "passage_id", "left")
    reach = F.aggregate(F.coalesce("f", F.array().cast("array<struct<passage_start:int,passage_end:int>>")), F.lit(0), lambda acc, x: F.when(acc == x["passage_start"], x["passage_end"]).otherwise(F.lit(-1)))
    return joined.filter(reach != F.col("size")).select("passage_id")


def markdown(title: Column, sections: Column) -> Column:
    """``# title`` and the ``sections``: array<struct<heading, slices: array<struct<page, text>>>>.

    Within a section a page marker stands where the page of a non-empty slice
    changes; blank lines separate the parts.
    """

    def body(slices: Column) -> Column:
        zero = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("page"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.when((acc["out"] != "") & ~F.endswith(acc["out"], F.lit("\n")), "\n").otherwise("")
            mark = F.when(acc["page"] != s["page"], F.concat(gap, F.lit("<!-- page: "), s["page"].cast("string"), F.lit(" -->\n"))).otherwise("")
            return F.when(s["text"] == "", acc).otherwise(F.struct(F.concat(acc["out"], F.coalesce(mark, F.lit("")), s["text"]).alias("out"), s["page"].cast("int").alias("page")))

        return F.aggregate(slices, zero, step, lambda acc: acc["out"])

    def add(out: Column, section: Column) -> Column:
        gap = F.when(F.endswith(out, F.lit("\n\n")), "").when(F.endswith(out, F.lit("\n")), "\n").otherwise("\n\n")
        return F.concat(out, gap, F.lit("## "), section["heading"], F.lit("\n\n"), body(section["slices"]))

    return F.aggregate(sections, F.concat(F.lit("# "), title), add)


def convert_sections(detected: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Passages of detected sections (doc_id, sections) with fragments: where each character stands on its page.

    (paper_id, passage_id, kind, ordinal, start, end, text, fragments:
    array<struct<page, start, end, passage_start, passage_end>>).
    """
    each = detected.select("doc_id", F.explode("sections").alias("s"))
    cut = split_passages(each.select("doc_id", F.col("s.kind").alias("kind"), F.col("s.text").alias("text")), budget, kind=F.col("kind"))
    zero = F.array().cast("array<struct<page:int,start:int,from:int,to:int>>")

    def place(acc: Column, span: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["to"], F.lit(0))
        return F.concat(acc, F.array(F.struct(span["page"].alias("page"), span["start"].alias("start"), at.alias("from"), (at + span["end"] - span["start"]).alias("to"))))

    sources = each.select(F.col("doc_id").alias("__doc"), F.col("s.kind").alias("__kind"), F.aggregate("s.spans", zero, place).alias("sources"))
    joined = cut.join(sources, (F.col("paper_id") == F.col("__doc")) & (F.col("kind") == F.col("__kind")))
    meeting = F.filter("sources", lambda x: F.greatest(x["from"], F.col("start")) < F.least(x["to"], F.col("end")))

    def fragment(x: Column) -> Column:
        a, b = F.greatest(x["from"], F.col("start")), F.least(x["to"], F.col("end"))
        return F.struct(x["page"].alias("page"), (x["start"] + a - x["from"]).alias("start"), (x["start"] + b - x["from"]).alias("end"), (a - F.col("start")).alias("passage_start"), (b - F.col("start")).alias("passage_end"))

    return joined.select("paper_id", "passage_id", "kind", "ordinal", "start", "end", "text", F.transform(meeting, fragment).alias("fragments"))
