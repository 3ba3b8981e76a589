from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import evaluate, passages, quality


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).head().x


def test_strict_tokens_fold_and_normalise(spark):
    text = "ﬁnance STRASSE straße İstanbul x_y 2½ don't"
    folded = unicodedata.normalize("NFKC", text).casefold()
    want = "".join(c if c.isalnum() else " " for c in folded).split()
    assert one(spark, text, T.strict_tokens) == want
    assert one(spark, "Straße, a_b 12", T.tokens) == ["strasse", "a", "b", "12"]
    assert one(spark, None, T.tokens) == []


def test_lines_and_paragraphs_cover_the_text(spark):
    for value in ("", "a", "a\n", "a\n\nb", "\n\n a \n \t\n\n\nb", "x\ny\n"):
        for cut in (T.lines, T.paragraphs):
            found = one(spark, value, cut)
            assert "".join(p.text for p in found) == value
            assert [p.start for p in found] == [sum(len(q.text) for q in found[:k]) for k in range(len(found))]


def greedy(text, budget):
    """A plain model of the packing."""
    import re

    ends = [m.end() for m in re.finditer(r"\n[ \t]*\n+", text)]
    marks = [0, *ends] + ([len(text)] if not ends or ends[-1] < len(text) else [])
    out, start, end = [], None, 0
    for a, b in zip(marks, marks[1:], strict=False):
        if b - a > budget:
            if start is not None:
                out.append((start, end))
                start = None
            while b - a > budget:
                cut = next((k + 1 for k in range(a + budget - 1, a, -1) if text[k].isspace() and text[a : k + 1].strip()), a + budget)
                out.append((a, cut))
                a = cut
            if a < b:
                out.append((a, b))
        elif start is not None and b - start <= budget:
            end = b
        else:
            if start is not None:
                out.append((start, end))
            start, end = a, b
    if start is not None:
        out.append((start, end))
    return [(a, b) for a, b in out if text[a:b].strip()]


def test_packing_follows_the_model(spark):
    cases = ["", "   ", "a" * 25, "      aaaaaaaaaaaaaaaaaaa bb", "one two three\n\nfour\n\nfive six seven eight nine ten eleven", "x \n\n \n\ny", "ab cd ef gh ij kl mn op", " " * 30 + "z", "a\n \nb\n\n\nc" * 4]
    for value in cases:
        found = one(spark, value, lambda t: passages.packed_ranges(t, 12))
        assert [(r.start, r.end) for r in found] == greedy(value, 12), repr(value)


def test_passages_have_unique_content_addresses(spark):
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, ""), (4, None)], "doc_id long, text string")
    rows = passages.split_passages(docs).collect()
    assert len(rows) == len({r.passage_id for r in rows}) == 2


def test_markdown_marks_page_changes(spark):
    sections = F.array(F.struct(F.lit("Abstract").alias("heading"), F.array(*[F.struct(F.lit(p).alias("page"), F.lit(t).alias("text")) for p, t in ((1, "a"), (2, ""), (2, "b\n"), (2, "c"))]).alias("slices")))
    assert one(spark, "T", lambda t: passages.markdown(t, sections)) == "# T\n\n## Abstract\n\na\n<!-- page: 2 -->\nb\nc"


def test_page_counters(spark):
    text = "a\x00\x85b\tc\n" + "x" * 12 + " " * 20 + "�" + "y" * 11
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in T.page_counters(F.col("t")).items()]).head()
    assert got.characters == len(text)
    assert got.non_whitespace == sum(not c.isspace() for c in text)
    assert (got.controls, got.replacements, got.repeated) == (2, 1, 12)
    assert got.printable == len(text) - 2 - 2


def assess(spark, pages):
    rows = spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(pages)], "doc_id string, page_number int, text string")
    row = quality.quality_status(quality.document_quality(quality.page_quality(rows))).head()
    return row.warnings, row.status


def test_quality_thresholds(spark):
    good = "Plain words of a page, long enough. " * 8
    assert assess(spark, [good, good]) == ([], "usable")
    assert assess(spark, ["", " \n"]) == (["all_pages_empty"], "likely_needs_ocr")
    assert assess(spark, [good, ""])[0] == ["empty_pages", "high_empty_page_ratio"]
    assert assess(spark, [good, good, ""]) == (["empty_pages"], "usable_with_warnings")
    assert assess(spark, ["short text"])[0] == ["very_low_text_volume", "sparse_pages"]
    assert assess(spark, [good * 20, good, good, good])[0] == ["severe_page_imbalance"]
    assert assess(spark, [good + "\x01" * 60])[1] == "unusable"
    assert "repeated_characters" in assess(spark, [good + "z" * 12])[0]
    assert "repeated_characters" not in assess(spark, [good + "z" * 11])[0]


def test_url_problems(spark):
    for url, want in (("https://a.b/c", None), ("ftp://a.b", "scheme"), ("http:///x", "host"), ("http://a b", "whitespace"), (None, "missing"), ("http://a:99999/", "port"), ("http://[::1]:80/", None), ("nope", "scheme")):
        assert one(spark, url, T.url_problem) == want, url


def test_packing_follows_the_model_on_random_texts(spark):
    import random

    rng = random.Random(11)
    texts = ["".join(rng.choice("ab \n\t") * rng.choice((1, 1, 1, 7)) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for budget in (5, 16):
        got = {r.k: [(x.start, x.end) for x in r.x] for r in rows.select("k", passages.packed_ranges(F.col("t"), budget).alias("x")).collect()}
        for k, text in enumerate(texts):
            assert got[k] == greedy(text, budget), (budget, text)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_fragments_equal_all_pairs(spark, width):
    """Intervals of any kind, overlapping, empty and long ones too: each intersection once, whatever the bins."""
    import random

    rng = random.Random(width)

    def intervals(n):
        starts = [(rng.choice("ab"), rng.randrange(60)) for _ in range(n)]
        return [(d, k, s, s + rng.choice((0, 1, 5, 30))) for k, (d, s) in enumerate(starts)] + [("a", n, 0, 90), ("c", n + 1, 3, 4)]

    left, right = intervals(25), intervals(25)
    cut = spark.createDataFrame(left, "paper_id string, passage_id long, start int, end int")
    pages = spark.createDataFrame(right, "paper_id string, page_number long, start int, end int")
    got = sorted((r.paper_id, r.passage_id, r.page_number, r.passage_start, r.passage_end, r.page_start, r.page_end) for r in passages.page_fragments(cut, pages, width).collect())
    want = sorted((d, k, n, max(a, x) - a, min(b, y) - a, max(a, x) - x, min(b, y) - x) for d, k, a, b in left for e, n, x, y in right if d == e and a < y and x < b)
    assert got == want and len(got) > 50


def test_a_long_document_is_joined_in_proportion(spark):
    """200,000 lines and as many passages of one document."""
    lines = spark.range(200_000).select(F.lit("d").alias("paper_id"), (F.col("id") + 1).alias("page_number"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 10).cast("int").alias("end"))
    cut = spark.range(200_000).select(F.lit("d").alias("paper_id"), F.col("id").alias("passage_id"), (F.col("id") * 10 + 5).cast("int").alias("start"), (F.col("id") * 10 + 15).cast("int").alias("end"))
    assert passages.page_fragments(cut, lines).count() == 399_999


def test_variants_are_numbered_without_their_texts(spark, monkeypatch):
    """Texts go neither through the numbering nor into its stored rows; they are joined once."""
    seen = []

    def watched(step):
        return lambda rows, *args, **named: seen.append(rows.columns) or step(rows, *args, **named)

    for name in ("running_total", "numbered"):
        monkeypatch.setattr(evaluate, name, watched(getattr(evaluate, name)))
    held = spark.createDataFrame([(7, "b", "seven", 0), (3, "a", "three", 0), (5, "a", "five", 1)], "passage_id long, paper_id string, text string, ordinal int")
    made = {r.passage_id: (r.paper_id, r.ordinal, r.text.replace("\n\nSynthetic resource-scaling variant ", "|")) for r in evaluate.scaled_corpus(held, 8).collect()}
    assert len(seen) == 2 and not any("text" in columns for columns in seen)
    assert made == {
        "7": ("b", 0, "seven"), "3": ("a", 0, "three"), "5": ("a", 1, "five"),
        "scale-00000004-3": ("a", 2, "three|4."), "scale-00000005-5": ("a", 3, "five|5."), "scale-00000006-7": ("b", 1, "seven|6."), "scale-00000007-3": ("a", 4, "three|7."), "scale-00000008-5": ("a", 5, "five|8."),
    }
