"""Text functions as Spark columns. Offsets and lengths count code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.shipping import ship_package

#: fixed value: a token is a maximal run of letters and numbers
TOKEN = r"[\p{L}\p{N}]+"

#: fixed values: all that counts as white space, also the four separators below U+0020
SPACE = r"[\s\x1c-\x1f]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers.

    Equals full case folding for all texts whose only folding beyond lower case
    is sharp s; ``strict_tokens`` covers the rest and compatibility forms.
    """
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit(TOKEN), F.lit(0))


#: texts whose tokens are Python objects at once
CUT_AT_ONCE = 256


@F.arrow_udf(T.ArrayType(T.StringType()))
def _folded_tokens(text: pa.Array) -> pa.Array:

    def cut(value: str | None) -> list[str]:
        folded = unicodedata.normalize("NFKC", value or "").casefold()
        return "".join(c if c.isalnum() else " " for c in folded).split()

    parts = [pa.array([cut(v) for v in text.slice(at, CUT_AT_ONCE).to_pylist()], pa.list_(pa.string())) for at in range(0, max(len(text), 1), CUT_AT_ONCE)]
    return pa.concat_arrays(parts)


def strict_tokens(text: Column) -> Column:
    """Tokens after NFKC and full case folding, for any script."""
    ship_package(SparkSession.active())
    return _folded_tokens(text)


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda value: unicodedata.normalize("NFKC", value or "").casefold())


def folded(text: Column) -> Column:
    """NFKC and full case folding; null is empty."""
    ship_package(SparkSession.active())
    return _folded(text)


def ascii_words(text: Column) -> Column:
    """Lower-cased ASCII words; any other character separates. ``ascii_words(folded(text))`` also folds compatibility forms."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    """Characters that the class ``pattern`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


#: fixed values: C0 controls but tab, newline, carriage return and form feed; delete; C1
CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f]"


def page_counters(text: Column, run: int = 12) -> dict[str, Column]:
    """The six counters of a page; ``run`` is the length from which repetition counts."""
    text = F.coalesce(text, F.lit(""))
    repeated = F.regexp_extract_all(text, F.lit(rf"(?sU)([^\s\x1c-\x1f])\1{{{run - 1},}}"), F.lit(0))
    return {
        "characters": F.length(text),
        "non_whitespace": F.length(F.regexp_replace(text, "(?U)" + SPACE, "")),
        "printable": F.length(text) - count_of(text, r"[\t\n\r\f]") - count_of(text, CONTROL),
        "controls": count_of(text, CONTROL),
        "replacements": count_of(text, "�"),
        "repeated": F.aggregate(repeated, F.lit(0), lambda acc, x: acc + F.length(x)),
    }


#: fixed values: a line with its newline; the digits that frame a running header
LINE = r"[^\n]*\n|[^\n]+\z"
FRAME_DIGITS = r"^\d+\s*|\s*\d+$"
#: fixed value: a paragraph with the blank lines behind it
PARAGRAPH = r"(?s).*?\n[ \t]*\n+|.+\z"


def pieces(text: Column, pattern: str) -> Column:
    """Consecutive pieces that cover the text, as structs (no, start, end, text), offsets half open."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<no:int,start:int,end:int,text:string>>")

    def step(acc: Column, piece: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        return F.concat(acc, F.array(F.struct(F.size(acc).alias("no"), start.alias("start"), (start + F.length(piece)).alias("end"), piece.alias("text"))))

    return F.aggregate(found, empty, step)


def lines(text: Column) -> Column:
    return pieces(text, LINE)


def paragraphs(text: Column) -> Column:
    return pieces(text, PARAGRAPH)


def oversized_pieces(budget: int) -> str:
    """Cuts behind the last white space within the budget that has text before it, else at the budget; a rest within it stays whole."""
    return rf"(?Us).{{1,{budget}}}\z|(?=.{{0,{budget - 2}}}?[^\s\x1c-\x1f]{SPACE}).{{1,{budget - 1}}}{SPACE}|.{{1,{budget}}}"


def without_frame_digits(line: Column) -> Column:
    return F.regexp_replace(line, FRAME_DIGITS, "")


def without_controls(text: Column, keep_layout: bool = False) -> Column:
    """Control characters become U+FFFD; ``keep_layout`` spares tab and newline."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]" if keep_layout else r"[\x00-\x1f\x7f-\x9f]", "�")


def page_range(first: Column, last: Column) -> Column:
    """``N/A``, ``3`` or ``3-4``."""
    return F.when(first.isNull(), "N/A").when(last.isNull() | (last == first), first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


#: fixed values: identifiers
PAPER_ID = r"\A[a-z0-9]+(?:[._-][a-z0-9]+)*\z"
PASSAGE_ID = r"\A[a-z0-9]+(?:[.:_-][a-z0-9]+)*\z"
NAME_ID = r"\A[a-z0-9]+(?:[._-][a-z0-9]+)*\z"


def is_id(value: Column, pattern: str) -> Column:
    """Whether a string has the form of an identifier; null has not."""
    return F.coalesce(F.regexp_like(value, F.lit(pattern)), F.lit(False))


#: fixed values: how a runtime marks a line as an error, and how much of it is shown
ERROR_LINE = r"\bE\s+\w+:\s*"
ERROR_CHARS = 200


def error_line(output: Column) -> Column:
    """The message of the last line marked as an error; empty if there is none. Unmarked lines, which may quote documents, are never shown."""
    lines_ = F.transform(F.split(F.coalesce(output, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda line: F.trim(line))
    marked = F.filter(F.transform(lines_, lambda line: F.trim(F.regexp_extract(line, r"^.*?" + ERROR_LINE + "(.*)$", 1))), lambda m: m != "")
    return F.left(F.coalesce(F.try_element_at(marked, F.lit(-1)), F.lit("")), F.lit(ERROR_CHARS))


def url_problem(url: Column) -> Column:
    """Why a URL is not acceptable as a source: null if it is."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^:/?#]*):([^/?#]*)", 1)
    return (
        F.when(url.isNull(), "missing")
        .when(F.regexp_like(url, F.lit("(?U)[\\s\\x00-\\x1f\\x7f]")), "whitespace")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "host")
        .when((port != "") & (~F.regexp_like(port, F.lit(r"^\d{1,5}$")) | (F.try_to_number(port, F.lit("99999")) > 65535)), "port")
    )


def canonical_text(value: Column) -> Column:
    """A string as canonical JSON: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for raw, escaped in named.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rest = out
    for code in range(0x20):
        if chr(code) not in named:
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(F.regexp_like(value, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]")), rest).otherwise(out), F.lit('"'))
