"""Awkward documents that every operator must take, and helpers."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, kept string, score string"

PROSE = {
    "en": "the quick answer to this was that they would have to go with the others and think about what they had done before",
    "de": "die schnelle antwort darauf war dass sie mit den anderen gehen und über das nachdenken mussten was sie vorher getan hatten",
    "fr": "la réponse rapide à cela était qu'ils devaient aller avec les autres et penser à ce qu'ils avaient fait auparavant",
}


def prose(lang: str, k: int, words: int = 60) -> str:
    """Invented running text: the language's words in an order of its own for each k."""
    base = PROSE[lang].split()
    out, x = [], 12345 + 7919 * k
    for n in range(words):
        x = (1103515245 * x + 12345) % (1 << 31)
        out.append(base[(x >> 8) % len(base)] + (".\n" if n % 12 == 11 else ""))
    return " ".join(out)


def awkward(spark, extra=()):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    texts = [None, "", " \n\t ", "...", "word", "Two words", "a\x00b \x85 é 漢字 😀", "\n\n\n", "x" * 70_000, prose("en", 1, 30_000)]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else f"s{k}", None, "r", "k", "s") for k, t in enumerate(texts)]
    rows += [(None, prose("en", 2), None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(50, prose("de", 3), "de", "s0", 1, "a", "b", "c")] * 2 + [(50, prose("fr", 4), "fr", "s0", 1, "a", "b", "c"), (51, prose("de", 3), "de", "s1", 1, "a", "b", "c")]
    rows += [(100 + k, t, "en", "s0", 0, "", "", "") for k, t in enumerate(extra)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
