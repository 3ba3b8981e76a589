"""Fill-in-the-middle transformation of texts, cut at the boundaries of a unit grammar.

A grammar says where a unit may end by neighbouring classes of characters: a
boundary stands wherever a character of the left class meets one of the right
class. As a regex of zero width, a lookbehind and a lookahead, it lets Spark's
``split`` cut a text without losing a character. ``split`` makes one empty piece
of an empty text, which has no unit: that case is handled on its own.

Prefix, middle and suffix are runs of units, and the output writes them in one
of two orders behind sentinels, from which ``restored`` rebuilds the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.columns import packed, quoted, unpacked
from quirelake.session import table

_SPACE, _OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: for each grammar the pairs of classes (left, right) between which a unit ends
GRAMMARS = {
    "token": [(_OTHER, _SPACE)],  # a word with the space before it; space at the end by itself
    "word": [(_OTHER, _SPACE), (_SPACE, _OTHER)],  # runs of space and of everything else
    "line": [(r"\n", r"[\s\S]")],  # a line with its newline
    "sentence": [(r"[.!?。！？]", _SPACE), (r"[。！？]", _OTHER)],  # a sentence with the space before it
    "identifier": [(r"\p{Ll}", r"\p{Lu}"), (r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"), (r"[^\p{L}\p{N}]", r"[\p{L}\p{N}]")],  # words of source code, camel case cut
    "character": [(r"[\s\S]", r"[\s\S]")],  # code points
}
SENTINELS = ("<P>", "<S>", "<M>")
#: the columns that the transformation appends
ADDED = ("fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output")


def boundary(grammar: str) -> str:
    """The regex of zero width at which units of ``grammar`` end."""
    if grammar not in GRAMMARS:
        raise ValueError(f"no grammar {grammar}; known: {', '.join(GRAMMARS)}")
    return "|".join(f"(?<={left})(?={right})" for left, right in GRAMMARS[grammar])


def units(text: Column, grammar: str = "token") -> Column:
    """The pieces of ``text``, which joined give it again; no piece of an empty or null text."""
    return F.when(F.length(text) > 0, F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels can be found again if none begins another and no first character stands elsewhere in one."""
    if len(sentinels) != 3 or not all(sentinels):
        raise ValueError("three sentinels are needed, none of them empty")
    if any(a.startswith(b) for k, a in enumerate(sentinels) for j, b in enumerate(sentinels) if j != k):
        raise ValueError("no sentinel may begin with another one")
    if {s[0] for s in sentinels} & set("".join(s[1:] for s in sentinels)):
        raise ValueError("the first character of a sentinel may stand nowhere else in one")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from."""
    prefix, suffix, middle = sentinels

    def behind(mark: str, until: str | None = None) -> Column:
        rest = F.substring_index(output, mark, -1)
        return rest if until is None else F.substring_index(rest, until, 1)

    psm = F.concat(behind(prefix, suffix), behind(middle), behind(suffix, middle))
    spm = F.concat(behind(prefix, middle), behind(middle), behind(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    grammar: str = "token",
    sentinels: tuple[str, str, str] = SENTINELS,
    seed: int = 42,
    fim_percent: int = 50,
    spm_percent: int = 80,
) -> DataFrame:
    """``docs`` with fim_units (long), fim_form (plain, psm, spm), fim_prefix, fim_middle, fim_suffix and fim_output (string).

    Draws come from sha256 of ``seed:key`` as four unsigned numbers of 32 bits: the first two
    choose the cuts among the places 0 to n, the third whether the text is transformed, the fourth
    the order. Equal keys draw equally, so reruns and repeated rows agree. A text that holds a
    sentinel, an empty one and a null one stay plain: their pieces are null and their output is the
    text, empty for null. A null key draws as the empty one. Input columns of these six names, in
    whatever letter case, are replaced; all others pass through untouched. An empty table gives an
    empty table. Every row is worked on by itself; nothing is shuffled.
    """
    check_sentinels(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(key).cast("string"), F.lit(""))), 256)
    drawn = packed(docs, ADDED, body=F.coalesce(quoted(text), F.lit("")), digest=digest)
    h1, h2, h3, h4 = (F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))
    marked = F.lit(False)
    for sentinel in sentinels:
        marked = marked | F.contains("body", F.lit(sentinel))
    plain = (F.col("body") == "") | marked | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    cut = drawn.select("row", "body", form.alias("form"), units(F.col("body"), grammar).alias("units"), h1.alias("h1"), h2.alias("h2"))
    places = F.size("units") + 1
    cut = cut.select("row", "body", "form", "units", F.least(F.col("h1") % places, F.col("h2") % places).cast("int").alias("a"), F.greatest(F.col("h1") % places, F.col("h2") % places).cast("int").alias("z"))

    def piece(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, length), ""))

    a, z = F.col("a"), F.col("z")
    pieces = cut.select("row", "body", "form", F.size("units").cast("long").alias("n"), piece(F.lit(0), a).alias("prefix"), piece(a, z - a).alias("middle"), piece(z, F.size("units") - z).alias("suffix"))
    p, s, m = (F.lit(x) for x in sentinels)
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm = F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("body"))
    return pieces.select(*unpacked(docs, ADDED), F.col("n").alias("fim_units"), F.col("form").alias("fim_form"), F.col("prefix").alias("fim_prefix"), F.col("middle").alias("fim_middle"), F.col("suffix").alias("fim_suffix"), output.alias("fim_output"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into tokens and transformed, with the digest of the text rebuilt from its output."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.length("fim_prefix").cast("long").alias("prefix_chars"),
        F.length("fim_middle").cast("long").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


#: tokens by matching them instead of cutting between them; what is rebuilt is held against the text itself
OP11_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(d, 1, 8) AS BIGINT), CAST('0x' || substr(d, 9, 8) AS BIGINT), CAST('0x' || substr(d, 17, 8) AS BIGINT), CAST('0x' || substr(d, 25, 8) AS BIGINT)] AS x FROM h),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS z,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:z], '') AS mid, array_to_string(u[z + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
