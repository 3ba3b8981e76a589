"""Document fingerprints: threshold-scaled sketches of word shingles, wholly in Spark expressions.

A sketch retains every shingle hash below a bound, which is a fixed fraction of
all hash values; of a text too short for that to leave ``floor`` hashes it
retains the ``floor`` smallest, that is, every one below a larger bound of its
own. It carries its bound, so two sketches are compared below the smaller one of
their bounds, where both are whole: a fixed share of either document whatever
their sizes, which makes containment as well as resemblance estimates unbiased
between very unequal documents. The sketch of two documents together is the
union of theirs below the smaller bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.llm.columns import packed, quoted, unpacked
from quirelake.llm.merkle import row_digest
from quirelake.operators.ranking import running_total
from quirelake.session import table

SHINGLE = 5  # words
FRACTION = 1 / 16
FLOOR = 64
#: hashes are 63 bits: a bound that all are below
ALL = 2**63 - 1

_SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text in lower case; none of a null one."""
    body = F.btrim(F.lower(text), F.lit(_SPACES))
    return F.when(F.length(body) > 0, F.split(body, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def with_sketch(rows: DataFrame, text: Column, name: str, size: int = SHINGLE, fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """``rows`` with the sketch of ``text``: struct of below (long) and hashes (ascending longs).

    A text of fewer than ``size`` words is one shingle; one without words, and
    a null one, has an empty sketch that is whole.
    """
    if size < 1 or floor < 0 or not 0 < fraction <= 1:
        raise ValueError("a shingle has a word or more, a fraction is above 0 and 1 at most")
    bound = min(int(fraction * 2**63), ALL)
    kept = rows.columns
    # each step in a select of its own: what is used twice is not computed twice
    hashed = rows.select(*map(quoted, kept), F.transform(words(text), lambda w: F.xxhash64(w)).alias("__words"))
    count = F.size("__words")

    def shingle(i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*[F.get("__words", i + k) for k in range(size)]), 1)

    whole = F.array(F.shiftrightunsigned(F.xxhash64("__words"), 1))
    several = F.transform(F.sequence(F.lit(0), F.greatest(count - size, F.lit(0))), shingle)
    every = hashed.select(*map(quoted, kept), F.when(count >= size, several).when(count > 0, whole).otherwise(F.array().cast("array<long>")).alias("__every"))
    sampled = every.select(*map(quoted, kept), F.when(F.size("__every") > floor, F.array_distinct(F.filter("__every", lambda h: h < bound))).alias("__low"), "__every")
    enough = (F.size("__every") > floor) & (F.size("__low") >= floor)
    # only a short text has all its shingles sorted; one more than the floor tells where its bound is
    chosen = sampled.select(*map(quoted, kept), F.when(enough, F.sort_array("__low")).otherwise(F.slice(F.sort_array(F.array_distinct("__every")), 1, floor + 1)).alias("__kept"), enough.alias("__enough"))
    below = F.when(F.col("__enough"), F.lit(bound)).when(F.size("__kept") > floor, F.greatest(F.element_at("__kept", -1), F.lit(bound))).otherwise(F.lit(ALL)).cast("long")
    held = F.when(F.col("__enough"), F.col("__kept")).otherwise(F.slice("__kept", 1, floor))
    return chosen.select(*map(quoted, kept), F.struct(below.alias("below"), held.alias("hashes")).alias(name))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    below = F.least(a["below"], b["below"])
    return F.struct(below.alias("below"), F.sort_array(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda h: h < below)).alias("hashes"))


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hashes of a, of b and of both below the smaller bound."""
    below = F.least(a["below"], b["below"])
    mine, other = (F.filter(s["hashes"], lambda h: h < below) for s in (a, b))
    return F.size(mine).cast("double"), F.size(other).cast("double"), F.size(F.array_intersect(mine, other)).cast("double")


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles; 1 of two without any, 0 of one without and one with."""
    mine, other, both = _common(a, b)
    empty = (F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0)
    return F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(both, mine + other - both), F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second one has; 1 of a text without any."""
    mine, _, both = _common(a, b)
    return F.when(F.size(a["hashes"]) == 0, 1.0).otherwise(F.coalesce(F.try_divide(both, mine), F.lit(0.0)))


def as_text(sketch: Column) -> Column:
    """The sketch as text: bound, colon, hashes, in sixteen hexadecimal digits each."""
    hashes = F.array_join(F.transform(sketch["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")
    return F.concat(F.lpad(F.lower(F.hex(sketch["below"])), 16, "0"), F.lit(":"), hashes)


def from_text(fingerprint: Column) -> Column:
    """The sketch that ``as_text`` wrote."""

    def number(digits: Column) -> Column:
        return F.conv(digits, 16, 10).cast("long")

    groups = F.regexp_extract_all(F.substring_index(fingerprint, ":", -1), F.lit("[0-9a-f]{16}"), 0)
    return F.struct(number(F.substring_index(fingerprint, ":", 1)).alias("below"), F.transform(groups, number).alias("hashes"))


def fingerprint_documents(docs: DataFrame, text: str = "text", size: int = SHINGLE, fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """``docs`` with ``fingerprint`` (string) and ``sketch`` (struct) of every whole text.

    Equal texts get equal fingerprints. Null, empty and blank texts get the
    sketch without hashes. Every row is worked on by itself, so repeated rows
    get equal results, and nothing is shuffled. Input columns called
    fingerprint or sketch, in whatever letter case, are replaced, all others
    pass through untouched. An empty table gives an empty table.
    """
    added = ("fingerprint", "sketch")
    rows = with_sketch(packed(docs, added, body=quoted(text)), F.col("body"), "sketch", size, fraction, floor)
    return rows.select(*unpacked(docs, added), as_text(F.col("sketch")).alias("fingerprint"), "sketch")


def successors(docs: DataFrame) -> DataFrame:
    """(mark, doc_id, n_chars, next_mark, times): what follows each row of ``docs`` (mark, doc_id, n_chars), the first one after the last.

    Rows ascend by doc_id, null first, then by mark, a digest of the row.
    Repeated rows follow each other: all but the last are followed by an equal one.
    """
    distinct = durable(docs.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies")))
    placed = durable(running_total(distinct, ["doc_id", "mark"], name="nth"))
    count = placed.count()
    follows = placed.select(F.col("mark").alias("next_mark"), F.when(F.col("nth") == 1, F.lit(count).cast("long")).otherwise(F.col("nth") - 1).alias("before"))
    linked = placed.join(follows, F.col("nth") == F.col("before"))
    ways = F.array(F.struct(F.col("next_mark"), F.lit(1).cast("long").alias("times")), F.struct(F.col("mark").alias("next_mark"), (F.col("copies") - 1).alias("times")))
    return linked.select("mark", "doc_id", "n_chars", F.inline(ways)).filter("times > 0")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; likeness is the share of the document's shingles that the other text has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_digest([F.col("doc_id"), F.coalesce("text", F.lit(""))]).alias("mark"))
    links = durable(successors(marked.select("mark", "doc_id", F.length("text").cast("long").alias("n_chars"))))
    links = links.withColumn("swapped", F.expr("n_chars div 4").cast("int"))
    # the texts are dealt out by mark once, for the sketches of next documents and for the documents themselves
    bodies = marked.groupBy("mark").agg(F.first("text").alias("body"))
    needed = links.select(F.col("mark").alias("for_mark"), "next_mark", "doc_id", "n_chars", "swapped", "times")
    following = bodies.join(needed, F.col("mark") == F.col("next_mark"))
    heads = fingerprint_documents(following, "body").select("for_mark", "doc_id", "n_chars", "swapped", "times", F.substring("body", F.lit(1), F.col("swapped")).alias("head"), F.col("sketch").alias("next_sketch"))
    met = fingerprint_documents(bodies.join(heads, F.col("mark") == F.col("for_mark")), "body")
    edited = met.select("doc_id", "n_chars", "times", "sketch", "next_sketch", F.concat(F.substring("body", F.lit(1), F.col("n_chars").cast("int") - F.col("swapped")), "head").alias("edited"))
    compared = with_sketch(edited, F.col("edited"), "edited_sketch")
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    out = compared.select(
        "doc_id",
        "n_chars",
        "times",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(other).alias("edited_fingerprint"),
        containment(own, other).alias("near_edited"),
        containment(own, following).alias("near_next"),
        resemblance(own, other).alias("resembles_edited"),
        resemblance(own, following).alias("resembles_next"),
    )
    # repeated rows, told by their number until here
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
