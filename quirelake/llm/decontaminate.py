"""Benchmark decontamination: size-partitioned MinHash containment search, wholly in Spark expressions.

An item counts as contained in a document if at least ``percent`` % of its
distinct five-word shingles stand in the document. Words are maximal runs of
letters and digits, lower-cased. An item of one to four words is one shingle,
all its words in a row.

Items are partitioned by size (number of shingles, powers of two). Every item
is represented by its bottom-k MinHash sketch: its k smallest shingle hashes,
where k follows from the partition's largest size s as s - ceil(percent s / 100)
+ 1. An item that is contained lacks at most s - ceil(percent s / 100) shingles,
so at least one of its k smallest is in the document: the search misses
nothing, whatever the document's length, and a long document costs no more per
word than a short one. The candidates are then verified within their document's
row, with all shingles of the item, compared as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.durable import durable, unpartitioned
from quirelake.session import table

SIZE = 5
PERCENT = 80
SHORT_CHARS = 12
#: estimated size of the items with all their shingles up to which index and items are broadcast; larger ones are joined by shuffle
BROADCAST_BYTES = 32 << 20
ITEMS_A_ROW = 256  # candidates of a document that are verified together

_WORD = r"[\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _grams(words: Column, width: int, make: Callable[..., Column]) -> Column:
    """``make`` of each ``width`` consecutive words; empty if there are fewer."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make(*[F.get(words, i + k) for k in range(width)])))


def _text(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def _items(benchmark: DataFrame, item_text: str, item_key: str) -> DataFrame:
    """(code, item, width, size, grams: hash and text of each distinct shingle, smallest hash first); code stands for the item, whose id may be null."""
    rows = benchmark.select(F.col(item_key).alias("item"), _words(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(SIZE)))
    found = F.lit(None)
    for width in range(1, SIZE + 1):
        both = _grams(F.col("words"), width, lambda *w: F.struct(F.xxhash64(*w).alias("hash"), _text(*w).alias("gram")))
        found = F.when(F.col("width") == width, both).otherwise(found)
    grams = rows.select("item", "width", F.array_distinct(found).alias("grams")).distinct()
    return grams.select(F.xxhash64("item", "grams").alias("code"), "item", "width", F.size("grams").alias("size"), F.array_sort("grams").alias("grams"))


def _sketches(items: DataFrame, percent: int) -> DataFrame:
    """(hash, code): the bottom-k sketch of every item, k by its size partition."""
    top = (F.pow(F.lit(2.0), F.floor(F.log2("size")) + 1) - 1).cast("int")  # the largest size in the item's partition
    k = top - F.ceil(top * F.lit(percent) / 100).cast("int") + 1
    return items.withColumn("k", k).select("code", F.explode(F.slice("grams", 1, F.col("k"))).alias("g")).select(F.col("g.hash").alias("hash"), "code")


def contained_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", percent: int = PERCENT) -> DataFrame:
    """(key, row, item, item_words, item_shingles, matched, containment) for each document and item it contains.

    row is xxhash64 of the document's text; item_words is 5, or the number of
    words of a shorter item. Null and empty texts and items without a word
    contain nothing and are contained in nothing. A null key is kept; rows
    equal in key and text give one result; equal items under several ids are
    reported under each. Empty tables give an empty result; other columns of
    the inputs are not read.
    """
    items = durable(_items(benchmark, item_text, item_key))
    sketches = _sketches(items, percent)
    held = items.groupBy("width").agg(F.sum(F.col("size") * 32 + 2 * F.length(F.array_join("grams.gram", ""))).alias("bytes")).collect()  # five rows at most
    small = F.broadcast if sum(r["bytes"] for r in held) <= BROADCAST_BYTES else (lambda df: df)
    widths = sorted(r["width"] for r in held)

    texts = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    words = texts.withColumn("words", _words(F.col("text"))).drop("text")
    none = F.array().cast("array<bigint>")
    hashed = words.select("id", "row", F.explode(F.concat(none, *[F.coalesce(_grams(F.col("words"), w, F.xxhash64), none) for w in widths])).alias("hash"))
    candidates = durable(hashed.join(small(sketches), "hash").select("id", "row", "code").distinct())

    # one document's candidates may be as many as there are items: they are dealt out over rows
    many = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("id", "row")) / ITEMS_A_ROW)
    listed = candidates.withColumn("turn", F.pmod("code", many))
    whole = listed.join(small(items.select("code", "item", "width", "size", F.col("grams.gram").alias("grams"))), "code")
    wanted = whole.groupBy("id", "row", "turn").agg(F.collect_list(F.struct("item", "width", "size", "grams")).alias("items"))
    met = texts.join(wanted.select(F.col("id").alias("wid"), unpartitioned("row").alias("wrow"), "items"), F.col("id").eqNullSafe(F.col("wid")) & (F.col("row") == F.col("wrow")))
    met = met.select("id", "row", "items", _words(F.col("text")).alias("words"))
    said = {}
    for w in widths:
        said[w] = f"__said{w}"
        met = met.withColumn(said[w], F.when(F.array_contains(F.transform("items", lambda it: it["width"]), w), F.array_distinct(_grams(F.col("words"), w, _text))))

    def matched(it: Column) -> Column:
        found = F.lit(0)
        for w in widths:
            found = F.when(it["width"] == w, F.size(F.array_intersect(it["grams"], F.coalesce(said[w], F.array().cast("array<string>"))))).otherwise(found)
        return found

    counted = met.select("id", "row", F.inline(F.transform("items", lambda it: F.struct(it["item"].alias("item"), it["width"].alias("width"), it["size"].alias("size"), matched(it).alias("matched")))))
    counted = counted.filter(F.col("matched") * 100 >= F.col("size") * percent).dropDuplicates(["id", "row", "item", "width", "size", "matched"])
    return counted.select(
        F.col("id").alias(key), "row", "item", F.col("width").cast("long").alias("item_words"), F.col("size").cast("long").alias("item_shingles"), F.col("matched").cast("long").alias("matched"), (F.col("matched") / F.col("size")).alias("containment")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, item_text: str = "text", short_chars: int = SHORT_CHARS) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item; columns and clean rows stay as they are.

    An item of fewer than five words drops documents only from ``short_chars``
    letters and digits on: an item like "yes" is no sign of a leak.
    ``contained_items`` reports it all the same.
    """
    telling = benchmark.filter((F.size(_words(F.col(item_text))) >= SIZE) | (F.length(F.array_join(_words(F.col(item_text)), "")) >= short_chars))
    hit = contained_items(docs, telling, text, key, item_text, percent=percent).select(F.col(key).alias("__hid"), F.col("row").alias("__hrow")).distinct()
    return docs.join(hit, docs[key].eqNullSafe(hit["__hid"]) & (F.xxhash64(docs[text]) == hit["__hrow"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items it contains."""
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), "item_words", "item_shingles", "matched", "containment")


#: the same by plain SQL: all shingles of all items against all shingles of all documents
OP2_SQL = r"""
WITH b AS (SELECT item_id, ws, least(len(ws), 5) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS ws FROM benchmark) WHERE len(ws) > 0),
d AS (SELECT doc_id, ws, w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS ws FROM documents), (SELECT DISTINCT w FROM b) WHERE len(ws) >= w),
bg AS (SELECT DISTINCT item_id, w, array_to_string(ws[i:i+w-1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS i FROM b)),
dg AS (SELECT DISTINCT doc_id, w, array_to_string(ws[i:i+w-1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS i FROM d)),
n AS (SELECT item_id, w, count(*) AS size FROM bg GROUP BY 1, 2)
SELECT doc_id, n.item_id, n.w AS item_words, n.size AS item_shingles, count(*) AS matched, count(*) / n.size AS containment
FROM dg JOIN bg USING (w, gram) JOIN n ON n.item_id = bg.item_id AND n.w = bg.w
GROUP BY doc_id, n.item_id, n.w, n.size HAVING count(*) * 100 >= n.size * 80
"""
