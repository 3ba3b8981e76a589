"""Line deduplication by content-defined chunks of lines, wholly in Spark expressions.

A text is cut at newlines, and chunks of consecutive lines are matched over the
whole corpus by a hash over their line hashes. Where a chunk begins and ends
depends on the lines in it alone, so what is inserted before it does not shift
it. Every line opens a chunk, which ends as soon as it is a passage, and closes
one, which begins as late as it can: chunks overlap. Boundaries that a rolling
hash chooses more sparsely (one line in two or four) were measured to leave most
short passages in, as a passage need not hold a whole chunk; see the README.

A run of consecutive lines is a passage if it has two lines or more (or is one
line of ``solid_chars``) and ``min_chars`` characters. A line goes exactly if
some passage around it also stands at an earlier place that does not overlap it,
in the same document or another one; places are ordered by (doc_id, text hash,
line). So every line that goes has an earlier copy that stays. It is enough to
look at the chunks: if a passage is repeated, each of its lines lies in a chunk
within it. Chunks go after their bytes have been compared with those of the
first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable, unpartitioned
from quirelake.llm.columns import shielded
from quirelake.session import table

SOLID_CHARS = 96
MIN_CHARS = 48


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _windows(docs: DataFrame, text: str, min_chars: int, solid_chars: int) -> DataFrame:
    """Adds __hashes (of the lines) and __windows (start line, number of lines)."""
    out = docs.withColumn("__lines", _lines(text))
    out = out.withColumn("__hashes", F.transform("__lines", lambda line: F.xxhash64(line)))
    out = out.withColumn("__lengths", F.transform("__lines", lambda line: F.length(line)))
    most = max(min_chars + 1, 2)  # every further line adds a newline at least

    def walk(lengths: Column) -> Column:
        """Number of leading lines that make a passage of two lines or more; null if all of them do not."""
        start = F.struct(F.lit(-1).alias("chars"), F.lit(0).alias("n"))

        def enough(acc: Column) -> Column:
            return (acc["chars"] >= min_chars) & (acc["n"] >= 2)

        def step(acc: Column, length: Column) -> Column:
            more = F.struct((acc["chars"] + length + 1).alias("chars"), (acc["n"] + 1).alias("n"))
            return F.when(enough(acc), acc).otherwise(more)

        return F.aggregate(lengths, start, step, lambda acc: F.when(enough(acc), acc["n"]))

    def shortest(i: Column, neighbour: Column, lengths: Column) -> Column:
        own = F.get("__lengths", i)
        return F.when(own >= max(solid_chars, min_chars), 1).when(own + 1 + F.get("__lengths", neighbour) >= min_chars, 2).otherwise(walk(lengths))

    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    out = out.withColumn("__ahead", F.transform(places, lambda i: shortest(i, i + 1, F.slice("__lengths", i + 1, most))))
    behind = F.transform(places, lambda i: shortest(i, i - 1, F.reverse(F.slice("__lengths", F.greatest(i + 1 - most, F.lit(0)) + 1, F.least(i + 1, F.lit(most))))))
    begins = F.transform("__ahead", lambda n, i: F.struct(i.alias("start"), n.alias("n")))
    ends = F.transform(behind, lambda n, i: F.struct((i - n + 1).alias("start"), n.alias("n")))
    begins = F.filter(begins, lambda w: w["n"].isNotNull())
    ends = F.filter(ends, lambda w: w["n"].isNotNull() & ~F.get("__ahead", w["start"]).eqNullSafe(w["n"]))
    return out.withColumn("__windows", F.concat(begins, ends))


def _places(docs: DataFrame, text: str, key: str, min_chars: int, solid_chars: int) -> DataFrame:
    """One row for each window: its hash, its number of lines and where it stands."""
    cut = _windows(docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).withColumn("__row", F.xxhash64("__text")), "__text", min_chars, solid_chars)
    listed = F.transform("__windows", lambda w: F.struct(F.xxhash64(F.slice("__hashes", w["start"] + 1, w["n"])).alias("window"), w["start"].alias("start"), w["n"].alias("n")))
    rows = cut.select("__id", "__row", F.explode(listed).alias("w"))
    return rows.select("w.window", "w.n", F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("w.start").alias("start")).alias("at"))


@shielded
def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, solid_chars: int = SOLID_CHARS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``removed_lines`` (long) appended.

    Null texts stay null and empty ones empty. A text that consists of
    repeated passages only becomes the empty string. Rows equal in key and text
    count as one place and get equal results; rows with a null key come
    last in the order. An empty table gives an empty table. Other columns pass
    through untouched; an input column named removed_lines is replaced.

    A window's copies are never gathered: its first and last place come from
    pre-aggregated min and max, and copies meet the first one in a join that
    adaptive execution may split. Only windows with two places or more have
    their text looked up, which a second time reads the documents' exchange.
    """
    plain = docs.drop("removed_lines")
    places = _places(docs, text, key, min_chars, solid_chars)
    repeated = places.groupBy("window").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first != last").select(unpartitioned("window").alias("window"), "first")
    is_first = F.col("at") == F.col("first")
    overlaps = F.col("at.id").eqNullSafe(F.col("first.id")) & (F.col("at.row") == F.col("first.row")) & (F.col("at.start") < F.col("first.start") + F.col("n"))
    found = places.join(repeated, "window").filter(is_first | ~overlaps)
    window = F.struct("window", F.col("at.start").alias("start"), "n")
    wanted = found.groupBy(F.col("at.id").alias("__gid"), F.col("at.row").alias("__grow"))
    wanted = durable(wanted.agg(F.collect_set(F.when(is_first, window)).alias("first"), F.collect_set(F.when(~is_first, window)).alias("later")))

    marked = plain.withColumn("__text_hash", F.xxhash64(F.col(text)))

    def meet(per_doc: DataFrame, how: str) -> DataFrame:
        return marked.join(per_doc, marked[key].eqNullSafe(per_doc["__gid"]) & (F.col("__text_hash") == F.col("__grow")), how)

    def bodies(which: str, *columns: str) -> DataFrame:
        met = meet(wanted.filter(F.size(which) > 0).select("__gid", "__grow", F.col(which).alias("__which")), "inner").withColumn("__lines", _lines(text))
        rows = F.transform("__which", lambda w: F.struct(w["window"].alias("window"), w["start"].alias("start"), w["n"].alias("n"), F.array_join(F.slice("__lines", w["start"] + 1, w["n"]), "\n").alias("body")))
        return met.select("__gid", "__grow", F.explode(rows).alias("w")).select(*columns)

    stays = bodies("first", "w.window", F.col("w.body").alias("kept_body")).dropDuplicates(["window"]).withColumn("window", unpartitioned("window"))
    later = bodies("later", "__gid", "__grow", "w.window", "w.start", "w.n", "w.body")
    gone = later.join(stays, "window").filter(F.col("body") == F.col("kept_body"))
    per_doc = gone.groupBy("__gid", "__grow").agg(F.collect_set(F.struct("start", "n")).alias("__gone"))
    cut = meet(per_doc, "left").withColumn("__lines", _lines(text))
    touched = F.col("__gone").isNotNull()
    numbers = F.flatten(F.transform("__gone", lambda w: F.sequence(w["start"], w["start"] + w["n"] - 1)))
    cut = cut.withColumn("__kept", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), numbers))
    rebuilt = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    lost = F.size("__lines") - F.size("__kept")
    # computed in a generator, which a later filter on the text or the count cannot be pushed through:
    # pushed down, it would repeat the cutting of the lines for every line
    result = F.struct(F.when(touched, rebuilt).otherwise(F.col(text)).alias("__new_text"), F.when(touched, lost).otherwise(F.lit(0)).cast("long").alias("__lost"))
    out = cut.select(*plain.columns, F.inline(F.array(result)))
    return out.select(*[F.col("__new_text").alias(text) if c == text else c for c in plain.columns], F.col("__lost").alias("removed_lines"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


#: the same by plain SQL, chunks compared as text
OP6_SQL = rf"""
WITH l AS (SELECT *, length(line) AS len, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
p AS (SELECT a.doc_id, a.no AS s, b.no AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.no - a.no BETWEEN 1 AND {MIN_CHARS} AND b.off + b.len - a.off >= {MIN_CHARS}),
w AS (SELECT doc_id, no AS s, no AS e FROM l WHERE len >= {max(SOLID_CHARS, MIN_CHARS)}
  UNION SELECT doc_id, s, min(e) FROM p SEMI JOIN (SELECT doc_id, no AS s FROM l WHERE len < {max(SOLID_CHARS, MIN_CHARS)}) USING (doc_id, s) GROUP BY doc_id, s
  UNION SELECT doc_id, max(s), e FROM p SEMI JOIN (SELECT doc_id, no AS e FROM l WHERE len < {max(SOLID_CHARS, MIN_CHARS)}) USING (doc_id, e) GROUP BY doc_id, e),
t AS (SELECT w.*, substr(text, CAST(a.off AS BIGINT) + 1, CAST(b.off + b.len - a.off AS BIGINT)) AS body FROM w JOIN documents USING (doc_id) JOIN l a ON a.doc_id = w.doc_id AND a.no = s JOIN l b ON b.doc_id = w.doc_id AND b.no = e),
f AS (SELECT body, doc_id AS fd, s AS fs FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM t) WHERE nth = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS no FROM t JOIN f USING (body) WHERE doc_id <> fd OR s > fs + e - s),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM l ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 0 THEN coalesce(kept.text, '') ELSE d.text END AS text, coalesce(n, 0) AS removed_lines, length(CASE WHEN n > 0 THEN coalesce(kept.text, '') ELSE d.text END) AS n_chars
FROM documents d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
