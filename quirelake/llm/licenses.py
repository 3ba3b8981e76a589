"""Licence scan: ordered signature rules, wholly in Spark expressions.

Each row is scanned by itself, so the operator never shuffles. A cheap
substring gate, implied by every rule, decides which texts are normalised at
all; within those, each distinct keyword is looked for once and gates the
regular expressions of its rules. Detections are intervals;
an interval inside another one of at least its priority is suppressed (equal
intervals: the higher priority, then the smaller label stays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.columns import shielded
from quirelake.llm.license_rules import GATES, RULES, Rule
from quirelake.session import table

#: words of the lower-cased text are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; before lower-casing, A-Z belong to them
_WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: the base phrases and their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_DETECTION = "array<struct<s:int,e:int,p:int,label:string>>"


def _places(words: Column, phrase: str) -> Column:
    """Indices at which the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == part)
        return test

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), lambda i: F.coalesce(here(i), F.lit(False)))
    return starts.cast("array<bigint>")


def _matches(norm: Column, rule: Column) -> Column:
    """Every match of one rule as (start, end, priority, label); offsets in the normalised text."""
    between = F.split(norm, rule["pattern"], F.lit(-1))
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    none = F.lit(None).cast(_DETECTION)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_DETECTION).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        s = acc["at"] + F.length(F.get(between, i))
        e = s + F.length(F.get(found, i))
        row = F.struct(s.alias("s"), e.alias("e"), rule["priority"].alias("p"), rule["label"].alias("label"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])
    return F.coalesce(F.when(F.size(found) > 0, walked), none, F.array().cast(_DETECTION))


def detections(norm: Column, rules: list[Rule] | None = None) -> Column:
    """All rule matches in a normalised text."""
    by_keyword: dict[str, list[Rule]] = {}
    for r in RULES if rules is None else rules:
        by_keyword.setdefault(r.keyword, []).append(r)
    if not by_keyword:
        return F.array().cast(_DETECTION)

    def group(keyword: str, members: list[Rule]) -> Column:
        listed = [F.struct(F.lit(rf"(?<= )(?:{r.pattern})(?= )").alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority")) for r in members]
        return F.struct(F.lit(keyword).alias("keyword"), F.array(*listed).alias("rules"))

    table_ = F.array(*[group(k, members) for k, members in by_keyword.items()])
    gated = F.flatten(F.transform(F.filter(table_, lambda g: F.contains(norm, g["keyword"])), lambda g: g["rules"]))
    return F.flatten(F.transform(gated, lambda r: _matches(norm, r)))


def surviving(found: Column) -> Column:
    """Detections not contained in another of at least their priority.

    Sorted by start, then longest first, an interval lies inside an earlier
    one exactly if the running maximum end among that one's priorities reaches
    its own end, so one pass suffices however many detections a text has.
    Returns a struct of the distinct labels and the characters covered.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("ne"), (-d["p"]).alias("np"), d["label"].alias("label"))))
    zero = F.struct(*[F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)], F.array().cast("array<string>").alias("labels"), F.lit(0).alias("covered"), F.lit(0).alias("reach"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["ne"], -d["np"]
        bar = F.when(priority == 3, acc["m3"]).when(priority == 2, acc["m2"]).otherwise(acc["m1"])
        inside = bar >= end
        return F.struct(
            *[F.when(priority >= p, F.greatest(acc[f"m{p}"], end)).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in (1, 2, 3)],
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            (acc["covered"] + F.greatest(F.lit(0), end - F.greatest(d["s"], acc["reach"]))).alias("covered"),
            F.greatest(acc["reach"], end).alias("reach"),
        )

    return F.aggregate(ordered, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["covered"].alias("covered")))


@shielded
def scan_licenses(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the columns of the scan appended.

    Added: n_words, n_base, first_word, last_word, base_labels, labels, score
    (share of the normalised characters that detections cover, 0 to 1).
    Null and empty texts have no words, no places, null positions and empty
    label strings. Rows are judged one by one, so repeated rows repeat their
    result; other columns pass through, and columns of the input named like an
    added one are replaced.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    gate = F.lit(False)
    lowered = F.col("__lower")
    for keyword in GATES if rules is None else [*{r.keyword for r in rules}, *(phrase.split()[0] for phrase, _ in BASE)]:
        gate = gate | F.contains(lowered, F.lit(keyword))
    words = F.transform(F.regexp_extract_all(raw, F.lit(_WORD_RAW), F.lit(0)), lambda w: F.translate(w, _UPPER, _LOWER))
    out = docs.withColumn("__lower", F.lower(raw))
    out = out.withColumn("__words", F.when(gate, words)).drop("__lower")
    out = out.withColumn("__norm", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")))
    empty = F.array().cast("array<bigint>")
    for k, (phrase, _) in enumerate(BASE):
        out = out.withColumn(f"__at{k}", F.when(F.contains("__norm", F.lit(f" {phrase} ")), _places(F.col("__words"), phrase)).otherwise(empty))
    out = out.withColumn("__method", F.when(F.col("__words").isNotNull(), surviving(detections(F.col("__norm"), rules))))
    places = F.concat(*[F.col(f"__at{k}") for k in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"__at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    none = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "n_words": F.coalesce(F.size("__words"), F.regexp_count(raw, F.lit(_WORD_RAW))).cast("long"),
            "n_base": F.size(places).cast("long"),
            "first_word": F.array_min(places),
            "last_word": F.array_max(places),
            "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","),
            "labels": F.array_join(F.array_sort(F.array_union(base, F.coalesce(F.col("__method.labels"), none))), ","),
            "score": F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("__method.covered").cast("double"), F.length("__norm").cast("double")), F.lit(0.0))),
        }
    )
    return out.drop("__words", "__norm", "__method", *[f"__at{k}" for k in range(len(BASE))])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text")
