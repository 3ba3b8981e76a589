"""Mixing sources to target weights by balanced sampling with the cube method.

A source of size s and target t takes each of its documents floor(t/s) times,
and once more with the inclusion probability t/s - floor(t/s). The cube method
decides those: it keeps moving the fractional probabilities of three documents
along the direction that leaves both their sum (documents) and their weighted
sum (tokens) unchanged, until one of them is 0 or 1. What it cannot decide, two
documents at most, is left to the next level and in the end to a landing phase
that picks the rounding nearest to the source's token total.

The flight runs in blocks of bounded size within a source, so a source of any
size is spread over many tasks; the undecided rest of all blocks, two documents
each, flies again until a source is down to one block. All draws are hashes of
the document, so that runs agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.durable import durable, unpartitioned
from quirelake.llm.columns import shielded
from quirelake.session import table
from quirelake.shipping import shipped

WEIGHTS = (5, 2, 1)
CEILING = 3  # times a source's size
BLOCK = 4_000
REPEATS = 1_000  # equal rows spelled out at a time
_WORD = r"[^\x20\x09-\x0D]+"
_TINY = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, documents, target) from (source, source_size, documents).

    Sources in the order of their code points, null last, weigh ``weights``,
    repeating. Targets share the total of all sizes by weight; what a target
    exceeds ``ceiling`` times its source's size is shared again among the
    others until none does. A source of size 0 has the target 0.

    Sources are numbered without gathering them: a range partitioning, a number
    within each partition, and the partitions' offsets.
    """
    spark = sizes.sparkSession
    spread = durable(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["n"] for r in spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets = dict(zip(sorted(counts), np.append(0, np.cumsum([counts[p] for p in sorted(counts)]))[:-1].tolist(), strict=True))
    shift = spark.createDataFrame([(p, o) for p, o in offsets.items()] or [(0, 0)], "part int, before long")
    number = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("before")
    ranked = spread.join(F.broadcast(shift), "part").withColumn("rank", number)
    weighed = durable(ranked.select("source", "source_size", "documents", F.get(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight")))
    total = weighed.agg(F.sum("source_size")).head()[0] or 0
    rate, room = 0.0, F.col("source_size") * ceiling
    while True:  # a source once at its ceiling stays there, as the rate only rises
        full = F.col("weight") * rate > room
        row = weighed.agg(F.sum(F.when(full, room)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).head()
        new = (total - (row["full"] or 0)) / row["open"] if row["open"] else rate
        if new <= rate:
            break
        rate = new
    return weighed.select("source", "source_size", "documents", F.least((F.col("weight") * rate).cast("double"), room.cast("double")).alias("target"))


def flight(probability: list[float], size: list[float], draw: list[float]) -> list[float]:
    """The probabilities after flying; all but two at most are 0 or 1.

    Sum and size-weighted sum of the probabilities stay what they were.
    """
    p = list(probability)
    active: list[int] = []
    waiting = iter(range(len(p)))
    while True:
        while len(active) < 3:
            k = next(waiting, None)
            if k is None:
                return p
            if p[k] <= _TINY or p[k] >= 1 - _TINY:
                p[k] = round(p[k])
            else:
                active.append(k)
        a, b, c = active
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min(((1 - p[k]) / d if d > 0 else p[k] / -d) for k, d in zip(active, u, strict=True) if d)
        down = min((p[k] / d if d > 0 else (1 - p[k]) / -d) for k, d in zip(active, u, strict=True) if d)
        # up with probability down/(up + down): no probability changes in expectation
        move = up if draw[a] * (up + down) < down else -down
        for k, d in zip(active, u, strict=True):
            p[k] += move * d
            if p[k] <= _TINY or p[k] >= 1 - _TINY:
                p[k] = round(p[k])
        active = [k for k in active if 0 < p[k] < 1]


def landing(probability: list[float], size: list[float], swaps: int = 6) -> list[float]:
    """Rounds what a flight left undecided so that the token total changes least.

    The undecided ones, two at most, may be large. All their roundings are
    tried; what the best of them lacks or exceeds is then made up by changing
    up to ``swaps`` decided ones, each time the one that brings the total
    nearest to its target (the first of equally good ones), as long as it helps.
    """
    out = np.array(probability, float)
    weight = np.array(size, float)
    rest = np.flatnonzero((out > 0) & (out < 1))
    if not len(rest):
        return out.tolist()
    bits = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1).astype(float)
    excess = ((bits - out[rest]) * weight[rest]).sum(axis=1)
    best = int(np.abs(np.round(excess, 6)).argmin())
    over = float(excess[best])
    out[rest] = bits[best]
    for _ in range(swaps):
        after = np.abs(over + np.where(out > 0, -weight, weight))
        k = int(after.argmin())
        if after[k] >= abs(over) - 0.5:
            break
        over += -weight[k] if out[k] > 0 else weight[k]
        out[k] = 1 - out[k]
    return out.tolist()


def _fly(block: pd.DataFrame) -> pd.DataFrame:
    # the largest fly first, so that what stays undecided is small
    block = block.sort_values(["weight", "draw", "unit"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size, draw = block["weight"].tolist(), ((block["draw"].to_numpy() >> 11) & ((1 << 52) - 1)) / float(1 << 52)
    p = flight(block["p"].tolist(), size, draw.tolist())
    # a source's only block lands
    done = landing(p, size) if bool((block["blocks"] == 1).all()) else p
    return block.assign(p=np.array(done, float))


_UNIT = "unit long, sid long, weight long, p double, draw long, block long, blocks long"


def _decide(units: DataFrame, block: int) -> DataFrame:
    """(unit, take) for (unit, sid, weight, p, draw): 1 or 0 for every unit."""
    decided, flying = None, units
    salt = 0
    while True:
        per_source = flying.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
        sized = per_source.select(unpartitioned("sid").alias("__sid"), F.ceil(F.col("n") / block).cast("long").alias("blocks"))
        dealt = flying.join(sized, F.col("sid") == F.col("__sid")).withColumn("block", F.pmod(F.xxhash64("draw", "unit", F.lit(salt)), F.col("blocks")))
        # dealt out anew: the grouping alone would accept rows dealt by source, with a large source in one task
        spread = dealt.select("unit", "sid", "weight", "p", "draw", "block", "blocks").repartition("sid", "block")
        flown = durable(shipped(spread).groupBy("sid", "block").applyInPandas(_fly, _UNIT))
        settled = flown.filter(F.col("p").isin(0.0, 1.0)).select("unit", F.col("p").cast("int").alias("take"))
        decided = settled if decided is None else decided.union(settled)
        flying = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).select("unit", "sid", "weight", "p", "draw")
        if not flying.head(1):
            return decided
        salt += 1


def mix_sources(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, block: int = BLOCK) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken, multiplicity), one row for each kind of row.

    Rows equal in key, source and size are one kind: they are decided together
    and get the same number of copies; multiplicity says how many there are.
    Null texts have size 0; null keys and sources are values like any other.
    Rows of size 0 and of sources of size 0 are taken 0 times. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    kinds = durable(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("multiplicity")))
    sizes = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("multiplicity")).alias("source_size"), F.sum("multiplicity").alias("documents"))
    targets = durable(source_targets(sizes, weights, ceiling).withColumn("sid", F.xxhash64("source")))
    named = targets.select(unpartitioned("sid").alias("__sid"), "source_size", "target")
    rated = kinds.withColumn("sid", F.xxhash64("source")).join(named, F.col("sid") == F.col("__sid")).drop("__sid")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    base = F.when(F.col("size") > 0, F.floor(rate + 1e-12)).otherwise(0)
    rated = durable(rated.withColumn("unit", F.xxhash64("id", "source", "size")).withColumn("base", base.cast("int")).withColumn("p", F.when(F.col("size") > 0, F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0))).otherwise(0.0)))
    units = rated.filter("p > 0").select("unit", "sid", (F.col("size") * F.col("multiplicity")).alias("weight"), "p", F.xxhash64("unit", F.lit(7)).alias("draw"))
    decided = _decide(units, block)
    copies = F.col("base") + F.coalesce("take", F.lit(0))
    joined = rated.join(decided, "unit", "left").withColumn("copies", copies)
    return joined.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "multiplicity")


@shielded
def apply_mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies`` (int) and ``taken`` (long: copies times words) appended."""
    mix = mix_sources(docs, text, key, source).select(F.col(key).alias("__id"), F.col(source).alias("__source"), F.col("size").alias("__size"), "copies", "taken").filter("copies > 0")
    plain = docs.drop("copies", "taken")
    sized = plain.withColumn("__words", word_count(F.col(text)))
    joined = sized.join(mix, sized[key].eqNullSafe(mix["__id"]) & sized[source].eqNullSafe(mix["__source"]) & (F.col("__words") == F.col("__size")))
    return joined.select(*plain.columns, "copies", "taken")


def repeated(kinds: DataFrame, times: str = "multiplicity", piece: int = REPEATS) -> DataFrame:
    """``kinds`` with every row as often as its column ``times`` says.

    Counts are cut into pieces, which are dealt out before they are spelled
    out, so that one row with a great count keeps no task busy.
    """
    pieces = kinds.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / piece))))
    sized = pieces.withColumn("__left", F.least(F.lit(piece).cast("long"), F.col(times) - F.col("__piece") * piece).cast("int"))
    dealt = sized.repartition(*[F.col(c) for c in kinds.columns], F.col("__piece"))
    return dealt.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__left")))).select(*kinds.columns)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and how many of their words the mix takes."""
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return repeated(mix).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
