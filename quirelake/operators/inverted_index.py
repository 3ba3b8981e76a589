"""A stored inverted index for BM25: what a batch of questions reads is its terms' postings, not the corpus.

Passages are numbered into blocks of ``BLOCK``. A posting row holds one term in
one block: how many passages have it, their places and counts, and the greatest
count and smallest length among them. Those two bound the term's weight in the
block for any parameters and any average length, so the index need not be
rewritten as the corpus grows. For a question, a block's bounds add up to more
than any of its passages can score. The most promising blocks are scored first;
what they yield is a score that the k-th answer reaches in any case, and blocks
bounded below it are passed over. Scores, ranks and ties are those of ``bm25``.

Tables of the library: ``postings`` (ordered by term and block), ``indexed`` (a
row a passage: block, place, length, digest of its tokens) and ``index_sizes``
(passages and tokens added by each change). All changes are appended or touch
the files of the passages alone: a removal deletes rows of ``indexed``, whose
postings thereby count for nothing, and adds negative counts for its terms.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirelake.durable import durable
from quirelake.functions.text import tokens
from quirelake.operators import bm25
from quirelake.operators.ranking import running_total
from quirelake.shipping import shipped
from quirelake.sources.library import Library

#: passages in a block
BLOCK = 64
#: blocks that a task scores together
GROUP = 32
#: blocks scored first for each question
SEEDS = 4
#: blocks up to which they reach the scan as a filter
PUSHED_BLOCKS = 100
POSTINGS = "term string, block long, n int, max_tf int, min_dl int, entries array<struct<place:int,tf:int,dl:int>>"
SIZES = "n long, tokens long"


def _described(passages: DataFrame, key: str, text: str, tokenizer: bm25.Tokenizer) -> DataFrame:
    """(passage_id, tokens, dl, sequence)."""
    return bm25.tokenised(passages, key, text, tokenizer).select("passage_id", "tokens", F.size("tokens").alias("dl"), F.md5(F.array_join("tokens", " ")).alias("sequence"))


def _sizes(described: DataFrame, sign: int) -> DataFrame:
    return described.agg((F.count(F.lit(1)) * sign).alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).cast("long").alias("tokens"))


def extend(library: Library, passages: DataFrame, key: str = "passage_id", text: str = "text", tokenizer: bm25.Tokenizer = tokens) -> int:
    """Adds the passages that the index does not hold yet, as one version of the library.

    Keys must be unique. A passage that is held with the same tokens is left
    alone, so a batch may be repeated; one held with others must be removed
    first and is an error.
    """
    described = _described(passages, key, text, tokenizer)
    sized = durable(described.select("passage_id", "dl", "sequence"))
    held = library.table("indexed", described.select("passage_id", "sequence").schema).select(F.col("passage_id").alias("held_id"), F.col("sequence").alias("held_sequence"))
    met = durable(sized.join(held, F.col("passage_id") == F.col("held_id"), "left"))
    if met.filter("sequence <> held_sequence").head(1):
        raise ValueError("a passage is held with another text: remove it first")
    start = library.table("indexed", "block long").agg(F.coalesce(F.max("block"), F.lit(-1)) + 1).head()[0]
    placed = running_total(met.filter("held_id is null").select("passage_id", "dl", "sequence"), ["passage_id"], name="nth")
    fresh = durable(placed.select("passage_id", "dl", "sequence", (F.lit(start) + F.expr(f"(nth - 1) div {BLOCK}")).cast("long").alias("block"), ((F.col("nth") - 1) % BLOCK).cast("int").alias("place")))
    # whole passages travel to their block, and its postings are made where they are: no token is shuffled by itself
    dealt = described.select("passage_id", "tokens").join(fresh.select("passage_id", "dl", "block", "place"), "passage_id").repartition("block")
    counted = dealt.select("block", "place", "dl", F.explode("tokens").alias("term")).groupBy("term", "block", "place", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    postings = durable(
        counted.groupBy("term", "block").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.array_sort(F.collect_list(F.struct("place", "tf", "dl"))).alias("entries")
        )
    )
    return library.apply(appended={"postings": postings, "indexed": fresh.select("block", "place", "passage_id", "dl", "sequence"), "index_sizes": _sizes(fresh, 1)})


def remove(library: Library, passages: DataFrame, key: str = "passage_id", text: str = "text", tokenizer: bm25.Tokenizer = tokens) -> int:
    """Takes passages (with the text that was indexed) out of the index; those that it does not hold are passed over."""
    described = _described(passages, key, text, tokenizer)
    sized = durable(described.select("passage_id", "dl", "sequence"))
    ids = durable(library.matching("indexed", sized.select("passage_id"), "passage_id").select("passage_id", "sequence"))
    gone = durable(sized.join(ids, ["passage_id", "sequence"], "left_semi"))
    if gone.count() < ids.count():
        raise ValueError("a passage is held with another text")
    less = described.join(ids, ["passage_id", "sequence"], "left_semi").select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).cast("int").alias("n"))
    counts = less.select("term", F.lit(-1).cast("long").alias("block"), "n", F.lit(0).alias("max_tf"), F.lit(0).alias("min_dl"), F.array().cast("array<struct<place:int,tf:int,dl:int>>").alias("entries"))
    return library.apply(appended={"postings": counts, "index_sizes": _sizes(gone, -1)}, put={"indexed": (ids.select("passage_id"), None)})


class _Asked(NamedTuple):
    """A batch of questions as arrays: what a task needs to weigh postings."""

    ids: list
    vocabulary: list[str]
    idf: np.ndarray
    wanted: np.ndarray  # terms by questions: 1 where a question has the term
    average: float
    k1: float
    b: float

    def weight(self, term: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        norm = (1 - self.b) + self.b * (dl / self.average)
        return self.idf[term] * (tf * (1 + 1 / self.k1) / (tf / self.k1 + norm) if self.k1 >= 1 else tf / (tf + self.k1 * norm) * (self.k1 + 1)) * bm25.FIXED_POINT

    def number(self, terms: pa.ChunkedArray) -> np.ndarray:
        return pc.index_in(terms, value_set=pa.array(self.vocabulary, pa.string())).to_numpy()


def _asked(terms: DataFrame, average: float, k1: float, b: float) -> _Asked | None:
    """The batch ``terms`` (query_id, term, idf) as arrays, or None if it is too large to travel."""
    size = terms.agg(F.count_distinct("query_id").alias("n"), F.count(F.lit(1)).alias("terms")).head()
    if size["n"] * size["terms"] > bm25.DENSE_CELLS:
        return None
    rows = terms.collect()
    ids, idf = list(dict.fromkeys(r["query_id"] for r in rows)), {r["term"]: r["idf"] for r in rows}
    query, term = {q: k for k, q in enumerate(ids)}, {t: k for k, t in enumerate(idf)}
    wanted = np.zeros((len(idf), len(ids)))
    for r in rows:
        wanted[term[r["term"]], query[r["query_id"]]] = 1
    return _Asked(ids, list(idf), np.array([*idf.values()]), wanted, average, k1, b)


def _bounding(asked: _Asked, kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """What each question can score at most in each block of a group, by a matrix product."""

    def run(heads: pa.Table) -> pa.Table:
        blocks, at = np.unique(heads["block"].to_numpy(), return_inverse=True)
        term = asked.number(heads["term"])
        most = np.zeros((len(blocks), len(asked.vocabulary)))
        # rounded up by a unit more, so that no rounding of the weights themselves gets above it; whole numbers below 2^53
        np.add.at(most, (at, term), np.ceil(asked.weight(term, heads["max_tf"].to_numpy(), heads["min_dl"].to_numpy())) + 1)
        bound = most @ asked.wanted
        row, query = np.nonzero(bound)
        return pa.table({"query_id": pa.array([asked.ids[q] for q in query.tolist()], kind), "block": blocks[row], "bound": bound[row, query].astype(np.int64)})

    return run


def _scoring(asked: _Asked, k: int, deduplicate: bool, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best k passages of a group of blocks for each question, block by block by matrix products."""

    size = BLOCK

    def run(postings: pa.Table, members: pa.Table) -> pa.Table:
        entries = postings["entries"].combine_chunks()
        owner = np.repeat(np.arange(len(postings)), pc.list_value_length(entries).to_numpy())
        place, tf, dl = (pc.struct_field(entries.flatten(), name).to_numpy() for name in ("place", "tf", "dl"))
        term = asked.number(postings["term"])[owner]
        part = np.floor(asked.weight(term, tf, dl) + 0.5)  # whole numbers below 2^53: products are exact in any order
        block = postings["block"].to_numpy()[owner]
        order = np.argsort(block, kind="stable")
        block, place, term, part = block[order], place[order], term[order], part[order]
        at, nth = members["block"].to_numpy(), members["place"].to_numpy()
        ids, sequence = (members[c].to_numpy() for c in ("passage_id", "sequence"))
        found = []
        for one in np.unique(at):
            a, z = np.searchsorted(block, one, "left"), np.searchsorted(block, one, "right")
            own = np.nonzero(at == one)[0]  # of the passages that are still held
            dense = np.zeros((size, len(asked.vocabulary)))
            dense[place[a:z], term[a:z]] = part[a:z]
            summed = ((dense[nth[own]] @ asked.wanted).astype(np.int64) + 500) // 1000
            row, query = np.nonzero(summed)
            score, row = summed[row, query], own[row]
            keep = bm25.best_entries(query, score, ids[row], sequence[row], k, deduplicate)
            found.append((query[keep], score[keep], row[keep]))
        query, score, row = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        keep = bm25.best_entries(query, score, ids[row], sequence[row], k, deduplicate)
        query, score, row = query[keep], score[keep], row[keep]
        return pa.table({"query_id": pa.array([asked.ids[q] for q in query.tolist()], kind), "passage_id": members["passage_id"].take(row), "sequence": members["sequence"].take(row), "parts": score * 1000})

    return run


def _grouped(rows: DataFrame) -> GroupedData:
    return rows.withColumn("group", F.expr(f"block div {GROUP}")).groupBy("group")


def _best_of(library: Library, blocks: DataFrame, terms: DataFrame, asked: _Asked, k: int, deduplicate: bool) -> DataFrame:
    """(query_id, passage_id, sequence, parts) of the best passages of ``blocks`` for every question."""
    within = {"block": blocks} if blocks.count() <= PUSHED_BLOCKS else {}  # beyond, testing each row costs more than it spares
    held = library.matching("postings", terms.select("term"), "term", POSTINGS, within=within).join(blocks, "block", "left_semi").select("block", "term", "entries")
    known = library.matching("indexed", blocks, "block").select("block", "place", "passage_id", "sequence")
    types = dict(known.dtypes) | dict(terms.dtypes)
    run = _scoring(asked, k, deduplicate, to_arrow_type(terms.schema["query_id"].dataType))
    return _grouped(shipped(held)).cogroup(_grouped(known)).applyInArrow(run, f"query_id {types['query_id']}, passage_id {types['passage_id']}, sequence string, parts long")


def _joined(library: Library, pairs: DataFrame, terms: DataFrame, average: float, k1: float, b: float) -> DataFrame:
    """(query_id, block, passage_id, sequence, parts) of the passages in the blocks of ``pairs`` (query_id, block)."""
    held = library.matching("postings", terms.select("term"), "term", POSTINGS, within={"block": pairs.select("block")})
    asked = pairs.join(terms, "query_id").select("query_id", "block", "term", "idf")
    rows = held.join(asked, ["term", "block"]).select("query_id", "block", "idf", F.inline("entries"))
    part = F.col("idf") * bm25.term_weight(F.col("tf").cast("double"), F.col("dl") / F.lit(average), k1, b)
    summed = rows.select("query_id", "block", "place", F.round(part * bm25.FIXED_POINT).cast("long").alias("part")).groupBy("query_id", "block", "place").agg(F.sum("part").alias("parts"))
    known = library.matching("indexed", pairs.select("block"), "block").select("block", "place", "passage_id", "sequence")
    return summed.join(known, ["block", "place"]).select("query_id", "block", "passage_id", "sequence", "parts")


def _scored(library: Library, chosen: DataFrame, terms: DataFrame, asked: _Asked | None, average: float, k1: float, b: float, k: int, deduplicate: bool) -> DataFrame:
    """(query_id, passage_id, sequence, parts) of ``chosen``: blocks for all questions of a batch that travels, else pairs (query_id, block)."""
    found = _joined(library, chosen, terms, average, k1, b) if asked is None else _best_of(library, chosen, terms, asked, k, deduplicate)
    return found.select("query_id", "passage_id", "sequence", "parts")


def retrieve(library: Library, questions: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, question_key: str = "query_id", question: str = "query", deduplicate: bool = True, tokenizer: bm25.Tokenizer = tokens) -> DataFrame:
    """(query_id, passage_id, score, rank, retrieval_method), row for row what ``bm25.retrieve`` gives for the indexed passages."""
    bm25.check_parameters(k1, b, k)
    wanted = durable(questions.select(F.col(question_key).alias("query_id"), F.explode(F.array_distinct(tokenizer(F.col(question)))).alias("term")))
    size = library.table("index_sizes", SIZES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).head()
    if not size["n"]:
        ids = library.table("indexed", "passage_id long").schema["passage_id"].dataType.simpleString()
        return library.spark.createDataFrame([], f"query_id {wanted.schema['query_id'].dataType.simpleString()}, passage_id {ids}, score double, rank int, retrieval_method string")
    average = (size["tokens"] or 1) / size["n"]
    heads = durable(library.matching("postings", wanted.select("term"), "term", POSTINGS).select("term", "block", "n", "max_tf", "min_dl"))
    df = heads.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
    terms = durable(wanted.join(df, "term").select("query_id", "term", bm25.inverse_document_frequency(F.lit(size["n"]), F.col("df")).alias("idf")))
    asked = _asked(terms, average, k1, b)
    if asked is not None:
        run = _bounding(asked, to_arrow_type(terms.schema["query_id"].dataType))
        bounds = _grouped(shipped(heads.filter("block >= 0").join(terms.select("term").distinct(), "term", "left_semi"))).applyInArrow(run, f"query_id {dict(terms.dtypes)['query_id']}, block long, bound long")
    else:
        most = F.col("idf") * bm25.term_weight(F.col("max_tf").cast("double"), F.col("min_dl") / F.lit(average), k1, b)
        # rounded up by a unit more, so that no rounding of the weights themselves gets above it
        bounds = heads.filter("block >= 0").join(terms, "term").groupBy("query_id", "block").agg(F.sum((F.ceil(most * bm25.FIXED_POINT) + 1).cast("long")).alias("bound"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = durable(bounds)
    seeds = durable(bounds.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= SEEDS).select("query_id", "block"))
    if asked is not None:  # a block that is read is scored for all questions
        seeds = durable(seeds.select("block").distinct())
    first = durable(_scored(library, seeds, terms, asked, average, k1, b, k, deduplicate))
    reached = _ranked(first, k, deduplicate).filter(F.col("rank") == k).select("query_id", (F.col("score") * 1e9).alias("reached"))
    left = bounds.join(seeds, seeds.columns, "left_anti").join(reached, "query_id", "left")
    rest = durable(left.filter("reached is null or (bound + 500) div 1000 >= cast(round(reached) as bigint)").select(*seeds.columns).distinct())
    found = first.unionByName(_scored(library, rest, terms, asked, average, k1, b, k, deduplicate)) if rest.head(1) else first
    return _ranked(found, k, deduplicate).select("query_id", "passage_id", "score", "rank", F.lit(bm25.METHOD).alias("retrieval_method"))


def _ranked(scored: DataFrame, k: int, deduplicate: bool) -> DataFrame:
    rows = scored.select("query_id", "passage_id", "sequence", (F.expr("(parts + 500) div 1000") / 1e9).alias("score")).filter("score > 0")
    return bm25.ranked(rows, k, deduplicate)
