"""BM25 ranking of passages for a batch of questions.

Every passage counts in N, the average length and the document frequencies,
copies included. Contributions are summed as integers of 1e-12, so a score does
not depend on the order of summation, and ranks go by the score rounded to nine
digits, then by id. Of passages with the same token sequence the best-ranked
one stays, before the cut at k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirelake.functions.text import tokens
from quirelake.shipping import shipped

METHOD = "bm25-v1"  # fixed value: the label of a result
FIXED_POINT = 1e12
#: questions times their terms up to which a batch travels to the tasks (8 bytes each at most)
DENSE_CELLS = 8_000_000
BLOCK = 256  # passages scored at once
SLICE = 1024  # passages whose tokens a task looks up at once


def check_parameters(k1: float, b: float, k: int) -> None:
    if isinstance(k1, bool) or not 0 < k1 < float("inf"):
        raise ValueError("k1 must be finite and positive")
    if isinstance(b, bool) or not 0 <= b <= 1:
        raise ValueError("b must be between 0 and 1")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a whole number of at least 1")


def inverse_document_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, length_ratio: Column, k1: float, b: float) -> Column:
    """The term-frequency part; two equal forms, each stable for its range of k1."""
    norm = F.lit(1 - b) + F.lit(b) * length_ratio
    if k1 >= 1:
        return tf * (1 + 1 / k1) / (tf / k1 + norm)
    return tf / (tf + k1 * norm) * (k1 + 1)


Tokenizer = Callable[[Column], Column]


def tokenised(passages: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    return passages.select(F.col(key).alias("passage_id"), tokenizer(F.col(text)).alias("tokens"))


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a list of tokens, by runs of the sorted list: nothing is held beyond the row."""

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is computed once, whatever it is used for."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def counted(held: Column, starts: Column) -> Column:
        return F.transform(starts, lambda i, at: F.struct(F.get(held, i).alias("term"), (F.coalesce(F.get(starts, at + 1), F.size(held)) - i).cast("long").alias("tf")))

    def runs(held: Column) -> Column:
        places = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1)).otherwise(F.array().cast("array<int>"))
        return bound(F.filter(places, lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1))), lambda starts: counted(held, starts))

    return bound(F.array_sort(tokens), runs)


def term_frequencies(passages: DataFrame, key: str = "passage_id", text: str = "text") -> DataFrame:
    """(passage_id, term, tf), counted within the row of a passage; rows of one id count together."""
    whole = tokenised(passages, key, text).groupBy("passage_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return whole.select("passage_id", F.inline(term_counts(F.col("tokens"))))


def document_frequencies(passages: DataFrame, key: str = "passage_id", text: str = "text") -> DataFrame:
    """(term, df): passages that a term occurs in, without counting its occurrences first."""
    return tokenised(passages, key, text).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(passages: DataFrame, key: str = "passage_id", text: str = "text", tokenizer: Tokenizer = tokens) -> DataFrame:
    """One row (n, total_tokens, avgdl)."""
    sized = tokenised(passages, key, text, tokenizer).select(F.size("tokens").alias("dl"))
    return sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens")).withColumn("avgdl", F.coalesce(F.try_divide(F.col("total_tokens").cast("double"), F.col("n").cast("double")), F.lit(0.0)))


def scores(passages: DataFrame, questions: DataFrame, k1: float = 1.5, b: float = 0.75, key: str = "passage_id", text: str = "text", question_key: str = "query_id", question: str = "query", tokenizer: Tokenizer = tokens) -> DataFrame:
    """(query_id, passage_id, score, sequence) of every passage that shares a term with a question.

    Terms that no question has are dropped before anything is counted. The
    sequence is a digest of the passage's tokens.
    """
    check_parameters(k1, b, 1)
    wanted = questions.select(F.col(question_key).alias("query_id"), F.explode(F.array_distinct(tokenizer(F.col(question)))).alias("term"))
    vocabulary = wanted.select("term").distinct()
    base = tokenised(passages, key, text, tokenizer)
    # in a select of its own: beside the explode, the digest would be taken again for every token
    described = base.select("passage_id", "tokens", F.size("tokens").alias("dl"), F.md5(F.array_join("tokens", " ")).alias("sequence"))
    occurring = described.select("passage_id", "dl", "sequence", F.explode("tokens").alias("term"))
    tf = occurring.join(vocabulary, "term", "left_semi").groupBy("passage_id", "dl", "sequence", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = base.select(F.explode(F.array_distinct("tokens")).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    statistics = corpus_statistics(passages, key, text, tokenizer)
    idf = df.crossJoin(F.broadcast(statistics)).filter("avgdl > 0").select("term", "avgdl", inverse_document_frequency(F.col("n"), F.col("df")).alias("idf"))
    part = F.col("idf") * term_weight(F.col("tf").cast("double"), F.col("dl") / F.col("avgdl"), k1, b)
    weights = tf.join(idf, "term").select("passage_id", "sequence", "term", F.round(part * FIXED_POINT).cast("long").alias("part"))
    summed = weights.join(wanted, "term").groupBy("query_id", "passage_id", "sequence").agg(F.sum("part").alias("parts"))
    return summed.select("query_id", "passage_id", "sequence", (F.expr("(parts + 500) div 1000") / 1e9).alias("score")).filter("score > 0")


class _Questions(NamedTuple):
    """A batch of questions as arrays: what a task needs to score passages."""

    ids: list
    vocabulary: list[str]
    idf: list[float]
    terms: list[list[int]]  # of each question: numbers in the vocabulary
    avgdl: float
    kind: pa.DataType  # of the ids


def _known_questions(passages: DataFrame, questions: DataFrame, key: str, text: str, question_key: str, question: str, tokenizer: Tokenizer) -> _Questions | None:
    """The batch with its document frequencies, or None if it is too large to travel."""
    wanted = questions.select(F.col(question_key).alias("query_id"), F.array_distinct(tokenizer(F.col(question))).alias("terms")).filter(F.size("terms") > 0)
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).head()
    if size["n"] * max(size["terms"], 1) > DENSE_CELLS:
        return None
    # the number of terms is bounded by the check above; the empty term, which every passage has once, stands for the totals
    terms = wanted.select(F.explode("terms").alias("term")).distinct().union(passages.sparkSession.createDataFrame([("",)], "term string"))
    occurring = tokenised(passages, key, text, tokenizer).select(F.size("tokens").alias("dl"), F.array_distinct("tokens").alias("tokens"))
    every = F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term")
    counted = occurring.select("dl", every).join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("tokens")).collect()
    totals = next((r for r in counted if r["term"] == ""), None)
    average = totals["tokens"] / totals["df"] if totals else 0.0
    found = sorted((r["term"], r["df"]) for r in counted if r["term"] != "")
    rated = passages.sparkSession.createDataFrame(found, "term string, df long")
    idf = rated.select("term", F.lit(average).alias("avgdl"), inverse_document_frequency(F.lit(totals["df"] if totals else 0), F.col("df")).alias("idf")).collect()
    number = {r["term"]: k for k, r in enumerate(idf)}
    asked = wanted.collect()
    return _Questions([r["query_id"] for r in asked], list(number), [r["idf"] for r in idf], [[number[t] for t in r["terms"] if t in number] for r in asked], idf[0]["avgdl"] if idf else 0.0, to_arrow_type(wanted.schema["query_id"].dataType))


def best_entries(query: np.ndarray, score: np.ndarray, ids: np.ndarray, sequence: np.ndarray, k: int, deduplicate: bool) -> np.ndarray:
    """Indices of each question's best k entries, of one token sequence the best only."""
    _, place = np.unique(ids, return_inverse=True)
    order = np.lexsort((place, -score, query))
    if deduplicate:
        _, kind = np.unique(sequence, return_inverse=True)
        _, first = np.unique(query[order] * np.int64(kind.max(initial=0) + 1) + kind[order], return_index=True)
        order = order[np.sort(first)]
    groups = query[order]
    start = np.searchsorted(groups, groups, "left")
    return order[np.arange(len(order)) - start < k]


def _scoring(asked: _Questions, k: int, k1: float, b: float, deduplicate: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores a partition's passages against all questions by matrix products and hands on each question's best k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, width = pa.array(asked.vocabulary, pa.string()), np.array(asked.idf), len(asked.vocabulary)
        wanted = np.zeros((width, len(asked.ids)))
        for q, terms in enumerate(asked.terms):
            wanted[terms, q] = 1
        held: list[tuple[np.ndarray, ...]] = []
        kind = pa.int64()

        def prune() -> None:
            parts = [np.concatenate(c) for c in zip(*held, strict=True)]
            keep = best_entries(*parts, k, deduplicate)
            held[:] = [tuple(c[keep] for c in parts)]

        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            kind = batch.schema.field("passage_id").type
            ids, sequence = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("passage_id", "sequence"))
            column = batch.column("tokens")
            found = pc.fill_null(pc.index_in(column.flatten(), value_set=vocabulary), -1).to_numpy()
            dl = pc.list_value_length(column).to_numpy()
            owner = np.repeat(np.arange(len(dl)), dl)
            hit = found >= 0
            cell, tf = np.unique(owner[hit] * np.int64(max(width, 1)) + found[hit], return_counts=True)
            doc, term = np.divmod(cell, max(width, 1))
            norm = (1 - b) + b * (dl[doc] / asked.avgdl)
            weight = tf * (1 + 1 / k1) / (tf / k1 + norm) if k1 >= 1 else tf / (tf + k1 * norm) * (k1 + 1)
            part = np.floor(idf[term] * weight * FIXED_POINT + 0.5)  # whole numbers below 2^53: products are exact in any order
            for at in range(0, len(dl), BLOCK):
                a, z = np.searchsorted(doc, (at, at + BLOCK))
                dense = np.zeros((min(BLOCK, len(dl) - at), width))
                dense[doc[a:z] - at, term[a:z]] = part[a:z]
                summed = ((dense @ wanted).astype(np.int64) + 500) // 1000
                row, query = np.nonzero(summed)
                score, row = summed[row, query], row + at
                keep = best_entries(query, score, ids[row], sequence[row], k, deduplicate)
                held.append((query[keep], score[keep], ids[row[keep]], sequence[row[keep]]))
                if len(held) > 16:
                    prune()
        if held:
            prune()
            query, score, ids, sequence = held[0]
            yield pa.RecordBatch.from_arrays([pa.array([asked.ids[q] for q in query.tolist()], asked.kind), pa.array(ids, kind), pa.array(sequence, pa.string()), pa.array(score / 1e9)], ["query_id", "passage_id", "sequence", "score"])

    return run


def _candidates(passages: DataFrame, asked: _Questions, k: int, k1: float, b: float, deduplicate: bool, key: str, text: str, query_type: str, tokenizer: Tokenizer) -> DataFrame:
    rows = tokenised(passages, key, text, tokenizer).withColumn("sequence", F.md5(F.array_join("tokens", " ")))
    kind = dict(rows.dtypes)["passage_id"]
    return shipped(rows).mapInArrow(_scoring(asked, k, k1, b, deduplicate), f"query_id {query_type}, passage_id {kind}, sequence string, score double")


def ranked(scored: DataFrame, k: int, deduplicate: bool = True) -> DataFrame:
    """The best k rows of each query_id, with their rank; of one sequence the best only."""
    best = (F.desc("score"), F.asc("passage_id"))
    if deduplicate:
        scored = scored.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "sequence").orderBy(*best))).filter("copy = 1")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("rank") <= k)


def retrieve(
    passages: DataFrame,
    questions: DataFrame,
    k: int = 10,
    k1: float = 1.5,
    b: float = 0.75,
    key: str = "passage_id",
    text: str = "text",
    question_key: str = "query_id",
    question: str = "query",
    deduplicate: bool = True,
    tokenizer: Tokenizer = tokens,
) -> DataFrame:
    """(query_id, passage_id, score, rank, retrieval_method): the best k passages of each question.

    A batch of questions of checked size travels to the passages: every task
    scores its own by matrix products and hands on k rows a question at most,
    so nothing of the size of passages times questions is ever shuffled. A
    larger batch is joined by term. Both ways give the same scores. With
    ``tokenizer=strict_tokens`` composed, decomposed and compatibility forms of
    a character match each other.
    """
    check_parameters(k1, b, k)
    asked = _known_questions(passages, questions, key, text, question_key, question, tokenizer)
    if asked is None:
        scored = scores(passages, questions, k1, b, key, text, question_key, question, tokenizer)
    else:
        scored = _candidates(passages, asked, k, k1, b, deduplicate, key, text, dict(questions.dtypes)[question_key], tokenizer)
    return ranked(scored, k, deduplicate).select("query_id", "passage_id", "score", "rank", F.lit(METHOD).alias("retrieval_method"))
