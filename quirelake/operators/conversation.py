"""Bounded conversation state: follow-up questions and the last answered turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import ascii_words
from quirelake.operators.ranking import parted, with_next
from quirelake.shipping import shipped

MAX_TURNS = 2

#: fixed values: words that point to an earlier turn
REFERRING = ["it", "its", "they", "them", "their", "these", "those", "that", "this", "he", "she", "his", "her", "there", "same", "above", "former", "latter"]
#: fixed values: openings that continue an earlier turn
OPENERS = [("what", "about"), ("how", "about"), ("and", "what"), ("what", "else"), ("any", "others"), ("anything", "else")]


def refers_back(question: Column, fold: Callable[[Column], Column] | None = None) -> Column:
    """Whether the wording of a question leans on an earlier turn; ``fold=folded`` also reads compatibility forms."""
    words = ascii_words(fold(question) if fold else question)
    opening = F.slice(words, 1, 2)
    elliptical = F.lit(False)
    for pair in OPENERS:
        elliptical = elliptical | (opening == F.array(*map(F.lit, pair)))
    return F.arrays_overlap(words, F.array(*map(F.lit, REFERRING))) | elliptical


def answered_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, question, answer): user turns, with the assistant turn that follows at once, else null.

    Turns lie in ranges of conversation and turn, so a conversation of any length is no task of its own.
    """
    named = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    following = with_next(parted(named, ["conv_id", "turn"]), ["conv_id", "turn"], {"next_conv": "conv_id", "next_role": "role", "next_text": "text"})
    answered = F.col("next_conv").eqNullSafe(F.col("conv_id")) & (F.col("next_role") == "assistant")
    return following.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.when(answered, F.col("next_text")).alias("answer"))


def _last_of(rows: DataFrame, entries: str, group: list[str], order: str, most: int, before: str, after: str) -> DataFrame:
    """``rows`` with the last ``most`` of the arrays ``entries`` (null: none) of earlier rows of the group, and of those with the row's own.

    Each pass lets a row with entries see one more such row before it; nothing unbounded is collected.
    """
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast(rows.schema[entries].dataType)
    known = rows.withColumn(after, F.col(entries))

    def joined() -> Column:
        both = F.concat(before, F.coalesce(entries, none))
        return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), most)

    for _ in range(most - 1):
        known = known.withColumn(before, F.coalesce(F.last(after, ignorenulls=True).over(earlier), none)).withColumn(after, F.when(F.col(entries).isNotNull(), joined()))
    known = known.withColumn(before, F.coalesce(F.last(after, ignorenulls=True).over(earlier), none))
    return known.withColumn(after, joined())


def history_before(turns: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """``turns`` (conv_id, turn, question, answer) with the last answered turns before each, oldest first.

    Turns without an answer never enter the history. Turns lie in ranges of
    conversation and turn. What a range leaves of a conversation that goes on in
    the next one, ``max_turns`` entries, is handed over by a second, small pass
    over the ranges.
    """
    if isinstance(max_turns, bool) or max_turns < 1:
        raise ValueError("max_turns must be at least 1")
    entry = F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", F.array(F.struct("turn", "question", "answer")))
    parts = parted(turns.withColumn("turn", F.col("turn").cast("long")), ["conv_id", "turn"]).withColumn("__entry", entry)
    local = _last_of(parts, "__entry", ["__part", "conv_id"], "turn", max_turns, "__before", "__after")
    left = local.groupBy("__part", "conv_id").agg(F.max_by("__after", "turn").alias("__left"))
    # conversations that lie in several ranges: two a range at most
    spread = left.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__parts")).filter("__parts > 1").select(F.col("conv_id").alias("__conv"))
    going = left.join(spread, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("__part", "conv_id", F.when(F.size("__left") > 0, F.col("__left")).alias("__left"))
    carried = _last_of(going, "__left", ["conv_id"], "__part", max_turns, "__carried", "__onward").select(F.col("__part").alias("__at"), F.col("conv_id").alias("__conv"), "__carried")
    met = local.join(carried, (F.col("__part") == F.col("__at")) & F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    whole = F.concat(F.coalesce("__carried", F.array().cast(carried.schema["__carried"].dataType)), "__before")
    return met.select(*turns.columns, F.slice(whole, F.greatest(F.size(whole) - max_turns + 1, F.lit(1)), max_turns).alias("history"))


def needs_context(turns: DataFrame, max_turns: int = MAX_TURNS, fold: Callable[[Column], Column] | None = None) -> DataFrame:
    """History and a flag: the question refers back and there is something to refer to."""
    known = history_before(turns, max_turns)
    return known.withColumn("needs_context", (F.size("history") > 0) & F.coalesce(refers_back(F.col("question"), fold), F.lit(False)))


#: (question, earlier questions) -> a question that stands by itself; anything else, or an exception, leaves the question as it is
Resolver = Callable[[str, list[str]], str]


def joining_resolver(question: str, earlier: list[str]) -> str:
    """A deterministic stand-in for a model: the last earlier question before the follow-up."""
    return f"{earlier[-1].strip()} {question.strip()}"


def resolved(question: str | None, earlier: list[str], resolver: Resolver) -> str:
    """The rewritten question, or the literal one where the resolver fails, says nothing or says the same."""
    literal = (question or "").strip()
    try:
        said = resolver(literal, earlier)
    except Exception:  # a rewrite that fails must not cost the turn
        return literal
    return said.strip() if isinstance(said, str) and said.strip() else literal


def resolve_follow_ups(turns: DataFrame, resolver: Resolver = joining_resolver) -> DataFrame:
    """``turns`` (with history and needs_context) and resolved_question: that of a turn in need of context is rewritten from the questions of its history."""
    read = turns.select("*", F.transform("history", lambda h: h["question"]).alias("__earlier"))
    at, names = {name: k for k, name in enumerate(read.columns)}, turns.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(at[c]).to_pylist() for c in ("question", "needs_context", "__earlier")]
            said = [resolved(q, earlier, resolver) if needed else (q or "").strip() for q, needed, earlier in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in names], pa.array(said, pa.string())], [*names, "resolved_question"])

    return shipped(read).mapInArrow(run, turns.withColumn("resolved_question", F.lit("")).schema)
