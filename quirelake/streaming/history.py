"""Conversation state over a stream of turns: the last answered turns of each conversation, by the time of the turns.

Turns may arrive in any order within a stated lateness. A turn waits in the
state, keyed by its number, until the watermark has passed its time: no earlier
turn can come any more, so its history is final, and the result equals that of
the batch however the arrivals were shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirelake.operators.conversation import MAX_TURNS, OPENERS, REFERRING
from quirelake.shipping import shipped

OUTPUT = "conv_id long, turn long, question string, history array<string>, needs_context boolean"


def _leans_back(question: str) -> bool:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in question.lower()).split()
    return any(w in REFERRING for w in words) or tuple(words[:2]) in OPENERS


def told(turns: list[tuple[int, str | None, str | None]], held: list[str], max_turns: int = MAX_TURNS) -> tuple[list[tuple], list[str]]:
    """Rows (turn, question, history, needs_context) of turns (turn, question, answer) in order, and the questions held after them."""
    out = []
    for turn, question, answer in turns:
        question = question or ""
        out.append((turn, question, list(held), bool(held) and _leans_back(question)))
        if isinstance(answer, str) and answer.strip(" "):
            held = [*held, question][-max_turns:]
    return out, held


STATE = "turns array<long>, times array<long>, questions array<string>, answers array<string>, held array<string>, last long"


def _telling(idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Takes up a conversation's turns and tells those that the watermark has passed.

    The state comes and goes once a batch: turns that wait for the watermark, the last answered
    questions, and the time of the last turn that was told.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, times, questions, answers, held, last = state.get if state.exists else ([], [], [], [], [], None)
        waiting = {t: (at, q, a) for t, at, q, a in zip(turns, times, questions, answers, strict=True)}
        for frame in frames:
            waiting |= {t: row for t, *row in zip(*[frame[c].tolist() for c in ("turn", "at_ms", "question", "answer")], strict=True)}
        now, out, held = state.getCurrentWatermarkMs(), [], list(held)
        for turn in sorted(t for t, (at, _, _) in waiting.items() if at <= now):
            at, question, answer = waiting.pop(turn)
            if idle_ms is not None and last is not None and at > last + idle_ms:
                held = []
            rows, held = told([(turn, question, answer)], held)
            out += rows
            last = at if last is None else max(last, at)
        if not waiting and (not held or (idle_ms is not None and now > last + idle_ms)):
            state.remove()
        else:
            state.update(([*waiting], *[[row[k] for row in waiting.values()] for k in range(3)], held, last))
            if waiting:
                state.setTimeoutTimestamp(max(min(at for at, _, _ in waiting.values()) - 1, now))  # it is over once the watermark is beyond it
            elif idle_ms is not None:
                state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["conv_id", "turn", "question", "history", "needs_context"])

    return run


def stream_history(turns: DataFrame, lateness: str = "10 minutes", at: str = "asked_at", idle: int | None = None) -> DataFrame:
    """Each turn (conv_id, turn, question, answer, and its time ``at``) of a stream with the answered questions before it.

    Turns of a conversation are numbered in the order of their times. One that comes later than
    ``lateness`` behind the newest turn of the whole stream is dropped, as is one with a null time,
    number or conversation; a number that comes twice while it waits counts once, as it came last. A
    turn is told once the stream's time has passed it by ``lateness``. A conversation's state is its
    waiting turns and at most MAX_TURNS questions; after ``idle`` seconds without a turn, if given, it
    is forgotten. Times lie after 1970, where a stream's time begins.
    Any state store will do; RocksDB keeps its state outside the heap.
    """
    timed = turns.filter(F.col(at).isNotNull() & F.col("turn").isNotNull() & F.col("conv_id").isNotNull()).withWatermark(at, lateness)
    rows = timed.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "question", "answer", at, F.unix_millis(at).alias("at_ms"))
    return shipped(rows).groupBy("conv_id").applyInPandasWithState(_telling(None if idle is None else idle * 1000), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def reset_history(turns: DataFrame, resets: DataFrame) -> DataFrame:
    """Batch twin of a reset: turns behind a conversation's last reset (conv_id, turn) only."""
    last = resets.groupBy("conv_id").agg({"turn": "max"}).withColumnRenamed("max(turn)", "reset_at")
    return turns.join(last, "conv_id", "left").filter("reset_at is null or turn > reset_at").drop("reset_at")
