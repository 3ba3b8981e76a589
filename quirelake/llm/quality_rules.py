"""Quality rules: counters, and a linear-chain CRF that marks lines as content or boilerplate.

The CRF has two states. A line's features (below) give the log odds of
boilerplate, transitions reward staying in a state; Viterbi decoding of all
lines of a text yields the marks, and the words in content lines decide
whether it stays. It is trained by maximum conditional likelihood on a bounded
sample of labelled texts, whose lines take the label of their text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.kernels import _SPACE, Words, buffers, mix, slices
from quirelake.session import table
from quirelake.shipping import shipped

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_CONTENT = 0.4
#: bounds of the labelled sample: texts of either label, characters and lines of one text
SAMPLE_TEXTS, TEXT_CHARS, SAMPLE_LINES = 400, 6000, 48

FEATURES = ("bias", "symbols", "upper", "digits", "exclamations", "duplicate", "repeated", "short", "long", "sentence")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
_ROW = np.uint64(0x9E3779B97F4A7C15)


class Crf(NamedTuple):
    weights: tuple[float, ...]  # log odds of boilerplate for each feature
    stay: float  # score of keeping the state against changing it
    start: float  # log odds of boilerplate at the first line


#: used where no labelled text exists
DEFAULT = Crf((-2.0, 12.0, 4.0, 4.0, 12.0, 2.0, 3.0, 0.3, -0.5, -0.5), 1.0, 0.0)


class Lines(NamedTuple):
    first: np.ndarray  # index of each text's first line, and one past the last text's
    words: np.ndarray
    features: np.ndarray


class Counts(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _between(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How often the mask holds from each edge to the next."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[edges])


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[Counts, Lines]:
    """Counters of each text of a slice, and its lines with their features."""
    words = Words(data, offsets, lower=False)
    text, ends = words.data, words.offsets
    visible = ~_SPACE[text] & ((text & 0xC0) != 0x80)
    # windows of five words that stand twice in a text cover repeated words
    grams, whole = words.shingles(words.hashes(), WINDOW)
    at = np.flatnonzero(whole)
    _, where, times = np.unique(mix(grams[at] + words.row[at].astype(np.uint64) * _ROW), return_inverse=True, return_counts=True)
    again = at[times[where] > 1]
    cover = np.zeros(len(words.start) + WINDOW + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeated = np.cumsum(cover)[: len(words.start)] > 0

    breaks = np.flatnonzero(text == 10) + 1
    begins = np.concatenate([ends[:-1], breaks])
    owner = np.concatenate([np.arange(len(ends) - 1), np.searchsorted(ends, breaks - 1, "right") - 1])
    # a text that ends in a newline has an empty last line, which starts where the next text does
    order = np.lexsort((begins, owner))
    begins, owner = begins[order], owner[order]
    stops = np.append(begins[1:], len(text))
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    stops = np.where(last, ends[owner + 1], stops)
    first = np.searchsorted(owner, np.arange(len(ends)))
    has = np.searchsorted(words.start, begins), np.searchsorted(words.start, stops)
    n = has[1] - has[0]

    duplicate = np.zeros(len(begins), bool)
    raw = text.tobytes()
    seen: set[bytes] = set()
    own = -1
    for k, (a, b, o, some) in enumerate(zip(begins.tolist(), stops.tolist(), owner.tolist(), (n > 0).tolist(), strict=True)):
        if o != own:
            own, seen = o, set()
        if some:
            line = raw[a:b]
            line = line[:-1] if line.endswith(b"\n") else line
            if line in seen:
                duplicate[k] = True
            seen.add(line)

    def of(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[stops] - total[begins]

    chars = np.maximum(of(visible), 1)
    covered = np.zeros(len(repeated) + 1, np.int64)
    np.cumsum(repeated, out=covered[1:])
    final = np.zeros(len(begins), bool)
    final[n > 0] = _STOP[text[words.end[has[1][n > 0] - 1] - 1]]
    features = np.stack(
        [
            np.ones(len(begins)),
            of(_SYMBOL[text]) / chars,
            of(_UPPER[text]) / chars,
            of(_DIGIT[text]) / chars,
            of(text == ord("!")) / chars,
            duplicate,
            (covered[has[1]] - covered[has[0]]) / np.maximum(n, 1),
            n < 4,
            n >= 12,
            final,
        ],
        axis=1,
    ).astype(np.float64)
    counts = Counts(
        words.count,
        _between(visible, ends),
        _between(_SYMBOL[text], ends),
        np.bincount(owner[duplicate], minlength=len(ends) - 1),
        np.bincount(words.row[repeated], minlength=len(ends) - 1),
    )
    return counts, Lines(first, n, features)


def viterbi(odds: list[float], stay: float, start: float) -> list[bool]:
    """The best states of one text's lines; ties go to content."""
    content, junk = 0.0, 0.0
    back: list[tuple[bool, bool]] = []
    for k, odd in enumerate(odds):
        if k == 0:
            content, junk = 0.0, start + odd
            continue
        from_junk, from_content = junk > content + stay, content > junk + stay
        back.append((from_junk, not from_content))
        content, junk = (junk if from_junk else content + stay), (content if from_content else junk + stay) + odd
    state = junk > content
    marks = [state]
    for to_content, to_junk in reversed(back):
        state = to_junk if state else to_content
        marks.append(state)
    return marks[::-1][: len(odds)]


def train(texts: list[tuple[str, int]], steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by forward-backward and Adam; quality 0 is boilerplate."""
    if len({q for _, q in texts}) < 2:
        return DEFAULT
    data = np.frombuffer("".join(t for t, _ in texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t, _ in texts])).astype(np.int64)
    _, lines = measure(data, offsets)
    m, width = len(texts), len(FEATURES)
    x, there, label = np.zeros((m, SAMPLE_LINES, width)), np.zeros((m, SAMPLE_LINES), bool), np.zeros((m, SAMPLE_LINES))
    for k, (_, quality) in enumerate(texts):
        a, b = int(lines.first[k]), int(lines.first[k + 1])
        some = np.flatnonzero(lines.words[a:b] > 0)[:SAMPLE_LINES] + a
        x[k, : len(some)], there[k, : len(some)], label[k, : len(some)] = lines.features[some], True, quality == 0
    weight = np.where(label[:, :1] > 0, 1 / max(1, (label[:, 0] > 0).sum()), 1 / max(1, (label[:, 0] == 0).sum()))
    theta = np.zeros(width + 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    pairs = there[:, 1:]
    for step in range(1, steps + 1):
        odds, stay, start = x @ theta[:width], theta[width], theta[width + 1]
        odds[:, 0] += start
        forward, backward = np.zeros((m, SAMPLE_LINES, 2)), np.zeros((m, SAMPLE_LINES, 2))
        emit = np.stack([np.zeros_like(odds), odds], axis=2) * there[:, :, None]
        move = np.array([[stay, 0.0], [0.0, stay]])
        forward[:, 0] = emit[:, 0]
        for t in range(1, SAMPLE_LINES):
            new = np.logaddexp(forward[:, t - 1, 0, None] + move[0], forward[:, t - 1, 1, None] + move[1]) + emit[:, t]
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(SAMPLE_LINES - 2, -1, -1):
            after = emit[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(move[:, 0] + after[:, 0, None], move[:, 1] + after[:, 1, None])
            backward[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        junk = np.exp(np.clip(forward[:, :, 1] + backward[:, :, 1] - z[:, None], -60, 0)) * there
        same = sum(np.exp(np.clip(forward[:, :-1, s] + stay + emit[:, 1:, s] + backward[:, 1:, s] - z[:, None], -60, 0)) for s in (0, 1)) * pairs
        gap = (label * there - junk) * weight
        grad = np.concatenate([np.einsum("mt,mtf->f", gap, x), [((pairs - same) * weight).sum() * 0.02], [gap[:, 0].sum()]]) - decay * theta
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        theta += rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Crf(tuple(theta[:width].tolist()), float(np.clip(theta[width], 0, 3)), float(theta[width + 1]))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", texts: int = SAMPLE_TEXTS, chars: int = TEXT_CHARS) -> Crf:
    """A CRF from a bounded sample of labelled texts, chosen by a hash of their key.

    A key counts once for each of its labels, however many rows have it: the
    start of its text that sorts first is learnt from. At most ``texts`` starts
    of ``chars`` characters for either label reach the driver.
    """
    drawn = F.xxhash64("__key")
    known = labels.filter(F.col(quality).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(quality).cast("int").alias("__quality")).distinct()
    # a sorted limit for either label: each task hands on ``texts`` rows at most; 2 * texts rows in all, so the broadcast is bounded
    chosen = functools.reduce(DataFrame.union, [known.filter(F.col("__quality") == label).withColumn("__draw", drawn).orderBy("__draw", "__key").limit(texts) for label in (0, 1)])
    starts = docs.join(F.broadcast(chosen), F.col(key) == F.col("__key")).groupBy("__quality", "__draw", "__key").agg(F.min(F.substring(text, 1, chars)).alias("t"))
    return train([(r["t"], r["__quality"]) for r in sorted(starts.collect(), key=lambda r: (r["__quality"], r["__draw"], r["__key"])) if r["t"]])


def _judging(crf: Crf, text: int, keep: list[int], names: list[str], min_content: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(crf.weights)
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            for i, j in slices(offsets):
                counts, lines = measure(data, offsets[i : j + 1])
                some = lines.words > 0
                index = np.append(0, np.cumsum(some))[lines.first]
                odds, said = (lines.features[some] @ weights).tolist(), lines.words[some]
                share = np.ones(j - i)
                for r, (a, b) in enumerate(zip(index[:-1].tolist(), index[1:].tolist(), strict=True)):
                    if b > a:
                        own = odds[a:b]
                        if max(own) + max(crf.start, 0.0) + 2 * crf.stay > 0:  # else no line can be boilerplate
                            junk = np.array(viterbi(own, crf.stay, crf.start))
                            share[r] = 1 - said[a:b][junk].sum() / said[a:b].sum()
                failed = (counts.n_words < MIN_WORDS) | (100 * counts.n_repeat_words > MAX_REPEAT_PERCENT * counts.n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in keep] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share)], names
                )

    return run


_ADDED = [*((c, T.LongType()) for c in Counts._fields), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("content_share", T.DoubleType())]


def judge_quality(docs: DataFrame, crf: Crf, text: str = "text", keep: list[str] | None = None, min_content: float = MIN_CONTENT) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with the counters and the verdict appended.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share. Null, empty and blank texts have counters
    of 0, fail and have a content share of 1. Rows are judged one by one;
    input columns of those names are replaced.
    """
    added = [c for c, _ in _ADDED]
    kept = [c for c in (keep or docs.columns) if c not in added]
    read = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*[read.schema[c] for c in kept], *[T.StructField(c, kind) for c, kind in _ADDED]])
    return shipped(read).mapInArrow(_judging(crf, read.columns.index(text), [read.columns.index(c) for c in kept], schema.names, min_content), schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and verdicts of all documents, by a CRF learnt from the labels."""
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
