"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end token a text. The vocabulary, with the
count c of every token in the training part, covers the whole corpus. A token's
probability is p(class | classes of the two tokens before) times p(token | class).

* Classes: the ``HEADS`` most frequent tokens are classes of their own; all
  others share ``TAILS`` classes by a hash of their last three bytes (word
  endings), so that any token's class is known where the token stands.
* p(class | history) is a log-bilinear neural model: each position of the
  history has its own class vectors, whose products with the output vectors
  give the scores. It is trained in numpy by noise-contrastive estimation on
  the class pairs at distance one and two of all training texts, with the noise
  (the class unigram) taken in expectation. The scores of both positions add
  up, those of the farther one weighted by ``FAR`` as their evidence overlaps.
* As the scores add up, the normaliser of every history is one entry of the
  product of two matrices (exponentiated far and near scores): one batched
  product gives all of them, and scoring looks up three tables.
* p(token | class) = (c + 0.5) / (sum over the class's tokens of (c + 0.5), and
  0.5 for an unknown one).

Counts of all tokens are never gathered. The at most ``HOT`` most frequent ones
travel to the tasks; the others are looked up by a join, in which none of them
can be a hot key. At most 2 * CLASSES^2 pair counts reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.llm.kernels import Words, buffers, slices
from quirelake.llm.language_id import held_out
from quirelake.session import table
from quirelake.shipping import shipped

HOT = 100_000  # tokens sent to every task: a bound
CLASSES, HEADS = 1024, 400  # class 0 pads the history, 1 is the end; then the most frequent tokens; then the tails
TAILS = CLASSES - 2 - HEADS
FAR = 0.6
FLUSH = 400_000  # distinct tokens a task holds before it hands counts on
PAIRS = 1_000_000  # tokens whose pairs are counted at a time
BINS = 64  # of counts, for each doubling
END = b""  # no word is empty


class Vocabulary(NamedTuple):
    tokens: int  # N
    distinct: int  # V
    hot: dict[bytes, int]  # token: count
    heads: dict[bytes, int]  # token: class


def _tail(word: bytes) -> int:
    """The class of a token that has none of its own."""
    return 2 + HEADS + zlib.crc32(word[-3:]) % TAILS if word else 1


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "c"])
        counts.clear()
        return out

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in slices(offsets):
            for r in range(i, j):
                counts.update(data[offsets[r] : offsets[r + 1]].tobytes().lower().split())
            counts[END] += j - i
            if len(counts) > FLUSH:
                yield flush()
    if counts:
        yield flush()


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token: binary, c, hash) of all tokens of ``docs``; the end token is the empty word."""
    partial = shipped(docs).select(F.col(text).alias("text")).mapInArrow(_token_counts, "token binary, c long")
    return partial.groupBy("token").agg(F.sum("c").alias("c")).withColumn("hash", F.xxhash64("token"))


def vocabulary(counts: DataFrame, hot: int = HOT) -> Vocabulary:
    """The totals, and the most frequent tokens: as many whole bins of like counts as have ``hot`` tokens at most."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    level = F.floor(F.log2(F.col("c").cast("double")) * BINS)
    bins = sorted(counts.groupBy(level.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["bin"])  # at most 64 * BINS rows
    least, held = None, 0
    for row in bins:
        held += row["n"]
        if held > hot:
            break
        least = row["bin"]
    top = counts.filter(level >= least).select("token", "c").collect() if least is not None else []
    words = {bytes(r["token"]): r["c"] for r in sorted(top, key=lambda r: (-r["c"], bytes(r["token"])))}
    end = counts.filter(F.length("token") == 0).head()  # always hot, as its class is its own
    words[END] = end["c"] if end else 0
    heads = [w for w in words if w != END][:HEADS]
    return Vocabulary(total[0], total[1], words, {END: 1} | {w: k + 2 for k, w in enumerate(heads)})


class _Lookup:
    """The vocabulary as arrays, made once in each Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.number = {w: k for k, w in enumerate(vocabulary.hot)}
        self.count = np.array([*vocabulary.hot.values(), 0.0])  # the last one, -1: not hot
        self.cls = np.array([vocabulary.heads.get(w) or _tail(w) for w in vocabulary.hot] + [0], np.int64)
        self.end = self.number.get(END, -1)

    def classes(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        found = self.cls[ids]
        for k in np.flatnonzero(ids < 0).tolist():
            found[k] = _tail(words[k])
        return found


_made: list[tuple[Vocabulary, _Lookup]] = []


def _tokens(batch: pa.RecordBatch, look: _Lookup) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: row range, words, ids, classes (end tokens in place), and where each row's tokens start."""
    data, offsets = buffers(batch.column("text"))
    get = look.number.get
    for i, j in slices(offsets):
        words: list[bytes] = []
        bounds = [0]
        for r in range(i, j):
            words += data[offsets[r] : offsets[r + 1]].tobytes().lower().split()
            words.append(END)
            bounds.append(len(words))
        ids = np.array([get(w, -1) for w in words], np.int64)
        cls = look.classes(words, ids)
        cls[np.array(bounds[1:]) - 1] = 1
        yield i, j, words, ids, cls, np.array(bounds)


def _history(cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the tokens one and two before each token of its text; 0 where there is none."""
    one, two = np.zeros_like(cls), np.zeros_like(cls)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    first = bounds[:-1]
    one[first] = 0
    two[first] = 0
    second = first + 1
    two[second[second < bounds[1:]]] = 0
    return one, two


def _pairs(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of (class before, class) and, from CLASSES^2 on, of (class two before, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _lookup(shared)
        total = np.zeros(2 * CLASSES**2, np.int64)
        held: list[np.ndarray] = []

        def count() -> None:
            if held:
                cells = np.concatenate(held)
                total[:] += np.bincount(cells, minlength=len(total))
                held.clear()

        for batch in batches:
            for _, _, _, _, cls, bounds in _tokens(batch, look):
                one, two = _history(cls, bounds)
                held += [one * CLASSES + cls, CLASSES**2 + two * CLASSES + cls]
                if sum(map(len, held)) > 2 * PAIRS:
                    count()
        count()
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    return run


class Position(NamedTuple):
    """What one position of the history contributes: the score of a class is input[history] . output[class], plus bias[class]."""

    input: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def train(pairs: np.ndarray, size: int = 48, noise: int = 16, prior: float = 60, steps: int = 120, rate: float = 0.06, seed: int = 11) -> Position:
    """The vectors of one position from the (history, class) counts.

    Noise-contrastive estimation with ``noise`` samples a token: the score less
    the log of the noise's share decides by a logistic loss between data and
    noise. Every history gets ``prior`` tokens of the class unigram besides its
    own, so that rare ones stay near it. Adam over all histories at once; the
    result depends on nothing but the counts and the parameters.
    """
    counts = pairs.reshape(CLASSES, CLASSES).astype(np.float32)
    classes = counts.sum(axis=0, dtype=np.float64)
    unigram = ((classes + 0.5) / (classes + 0.5).sum()).astype(np.float32)
    counts += np.float32(prior) * unigram
    data = counts / np.float32(counts.sum(dtype=np.float64))
    fake = data.sum(axis=1, keepdims=True) * (noise * unigram)
    offset = np.log(noise * unigram)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.3, (CLASSES, size)).astype(np.float32), rng.normal(0, 0.3, (CLASSES, size)).astype(np.float32), np.log(unigram)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in p]
    for step in range(1, steps + 1):
        score = p[0] @ p[1].T
        score += p[2] - offset
        model = 1 / (1 + np.exp(-np.clip(score, -30, 30)))  # that a token comes from the data
        grad = (fake + data) * model - data
        for k, g in enumerate((grad @ p[1], grad.T @ p[0], grad.sum(axis=0))):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[k] -= np.float32(rate * (1 - step / (steps + 1)) / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-10))
    return Position(*p)


class Tables(NamedTuple):
    """Natural-log scores: near[one before, class], far[two before, class], and norm[two before, one before] of a history."""

    near: np.ndarray
    far: np.ndarray
    norm: np.ndarray


def tables(near: Position, far: Position) -> Tables:
    a = near.input @ near.output.T + near.bias
    b = np.float32(FAR) * (far.input @ far.output.T)
    a -= a.max(axis=1, keepdims=True)
    b -= b.max(axis=1, keepdims=True)
    return Tables(a, b, np.log(np.exp(b) @ np.exp(a).T + np.float32(1e-30)))


def _lookup(shared: object) -> _Lookup:
    if not _made or _made[0][0] is not shared.value:
        _made[:] = [(shared.value, _Lookup(shared.value))]
    return _made[0][1]


_tables: list[tuple[object, Tables]] = []


def _scoring(shared: object, model: object, mass: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text: n_tokens, known and log10 sums over hot tokens, the class part, and the other tokens' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _lookup(shared)
        if not _tables or _tables[0][0] is not model.value:
            _tables[:] = [(model.value, tables(*model.value))]
        own, given = np.log10(look.count + 0.5), _tables[0][1]
        for batch in batches:
            for i, j, words, ids, cls, bounds in _tokens(batch, look):
                first = bounds[:-1]
                hot, met = ids >= 0, look.count[ids] > 0
                token = np.where(hot, own[ids], 0.0)
                one, two = _history(cls, bounds)
                rest = (given.near[one, cls].astype(np.float64) + given.far[two, cls] - given.norm[two, one]) / math.log(10) - mass[cls]
                cold = np.flatnonzero(~hot)
                names = pa.array([words[k] for k in cold.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(i, j - i) for c in ("rid", "id", "held_out")],
                        pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat(met.astype(np.int64), first)),
                        pa.array(np.add.reduceat(token, first)),
                        pa.array(np.add.reduceat(rest, first)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(cold, bounds), pa.int32()), names),
                    ],
                    ["rid", "id", "held_out", "n_tokens", "hot", "hot_log", "rest_log", "cold"],
                )

    return run


def class_masses(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """log10 of the sum of c + 0.5 over each class's tokens, an unknown one included."""
    total = np.full(CLASSES, 0.5)
    heads = list(vocabulary.heads)
    tail_of = F.when(F.length("token") == 0, 1).otherwise(F.pmod(F.crc32(F.substring("token", -3, 3)), F.lit(TAILS)).cast("int") + 2 + HEADS)
    rest = counts.filter(~F.col("token").isin([bytearray(w) for w in heads]) if heads else F.lit(True))
    for row in rest.groupBy(tail_of.alias("cls")).agg(F.sum(F.col("c") + 0.5).alias("mass")).collect():
        total[row["cls"]] += row["mass"]
    for word, cls in vocabulary.heads.items():
        total[cls] += vocabulary.hot.get(word, 0) + 0.5
    return np.log10(total)


def score_texts(docs: DataFrame, learning: DataFrame, text: str = "text", key: str = "doc_id", held: str = "held_out", hot: int = HOT) -> DataFrame:
    """(key, held, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Both scores are log10 probabilities of the whole text and its end; the model
    learns from the texts of ``learning``. Null, empty and blank texts consist
    of the end token. Rows are scored one by one, repeated ones and ones with a
    null key included. If there is nothing to learn from, counts are 0 and the
    model is that of an empty corpus. Other columns are not read.
    """
    spark = docs.sparkSession
    counts = durable(count_tokens(learning, text))
    known = vocabulary(counts, hot)
    shared = spark.sparkContext.broadcast(known)
    cells = np.zeros(2 * CLASSES**2, np.int64)
    pairs = shipped(learning).select(F.col(text).alias("text")).mapInArrow(_pairs(shared), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = pairs.toArrow()  # at most 2 * CLASSES^2 rows
    cells[found["cell"].to_numpy()] = found["n"].to_numpy()
    near, far = np.split(cells, 2)
    model = spark.sparkContext.broadcast((train(near), train(far)))
    mass = class_masses(counts, known)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), F.col(held).alias("held_out"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    scored = durable(shipped(rows).mapInArrow(_scoring(shared, model, mass), f"rid long, id {kind}, held_out boolean, n_tokens long, hot long, hot_log double, rest_log double, cold array<binary>").select("*", F.transform("cold", lambda w: F.xxhash64(w)).alias("hashes")).drop("cold"))
    cold = scored.select("rid", F.explode("hashes").alias("hash"))
    looked = cold.join(counts.select("hash", "c"), "hash", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    sums = looked.groupBy("rid").agg(F.count("c").alias("cold"), F.sum(log).alias("cold_log"))
    joined = scored.drop("hashes").join(sums, "rid", "left")
    words = F.col("hot_log") + F.coalesce("cold_log", F.lit(0.0))
    whole = np.log10(known.tokens + 0.5 * (known.distinct + 1))
    return joined.select(
        F.col("id").alias(key),
        F.col("held_out").alias(held),
        "n_tokens",
        (F.col("hot") + F.coalesce("cold", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * float(whole)).alias("base_score"),
        (words + F.col("rest_log")).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model learnt from the training part."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5, 1))
    return score_texts(docs, docs.filter(~F.col("held_out")))
