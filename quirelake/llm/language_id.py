"""Language identification by cross-parsing entropy.

For every language a bounded sample of labelled text is turned into a suffix
automaton. A text is parsed against each of them: the longest match with the
sample is a phrase, and parsing goes on behind it. A language in which the text
falls into few phrases is close to it; phrases are normalised by the logarithm
of the sample's length and the length of the text, which estimates the cross
entropy in bits a character. The language with the least wins.

Only letters matter: they are lower-cased, and any run of other characters is
one separator. Whole texts are parsed, in blocks of ``BLOCK`` characters that
start a phrase each, so that many blocks advance together in numpy, one
character a step.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.durable import durable
from quirelake.llm.kernels import buffers, slices
from quirelake.session import table
from quirelake.shipping import shipped

#: bounds of the labelled sample: languages (the most frequent labels), texts looked at and characters learnt a language, characters of one text
LANGUAGES, SAMPLE_TEXTS, SAMPLE_CHARS, TEXT_CHARS = 512, 600, 32_768, 64
#: chosen rows (a language, a key, a number each) up to which they are broadcast to fetch their texts; beyond, a shuffle join does it
BROADCAST_ROWS = 50_000
BLOCK = 1024
UNDETERMINED = "und"
_PLANE = 0x3000  # code points above are told apart as letters or not, nothing more

Model = tuple[tuple[str, str], ...]  # (language, sample text)
LETTERS_ONLY: Model = (("any", "a"),)  # tells texts with a letter from those without


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_PLANE)])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", languages: int = LANGUAGES, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, excerpt: int = TEXT_CHARS) -> Model:
    """The samples: for each language, excerpts of texts in the order of a hash of their key.

    Short excerpts from many texts, at places that the hash chooses, keep a
    passage that many texts share, or one in another language, from weighing
    much. Ranking reads no text; the few chosen rows are then fetched. Null
    languages, texts and keys teach nothing; a key teaches once however many
    rows have it (the excerpt that sorts first), and so does an excerpt. What
    reaches the driver is bounded by ``languages``, ``texts`` and ``excerpt``.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("key"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return ()
    # thin out by a second hash to about eight times the sample before ranking, so that a common language is no hot key
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 8.0 * texts / max(r["n"], 1)))])
    drawn = F.shiftrightunsigned(F.xxhash64("key", F.lit(2)), 11) / float(1 << 53) < share[F.col("lang")]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = labelled.filter(drawn).distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= texts)
    wanted = durable(chosen.select(F.col("lang").alias("__lang"), F.col("key").alias("__key"), "rank"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    place = F.pmod(F.xxhash64("__key", F.lit(1)), F.greatest(F.length(text) - excerpt, F.lit(1))).cast("int") + 1
    found = docs.join(wanted, (F.col(key) == F.col("__key")) & (F.col(lang) == F.col("__lang"))).groupBy("__lang", "rank").agg(F.min(F.substring(text, place, F.lit(excerpt))).alias("text"))
    seen: dict[str, dict[str, None]] = {}
    for row in sorted(found.collect(), key=lambda r: (r["__lang"], r["rank"])):
        seen.setdefault(row["__lang"], {})[row["text"]] = None
    model = []
    for language, excerpts in sorted(seen.items()):
        words = " ".join("".join(c if c.isalpha() else " " for c in "\n".join(excerpts).lower()).split())
        if words:
            model.append((language, words[:chars]))
    return tuple(model)


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts all substrings; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sequence:
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


class Parser:
    """The automata as dense tables, and the parse of many blocks at once.

    A table's entry holds the next state and, above bit 28, how many phrases
    end by the step: none on a match; else the one before, and the character by
    itself if even the root lacks it.
    """

    def __init__(self, model: Model) -> None:
        self.languages = [language for language, _ in model]
        self.bits = np.array([math.log2(len(sample) + 1) for _, sample in model])
        alphabet = sorted({c for _, sample in model for c in sample if c != " "})
        self.width = len(alphabet) + 2  # 0: separator, 1: a letter that no sample has
        self.code = np.where(_letters(), 1, 0).astype(np.uint16)
        number = {" ": 0} | {c: k + 2 for k, c in enumerate(alphabet)}
        for c, k in number.items():
            if ord(c) < _PLANE:
                self.code[ord(c)] = k
        self.far = {ord(c): k for c, k in number.items() if ord(c) >= _PLANE}
        self.tables = []
        for _, sample in model:
            edges = suffix_automaton([number[c] for c in sample])
            root = np.full(self.width, 1 << 28, np.int32)  # unknown at the root: a phrase by itself
            for c, to in edges[0].items():
                root[c] = to * self.width
            restart = np.where(root >= 1 << 28, np.int32(2 << 28), root + (1 << 28)).astype(np.int32)
            dense = np.tile(restart, (len(edges), 1))
            dense[0] = root
            for state, out in enumerate(edges):
                for c, to in out.items():
                    dense[state, c] = to * self.width
            self.tables.append(dense.ravel())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts with separators collapsed, each text's length and its number of letters."""
        lowered = [t.lower() for t in texts]
        lengths = np.array([len(t) for t in lowered], np.int64)
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[np.minimum(points, _PLANE - 1)]
        far = np.flatnonzero(points >= _PLANE)
        if len(far):
            distinct, which = np.unique(points[far], return_inverse=True)
            codes[far] = np.array([self.far.get(point, int(chr(point).isalpha())) for point in distinct.tolist()], np.uint16)[which]
        row = np.repeat(np.arange(len(texts)), lengths)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (row[1:] != row[:-1])
        return codes[keep], np.bincount(row[keep], minlength=len(texts)), np.bincount(row, weights=codes > 0, minlength=len(texts))

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(text, language): the number of phrases."""
        first = np.cumsum(lengths) - lengths
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[owner] + nth * BLOCK
        size = np.minimum(lengths[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        total = np.zeros((len(lengths), len(self.tables)))
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        columns = [codes[start[:n] + t].astype(np.int32) for t, n in enumerate(active)]
        for k, dense in enumerate(self.tables):
            state, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
            for n, column in zip(active, columns, strict=True):
                step = dense.take(state[:n] + column)
                count[:n] += step >> 28
                state[:n] = step & ((1 << 28) - 1)
            total[:, k] = np.bincount(owner, weights=count + (state > 0), minlength=len(lengths))
        return total

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the runner-up's share of the two best entropies."""
        codes, lengths, letters = self.encode(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        entropy = self.phrases(codes, lengths) * self.bits / np.maximum(lengths, 1)[:, None]
        best = entropy.argmin(axis=1)
        ranked = np.sort(entropy, axis=1)
        score = ranked[:, 1] / np.maximum(ranked[:, 0] + ranked[:, 1], 1e-300) if len(self.languages) > 1 else np.ones(len(texts))
        known = letters > 0
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


@functools.lru_cache(maxsize=2)
def _parser(model: Model) -> Parser:
    """Built once in each Python worker; what travels is the samples."""
    return Parser(model)


def _judging(model: Model, text: int, keep: list[int], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(model)
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            for i, j in slices(offsets):
                texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
                languages, scores = parser.judge(texts)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in keep] + [pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names)

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with the language and its score appended under ``names``.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if the model knows no language. Equal entropies go to the language
    that sorts first. Rows are judged one by one; input columns of those
    names are replaced.
    """
    kept = [c for c in (keep or docs.columns) if c not in names]
    read = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*[read.schema[c] for c in kept], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return shipped(read).mapInArrow(_judging(model, read.columns.index(text), [read.columns.index(c) for c in kept], schema.names), schema)


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row's key puts it outside the training part; a null key is neither learnt from nor held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def learn_from_training_part(docs: DataFrame) -> Model:
    return learn(docs.filter(~held_out()))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without null texts and texts without a letter, whose language no model can tell; columns and other rows stay as they are.

    That holds for an empty model too: a table without labels loses no other row.
    """
    judged = identify(docs, model or LETTERS_ONLY, names=("__language", "__language_score"))
    return judged.filter(F.col("__language") != UNDETERMINED).select(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the training part's labels."""
    docs = table(spark, sf_dir, "documents")
    model = learn_from_training_part(docs)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
