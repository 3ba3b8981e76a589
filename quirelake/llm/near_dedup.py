"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

1. Each text becomes its set of word shingles. Texts with equal sets form one
   class, of which one text is worked on; copies are never paired.
2. ``bands`` bands of ``ROWS`` MinHash values find classes that may be alike. The
   number of bands follows from the threshold so that a pair at the threshold
   is missed with a probability of ``MISS`` at most.
3. All MinHash samples of a class are folded into a parity bitmap, the odd
   sketch. Within a bucket, the population count of two sketches' XOR estimates
   the similarity; a bucket hands on stars that span the pairs whose estimate
   is within five standard errors of the threshold, never all pairs.
4. Components of those stars are candidate groups. The shingle sets of their
   classes are gathered once, in blocks of bounded size, and every pair is
   settled exactly through an inverted index; a block hands on stars that span
   the links that hold.
5. Components of those links are the groups.

Buckets and groups of any size are dealt out as pairs of blocks, so no task
holds more than two blocks and none is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable, unpartitioned
from quirelake.llm.columns import shielded
from quirelake.llm.components import connected_components
from quirelake.llm.kernels import Words, buffers, mix, slices
from quirelake.session import table
from quirelake.shipping import shipped

ROWS = 5
MISS = 1e-6
SKETCH_BITS = 512
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(977)  # fixed: sketches must agree between runs and executors
_MULTIPLY = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64)


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def minhash(shingles: np.ndarray, samples: int) -> np.ndarray:
    low = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    multiply, add = _MULTIPLY[:samples], _ADD[:samples]
    for k in range(0, len(shingles), 256):
        low = np.minimum(low, (shingles[k : k + 256, None] * multiply + add).min(axis=0))
    return low


def odd_sketch(low: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The samples folded into a bitmap: each flips the bit that it hashes to."""
    at = mix(low + _ADD[: len(low)]) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def farthest(threshold: float, samples: int, bits: int = SKETCH_BITS) -> int:
    """The largest XOR population count that a pair at the threshold may show.

    With x differing bits the similarity is estimated as
    1 + bits/(4 samples) ln(1 - 2x/bits).
    """
    least = threshold - 5.2 * math.sqrt(threshold * (1 - threshold) / samples)
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * (1 - least) / bits)))


def _fingerprints(size: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    samples = bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                n, kinds, keys, sketches = [], [], [], []
                for found in Words(data, offsets[i : j + 1], lower=True).sets(size):
                    n.append(len(found))
                    if not len(found):
                        kinds.append(None), keys.append(None), sketches.append(None)
                        continue
                    kinds.append(int(mix(mix(found + _ADD[0]).sum(dtype=np.uint64, keepdims=True) + np.array([len(found)], np.uint64)).view(np.int64)[0]))
                    low = minhash(found, samples)
                    keys.append(mix((low.reshape(bands, ROWS) * _MULTIPLY[:ROWS]).sum(axis=1, dtype=np.uint64) + order).view(np.int64))
                    sketches.append(odd_sketch(low))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), batch.column("row").slice(i, j - i), pa.array(n, pa.int64()), pa.array(kinds, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["id", "row", "n", "kind", "bands", "sketch"],
                )

    return run


class _Stars:
    """Classes of members 0 .. n-1, each named after its smallest."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def strangers(self, x: int) -> np.ndarray:
        """The members after x that are not yet in its class."""
        return np.flatnonzero(self.root[x + 1 :] != self.root[x]) + x + 1

    def join(self, x: int, ys: np.ndarray) -> None:
        """Unites the classes of x and of all ``ys``."""
        met = np.unique(np.append(self.root[ys], self.root[x]))
        self.root[np.isin(self.root, met)] = met[0]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of all but the roots."""
        members = np.flatnonzero(self.root != np.arange(len(self.root)))
        return members, self.root[members]


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of whole groups of rows with equal keys, and where each group starts.

    The rows of a partition come sorted by the key; a group may span batches.
    """
    rest: list[pa.RecordBatch] = []

    def cut(held: list[pa.RecordBatch], last: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(whole.num_rows, bool)
        new[0] = True
        for name in key:
            values = whole.column(name).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        end = whole.num_rows if last else int(starts[-1])
        held[:] = [] if last else [whole.slice(end)]
        if end:
            yield whole.slice(0, end), np.append(starts[starts < end], end)

    for batch in batches:
        if batch.num_rows:
            rest.append(batch)
            if sum(b.num_rows for b in rest) >= 2 * rest[0].num_rows or len(rest) == 1:
                yield from cut(rest, last=False)
    if rest:
        yield from cut(rest, last=True)


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs]), pa.int64()) for k in (0, 1)], ["a", "b"])


def _sketch_stars(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _grouped(batches, ["bucket", "i", "j"]):
            kind = rows.column("kind").to_numpy()
            data, where = buffers(rows.column("sketch"))
            bitmap = data[where[0] : where[-1]].copy().view(np.uint64).reshape(rows.num_rows, SKETCH_BITS // 64)
            size = np.diff(at)
            two = at[:-1][size == 2]
            near = np.bitwise_count(bitmap[two] ^ bitmap[two + 1]).sum(axis=1) <= most
            pairs = [(kind[two[near]], kind[two[near] + 1])]
            for g in np.flatnonzero(size > 2):
                a, m = int(at[g]), int(size[g])
                own, stars = bitmap[a : a + m], _Stars(m)
                for x in range(m - 1):
                    others = stars.strangers(x)
                    if len(others):
                        alike = others[np.bitwise_count(own[others] ^ own[x]).sum(axis=1) <= most]
                        if len(alike):
                            stars.join(x, alike)
                members, roots = stars.links()
                pairs.append((kind[a + members], kind[a + roots]))
            yield from _links(pairs)

    return run


def exact_stars(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the classes that the pairs with 100 |intersection| >= percent |union| make of ``sets``.

    An inverted index counts the shingles that a set shares with the others;
    only pairs that no earlier link has united are looked at, so a dense group
    costs little more than its size.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    stars = _Stars(m)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if (100 + percent) * both >= percent * int(size.sum()):
            stars.join(0, np.array([1]))
        return stars.links()
    owner = np.repeat(np.arange(m), size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    posting, count = owner[order], np.bincount(ids)
    begin = np.cumsum(count) - count
    first = np.cumsum(size) - size
    for x in range(m - 1):
        others = stars.strangers(x)
        # a set much smaller or larger than x cannot reach the share
        others = others[(100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x]))]
        if not len(others):
            continue
        mine = ids[first[x] : first[x] + size[x]]
        lens = count[mine]
        take = np.repeat(begin[mine] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        both = np.bincount(posting[take], minlength=m)[others]
        alike = others[(100 + percent) * both >= percent * (size[x] + size[others])]
        if len(alike):
            stars.join(x, alike)
    return stars.links()


def _exact_stars(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _grouped(batches, ["part", "i", "j"]):
            kind = rows.column("kind").to_numpy()
            data, offsets = buffers(rows.column("shingles"))
            pairs = []
            for g in range(len(at) - 1):
                a, b = int(at[g]), int(at[g + 1])
                if b - a > 1:
                    members, roots = exact_stars([data[offsets[r] : offsets[r + 1]].copy().view(np.uint64) for r in range(a, b)], percent)
                    pairs.append((kind[a + members], kind[a + roots]))
            yield from _links(pairs)

    return run


def _shingle_sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sets = [s.tobytes() for s in Words(data, offsets[i : j + 1], lower=True).sets(size)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("kind", "part", "blocks")] + [pa.array(sets, pa.binary())], ["kind", "part", "blocks", "shingles"])

    return run


def _block_pairs(blocks: Column, own: Column) -> Column:
    """The pairs of blocks that a row of block ``own`` takes part in."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, row, n_shingles, component_id, kept) for every row of ``docs``.

    row is xxhash64 of the text, to join on together with the key; component_id
    the smallest key of the rows whose texts are linked, directly or through
    others; kept whether it is the row's own key. Texts with fewer words than
    ``size`` are one shingle; null, empty and blank texts have none and are
    linked with nothing. Rows with a null key take part, but a component is
    named after its smallest non-null key (null if there is none, and kept is
    then true). Repeated rows share a component and are both kept. An empty
    table gives an empty table; other columns of the input are not read.
    """
    prints, _, classes = _near_groups(docs, text, key, size, percent)
    named = classes.groupBy("group").agg(F.min("least").alias("component_id")).select(unpartitioned("group").alias("g"), "component_id")
    result = classes.join(named, F.col("group") == F.col("g")).select(unpartitioned("kind").alias("k"), "component_id")
    shingled = prints.filter("n > 0").select("id", "row", "n", "kind").join(result, F.col("kind") == F.col("k")).select("id", "row", "n", "component_id")
    out = shingled.union(prints.filter("n = 0").select("id", "row", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "row", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _near_groups(docs: DataFrame, text: str, key: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``near_duplicates`` finds: the prints of all texts, the text of each class, and the group of each class.

    prints: (id, row, n, kind, ...), a row for each of ``docs``; kind, the
    class, is null for texts without a shingle. texts: (kind, first: struct
    none, id, row), first being the smallest key, a null one last. classes:
    (kind, least, group); group does not depend on keys.
    """
    bands = band_count(percent / 100)
    most = farthest(percent / 100, bands * ROWS)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    prints = durable(shipped(texts).mapInArrow(_fingerprints(size, bands), "id long, row long, n long, kind long, bands array<long>, sketch binary"))
    named = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = durable(prints.filter("n > 0").groupBy("kind").agg(F.min(named).alias("first"), F.min("n").alias("n"), F.min(F.struct("bands", "sketch")).alias("f")))

    dealt = classes.select("kind", "f.sketch", F.posexplode("f.bands").alias("band", "bucket"))
    full = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").withColumn("bucket", unpartitioned("bucket"))
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    placed = dealt.join(full, "bucket").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("kind", F.lit(3)), F.col("blocks")).cast("int")
    placed = placed.select("bucket", "kind", "sketch", F.explode(_block_pairs(F.col("blocks"), own)).alias("p")).select("bucket", "p.i", "p.j", "kind", "sketch")
    placed = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "kind")
    candidates = connected_components(shipped(placed).mapInArrow(_sketch_stars(most), "a long, b long"))

    parts = candidates.withColumnsRenamed({"node": "kind", "component": "part"}).join(classes.select("kind", "n", "first"), "kind")
    weights = parts.groupBy("part").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).withColumn("part", unpartitioned("part"))
    parts = parts.join(weights, "part").select(
        "kind", "part", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.col("first.id").alias("tid"), F.col("first.row").alias("trow")
    )
    wanted = texts.join(parts, texts["id"].eqNullSafe(parts["tid"]) & (texts["row"] == parts["trow"])).select("kind", "part", "blocks", "text")
    sets = shipped(wanted).mapInArrow(_shingle_sets(size), "kind long, part long, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("kind", F.lit(5)), F.col("blocks")).cast("int")
    sets = sets.select("part", "kind", "shingles", F.explode(_block_pairs(F.col("blocks"), own)).alias("p")).select("part", "p.i", "p.j", "kind", "shingles")
    sets = sets.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "kind")
    groups = connected_components(shipped(sets).mapInArrow(_exact_stars(percent), "a long, b long"))
    grouped = classes.select("kind", F.col("first.id").alias("least")).join(groups.withColumnRenamed("node", "kind"), "kind", "left")
    return prints, classes.select("kind", "first"), grouped.select("kind", "least", F.coalesce("component", "kind").alias("group"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents alike by their three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).drop("row")


@shielded
def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest key.

    A null key comes last, and among rows with the same key the smallest text
    hash decides, so one row stays whatever the keys are. Of rows equal in key
    and text one stays. Rows without a word are linked
    with nothing and stay. Columns are those of ``docs``.
    """
    prints, texts, classes = _near_groups(docs, text, key, size, percent)
    firsts = texts.join(classes.select(unpartitioned("kind").alias("k"), "group"), F.col("kind") == F.col("k")).groupBy("group").agg(F.min("first").alias("first"))
    blank = prints.filter("n = 0").select("id", "row").distinct()
    chosen = durable(firsts.select(F.col("first.id").alias("__kid"), F.col("first.row").alias("__krow")).union(blank))
    marked = docs.withColumn("__row", F.xxhash64(F.col(text)))
    joined = marked.join(chosen, marked[key].eqNullSafe(chosen["__kid"]) & (F.col("__row") == F.col("__krow")))
    again = prints.groupBy("id", "row").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    if again.join(chosen, F.col("id").eqNullSafe(F.col("__kid")) & (F.col("row") == F.col("__krow"))).head(1):
        # of equal rows the one with the smallest hash of the other columns, found in each task first
        ordered = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        one = joined.groupBy("__kid", "__krow").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*ordered)).alias("__one"))
        joined = one.select("__one.*")
    return joined.select(*docs.columns)


#: the same by plain SQL: every pair of documents that share a shingle, and the closure of the links
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON e.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
