from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import near_dedup
from quirelake.llm.components import connected_components
from quirelake.llm.decontaminate import contained_items, decontaminate, op2_decontamination
from quirelake.llm.kernels import Words, buffers, slices
from quirelake.llm.line_dedup import dedup_lines

from .common import awkward, empty, prose


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute_components(texts, size, percent):
    """Components by comparing every pair of texts that share a shingle."""
    sets = [shingle_set(t, size) for t in texts]
    index = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            index[g].append(k)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, both in collections.Counter(j for g in s for j in index[g] if j < k).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(k), find(j)))
                parent[b] = a
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def near_copies(n, words=80, seed=5):
    rng = random.Random(seed)
    base = prose("en", 9, words).split(" ")
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 2048), (5, 80, 2048), (3, 85, 7)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, size, percent, block):
    """Also with blocks so small that buckets and groups are dealt out as pairs of blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", block)
    texts = near_copies(60) + [prose("de", k) for k in range(20)] + ["one two", "one two", "ONE\ttwo", "one", "", " "] + near_copies(20, seed=6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, size=size, percent=percent).collect()}
    want, sizes = brute_components(texts, size, percent)
    assert [got[k].component_id for k in range(len(texts))] == want
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert all(got[k].kept == (got[k].component_id == k) for k in got)
    assert len(set(want)) < len(texts) - 30


def test_near_duplicates_take_awkward_rows(spark):
    docs = awkward(spark)
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    null = [r for r in out if r.doc_id is None]
    assert len(null) == 2 and all(r.component_id is None and r.kept for r in null)
    pair = [r for r in out if r.doc_id in (50, 51)]
    assert sorted((r.doc_id, r.component_id) for r in pair) == [(50, 50)] * 3 + [(51, 50)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_keep_one(spark):
    docs = awkward(spark)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[50] == 2 and ids[51] == 0  # two texts under one key stay, the repeated row and the copy go
    assert near_dedup.keep_one(empty(spark)).count() == 0


def test_keep_one_whatever_the_keys(spark):
    """Null keys, one key for a whole group, and a group with a key in another one: one document of each group stays."""
    groups = [[prose("en", k, 200) + f" tail{j}" for j in range(3)] for k in range(3)]
    rows = [(None, t) for t in groups[0]] + [(7, t) for t in groups[1] + groups[2]] + [(None, groups[2][0]), (3, groups[2][1]), (None, ""), (None, " "), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.keep_one(docs).collect()
    assert [sum(r.text in g for r in got) for g in groups] == [1, 1, 1]
    assert [r.doc_id for r in got if r.text in groups[2]] == [3]
    assert sorted((r.doc_id or 0, r.text) for r in got if not r.text.strip()) == [(0, ""), (0, " "), (7, "")]


def test_keep_one_of_a_repeated_row_takes_any_column(spark):
    rows = [(k // 3, prose("en", k // 3, 40), {"a": k}, [k]) for k in range(9)] + [(None, "x", None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, more array<int>")
    kept = near_dedup.keep_one(docs).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept) == [-1, 0, 1, 2] and all(tuple(r) in [tuple(x) for x in rows] for r in kept)


def test_exact_stars_equal_brute_force():
    """Groups dense and sparse, and members that only others connect."""
    rng = np.random.default_rng(8)
    for spread in (2, 6, 20, 60):
        pool = rng.permutation(400).astype(np.uint64)
        sets = [np.unique(np.concatenate([pool[a : a + 100], pool[300:]])) for a in np.cumsum(rng.integers(0, spread, 12)) % 150] + [pool[:5], pool[:200]]
        sets = [np.sort(s) for s in sets]
        root = list(range(len(sets)))
        for x in range(len(sets)):
            for y in range(x):
                both = len(np.intersect1d(sets[x], sets[y]))
                if 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root[x], root[y]))
                    root = [a if r == b else r for r in root]
        members, roots = near_dedup.exact_stars(sets, 85)
        got = list(range(len(sets)))
        for m, r in zip(members.tolist(), roots.tolist(), strict=True):
            got[m] = r
        assert got == root


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    samples = 120
    most = near_dedup.farthest(0.85, samples)
    for share, near in ((0.95, True), (0.85, True), (0.3, False)):
        both = rng.integers(0, 1 << 62, int(400 * share), dtype=np.uint64)
        sides = [np.concatenate([both, rng.integers(0, 1 << 62, int(400 * (1 - share) / 2), dtype=np.uint64)]) for _ in (0, 1)]
        a, b = (np.frombuffer(near_dedup.odd_sketch(near_dedup.minhash(s, samples)), np.uint64) for s in sides)
        assert (int(np.bitwise_count(a ^ b).sum()) <= most) is near
    assert 1 - (1 - 0.85**near_dedup.ROWS) ** near_dedup.band_count(0.85) >= 1 - near_dedup.MISS


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(8, 60)] + [(59, 7), (7, 7)]
    edges = spark.createDataFrame([*chain, *star, (None, 3), (5, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 60)}
    assert connected_components(edges.limit(0)).count() == 0


def test_words_and_sets_follow_the_bytes():
    texts = ["", "a", None, " A b\tc\nd ", "éÉ \x85x", "x" * 200 + " y", "p q r s t u"]
    data, offsets = buffers(pa.array(texts))
    for size in (1, 3, 5):
        got = []
        for i, j in slices(offsets, 16):
            got += [len(s) for s in Words(data, offsets[i : j + 1], lower=True).sets(size)]
        assert got == [len(shingle_set(t, size)) for t in texts]


PASSAGE = "\n".join(prose("fr", 77, 24).replace("\n", "").split(" . ")) + "\n" + prose("de", 78, 40).replace(".\n", ",")


def test_repeated_passages_are_cut_after_the_first(spark):
    texts = [f"{prose('en', k, 40)}\n{PASSAGE}\n{prose('en', k + 50, 40)}" for k in range(6)] + [prose("en", 99, 80)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, removed_lines string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    long = PASSAGE.split("\n")[-1]
    assert got[0].text == texts[0] and got[0].removed_lines == 0
    assert got[6].text == texts[6]
    for k in range(1, 6):
        assert long not in got[k].text and got[k].removed_lines > 0
        for line in texts[k].split("\n"):
            assert line in got[k].text or line in PASSAGE


def repeated_lines(texts, min_chars=48, solid_chars=96):
    """Brute force over all pairs of equal lines: the (text, line) places of lines in a passage that stands earlier."""
    lines = [t.split("\n") for t in texts]
    spots = collections.defaultdict(list)
    for d, ls in enumerate(lines):
        for k, line in enumerate(ls):
            spots[line].append((d, k))
    gone = set()
    for same in spots.values():
        for b in range(len(same)):
            for a in range(b):
                (d, i), (e, j) = same[a], same[b]
                n = 0
                while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n] and (d != e or i + n < j):
                    n += 1
                body = "\n".join(lines[e][j : j + n])
                if len(body) >= min_chars and (n >= 2 or len(body) >= solid_chars):
                    gone |= {(e, j + m) for m in range(n)}
    return gone


def without(texts, gone):
    return ["\n".join(line for k, line in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in enumerate(texts)]


@pytest.mark.parametrize(("least", "solid"), [(48, 96), (10, 30), (0, 1)])
def test_line_dedup_equals_brute_force(spark, least, solid):
    """Exact whatever counts as a passage; from 0 and 1 on, every repeated line does."""
    rng = random.Random(11)
    pool = ["", "", "a", "b"] + [f"{k} " + "s" * rng.randint(3, 40) for k in range(8)] + [f"{k} " + "l" * rng.randint(44, 90) for k in range(10)] + [f"{k} " + "x" * 100 for k in range(3)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(80)] + ["a\n" * 120, "a\nb\n" * 60, "\n" * 130, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = repeated_lines(texts, least, solid)
    got = {r.doc_id: r for r in dedup_lines(docs, min_chars=least, solid_chars=solid).collect()}
    assert [got[k].text for k in range(len(texts))] == without(texts, gone)
    assert [got[k].removed_lines for k in range(len(texts))] == [sum(d == k for d, _ in gone) for k in range(len(texts))] and len(gone) > 100


def test_passages_of_light_lines_go_whole(spark):
    """Whatever stands around them, and a light line between two solid ones too."""
    rng = random.Random(3)
    line = lambda low, high: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(low, high)))
    texts, passages = [], []
    for n in (2, 3, 4, 6, 8, 12):
        for _ in range(10):
            passages.append([line(50, 90) for _ in range(n)])
    passages.append([line(100, 120), line(10, 20), line(100, 120)])
    for _ in (0, 1):
        texts += ["\n".join([line(50, 90), *p, line(50, 90)]) for p in passages]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    half = len(passages)
    for k, p in enumerate(passages):
        first, second = texts[k], texts[half + k].split("\n")
        assert (got[k].text, got[k].removed_lines) == (first, 0)
        assert (got[half + k].text, got[half + k].removed_lines) == ("\n".join([second[0], second[-1]]), len(p))


def test_line_dedup_equals_its_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    from quirelake.llm.line_dedup import OP6_SQL, op6_line_dedup

    engine = duckdb.connect()
    engine.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = engine.sql(f"SELECT doc_id, text, removed_lines, n_chars FROM ({OP6_SQL})").fetchall()
    got = [tuple(r) for r in op6_line_dedup(spark, data).select("doc_id", "text", "removed_lines", "n_chars").collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 20


def test_line_dedup_takes_awkward_rows(spark):
    docs = awkward(spark)
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "removed_lines"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert sum(r.text is None for r in rows) == 2
    twice = [r.text for r in rows if r.doc_id == 50 and r.lang == "de"]
    assert twice == [prose("de", 3)] * 2  # a repeated row is one occurrence
    assert next(r.text for r in rows if r.doc_id == 51) == ""  # the copy under another key is gone
    assert dedup_lines(empty(spark)).count() == 0


def test_a_filter_on_the_result_does_not_repeat_the_work(spark):
    docs = spark.createDataFrame([(1, "a\n" * 3000), (2, prose("en", 5, 4000))], "doc_id long, text string")
    assert dedup_lines(docs).filter("length(text) > 0 and removed_lines >= 0").count() == 2


def test_containment_equals_brute_force(spark):
    items = [prose("en", k, 12 + 5 * k) for k in range(8)] + ["Answer, to", "quick", "the capital of France", None, "", "..."]
    texts = [prose("de", 1) + " " + items[3] + " " + prose("de", 2), items[5].upper(), " ".join(items[6].split()[:30]) + " gap " + " ".join(items[6].split()[31:]), " ".join(items[7].split()[:20]), prose("fr", 3), "Is it THE capital of france?", "the capital of-Norway, quick answer to", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def grams(text, n):
        ws = words(text)
        return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}

    want = set()
    for i, q in enumerate(items):
        if n := min(5, len(words(q))):
            want |= {(d, i) for d, t in enumerate(texts) if 100 * len(grams(q, n) & grams(t, n)) >= 80 * len(grams(q, n))}
    got = {(r.doc_id, r.item) for r in contained_items(docs, bench).collect()}
    assert got == want and {(0, 3), (1, 5), (2, 6), (5, 10), (6, 8)} <= got and (6, 10) not in got
    # items under twelve letters are reported but drop nothing
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == set(range(len(texts))) - {d for d, i in want if i not in (8, 9)}
    assert {r.doc_id for r in decontaminate(docs, bench, short_chars=0).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_a_document_of_many_items(spark, monkeypatch):
    """Its candidates are dealt out over rows; a shingle that all items share makes no difference."""
    from quirelake.llm import decontaminate as module

    monkeypatch.setattr(module, "ITEMS_A_ROW", 7)
    items = [f"one common opening of all items and then {prose('en', k, 9)}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(items)), (1, " ".join(items)), (2, items[3]), (3, "one common opening of all items and then no more")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item) for r in contained_items(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect())
    assert got == [(1, k) for k in range(60)] + [(2, 3)]


def test_decontamination_takes_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(None, prose("de", 3)), (1, prose("de", 3)), (2, None)], "item_id long, text string")
    assert {(r.doc_id, r.item) for r in contained_items(docs, bench).collect()} == {(50, None), (50, 1), (51, None), (51, 1)}
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert decontaminate(empty(spark), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_a_large_index_is_joined(spark, data, monkeypatch):
    from quirelake.llm import decontaminate as module

    small = {tuple(r) for r in op2_decontamination(spark, data).collect()}
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in op2_decontamination(spark, data).collect()} == small
