from __future__ import annotations

import collections
import hashlib
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from quirelake.llm import fill_in_middle as fim
from quirelake.llm import fingerprints as fp
from quirelake.llm import merkle

from .common import awkward, empty, prose

OWN = "doc_id long, text string, lang string, source string, n_chars long"


def folder_of(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def held_against(spark, folder, query, sql):
    """Query and SQL give the same rows, repeated ones as often."""
    got = query(spark, folder)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = connection.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = list(want.columns)
    left = collections.Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert left == collections.Counter(want.fetchall())
    return left


# fill in the middle


def test_fill_in_middle_equals_sql_on_awkward_rows(spark, tmp_path):
    texts = ["<P> in it", "a <S", "b\x0b c\x0cd  ", "  lead", "x<", "S>y <M", "é 漢 字 😀😀 a", *[prose("fr", k, 30) for k in range(40)]]
    rows = held_against(spark, folder_of(spark, tmp_path, awkward(spark, texts)), fim.op11_fill_in_middle, fim.OP11_SQL)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("grammar", list(fim.GRAMMARS))
def test_units_join_to_the_text(spark, grammar):
    docs = awkward(spark, ["fooBar_baz9 (x)", "One. Two! 三。四", "😀a😀", "\n\na\n"])
    rows = docs.select("text", fim.units(F.col("text"), grammar).alias("u")).collect()
    assert all("".join(r.u) == (r.text or "") and all(r.u) for r in rows)


def test_units_by_hand(spark):
    def cut(text, grammar):
        return spark.createDataFrame([(text,)], "t string").select(fim.units(F.col("t"), grammar)).head()[0]

    assert cut("  a b\n ", "token") == ["  a", " b", "\n "]
    assert cut("  a b", "word") == ["  ", "a", " ", "b"]
    assert cut("a\n\nb", "line") == ["a\n", "\n", "b"]
    assert cut("One. Two!  三。四", "sentence") == ["One.", " Two!", "  三。", "四"]
    assert cut("getHttp2Value_x", "identifier") == ["get", "Http2Value", "_", "x"]
    assert cut("a😀b", "character") == ["a", "😀", "b"]
    with pytest.raises(ValueError):
        fim.units(F.col("t"), "syllable")


def test_every_form_is_restored(spark):
    docs = awkward(spark, [prose("en", k, 25) for k in range(60)])
    for marks in (fim.SENTINELS, ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>"), ("\x01", "\x02", "\x03")):
        out = fim.fill_in_middle(docs, sentinels=marks, fim_percent=100, spm_percent=50, grammar="character")
        rows = out.select("text", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", fim.restored(F.col("fim_output"), F.col("fim_form"), marks).alias("back")).collect()
        assert all(r.back == (r.text or "") for r in rows) and {r.fim_form for r in rows} == {"plain", "psm", "spm"}
        assert all(r.fim_form == "plain" or r.fim_prefix + r.fim_middle + r.fim_suffix == r.text for r in rows)


@pytest.mark.parametrize("marks", [("<a>", "<a>b", "<c>"), ("", "<S>", "<M>"), ("<P>", "P<S", "<M>"), ("<P>", "<S>")])
def test_sentinels_that_could_be_mistaken(marks):
    with pytest.raises(ValueError):
        fim.check_sentinels(marks)


def test_fill_in_middle_keeps_other_columns(spark):
    docs = awkward(spark).withColumns({"row": F.lit("r"), "body": F.lit(1), "FIM_form": F.lit("old"), "a.b c": F.col("doc_id"), "h1": F.lit(2), "units": F.lit(None).cast("string")})
    out = fim.fill_in_middle(docs)
    others = [c for c in docs.columns if c != "FIM_form"]
    assert out.columns == [*others, *fim.ADDED]
    assert sorted(map(str, out.select(*[f"`{c}`" for c in others]).collect())) == sorted(map(str, docs.select(*[f"`{c}`" for c in others]).collect()))
    assert fim.fill_in_middle(empty(spark)).count() == 0


# fingerprints


def brute_sketch(text, size=fp.SHINGLE, fraction=fp.FRACTION, floor=fp.FLOOR):
    """Bound and hashes of a text by another implementation of the hash, word by word."""

    def hashed(words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed)
        return seed >> 1

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    sets = [words[k : k + size] for k in range(len(words) - size + 1)] or ([words] if words else [])
    every = sorted({hashed(s) for s in sets})
    limit = min(int(fraction * 2**63), fp.ALL)
    low = [h for h in every if h < limit]
    if len(low) >= floor and len(every) > floor:
        return limit, low
    if len(every) > floor:
        return max(every[floor], limit), every[:floor]
    return fp.ALL, every


def brute_query(rows):
    """What op12 returns for (doc_id, text), by sorting and slicing."""

    def held(a, b):
        below = min(a[0], b[0])
        mine, other = {h for h in a[1] if h < below}, {h for h in b[1] if h < below}
        return 1.0 if not a[1] else len(mine & other) / len(mine) if mine else 0.0

    def key(row):
        parts = ["-" if row[0] is None else f"{len(str(row[0]))}:{row[0]}", f"{len((row[1] or '').encode())}:{row[1] or ''}"]
        return row[0] is not None, row[0] or 0, hashlib.sha256("".join(parts).encode()).hexdigest()

    rows = sorted(rows, key=key)
    out = collections.Counter()
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        swapped = len(text) // 4
        edited = text[: len(text) - swapped] + after[:swapped]
        own, other, following = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        texts = [f"{s[0]:016x}:" + "".join(f"{h:016x}" for h in s[1]) for s in (own, other)]
        out[(doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *texts, held(own, other), held(own, following))] += 1
    return out


def test_fingerprints_equal_brute_force(spark, tmp_path):
    texts = [prose("en", 700 + k, 40 * k) for k in range(12)] + [prose("de", 5, 300), prose("de", 5, 300), "one two three", "ONE two\tthree", "two words", prose("fr", 1, 8000)]
    docs = awkward(spark, texts)
    got = fp.op12_fingerprints(spark, folder_of(spark, tmp_path, docs))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    want = brute_query([(r.doc_id, r.text) for r in docs.collect()])
    assert collections.Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize(("size", "fraction", "floor"), [(5, 1 / 16, 64), (3, 1 / 4, 0), (1, 1.0, 10), (5, 1 / 1000, 0)])
def test_sketches_at_other_parameters(spark, size, fraction, floor):
    docs = awkward(spark, [prose("en", k, 30 * k) for k in range(10)])
    for r in fp.fingerprint_documents(docs, size=size, fraction=fraction, floor=floor).collect():
        assert (r.sketch.below, r.sketch.hashes) == brute_sketch(r.text, size, fraction, floor)


def test_sketches_merge_and_travel_as_text(spark):
    """The sketch of two texts together is that of their shingles' union, whatever their sizes; text and back is the same."""
    short, long = prose("en", 1, 90), prose("de", 2, 20_000)
    rows = spark.createDataFrame([(short, long)], "a string, b string")
    rows = fp.with_sketch(fp.with_sketch(rows, F.col("a"), "sa"), F.col("b"), "sb")
    row = rows.select(fp.merged(F.col("sa"), F.col("sb")).alias("m"), fp.from_text(fp.as_text(F.col("sb"))).alias("back"), "sb").head()
    assert row.back == row.sb
    low = {h for t in (short, long) for h in brute_sketch(t, floor=10**9)[1] if h < row.m.below}
    assert row.m.hashes == sorted(low)


def test_containment_between_unequal_texts(spark):
    """A passage of 1,500 words in a text of 20,000: contained though hardly alike; estimates near the truth."""
    passage, rest = prose("en", 11, 1500), prose("fr", 12, 20_000)
    half = prose("en", 11, 750) + " " + prose("de", 13, 750)
    rows = spark.createDataFrame([(passage, passage + " " + rest, half)], "a string, b string, c string")
    for name in "abc":
        rows = fp.with_sketch(rows, F.col(name), f"s{name}")
    a, b, c = (F.col(f"s{n}") for n in "abc")
    row = rows.select(fp.containment(a, b).alias("ab"), fp.resemblance(a, b).alias("jab"), fp.containment(c, b).alias("cb"), fp.containment(a, a).alias("aa")).head()
    exact = [brute_sketch(t, floor=10**9)[1] for t in (passage, passage + " " + rest, half)]
    sets = [set(x) for x in exact]
    assert row.ab == 1.0 and row.aa == 1.0
    assert abs(row.jab - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.05
    assert abs(row.cb - len(sets[2] & sets[1]) / len(sets[2])) < 0.2


def test_fingerprints_keep_other_columns(spark, tmp_path):
    docs = awkward(spark).withColumns({"__words": F.lit("w"), "Sketch": F.lit(1), "row": F.lit(2), "a.b": F.lit(3), "__kept": F.lit(4)})
    out = fp.fingerprint_documents(docs)
    others = [c for c in docs.columns if c != "Sketch"]
    assert out.columns == [*others, "fingerprint", "sketch"]
    assert sorted(map(str, out.select(*[f"`{c}`" for c in others]).collect())) == sorted(map(str, docs.select(*[f"`{c}`" for c in others]).collect()))
    assert fp.fingerprint_documents(empty(spark)).count() == 0
    for wrong in ({"size": 0}, {"fraction": 0.0}, {"floor": -1}):
        with pytest.raises(ValueError):
            fp.fingerprint_documents(docs, **wrong)
    assert fp.op12_fingerprints(spark, folder_of(spark, tmp_path, empty(spark))).count() == 0


# Merkle manifest


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


@pytest.mark.parametrize("arity", [2, 3, 16])
@pytest.mark.parametrize("tasks", [1, 7])
def test_trees_equal_brute_force(spark, arity, tasks):
    """Sizes around powers of the arity, leaves in any order over any number of tasks."""
    sizes = {f"t{n}": n for n in (1, 2, 3, 15, 16, 17, 31, 33, 256, 257, 600)}
    rows = [(t, n, k, digest([f"{t}{k}"])) for t, n in sizes.items() for k in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, size long, place long, digest string").repartition(tasks, "digest")
    got = {(r.tree, r.level, r.number): (r.digest, r.is_root) for r in merkle.grown(leaves, arity).collect()}
    want = {}
    for t, n in sizes.items():
        levels = brute_tree([digest([f"{t}{k}"]) for k in range(n)], arity)
        want |= {(t, v, k): (d, v == len(levels) - 1) for v in range(1, len(levels)) for k, d in enumerate(levels[v])}
    assert got == want


def test_growing_holds_only_what_is_incomplete():
    """Events of a sorted run leave a task as soon as their parent is complete; the rest is the frontier."""
    events = [(("t", 100, 1, k // 4), {k % 4: f"d{k}"}) for k in range(2, 70)]
    out = list(merkle._growing(4)(events))
    frontier = {row[:4]: row[7] for row in out if row[7] is not None}
    assert set(frontier) == {("t", 100, 1, 0), ("t", 100, 1, 17), ("t", 100, 2, 0), ("t", 100, 2, 4), ("t", 100, 3, 0)}
    assert frontier[("t", 100, 1, 0)] == {2: "d2", 3: "d3"} and sorted(frontier[("t", 100, 3, 0)]) == [1, 2, 3]
    assert len(out) == 16 + 3 + len(frontier)


def test_wrong_places_are_an_error(spark):
    rows = [("t", 20, k, "d") for k in range(19)]
    with pytest.raises(ValueError):
        merkle.grown(spark.createDataFrame(rows, "tree string, size long, place long, digest string"))


def test_manifest_equals_sql(spark, tmp_path):
    """Null and odd source names, a source with one row, one with several levels."""
    rows = [(k, prose("en", k, 5), None if k % 7 == 0 else "en", "big" if k < 300 else f"s{k}", k) for k in range(340)]
    rows += [(900, "Alone", "de", None, 1), (901, None, None, "é", None), (902, "", None, "", 0), (903, "A", None, "Z", 0), (904, "x", "fr", "a\x00", 3), (905, "Ü", "de", "😀", 1), (906, "q", None, "～", 1), (None, "no key", None, "big", None)]
    docs = spark.createDataFrame(rows, OWN)
    got = held_against(spark, folder_of(spark, tmp_path, docs), merkle.op13_merkle_manifest, merkle.OP13_SQL)
    assert all(verified == ((doc is None) or zlib.crc32(str(doc).encode()) % 5 != 0 or not re.search("[A-Z]", text(doc, rows))) for (doc, *_, verified) in got)


def text(doc, rows):
    return next(r[1] for r in rows if r[0] == doc) or ""


def test_manifest_by_its_general_interface(spark):
    """Awkward rows, other columns, another arity: every proof leads to the root, a changed leaf does not; repeated rows are leaves of their own."""
    docs = awkward(spark)
    leaves, nodes = merkle.manifest(docs, ["text", "kept"], group="lang", order="n_chars", arity=3, carry={"tree": F.col("text"), "proof_of": F.lit(1)})
    rows = leaves.select("*", merkle.folded(F.col("leaf"), F.col("proof")).alias("there"), merkle.folded(F.sha2("leaf", 256), F.col("proof")).alias("elsewhere")).collect()
    assert len(rows) == docs.count() and len({r.root for r in rows}) == 1
    assert all(r.there == r.root != r.elsewhere for r in rows)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.lang].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    tops = [r for r in nodes.filter("is_root").collect() if r.tree == ""]
    assert [r.digest for r in tops] == [rows[0].root]
    none, inner = merkle.manifest(empty(spark), ["text"])
    assert none.count() == 0 and inner.count() == 0
    one, _ = merkle.manifest(docs.filter("doc_id = 1"), ["text"])
    row = one.head()
    assert row.leaf == row.subroot == row.root and row.proof == []


def test_operators_leave_clashing_columns_alone(spark):
    """Columns named like the operators' own pass through with their values."""
    from quirelake.llm import licenses, line_dedup, mixing, near_dedup

    names = ["__row", "__kid", "__krow", "__one", "__lines", "__text_hash", "__gid", "__grow", "__gone", "__kept", "__words", "__norm", "__lower", "__method", "__id", "__size", "__source", "__at0", "callers_0"]
    passage = "\n".join(prose("en", k, 12).replace("\n", " ") for k in range(4))
    rows = [(k, t, f"s{k % 2}") for k, t in enumerate([prose("en", 50, 60), prose("en", 50, 60) + " tail", f"{passage}\n{prose('de', 1)}", f"{prose('fr', 2)}\n{passage}", "MIT license", None])]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clashing = plain.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for operator in (near_dedup.keep_one, line_dedup.dedup_lines, mixing.apply_mix, licenses.scan_licenses):
        got, want = operator(clashing), operator(plain)
        assert got.columns[: len(clashing.columns)] == clashing.columns and got.columns[len(clashing.columns) :] == want.columns[len(plain.columns) :]
        assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
        assert sorted(map(str, got.drop(*names).collect())) == sorted(map(str, want.collect()))
    renamed = plain.withColumnsRenamed({"text": "__text", "doc_id": "__row"})
    assert near_dedup.keep_one(renamed, text="__text", key="__row").columns == ["__row", "__text", "source"]
