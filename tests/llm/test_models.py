from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import language_id, lm_score, quality_rules

from .common import awkward, empty, prose


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = "abcbcabbca"
    edges = language_id.suffix_automaton([ord(c) for c in text])

    def accepts(word):
        state = 0
        for c in word:
            if ord(c) not in edges[state]:
                return False
            state = edges[state][ord(c)]
        return True

    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        assert accepts(word) == (word in text)


def phrases_by_hand(text, sample):
    """Longest matches with the sample, restarted at every block."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = re.sub(" +", " ", letters)
    count = 0
    for a in range(0, len(letters), language_id.BLOCK):
        block, k = letters[a : a + language_id.BLOCK], 0
        while k < len(block):
            n = 1
            while k + n <= len(block) and block[k : k + n] in sample:
                n += 1
            k += max(1, n - 1)
            count += 1
    return count


def test_phrase_counts_follow_the_definition():
    sample = prose("en", 1, 300).replace("\n", " ").replace(".", " ")
    sample = re.sub(" +", " ", sample)
    parser = language_id.Parser((("en", sample), ("xx", "zq zq zq")))
    texts = ["the quick answer", "zebra! 12 about", "", "é", prose("en", 2, 500), prose("de", 3, 20)]
    codes, lengths, _ = parser.encode(texts)
    got = parser.phrases(codes, lengths)
    assert [int(x) for x in got[:, 0]] == [phrases_by_hand(t, sample) for t in texts]


def test_language_id(spark):
    rows = [(k, prose(lang, k), lang) for k in range(60) for lang in ("en", "de", "fr")]
    docs = spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.learn(docs.filter("doc_id < 90"))
    assert [lang for lang, _ in model] == ["de", "en", "fr"]
    out = language_id.identify(docs.filter("doc_id >= 90"), model).collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) == 1.0
    assert all(0 < r.score <= 1 for r in out)


def test_language_id_takes_awkward_rows(spark):
    docs = awkward(spark)
    model = language_id.learn(docs)
    out = language_id.identify(docs, model)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters), r.text and r.text[:40]
        assert (r.score > 0) == letters
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    assert language_id.identify(empty(spark), ()).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, ()).collect()} == {"und"}


@pytest.mark.parametrize("column", ["lang", "doc_id"])
def test_without_labels_or_keys_no_document_with_a_letter_goes(spark, column):
    docs = awkward(spark, [prose("en", 800), "漢字", "12 34"])
    docs = docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType))
    model = language_id.learn_from_training_part(docs)
    assert not model
    want = sorted(r.text for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert sorted(r.text for r in language_id.keep_identified(docs, model).collect()) == want and len(want) > 8


def test_held_out_accuracy_on_driver_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = language_id.op1_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


def test_quality_verdicts_on_held_out_labels(spark):
    """Learnt from half of the labels, judged on the other half."""
    from pathlib import Path

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no driver tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    crf = quality_rules.learn(docs, labels.filter(~out))
    judged = quality_rules.judge_quality(docs, crf, keep=["doc_id"]).join(labels.filter(out), "doc_id").filter("not base_failed").collect()
    good, bad = ([r for r in judged if r.quality == q] for q in (1, 0))
    assert len(good) > 100 and sum(r.kept for r in good) / len(good) > 0.97
    assert len(bad) > 10 and sum(not r.kept for r in bad) / len(bad) > 0.5


def test_repeated_rows_teach_once(spark):
    """What reaches the driver is bounded by the sample, not by the number of rows."""
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"), F.lit("en").alias("lang"))
    other = spark.createDataFrame([(k, prose("de", k), "de") for k in range(20)], rows.schema)
    docs = rows.union(other)
    model = dict(language_id.learn(docs))
    assert model["en"] == "the same text again" and len(model["de"]) > 500
    assert [lang for lang, _ in language_id.learn(docs, languages=1)] == ["de"]  # the label of the most keys
    labels = spark.range(1_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("quality")).union(spark.createDataFrame([(k, 0) for k in range(5)], "doc_id long, quality int"))
    assert quality_rules.learn(docs, labels) == quality_rules.learn(docs.distinct(), labels.distinct())


def test_far_letters_are_told_by_the_sample(spark):
    parser = language_id.Parser((("ja", "漢字かな交じり文"), ("ko", "한국어 문장")))
    codes, lengths, letters = parser.encode(["漢字 한국", "龘、😀", "한"])
    assert lengths.tolist() == [5, 2, 1] and letters.tolist() == [4, 1, 1] and codes[5] == 1
    assert parser.judge(["漢字かな", "한국어 문장"])[0] == ["ja", "ko"]


def base_scores(texts, learning):
    count = collections.Counter()
    for t in learning:
        count.update((t or "").encode().lower().split())
        count[b""] += 1
    total, distinct = sum(count.values()), len(count)
    out = []
    for t in texts:
        words = [*(t or "").encode().lower().split(), b""]
        out.append((len(words), sum(count[w] > 0 for w in words), total, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)))
    return out


@pytest.mark.parametrize("hot", [100_000, 5])
def test_lm_base_equals_the_formula(spark, hot):
    """Also with so few hot tokens that nearly all are looked up by the join."""
    docs = awkward(spark, [prose("en", k) for k in range(30)]).withColumn("held_out", F.coalesce(F.col("doc_id") >= 110, F.lit(False)))
    rows = docs.collect()
    out = lm_score.score_texts(docs, docs.filter("not held_out"), hot=hot)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect())
    want = base_scores([r.text for r in rows], [r.text for r in rows if not r.held_out])
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, *w[:3], round(w[3], 6)) for r, w in zip(rows, want, strict=True))
    assert all(r.score < 0 for r in out.collect())


def test_lm_beats_its_base_and_empty_tables(spark, data):
    out = lm_score.op5_lm_score(spark, data).filter("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).head()
    assert out.m > out.b
    none = empty(spark).withColumn("held_out", F.lit(False))
    assert lm_score.score_texts(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    row = lm_score.score_texts(some, some.limit(0)).head()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)


def test_lm_probabilities_are_normalised(spark):
    rng = np.random.default_rng(2)
    k = lm_score.CLASSES
    model = lm_score.tables(*[lm_score.train(rng.poisson(0.02, k * k), steps=5) for _ in range(2)])
    for two, one in ((0, 0), (3, 700), (k - 1, 5)):
        assert np.isclose(np.exp(model.near[one].astype(float) + model.far[two] - model.norm[two, one]).sum(), 1, atol=1e-4)
    docs = spark.createDataFrame([(k, prose("en", k)) for k in range(40)] + [(41, "x é ab")], "doc_id long, text string")
    counts = lm_score.count_tokens(docs)
    known = lm_score.vocabulary(counts, 10)
    mass = 10 ** lm_score.class_masses(counts, known)
    by_class = np.full(lm_score.CLASSES, 0.5)
    for r in counts.collect():
        word = bytes(r.token)
        by_class[known.heads.get(word) or lm_score._tail(word)] += r.c + 0.5
    assert np.allclose(mass, by_class)


def test_lm_training_prefers_what_it_saw():
    k = lm_score.CLASSES
    near, far = np.zeros((k, k)), np.zeros((k, k))
    near[4, 5] = near[3, 6] = far[3, 5] = far[4, 6] = 500
    model = lm_score.tables(lm_score.train(near), lm_score.train(far))
    for two, one, best in ((3, 4, 5), (4, 3, 6)):
        assert (model.near[one] + model.far[two]).argmax() == best


def test_lm_score_is_the_sum_of_its_tokens(spark):
    """Every token by hand: classes, pair counts, normalisation over all classes, share within the class."""
    texts = [prose(lang, k, 40) for k in range(12) for lang in ("en", "de")] + ["", None, "One", "  é x\ny "]
    docs = spark.createDataFrame([(k, t, k % 5 == 0) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in lm_score.score_texts(docs, docs.filter("not held_out")).collect()}
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    count = collections.Counter(w for k, ws in enumerate(tokens) if k % 5 for w in ws)
    heads = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])) if w][: lm_score.HEADS]
    number = {b"": 1} | {w: k + 2 for k, w in enumerate(heads)}
    cls = lambda w: number[w] if w in number else 2 + lm_score.HEADS + zlib.crc32(w[-3:]) % lm_score.TAILS
    k = lm_score.CLASSES
    near, far, mass = np.zeros((k, k), np.int64), np.zeros((k, k), np.int64), np.full(k, 0.5)
    for w, c in count.items():
        mass[cls(w)] += c + 0.5
    for n, ws in enumerate(tokens):
        if n % 5:
            at = [0, 0, *map(cls, ws)]
            for a, b, c in zip(at, at[1:], at[2:]):
                near[b, c] += 1
                far[a, c] += 1
    (ni, no, nb), (fi, fo, _) = lm_score.train(near), lm_score.train(far)
    for n, ws in enumerate(tokens):
        total, at = 0.0, [0, 0, *map(cls, ws)]
        for a, b, c, w in zip(at, at[1:], at[2:], ws):
            scores = (no @ ni[b] + nb + lm_score.FAR * (fo @ fi[a])).astype(float)
            total += (scores[c] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / math.log(10) + math.log10((count[w] + 0.5) / mass[c])
        assert got[n].score == pytest.approx(total, abs=1e-3 * len(ws))


def test_hot_tokens_are_whole_bins_of_counts(spark):
    docs = spark.createDataFrame([(1, " ".join(["a"] * 9 + ["b"] * 5 + ["c"] * 5 + ["d"] * 2 + [f"w{k}" for k in range(50)]))], "doc_id long, text string")
    counts = lm_score.count_tokens(docs)
    hot = lambda n: set(lm_score.vocabulary(counts, n).hot)
    assert hot(0) == {b""} and hot(1) == hot(2) == {b"", b"a"} and hot(3) == {b"", b"a", b"b", b"c"} and hot(10) == {b"", b"a", b"b", b"c", b"d"} and len(hot(100)) == 55



def counters_by_hand(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_counters_equal_the_definition(spark):
    extra = ["a b c d e f a b c d e g h", "same\nsame\n same\n\nsame", "# * $ % & | < > é\n", "one\r\none\r\n", "end\n", "x y z " * 30]
    docs = awkward(spark, extra)
    out = quality_rules.judge_quality(docs, quality_rules.DEFAULT)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    assert out.columns == [*[c for c in docs.columns if c != "kept"], *added]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        hand = counters_by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == hand, r.text and r.text[:60]
        assert r.base_failed == (hand[0] < 10 or 100 * hand[4] > 20 * hand[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(empty(spark), quality_rules.DEFAULT).count() == 0


def test_viterbi_finds_the_best_path():
    rng = random.Random(4)
    for _ in range(100):
        odds, stay, start = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))], rng.uniform(0, 2), rng.uniform(-1, 1)

        def total(path, odds=odds, stay=stay, start=start):
            return sum(o for o, s in zip(odds, path, strict=True) if s) + start * path[0] + stay * sum(a == b for a, b in zip(path, path[1:], strict=False))

        best = max(total([bool(c >> k & 1) for k in range(len(odds))]) for c in range(1 << len(odds)))
        assert total(quality_rules.viterbi(odds, stay, start)) == pytest.approx(best)


def test_crf_learns_lines(spark, data):
    clean = [(prose("en", k, 60), 1) for k in range(40)]
    junk = [("\n".join(f"### $$$ {k} || && %%% <b> ***" for _ in range(6)), 0) for k in range(40)]
    crf = quality_rules.train(clean + junk)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate([(prose("de", 7, 60), 1), ("\n".join(f"$$$ {k} ## a{k} %% << b{k} ** c{k} &" for k in range(9)), 0)])], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge_quality(docs, crf).collect()}
    assert kept == {0: True, 1: False}
    assert quality_rules.train(clean) == quality_rules.DEFAULT
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = quality_rules.op10_quality_rules(spark, data).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r.quality: r.kept for r in out}[1] >= 0.97
