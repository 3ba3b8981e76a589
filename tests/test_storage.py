from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quirelake.operators import conversation, preflight
from quirelake.sources import corpora, pdf
from quirelake.sources.library import SCHEMA_VERSION, ConflictError, Library, SchemaVersionError, cascade_delete, differences, latest, upsert, upsert_if_changed
from quirelake.streaming import history


def test_library_life_cycle(spark, tmp_path):
    store = Library(spark, f"file://{tmp_path}/library")
    assert store.status()["state"] == "missing"
    with pytest.raises(SchemaVersionError):
        store.initialise(read_only=True)
    assert store.initialise() == SCHEMA_VERSION
    papers = spark.createDataFrame([(1, "a"), (2, "b")], "paper_id long, title string")
    base = store.manifest()["version"]
    first = store.commit({"papers": papers, "passages": papers.select("paper_id")})
    assert store.status() == {"state": "ready", "version": first, "schema_version": SCHEMA_VERSION, "rows": {"papers": 2, "passages": 2}}
    with pytest.raises(ConflictError):
        store.commit({"papers": papers}, base=base)
    store.commit({"papers": upsert(store.table("papers"), spark.createDataFrame([(2, "c"), (3, "d")], papers.schema), ["paper_id"])})
    assert {tuple(r) for r in store.table("papers").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert store.table("papers", version=first).count() == 2
    assert store.table("nothing", "x int").count() == 0
    gone = cascade_delete({n: store.table(n) for n in ("papers", "passages")}, papers.filter("paper_id = 1"))
    store.commit(gone)
    assert store.status()["rows"] == {"papers": 2, "passages": 1}
    with pytest.raises(SchemaVersionError):
        store.initialise(migrations=[lambda _: {}])


def test_a_failed_migration_publishes_nothing(spark, tmp_path):
    store = Library(spark, f"file://{tmp_path}/library")

    def broken(_):
        raise RuntimeError("refused")

    with pytest.raises(RuntimeError):
        store.initialise(migrations=[lambda _: {}, broken])
    assert store.manifest()["schema_version"] == 1


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id long, x string, updated_at int")
    new = spark.createDataFrame([(1, "a", 9), (2, "z", 9), (3, "n", 9)], "id long, x string, updated_at int")
    assert {tuple(r) for r in upsert_if_changed(old, new, ["id"]).collect()} == {(1, "a", 5), (2, "z", 9), (3, "n", 9)}
    assert {tuple(r) for r in upsert(old, new, ["id"], keep=["updated_at"]).collect()} == {(1, "a", 5), (2, "z", 5), (3, "n", 9)}
    assert differences(old, old).count() == 0 and differences(old, old.union(old)).count() == 2
    assert latest(old.union(new), "id").filter("id = 2").head().x == "z"


def test_preflight(spark):
    files = spark.createDataFrame([("b", 1, "X"), ("a", 1, "X"), ("c", 2, "y"), ("d", 3, "z")], "path string, size long, sha256 string")
    checked = preflight.preflight(files, spark.createDataFrame([("Y",), ("x",)], "checksum string"))
    got = {r.path: (r.is_stored, r.is_batch_duplicate, r.duplicate_of) for r in checked.collect()}
    assert got == {"a": (True, False, None), "b": (True, True, "a"), "c": (True, False, None), "d": (False, False, None)}
    assert tuple(preflight.preflight_counts(checked).head()) == (4, 1, 3, 1)


def test_files_and_corpora(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"one\x0ctwo\r\nlines")
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    assert [r.path.rsplit("/", 1)[1] for r in corpora.discover_pdfs(spark, str(tmp_path / "in")).collect()] == ["a.PDF", "b.pdf"]

    def extractor(content):
        if content == b"broken":
            raise ValueError("no pages")
        return content.decode().split("\f") + [None], {"title": "T"}

    rows = pdf.read_pdfs(spark, str(tmp_path / "in"), extractor).orderBy("path", "page_number").collect()
    assert [(r.page_number, r.text) for r in rows[:3]] == [(1, "one"), (2, "two\nlines"), (3, "")]
    assert rows[3].error == "ValueError: no pages" and rows[0].metadata == {"title": "T"}

    corpus = {"schema_version": 1, "corpus_id": "c", "papers": [{"paper_id": "p", "title": "t", "authors": [], "source_name": "s", "source_identifier": "i"}], "passages": [{"passage_id": "x", "paper_id": "p", "text": "t", "ordinal_position": 0}]}
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "good.json").write_text(json.dumps(corpus, indent=1))
    (tmp_path / "json" / "newer.json").write_text(json.dumps(corpus | {"schema_version": 2}))
    (tmp_path / "json" / "bad.json").write_text("{not json")
    papers, held, problems = corpora.read_corpora(spark, str(tmp_path / "json"))
    assert papers.count() == held.count() == 1 and problems.count() == 2


def test_title_fallback(spark):
    row = spark.createDataFrame([(" ", "/x/A Paper.v2.pdf")], "t string, p string").select(pdf.title_or_stem(F.col("t"), F.col("p")).alias("x")).head()
    assert row.x == "A Paper.v2"


def test_follow_ups(spark):
    rows = [(1, 0, "user", "What about this?"), (1, 1, "assistant", "An answer"), (1, 2, "user", "And what else"), (1, 3, "user", "Plain question"), (1, 4, "assistant", "Second"), (1, 5, "user", "does it hold"), (1, 6, "assistant", "Third"), (1, 7, "user", "élan vital")]
    turns = conversation.answered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.turn: ([h.turn for h in r.history], r.needs_context) for r in conversation.needs_context(turns).collect()}
    assert got == {0: ([], False), 2: ([0], True), 3: ([0], False), 5: ([0, 3], True), 7: ([3, 5], False)}


def streamed(spark, folder, arrivals, **options):
    """What the stream tells of turns (conv_id, turn, question, answer, minute) that arrive in batches; a last turn, far in the future, moves time on."""
    schema = "conv_id long, turn long, question string, answer string, minute long"
    for k, rows in enumerate([*arrivals, [(-1, 0, "end", None, 10**6)], [(-1, 1, "end", None, 2 * 10**6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    import os
    import time

    for k in range(len(arrivals) + 2):  # files are read in the order of their times
        for name in os.listdir(f"{folder}/in/{k}"):
            os.utime(f"{folder}/in/{k}/{name}", (time.time() - 1000 + k, time.time() - 1000 + k))
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withColumn("asked_at", F.timestamp_seconds(F.col("minute") * 60 + 10**9))
    query = history.stream_history(turns, **options).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return {(r.conv_id, r.turn): (r.history, r.needs_context) for r in spark.read.parquet(f"{folder}/out").collect() if r.conv_id >= 0}


def batch_history(spark, rows):
    turns = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, question string, answer string")
    return {(r.conv_id, r.turn): ([h.question for h in r.history], r.needs_context) for r in conversation.needs_context(turns).collect()}


def test_stream_equals_batch_for_shuffled_arrivals(spark, tmp_path):
    """Turns 0, 2, 1 of a conversation in three batches, another one backwards, one in order."""
    rows = [(c, t, q, a, t) for c in (1, 2, 3) for t, q, a in ((0, "roads", "x"), (1, "what about it", None), (2, "and them", "y"), (3, "that one", "z"))]
    order = {1: [0, 2, 1, 3], 2: [3, 2, 1, 0], 3: [0, 1, 2, 3]}
    arrivals = [[r for r in rows if order[r[0]].index(r[1]) == k] for k in range(4)]
    assert streamed(spark, tmp_path, arrivals, lateness="5 minutes") == batch_history(spark, rows)
    turns = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, question string, answer string")
    assert history.reset_history(turns, spark.createDataFrame([(1, 1)], "conv_id long, turn long")).count() == 10


def test_stream_beyond_lateness_and_idleness(spark, tmp_path):
    """A turn beyond the lateness is dropped, a repeated one counts once, and after a silence the history is forgotten."""
    first = [(1, 0, "roads", "x", 0), (1, 0, "roads", "x", 0), (1, 2, "them", "y", 2), (2, 0, "a", "b", 0)]
    late = [(1, 1, "late", "z", 1), (1, 3, "those", "w", 41), (2, 1, "these", "v", 45)]
    told = streamed(spark, tmp_path, [first, [(9, 0, "time goes on", None, 40)], [(9, 1, "and on", None, 40)], late], lateness="5 minutes", idle=1800)
    assert told[(1, 0)] == ([], False) and told[(1, 2)] == (["roads"], True) and (1, 1) not in told
    assert told[(1, 3)] == ([], False) and told[(2, 1)] == ([], False)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_a_hot_conversation_lies_in_many_ranges(spark, most):
    """One conversation has most of the turns, few of them answered: its history crosses the ranges, some without an entry."""
    import random

    rng = random.Random(most)
    turns, rows = [], []
    for conv, n in ((1, 6), (2, 400), (3, 5), (None, 4)):
        for k in range(n):
            turns.append((conv, k, "user" if rng.random() < 0.7 else "assistant", f"{conv}-{k}" if rng.random() < 0.9 else " "))
    frame = spark.createDataFrame(rng.sample(turns, len(turns)), "conv_id long, turn long, role string, text string")
    for conv in (1, 2, 3, None):
        held, mine = [], [t for t in turns if t[0] == conv]
        for k, (_, turn, role, text) in enumerate(mine):
            if role == "user":
                answer = mine[k + 1][3] if k + 1 < len(mine) and mine[k + 1][2] == "assistant" else None
                rows.append((conv, turn, text, answer, tuple(h[0] for h in held[-most:])))
                held += [(turn, text)] if answer and answer.strip() else []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = conversation.history_before(conversation.answered_turns(frame), most).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: (r[0] or 0, r[1])
    assert sorted([(r.conv_id, r.turn, r.question, r.answer, tuple(h.turn for h in r.history)) for r in got], key=key) == sorted(rows, key=key)


def test_the_streaming_twin_takes_few_batches(spark, tmp_path):
    """a conversation of 90 turns, which arrive in 31 lots, and files in several pieces: the stream's batches do not grow with either."""
    import glob

    from quirelake.durable import ensure_checkpoint_dir
    from quirelake.plans import catalogue

    rows = [(c, k, "user" if k % 3 else "assistant", f"what about {c}-{k}") for c, n in ((1, 90), (2, 4), (3, 7)) for k in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{shared}/stream-*"))
    got = {(r.conv_id, r.turn): (r.held, r.needs_context) for r in catalogue.queries()["stream_history"](spark, str(tmp_path)).collect()}
    turns = conversation.answered_turns(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    assert got == {(r.conv_id, r.turn): (len(r.history), r.needs_context) for r in conversation.needs_context(turns).collect()}
    (folder,) = set(glob.glob(f"{shared}/stream-*")) - before
    assert len(glob.glob(f"{folder}/state/commits/[0-9]*")) <= 2 * (catalogue.WAVES + 1)
