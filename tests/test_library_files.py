"""Changes of single files, pushed lookups, writers beside each other, older libraries."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quirelake.sources import library as lib
from quirelake.sources.library import ChecksumConflictError, ConflictError, Library
from quirelake.streaming.ingest import file_stream, ingest

PAPER = "paper_id string, checksum string, source_path string, title string"


def paper(k, title="t"):
    return (f"p{k:04d}", f"SUM{k:04d}", f"/x/{k}.pdf", title)


@pytest.fixture
def many_files(spark):
    """Small tables in as many files as there are shuffle partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture
def store(spark, tmp_path, many_files):
    made = Library(spark, f"file://{tmp_path}/library")
    made.initialise()
    papers = spark.createDataFrame([paper(k) for k in range(400)], PAPER)
    passages = papers.select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ordinal")).withColumn("text", F.lit("x"))
    made.save_papers(papers, {"passages": passages})
    return made


def paths(store, name):
    return {f["path"] for f in store.files(name)}


def test_saving_one_paper_rewrites_its_files_only(spark, store):
    before = {name: paths(store, name) for name in ("papers", "passages", "checksums")}
    assert all(len(p) >= 4 for p in before.values())
    store.save_papers(spark.createDataFrame([paper(123, "new")], PAPER), {"passages": spark.createDataFrame([("p0123", 0, "y")], "paper_id string, ordinal int, text string")})
    for name, held in before.items():
        assert len(held - paths(store, name)) == 1, name
    assert store.table("papers").count() == 400 and store.table("passages").count() == 1198
    assert store.paper("p0123").head().title == "new" and store.passages("p0123").head().text == "y"
    assert store.table("papers", version=store.manifest()["version"] - 1).filter("title = 'new'").count() == 0


def test_new_papers_and_deletions_leave_other_files(spark, store):
    before = paths(store, "papers")
    store.save_papers(spark.createDataFrame([paper(900), paper(901)], PAPER), {})
    assert before <= paths(store, "papers")
    store.delete_papers(spark.createDataFrame([("p0005",), ("p0006",), ("none",)], "paper_id string"))
    assert len(before - paths(store, "papers")) == 1
    assert store.status()["rows"] == {"checksums": 400, "papers": 400, "passages": 1194}
    store.save_papers(spark.createDataFrame([("fresh", "sum0005", "/y", "t")], PAPER), {})  # the checksum is free again
    with pytest.raises(ChecksumConflictError):
        store.save_papers(spark.createDataFrame([("other", "sum0007", "/y", "t")], PAPER), {})
    files = len(store.files("papers"))
    store.compact("papers")
    assert store.table("papers").count() == 401 and len(store.files("papers")) < files


def test_a_paper_may_change_its_checksum(spark, store):
    store.save_papers(spark.createDataFrame([("p0001", "SUMnew", "/x", "t")], PAPER), {})
    assert store.paper_by_checksum("sumNEW").head().paper_id == "p0001" and store.paper_by_checksum("SUM0001").count() == 0
    store.save_papers(spark.createDataFrame([("heir", "SUM0001", "/x", "t")], PAPER), {})
    assert store.paper_by_checksum("sum0001").head().paper_id == "heir"


def test_lookups_are_pushed_into_few_files(spark, store):
    for found, column, value in ((store.paper("p0077"), "paper_id", "p0077"), (store.passages("p0077"), "paper_id", "p0077"), (store.paper_by_checksum("Sum0077"), "paper_id", "p0077")):
        plan = found._jdf.queryExecution().toString()
        assert f"EqualTo({column},{value})" in plan.split("PushedFilters: ")[1].split("]")[0]
        assert len(found.inputFiles()) == 1
    assert store.paper("absent").count() == 0 and store.paper("zzz").count() == 0 and store.paper("zzz").columns == store.table("papers").columns
    few = store.matching("papers", ["p0001", "p0399"], "paper_id")
    assert few.count() == 2 and len(few.inputFiles()) == 2
    assert store.matching("papers", ["SUM0001".lower()], "checksum").count() == 1


def test_writers_beside_each_other(spark, store):
    """A writer builds upon a version that left its files alone; the same file, or new rows in its keys, is a conflict that changes nothing."""
    base = store.manifest()["version"]
    keys = lambda *k: spark.createDataFrame([(f"p{x:04d}",) for x in k], "paper_id string")
    rows = lambda *k: spark.createDataFrame([paper(x, "late") for x in k], PAPER)
    store.apply(put={"papers": (keys(10), rows(10))}, base=base)
    later = store.apply(put={"papers": (keys(390), rows(390))}, base=base)
    assert later == base + 2 and store.table("papers").filter("title = 'late'").count() == 2
    with pytest.raises(ConflictError):
        store.apply(put={"papers": (keys(11), rows(11))}, base=base)  # in the file of 10
    store.append("papers", spark.createDataFrame([paper(500)], PAPER))
    with pytest.raises(ConflictError):
        store.apply(put={"papers": (keys(500), rows(500))}, base=later)
    store.apply(appended={"papers": rows(501)}, base=base)
    with pytest.raises(ConflictError):
        store.apply(replaced={"papers": rows(1)}, base=base)
    assert store.table("papers").count() == 402 and store.table("papers").filter("title = 'late'").count() == 3


def test_a_version_taken_meanwhile_is_tried_again(spark, store, monkeypatch):
    publish, between = store._publish, []

    def late(manifest):
        if not between:
            between.append(1)
            Library(spark, store.root).append("papers", spark.createDataFrame([paper(600)], PAPER))
        publish(manifest)

    monkeypatch.setattr(store, "_publish", late)
    store.append("passages", spark.createDataFrame([("p0600", 0, "z")], "paper_id string, ordinal int, text string"))
    assert store.table("papers").count() == 401 and store.table("passages").count() == 1201


def test_batches_are_written_once(spark, store):
    rows = spark.createDataFrame([("p9999", 0, "b")], "paper_id string, ordinal int, text string")
    first = store.append("passages", rows, batch=("stream", 0))
    assert store.append("passages", rows, batch=("stream", 0)) == first
    assert store.append("passages", rows, batch=("stream", 1)) == first + 1
    assert store.append("passages", rows, batch=("other", 0)) == first + 2
    assert store.passages("p9999").count() == 3


def test_a_replayed_batch_and_a_writer_beside_it(spark, tmp_path):
    """The checkpoint is lost after the rows were published, and another writer commits while a batch is at work."""
    import shutil

    (tmp_path / "in").mkdir()
    store = Library(spark, f"file://{tmp_path}/library")
    store.initialise()
    beside = []

    def process(rows):
        if not beside:
            beside.append(Library(spark, store.root).append("texts", spark.createDataFrame([("elsewhere", "x")], "sha256 string, text string")))
        return rows.select("sha256", F.decode("content", "utf-8").alias("text"))

    def run():
        ingest(file_stream(spark, str(tmp_path / "in")), store, "texts", process, str(tmp_path / "state")).awaitTermination()
        return sorted(r.text for r in store.table("texts").collect())

    (tmp_path / "in" / "1.txt").write_text("one")
    assert run() == ["one", "x"]
    held = paths(store, "texts")
    shutil.rmtree(tmp_path / "state" / "commits")
    version = store.manifest()["version"]
    assert run() == ["one", "x"] and store.manifest()["version"] == version
    (tmp_path / "in" / "2.txt").write_text("two")
    assert run() == ["one", "two", "x"] and held <= paths(store, "texts")


def test_an_older_library_is_migrated(spark, tmp_path):
    """Version 2: manifests that name a folder for each table, no owners of checksums."""
    root = tmp_path / "library"
    spark.createDataFrame([paper(k) for k in range(3)], PAPER).withColumn("checksum", F.lower("checksum")).write.parquet(f"{root}/data/00000002-abc/papers")
    (root / "manifests").mkdir()
    (root / "manifests" / "00000002.json").write_text(json.dumps({"version": 2, "schema_version": 2, "tables": {"papers": "data/00000002-abc/papers"}}))
    store = Library(spark, f"file://{root}")
    assert store.status()["state"] == "outdated" and store.table("papers").count() == 3
    assert store.initialise() == lib.SCHEMA_VERSION
    assert store.status()["rows"] == {"checksums": 3, "papers": 3} and store.files("papers")[0]["low"] == "p0000"
    assert store.paper_by_checksum("SUM0002").head().paper_id == "p0002"
    assert store.table("papers", version=2).count() == 3


def test_keys_with_nulls_and_other_types(spark, store):
    rows = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "paper_id long, text string")
    store.commit({"notes": rows})
    store.apply(put={"notes": (rows.filter("paper_id = 1").select("paper_id"), None)})
    assert sorted((r.paper_id or 0, r.text) for r in store.table("notes").collect()) == [(0, "a"), (2, "c")]
    store.commit({"plain": rows.select("text")})
    assert store.table("plain").count() == 3 and store.files("plain")[0]["low"] is None
    store.commit({"plain": rows.select("text").limit(0)})
    assert store.table("plain").count() == 0 and store.table("plain").columns == ["text"]


def test_changes_read_only_the_files_that_differ(spark, store):
    base = store.manifest()["version"]
    store.save_papers(spark.createDataFrame([paper(123, "new"), paper(700)], PAPER), {})
    found = store.changes("papers", base)
    assert sorted((r.paper_id, r.title, r.side) for r in found.collect()) == [("p0123", "new", "right"), ("p0123", "t", "left"), ("p0700", "t", "right")]
    read = set(found.inputFiles())
    assert 0 < len(read) < len(store.files("papers"))
    assert store.changes("passages", base).count() == 0 and store.changes("papers", base, base).count() == 0


@pytest.mark.parametrize("buckets", [1, 16, 1024])
def test_differences_equal_those_of_all_rows(spark, buckets):
    rows = [(k % 40, f"t{k % 7}", None if k % 5 else float(k)) for k in range(300)]
    left = spark.createDataFrame(rows, "a long, b string, c double")
    right = spark.createDataFrame(rows[3:150] + rows[140:] + [(1, None, None), (None, None, None), (None, None, None)], "a long, b string, c double")
    plain = left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))
    assert sorted(map(str, lib.differences(left, right.select("c", "b", "a"), buckets).collect())) == sorted(map(str, plain.collect()))
    again = lib.differences(left, left.orderBy("b"), buckets)
    assert again.count() == 0 and again.columns == plain.columns
    assert lib.differences(left.limit(0), right, buckets).count() == right.count()
