from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quirelake import cli, config
from quirelake.operators import analysis, contracts, generate, report
from quirelake.sources.library import Library
from quirelake.streaming.ingest import file_stream, ingest

GOOD = "Title\n\nAbstract\n" + "We ask whether prices rise in towns. " * 8 + "\n\n1. Introduction\n" + "They do rise a good deal. " * 8 + "\n\n2. Data\nx\n"


def extractor(content):
    text = content.decode()
    if text == "broken":
        raise ValueError("no pages")
    return text.split("\f"), {}


def answer(prompt):
    return json.dumps({"question": "Do prices rise?", "sections": ["abstract"]})


def files(spark):
    rows = [("/a.pdf", GOOD), ("/b.pdf", GOOD), ("/c.pdf", "broken"), ("/d.pdf", " \f "), ("/e.pdf", "")]
    return spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary").select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def test_stages_of_a_batch(spark):
    out = analysis.analyze(files(spark), spark.createDataFrame([], "checksum string"), extractor, answer)
    rows = {r.path: r for r in out.collect()}
    assert {p: r.status for p, r in rows.items()} == {"/a.pdf": "completed", "/b.pdf": "duplicate", "/c.pdf": "failed", "/d.pdf": "halted", "/e.pdf": "failed"}
    assert rows["/b.pdf"].duplicate_of == "/a.pdf" and rows["/c.pdf"].failed_stages == ["extraction"] and rows["/d.pdf"].skipped_stages == ["sections", "question"]
    assert (rows["/a.pdf"].question, rows["/a.pdf"].question_kind) == ("Do prices rise?", "inferred")
    assert contracts.stage_violations(out, analysis.STAGES).count() == 0
    papers, passages = analysis.library_rows(out)
    assert papers.count() == 1 and papers.head().title == "a"
    kept = passages.orderBy("ordinal").collect()
    assert [r.kind for r in kept] == sorted(r.kind for r in kept) and all(r.fragments for r in kept)


def test_streamed_files_are_ingested_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Library(spark, f"file://{tmp_path}/library")
    store.initialise()

    def run():
        query = ingest(file_stream(spark, str(folder)), store, "texts", lambda rows: rows.select("sha256", F.decode("content", "utf-8").alias("text")), str(tmp_path / "state"))
        query.awaitTermination()
        return sorted(r.text for r in store.table("texts").collect())

    (folder / "1.txt").write_text("one")
    (folder / "2.txt").write_text("one")
    assert run() == ["one"]
    (folder / "3.txt").write_text("two")
    (folder / "4.txt").write_text("one")
    assert run() == ["one", "two"]


def test_config(tmp_path):
    path = str(tmp_path / "x" / "c.json")
    assert config.load(path) == {}
    config.save(path, {"library": "here"})
    assert config.load(path) == {"library": "here", "schema_version": config.SCHEMA_VERSION}
    assert config.resolve({"library": None}, {"library": "f"}, {"library": "d", "top_k": 5}) == {"library": "f", "top_k": 5, "model_id": None, "model_path": None, "model_sha256": None}
    with pytest.raises(config.ConfigError):
        config.resolve({"model_id": "m"}, {}, {})
    (tmp_path / "bad.json").write_text('{"schema_version": 9}')
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "bad.json"))


def test_reports():
    assert report.wrapped("a " * 60 + "\n\nb").count("\n") == 3
    assert report.clean("a\x00b\tc") == "a�b\tc"
    assert json.loads(report.json_report(b=[1], a="x")) == {"a": "x", "b": [1]}
    assert report.status_text({"state": "missing"}) == "library: missing"


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda *a: spark)
    monkeypatch.setattr(cli.pdf, "extract_with_pypdf", extractor)
    (tmp_path / "papers").mkdir()
    (tmp_path / "papers" / "Prices.pdf").write_bytes(GOOD.encode())
    base = ["--library", f"file://{tmp_path}/library", "--config", str(tmp_path / "none.json")]
    assert cli.main([*base, "status"]) == 0 and "missing" in capsys.readouterr().out
    assert cli.main([*base, "chat", "prices"]) == 2
    assert cli.main([*base, "analyze", str(tmp_path / "papers")]) == 0
    assert "discovered 1" in capsys.readouterr().out
    assert cli.main([*base, "chat", "do prices rise"]) == 0
    assert "[1] Prices (pages 1; passages 1" in capsys.readouterr().out
    assert cli.main([*base, "chat", "zebra"]) == 1


def test_generator_helpers(spark):
    cases = spark.createDataFrame([(c, r) for c in "ab" for r in (1, 2)], "case_id string, run int")
    runs = spark.createDataFrame([("a", 1, "succeeded"), ("a", 2, "failed")], "case_id string, run int, status string")
    assert {r.status: r.runs for r in generate.run_ledger(cases, runs).collect()} == {"succeeded": 1, "failed": 1, "not_run": 2}
    first, again = ([r.case_id for r in generate.deterministic_order(cases, "case_id", 3).orderBy("position").collect()] for _ in (0, 1))
    assert first == again
