"""What a library keeps of analyses, and what it spares the next batch."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake import cli
from quirelake.operators import analysis, passages
from quirelake.plans import catalogue
from quirelake.sources import pdf
from quirelake.sources.library import Library

from .test_analysis import GOOD


def texts(spark, **named):
    rows = [(f"/{name}.pdf", text.encode()) for name, text in named.items()]
    return spark.createDataFrame(rows, "path string, content binary").select("path", F.length("content").cast("long").alias("size"), F.upper(F.sha2("content", 256)).alias("sha256"), "content")


class Counted:
    """Extractor and generator whose calls are counted in a folder, from whichever process they come."""

    def __init__(self, folder):
        self.extractions, self.generations = str(folder / "extractions"), str(folder / "generations")

    @staticmethod
    def note(path):
        with open(path, "a") as out:
            out.write("x")

    def extractor(self):
        path = self.extractions

        def extract(content):
            Counted.note(path)
            if content == b"broken":
                raise ValueError("no pages")
            return content.decode().split("\f"), {}

        return extract

    def generator(self):
        path = self.generations

        def generate(prompt):
            Counted.note(path)
            return json.dumps({"question": "Do prices rise?", "sections": ["abstract"]})

        return generate

    def taken(self):
        """Calls since the last time."""
        found = []
        for path in (self.extractions, self.generations):
            try:
                with open(path) as held:
                    found.append(len(held.read()))
            except FileNotFoundError:
                found.append(0)
            open(path, "w").close()
        return tuple(found)


def actions(rows):
    return {r.path[1:-4]: (r.action, r.status, r.outcome) for r in rows.collect()}


def test_a_second_batch_reuses_the_first(spark, tmp_path):
    store, calls = Library(spark, f"file://{tmp_path}/library"), Counted(tmp_path)
    store.initialise()
    run = lambda files, **options: actions(analysis.analyze_into(store, files, calls.extractor(), calls.generator(), **options))
    second = GOOD.replace("towns", "cities")
    first = texts(spark, a=GOOD, b=GOOD, c="broken", d=" \f ", e="")
    want = {"a": ("new", "completed", "stored"), "b": ("duplicate", "duplicate", None), "c": ("new", "failed", "not_eligible"), "d": ("new", "halted", "not_eligible"), "e": ("new", "failed", "not_eligible")}
    assert run(first) == want
    assert calls.taken() == (3, 1)
    assert store.status()["rows"] == {"analyses": 3, "assessments": 3, "checksums": 1, "pages": 4, "papers": 1, "passages": store.table("passages").count()}

    # the same files again: nothing is called, nothing is published
    version = store.manifest()["version"]
    assert run(first) == {k: (v[0] if k in "be" else "reuse", *v[1:]) for k, v in want.items()}
    assert calls.taken() == (0, 0) and store.manifest()["version"] == version

    # another folder: what is stored of the first stays
    assert run(texts(spark, f=second, g=GOOD)) == {"f": ("new", "completed", "stored"), "g": ("reuse", "completed", "stored")}
    assert calls.taken() == (1, 1)
    assert store.table("analyses").count() == 4 and store.table("papers").count() == 2
    assert store.analyses(first.filter("path = '/a.pdf'").head().sha256).count() == 1

    # passages by another budget: cut from the stored sections
    cut = run(texts(spark, a=GOOD, f=second, c="broken"), budget=passages.BUDGET // 4)
    assert cut == {"a": ("backfill", "completed", "stored"), "f": ("backfill", "completed", "stored"), "c": ("reuse", "failed", "not_eligible")}
    assert calls.taken() == (0, 0) and store.table("analyses").count() == 4
    assert store.table("passages").agg(F.max(F.length("text"))).head()[0] <= passages.BUDGET // 4

    # a paper lost from the library is filled in without the generator
    store.delete_papers(store.table("papers").filter("source_path = '/f.pdf'"))
    assert run(texts(spark, f=second), budget=passages.BUDGET // 4) == {"f": ("backfill", "completed", "stored")}
    assert calls.taken() == (0, 0) and store.table("papers").count() == 2

    # other settings of one stage: earlier stages are reused
    assert run(texts(spark, a=GOOD, c="broken"), settings={"question": {"prompt": 2}}) == {"a": ("new", "completed", "stored"), "c": ("new", "failed", "not_eligible")}
    assert calls.taken() == (0, 1)
    assert run(texts(spark, a=GOOD), settings={"sections": {"version": 2}})["a"][0] == "new" and calls.taken() == (0, 1)
    assert run(texts(spark, a=GOOD), settings={"extraction": {"version": 2}})["a"][0] == "new" and calls.taken() == (1, 1)
    assert store.table("analyses").count() == 8 and store.table("analyses").select("analysis_id").distinct().count() == 8
    assert store.table("papers").count() == 2


def test_batch_equals_the_library(spark, tmp_path):
    """What analyze computes and what analyze_into keeps are the same."""
    store, calls = Library(spark, f"file://{tmp_path}/library"), Counted(tmp_path)
    store.initialise()
    files = texts(spark, a=GOOD, c="broken", d=" \f ")
    plain = analysis.analyze(files, store.table("papers", "checksum string"), calls.extractor(), calls.generator())
    analysis.analyze_into(store, files, calls.extractor(), calls.generator()).collect()
    columns = ["checksum", *analysis.RESULT]
    assert sorted(map(str, store.table("analyses").select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    papers, cut = analysis.library_rows(plain)
    assert sorted(map(str, store.table("passages").collect())) == sorted(map(str, cut.select(store.table("passages").columns).collect()))
    assert store.table("papers").drop("conversion").collect() == papers.collect()


def test_command_line_keeps_both_folders(spark, tmp_path, monkeypatch, capsys):
    calls = Counted(tmp_path)
    monkeypatch.setattr(cli, "local_session", lambda *a: spark)
    monkeypatch.setattr(cli.pdf, "extract_with_pypdf", calls.extractor())
    for name, text in (("a", GOOD), ("b", GOOD.replace("towns", "cities"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.pdf").write_bytes(text.encode())
    base = ["--library", f"file://{tmp_path}/library", "--config", str(tmp_path / "none.json")]
    for folder, said, extractions in (("a", "new 1, reused 0", 1), ("b", "new 1, reused 0", 1), ("a", "new 0, reused 1", 0)):
        assert cli.main([*base, "analyze", str(tmp_path / folder)]) == 0
        assert said in capsys.readouterr().out and calls.taken()[0] == extractions
    store = Library(spark, f"file://{tmp_path}/library")
    assert store.table("analyses").count() == store.table("papers").count() == 2


def test_pages_of_many_files_share_a_batch(spark):
    """A batch a file made the transfer outgrow the texts; a large file still closes its batch."""
    files = SimpleNamespace(sparkSession=spark, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))

    def extract(content):
        if content == b"broken":
            raise ValueError("no pages")
        return content.decode().split("\f"), {"title": "t"}

    contents = [b"a\fb", b"broken", b"x" * pdf.CHARACTERS_AT_ONCE, *[b"c"] * 3000]
    given = pa.RecordBatch.from_pydict({"path": [str(n) for n in range(len(contents))], "content": contents})
    batches = list(pdf.pages_of(files, extract)(iter([given.slice(0, 2000), given.slice(2000)])))
    assert [b.num_rows for b in batches] == [4, pdf.PAGES_AT_ONCE, pdf.PAGES_AT_ONCE, 3000 - 2 * pdf.PAGES_AT_ONCE]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["path"], r["page_number"], r["page_count"], r["text"], r["error_kind"]) for r in rows[:3]] == [("0", 1, 2, "a", None), ("0", 2, 2, "b", None), ("1", None, None, None, "parser")]
    assert [r["path"] for r in rows[3:]] == [str(n) for n in range(2, len(contents))]
    assert list(pdf.pages_of(files, extract)(iter([]))) == []


def test_analysis_reuse_equals_its_sql_for_any_ids_and_texts(spark, tmp_path):
    """Ids of ten digits had paths in common, and with them contents; empty texts were no analyses, null ones no files."""
    duckdb = pytest.importorskip("duckdb")
    large = [(10**10 + k, f"large {k}\fsecond page", "de" if k % 2 else "en") for k in range(6)]
    odd = [(-5, "same", "en"), (-40, "same", "fr"), (3, "", "de"), (4, "", "en"), (5, None, "fr"), (6, None, "en"), (7, "\f\r\n\f", None)]
    repeated = [(8, "one", "de"), (8, "other", "de"), (9, "twice", "es"), (9, "twice", "es")]
    spark.createDataFrame([*large, *odd, *repeated], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    engine = duckdb.connect()
    engine.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = engine.sql(catalogue.oracle_sql()["analysis_reuse"])
    got = catalogue.queries()["analysis_reuse"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
