from __future__ import annotations

import hashlib
import io
import json
import re
import stat
import tarfile
import zipfile

import pytest

from quirelake import cli, session
from quirelake.functions import text as T
from quirelake.operators import benchmarks, bm25, conversation, evaluate, generate, passages, records, sections
from quirelake.plans import catalogue
from quirelake.sources import archives, corpora, pdf
from quirelake.sources.library import ChecksumConflictError, Library, MigrationError

F = pytest.importorskip("pyspark.sql.functions")
PRINT = passages.settings_fingerprint(100)


def conversion(spark):
    """Two papers: A with an abstract and an introduction over two pages, B with an abstract."""
    texts = [("A", "abstract", "First words here. "), ("A", "introduction", "More words on two pages."), ("B", "abstract", "Another paper.")]
    cut = passages.split_passages(spark.createDataFrame(texts, "doc_id string, kind string, text string"), 100, kind=F.col("kind"))
    held = cut.select("paper_id", "passage_id", "ordinal", "kind", F.initcap("kind").alias("heading"), F.when(F.col("kind") == "abstract", 1).otherwise(2).alias("page_start"), F.when(F.col("kind") == "abstract", 1).otherwise(3).alias("page_end"), "text")
    parts = []
    for r in held.collect():
        if r.kind == "abstract":
            parts.append((r.passage_id, 1, 10, 10 + len(r.text), 0, len(r.text), r.text))
        else:
            parts += [(r.passage_id, 2, 0, 5, 0, 5, r.text[:5]), (r.passage_id, 3, 7, 2 + len(r.text), 5, len(r.text), r.text[5:])]
    fragments = spark.createDataFrame(parts, "passage_id string, page int, start int, end int, passage_start int, passage_end int, text string")
    known = spark.createDataFrame([(p, "c" + p, "local-pdf", "c" + p, PRINT, "# " + p, hashlib.sha256(f"# {p}".encode()).hexdigest()) for p in "AB"], "paper_id string, checksum string, source_name string, source_identifier string, fingerprint string, markdown string, markdown_sha256 string")
    return known, held, fragments


def test_consistent_records_have_no_violation(spark):
    assert records.record_violations(*conversion(spark), 100).count() == 0


@pytest.mark.parametrize(
    ("table", "column", "where", "value", "problems"),
    [
        ("passages", "ordinal", "ordinal = 1", "5", {"ordinal_gap", "wrong_id"}),
        ("passages", "heading", "ordinal = 1", "'Other'", {"wrong_heading"}),
        ("passages", "page_start", "ordinal = 1", "1", {"wrong_first_page"}),
        ("passages", "page_end", "ordinal = 1", "2", {"wrong_last_page"}),
        ("passages", "text", "ordinal = 1", "concat(text, '.')", {"wrong_id", "fragment_gap"}),
        ("passages", "text", "ordinal = 1", "repeat(text, 9)", {"wrong_id", "fragment_gap", "too_long"}),
        ("fragments", "text", "page = 3", "upper(text)", {"fragment_text"}),
        ("fragments", "passage_start", "page = 3", "6", {"fragment_gap", "fragment_length", "fragment_text"}),
        ("fragments", "page", "page = 3", "1", {"fragment_order", "wrong_last_page"}),
        ("fragments", "end", "page = 3", "end + 1", {"fragment_length"}),
        ("records", "markdown", "paper_id = 'A'", "'# a'", {"wrong_digest"}),
        ("records", "markdown", "paper_id = 'A'", "' '", {"wrong_digest", "blank_markdown"}),
        ("records", "source_identifier", "paper_id = 'A'", "null", {"wrong_source"}),
        ("records", "fingerprint", "paper_id = 'A'", "'x'", {"wrong_fingerprint"}),
    ],
)
def test_every_damage_is_named(spark, table, column, where, value, problems):
    held = dict(zip(("records", "passages", "fragments"), conversion(spark), strict=True))
    held[table] = held[table].withColumn(column, F.expr(f"if({where}{' and paper_id = \'A\'' if table == 'passages' else ''}, {value}, {column})"))
    found = records.record_violations(*held.values(), 100).collect()
    assert {r.problem for r in found} == problems and {r.paper_id for r in found} == {"A"}
    good = records.valid_records(held["records"], records.record_violations(*held.values(), 100))
    assert [r.paper_id for r in good.collect()] == ["B"]  # one damaged record hides no other


def test_texts_are_shuffled_once(spark):
    """Of all texts only the passages' go through an exchange, to meet their fragments; the fragments' and records' stay where they are read."""
    held = [rows.checkpoint() for rows in conversion(spark)]
    plan = records.record_violations(*held, 100)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    below = re.findall(r"Exchange hashpartitioning\(.*\n[ +:-]*(?:\* ?(?:\(\d+\) )?)?Project \[(.*)\]", plan)
    below = [[c.split(" AS ")[-1].split("#")[0] for c in re.split(r", (?![^(]*\))", p)] for p in below]
    assert below and sum("text" in columns for columns in below) == 1 and not any("markdown" in columns for columns in below)


def test_texts_meet_in_the_pieces_asked_for(spark):
    """Passages and fragments are dealt out by their id to that many pieces, not to Spark's number of shuffle partitions, with the same findings."""
    known, held, parts = [rows.checkpoint() for rows in conversion(spark)]
    torn = parts.withColumns({"text": F.when(F.col("page") == 3, F.upper("text")).otherwise(F.col("text")), "end": F.when(F.col("page") == 2, F.col("end") + 1).otherwise(F.col("end"))})
    found = records.record_violations(known, held, torn, 100, pieces=7)
    dealt = re.findall(r"Exchange hashpartitioning\(passage_id#\d+, (\d+)\)", found._jdf.queryExecution().toString().split("== Physical Plan ==")[1])
    assert dealt and set(dealt) == {"7"}
    assert set(found.collect()) == set(records.record_violations(known, held, torn, 100).collect()) == {("A", "fragment_text"), ("A", "fragment_length")}


def test_pieces_grow_with_the_table(spark, data, tmp_path, monkeypatch):
    """A table of one file is dealt out to more pieces the larger it is, and the passages of its records meet in as many."""
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/ids.parquet")
    rows = session.table(spark, str(tmp_path), "ids")
    assert session.spread(rows, "id").rdd.getNumPartitions() == session.pieces(rows) == 4
    wanted, seen, real = session.pieces(session.table(spark, data, "documents")), [], records.record_violations
    monkeypatch.setattr(records, "record_violations", lambda *a: seen.append(a[-1]) or real(*a))
    before = set(catalogue.valid_records(spark, data).collect())
    monkeypatch.setattr(session, "PIECE", 9_000)
    assert session.spread(rows, "id").rdd.getNumPartitions() == session.pieces(rows) >= 8
    assert set(catalogue.valid_records(spark, data).collect()) == before
    assert seen == [wanted, session.pieces(session.table(spark, data, "documents"))] and seen[1] > seen[0]


def test_a_reader_asks_for_ids_alone(spark):
    """Whether there are valid records is told without their texts."""
    known, held, parts = conversion(spark)
    broken = records.record_violations(known, held, parts.withColumn("text", F.upper("text")), 100).filter("paper_id = 'A'")
    unread = known.withColumn("markdown", F.raise_error(F.lit("a text was read")).cast("string"))
    assert [r.paper_id for r in records.valid_records(unread, broken).select("paper_id").collect()] == ["B"]


def test_passages_that_share_an_id_and_repeated_records(spark):
    known, held, parts = conversion(spark)
    copied = held.filter("paper_id = 'A' and ordinal = 0").withColumn("text", F.upper("text"))
    found = {(r.paper_id, r.problem) for r in records.record_violations(known, held.union(copied), parts, 100).collect()}
    assert found == {("A", p) for p in ("duplicate_passage", "wrong_id", "fragment_text", "ordinal_gap", "source_overlap")}


def test_only_damaged_records_are_an_error(spark):
    known, held, parts = conversion(spark)
    broken = records.record_violations(known, held.limit(0), parts, 100)
    assert {(r.paper_id, r.problem) for r in broken.collect()} == {("A", "no_passages"), ("B", "no_passages")}
    with pytest.raises(records.NoValidRecordError):
        records.valid_records(known, broken)
    assert records.valid_records(known.limit(0), broken).count() == 0


def test_records_are_assembled_in_order(spark):
    known, held, parts = conversion(spark)
    rows = {r.paper_id: r for r in records.assembled(known, held, parts, PRINT).collect()}
    assert [p.kind for p in rows["A"].passages] == ["abstract", "introduction"] and [f.page for f in rows["A"].passages[1].fragments] == [2, 3]
    assert records.assembled(known, held, parts, "other settings").count() == 0
    assert [r.paper_id for r in records.by_checksum(known, "CA").collect()] == ["A"]


def test_records_are_assembled_in_the_pieces_asked_for(spark):
    known, held, parts = [rows.checkpoint() for rows in conversion(spark)]
    whole = records.assembled(known, held, parts, PRINT, 7)
    dealt = re.findall(r"Exchange hashpartitioning\((?:passage|paper)_id#\d+, (\d+)\)", whole._jdf.queryExecution().toString().split("== Physical Plan ==")[1])
    assert len(dealt) >= 3 and set(dealt) == {"7"}
    assert sorted(whole.collect()) == sorted(records.assembled(known, held, parts, PRINT).collect())


def detected(spark, rows):
    """(kinds with page, start, end), candidates (kind, page), warnings (code, pages)."""
    made = [(k, [{"kind": kind, "spans": [{"page": p, "start": a, "end": b}]} for kind, p, a, b in s], [{"kind": kind, "page": p, "start": n} for n, (kind, p) in enumerate(c)], [{"code": code, "pages": list(pages)} for code, pages in w]) for k, (s, c, w) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id int, sections array<struct<kind:string,spans:array<struct<page:int,start:int,end:int>>>>, candidates array<struct<kind:string,page:int,start:int>>, warnings array<struct<code:string,pages:array<int>>>")


def test_section_contradictions(spark):
    a, i = ("abstract", 1, 0, 50), ("introduction", 1, 60, 90)
    none = [("missing_abstract", []), ("missing_introduction", [])]
    cases = [
        ([a, i], [], []), ([], [], none), ([a], [], []), ([a, i], [], [("missing_abstract", [])]), ([i, a], [], []), ([a, a, i], [], []),
        ([], [], none[::-1]), ([a, i], [], [("no_pages", [])]), ([i], [("abstract", 1)], [("empty_abstract_body", [1])]), ([i], [("abstract", 1)], [("empty_abstract_body", [2])]),
        ([i], [("abstract", 1), ("abstract", 2)], [("ambiguous_abstract_candidates", [1, 2])]), ([i], [("abstract", 1)], [("ambiguous_abstract_candidates", [1])]),
        ([i], [("abstract", 1), ("abstract", 3)], [("ambiguous_abstract_candidates", [1])]), ([i], [("abstract", 1)], [("unresolved_abstract_boundary", [1]), ("missing_abstract", [])]),
    ]
    found: dict[int, set] = {}
    for r in records.section_violations(detected(spark, cases), sections.WARNINGS).collect():
        found.setdefault(r.doc_id, set()).add(r.problem)
    want = [
        set(), set(), {"introduction_not_accounted_for"}, {"missing_abstract_with_abstract"}, {"section_overlap"}, {"repeated_section", "section_overlap"},
        {"warning_order"}, {"sections_without_pages"}, set(), {"empty_abstract_body_ungrounded"},
        set(), {"ambiguous_abstract_candidates_ungrounded"}, {"ambiguous_abstract_candidates_ungrounded"}, {"unresolved_abstract_boundary_with_missing_abstract"},
    ]
    assert [found.get(k, set()) - {"warning_order"} if k == 13 else found.get(k, set()) for k in range(len(cases))] == want


def test_detected_sections_do_not_contradict_themselves(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.lit(1).alias("page_number"), "text")
    titled = docs.withColumn("text", F.concat(F.when(F.col("doc_id") % 2 == 0, "Abstract\n\n").otherwise(""), "text", F.lit("\n\n1. Introduction\n\n"), "text"))
    assert records.section_violations(sections.detect_sections(titled), sections.WARNINGS).count() == 0


def test_citations_against_the_library(spark):
    papers = spark.createDataFrame([("A", "Ta")], "paper_id string, title string")
    held = spark.createDataFrame([("a1", "A", "text")], "passage_id string, paper_id string, text string")
    cited = spark.createDataFrame([(1, "e1", "A", "a1", "text"), (1, "e2", "A", "a1", "other"), (1, "e3", "A", "zz", "text"), (1, "e4", "Z", "a1", "text")], "request_id int, citation_id string, paper_id string, passage_id string, text string")
    found = records.resolved_citations(cited, papers, held)
    assert {r.citation_id: (r.title, r.problem) for r in found.collect()} == {"e1": ("Ta", None), "e2": ("Ta", "changed"), "e3": ("Ta", "unknown_passage"), "e4": (None, "unknown_paper")}


def benchmark_file(**changes):
    query = {"query_id": "q", "question_type": "topic", "query": "why", "relevant_passage_ids": ["x"], "rationale": "r"}
    return {"schema_version": 1, "benchmark_id": "b", "corpus_id": "c", "corpus_fingerprint": "sha256:" + "0" * 64, "license": "l", "source": "s", "k_values": [1, 3], "thresholds": [{"metric": "recall", "k": 3, "minimum": 0.5}], "queries": [query]} | changes


def write(folder, **files):
    folder.mkdir()
    for name, value in files.items():
        (folder / f"{name}.json").write_bytes(value if isinstance(value, bytes) else json.dumps(value).encode())
    return str(folder)


def test_retrieval_benchmarks_are_validated(spark, tmp_path):
    path = write(tmp_path / "b", good=benchmark_file(), ks=benchmark_file(benchmark_id="k", k_values=[3, 1]), print=benchmark_file(benchmark_id="f", corpus_fingerprint="md5"), list=[1], text=b"{", latin=b'{"license": "\xe9"}', newer=benchmark_file(schema_version=2))
    queries, judgments, thresholds, problems = corpora.read_retrieval_benchmarks(spark, path)
    assert queries.count() == judgments.count() == thresholds.count() == 1
    assert {(r.file.rsplit("/", 1)[1], r.problem) for r in problems.collect()} == {("ks.json", "k_not_increasing"), ("print.json", "corpus_fingerprint"), ("list.json", "invalid_json"), ("text.json", "invalid_json"), ("latin.json", "encoding"), ("newer.json", "schema_version")}
    with pytest.raises(FileNotFoundError):
        corpora.read_retrieval_benchmarks(spark, str(tmp_path / "nowhere"))


def test_corpora_are_validated(spark, tmp_path):
    paper = {"paper_id": "p", "title": "t", "authors": [], "source_name": "s", "source_identifier": "i"}
    passage = {"passage_id": "x", "paper_id": "p", "text": "t", "ordinal_position": 0}
    corpus = lambda **c: {"schema_version": 1, "corpus_id": "c", "papers": [paper], "passages": [passage]} | c
    other = lambda **c: corpus(passages=[passage, passage | {"passage_id": "y", "ordinal_position": 1} | c])
    path = write(
        tmp_path / "c", good=other(), empty=corpus(passages=[]), twice=corpus(papers=[paper, paper]), id=corpus(corpus_id="C C"), orphan=other(paper_id="z"), ordinal=other(ordinal_position=0), same=other(passage_id="x"), blank=other(text=" "),
    )
    papers, held, problems = corpora.read_corpora(spark, path)
    assert (papers.count(), held.count()) == (1, 2)
    assert {r.file.rsplit("/", 1)[1][:-5]: r.problem for r in problems.collect()} == {"empty": "no_passages", "twice": "duplicate_paper", "id": "corpus_id", "orphan": "unknown_paper", "ordinal": "duplicate_ordinal", "same": "duplicate_passage", "blank": "blank_text"}


def test_generation_benchmarks_and_manifests(spark, tmp_path):
    cases = [{"case_id": c.replace("_", "-"), "category": c, "question": "why é?", "evidence": [], "semantic_expectations": [], "prohibited_claims": [], "critical_vetoes": []} for c in benchmarks.CATEGORIES]
    content = {"schema_version": 1, "benchmark_id": "g", "license": "l", "source": "s", "substantive_claim_unit": "u", "cases": cases}
    digest = lambda c: "sha256:" + hashlib.sha256(json.dumps(c, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    few = content | {"benchmark_id": "few", "cases": cases[1:]}
    path = write(tmp_path / "g", good=content | {"fingerprint": digest(content)}, changed=content | {"benchmark_id": "h", "fingerprint": digest(content)}, few=few | {"fingerprint": digest(few)})
    held, problems = corpora.read_generation_benchmarks(spark, path)
    assert held.count() == 12
    assert {(r.file.rsplit("/", 1)[1], r.problem) for r in problems.collect()} == {("changed.json", "fingerprint_mismatch"), ("few.json", "missing_category")}

    manifest = {"schema_version": 1, "artifact_id": "m", "kind": "model", "version": "1", "source": "s", "license": "l", "redistribution_status": "r", "expected_size_bytes": 3, "sha256": "0" * 64, "update_policy": "u", "contains_copyrighted_full_text": False, "local_path": "models/m"}
    path = write(tmp_path / "m", good=manifest, up=manifest | {"local_path": "a/../b"}, root=manifest | {"local_path": "/a"}, size=manifest | {"expected_size_bytes": 0}, sha=manifest | {"sha256": "A" * 64})
    found, problems = corpora.read_manifests(spark, path)
    assert found.count() == 1
    assert {r.file.rsplit("/", 1)[1][:-5]: r.problem for r in problems.collect()} == {"up": "local_path", "root": "local_path", "size": "expected_size_bytes", "sha": "sha256"}


def test_strict_tokens_in_retrieval(spark):
    """Composed, decomposed and compatibility forms, and full case folding, match each other."""
    held = spark.createDataFrame([("a", "INFRÀSTRUCTURE"), ("b", "ﬁnance"), ("c", "İzmir"), ("d", "other")], "passage_id string, text string")
    asked = spark.createDataFrame([(1, "infràstructure"), (2, "FINANCE"), (3, "i̇zmir")], "query_id int, query string")
    found = bm25.retrieve(held, asked, 3, tokenizer=T.strict_tokens).collect()
    assert {(r.query_id, r.passage_id) for r in found} == {(1, "a"), (2, "b"), (3, "c")}
    both = bm25.scores(held, asked, tokenizer=T.strict_tokens).collect()
    assert {(r.query_id, r.passage_id, r.score) for r in both} == {(r.query_id, r.passage_id, r.score) for r in found}
    flagged = spark.createDataFrame([("ｔｈｅｙ said",)], "q string").select(conversation.refers_back(F.col("q")).alias("plain"), conversation.refers_back(F.col("q"), T.folded).alias("folded")).head()
    assert (flagged.plain, flagged.folded) == (False, True)


def test_follow_ups_are_rewritten_or_left(spark):
    turns = spark.createDataFrame([(1, 1, "roads", "yes"), (1, 2, " what about it", "ok"), (1, 3, "why that", None)], "conv_id long, turn long, question string, answer string")
    known = conversation.needs_context(turns)
    said = lambda resolver: [r.resolved_question for r in conversation.resolve_follow_ups(known, resolver).orderBy("turn").collect()]
    assert said(conversation.joining_resolver) == ["roads", "roads what about it", "what about it why that"]
    assert said(lambda q, e: 1 / 0) == said(lambda q, e: " ") == said(lambda q, e: None) == ["roads", "what about it", "why that"]


def test_a_session_keeps_answered_turns_only(spark):
    held = spark.createDataFrame([("A", "a1", "Roads lower costs. More."), ("B", "b1", "Schools raise wages. More.")], "paper_id string, passage_id string, text string")
    session = generate.ChatSession(held, resolver=conversation.joining_resolver, k=1)
    first = session.ask("Do roads lower costs?")
    assert (first.outcome, first.resolved_question, session.citations) == ("answered", None, ["e1"])
    piece = session.show("e1")
    assert (piece.paper_id, piece.passage_id, piece["rank"], piece.text) == ("A", "a1", 1, "Roads lower costs. More.") and session.show("e2") is None
    said = []
    cli.shell(session, ["/show e1", "/show e9"], said.append)
    assert said[0].startswith("A  rank 1  score ") and said[0].endswith("Roads lower costs. More.") and said[1] == "not cited"
    assert session.ask("zebra").outcome == "no_matches" and session.citations == [] and session.show("e1") is None and len(session.history) == 1
    second = session.ask("what about those")
    assert (second.outcome, second.question, second.resolved_question) == ("answered", "what about those", "Do roads lower costs? what about those")
    assert len(session.history) == 2
    session.reset()
    assert session.ask("what about those").outcome == "no_matches" and not session.history


def test_shell_commands():
    class Session:
        def __init__(self):
            self.citations, self.asked = [], []

        def reset(self):
            self.citations = []

        def ask(self, question):
            self.asked.append(question)
            if question == "boom":
                raise ValueError("no model")
            self.citations = ["e1"]
            return {"outcome": "answered", "answer_text": "Yes.", "exit_code": 0, "resolved_question": "roads it" if question == "it" else None}

    said, session = [], Session()
    assert cli.shell(session, ["/show", " ", "roads", "/show", "it", "boom", "/what", "/reset", "/show", "/quit", "never"], said.append) == 0
    assert session.asked == ["roads", "it", "boom"]
    assert [said[k] for k in (0, 2, 4, 5, 6, 7)] == ["nothing to show", "e1", "failed: no model", "known: /show, /show ID, /reset, /quit", "forgotten", "nothing to show"]
    assert "Yes." in said[1] and said[3].startswith("(asked: roads it)")


def test_measurement_takes_its_clock(spark):
    ticks = iter(range(1000))
    held = {"x": spark.createDataFrame([(1,)], "a int")}
    out = evaluate.resource_measurement(lambda: held.get, ["x"], 2, 1, 3, lambda: next(ticks))
    assert out == {"initialisation_seconds": [1, 1], "query_seconds": [1, 1, 1], "questions": 1, "passes": 3}
    with pytest.raises(ValueError, match="passes"):
        evaluate.resource_measurement(lambda: held.get, ["x"], 1, 0, True)


def test_names_and_error_lines(spark):
    name = generate.generation_method("r", "m", "0" * 64, "v2", {"seed": 1})
    assert name.startswith("r:m@sha256-" + "0" * 64 + ":prompt-v2:config-sha256-") and name != generate.generation_method("r", "m", "0" * 64, "v2", {"seed": 2})
    rows = spark.createDataFrame([("fine\n0.1 E main: too long (9 tokens)\n secret text\n",), ("E x: \nE  srv:  one\r\nE y: " + "z" * 300,), ("nothing",), (None,)], "o string")
    assert [r.e for r in rows.select(T.error_line(F.col("o")).alias("e")).collect()] == ["too long (9 tokens)", "z" * 200, "", ""]
    ids = spark.createDataFrame([("a.b-c_d1",), ("A",), ("a..b",), ("a\n",), (None,), ("a:b",)], "i string").select(T.is_id(F.col("i"), T.PAPER_ID).alias("p"), T.is_id(F.col("i"), T.PASSAGE_ID).alias("q")).collect()
    assert [r.p for r in ids] == [True, False, False, False, False, False] and [r.q for r in ids] == [True, False, False, False, False, True]


def test_papers_are_saved_whole_or_not_at_all(spark, tmp_path):
    store = Library(spark, f"file://{tmp_path}/library")
    store.initialise()
    papers = lambda *rows: spark.createDataFrame(rows, "paper_id string, checksum string, source_path string, created_at int")
    parts = lambda *rows: spark.createDataFrame(rows, "paper_id string, ordinal int")
    store.save_papers(papers(("A", "AA", "p", 1), ("B", "bb", "p", 1)), {"passages": parts(("A", 0), ("A", 1), ("B", 0))})
    at = store.save_papers(papers(("A", "Aa", "q", 2)), {"passages": parts(("A", 0))}, keep=["created_at"])
    row = store.paper("A").head()
    assert (row.checksum, row.source_path, row.created_at) == ("aa", "q", 1) and store.passages("A").count() == 1 and store.passages("B").count() == 1
    assert store.paper_by_checksum("BB").head().paper_id == "B" and [r.paper_id for r in store.paper_ids().collect()] == ["A", "B"]
    for bad in (papers(("C", "BB", "p", 1)), papers(("C", "x", "p", 1), ("D", "X", "p", 1))):
        with pytest.raises(ChecksumConflictError):
            store.save_papers(bad, {"passages": parts(("C", 0))})
    assert store.versions()[-1] == at
    store.delete_papers(papers(("A", "aa", "", 0)))
    assert store.table("papers").count() == store.table("passages").count() == 1


def test_old_libraries_are_taken_over_or_refused(spark, tmp_path):
    def old(name, rows, schema):
        store = Library(spark, f"file://{tmp_path}/{name}")
        store.commit({"papers": spark.createDataFrame(rows, schema)}, schema=1)
        return store

    good = old("good", [("A", "AA", "p"), ("B", "bB", "p")], "paper_id string, checksum string, source_path string")
    good.initialise()
    assert sorted(r.checksum for r in good.table("papers").collect()) == ["aa", "bb"]
    for name, rows, schema in (("twice", [("A", "AA", "p"), ("B", "aa", "p")], "paper_id string, checksum string, source_path string"), ("bare", [("A", "AA")], "paper_id string, checksum string")):
        store = old(name, rows, schema)
        with pytest.raises(MigrationError):
            store.initialise()
        assert store.manifest()["schema_version"] == 1


def test_analyses_are_stored_and_found(spark, tmp_path):
    store = Library(spark, f"file://{tmp_path}/library")
    store.initialise()
    rows = lambda *r: spark.createDataFrame(r, "analysis_id string, checksum string, status string, updated_at int")
    store.save_analyses(rows(("a", "C1", "completed", 1), ("b", "c1", "halted", 1), ("c", "d", "failed", 1)))
    store.save_analyses(rows(("a", "C1", "completed", 9), ("b", "c1", "completed", 9)))
    assert [(r.analysis_id, r.updated_at) for r in store.analyses("c1").collect()] == [("b", 9), ("a", 1)]
    store.delete_analyses(rows(("b", "", "", 0)))
    assert [r.analysis_id for r in store.analyses().collect()] == ["c", "a"] and store.analysis("a").count() == 1


def test_conversions_are_run_anew(spark):
    spans = [{"page": 1, "start": 0, "end": 12}]
    found = spark.createDataFrame([("p", [{"kind": "abstract", "text": "Some words. ", "spans": spans}])], "doc_id string, sections array<struct<kind:string,text:string,spans:array<struct<page:int,start:int,end:int>>>>")
    stored = passages.convert_sections(found, 100)
    assert records.reconversion_differences(stored, found, 100).count() == 0
    assert {r.side for r in records.reconversion_differences(stored.withColumn("text", F.upper("text")), found, 100).collect()} == {"left", "right"}


def packed(kind, entries):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as archive:
            for name, content in entries:
                info = zipfile.ZipInfo(name)
                if content is None:
                    info.external_attr = (stat.S_IFLNK | 0o777) << 16
                archive.writestr(info, content or b"")
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as archive:
            for name, content in entries:
                info = tarfile.TarInfo(name)
                if isinstance(content, bytes):
                    info.size = len(content)
                    archive.addfile(info, io.BytesIO(content))
                else:
                    info.type, info.linkname = (tarfile.FIFOTYPE, "") if content is None else (tarfile.DIRTYPE, "") if content == "/" else (tarfile.SYMTYPE, content)
                    archive.addfile(info)
    return out.getvalue()


def test_archives_are_read_only_if_safe(spark):
    cases = {
        "good.zip": packed("zip", [("a/b.txt", b"x"), ("c", b"yy")]), "up.zip": packed("zip", [("a", b"x"), ("../b", b"y")]), "root.zip": packed("zip", [("/b", b"y")]), "drive.zip": packed("zip", [("C:b", b"y")]),
        "case.zip": packed("zip", [("a/B", b"x"), ("A\\b", b"y")]), "dot.zip": packed("zip", [("a.", b"y")]), "con.zip": packed("zip", [("x/Con.txt", b"y")]), "link.zip": packed("zip", [("a", None)]), "below.zip": packed("zip", [("a", b"x"), ("a/b", b"y")]),
        "good.tgz": packed("tar", [("./", "/"), ("d", "/"), ("d/a", b"x"), ("d/l", "a"), ("l2", "d/l")]), "loop.tgz": packed("tar", [("a", "b"), ("b", "a")]), "out.tgz": packed("tar", [("a", "../x")]), "pipe.tgz": packed("tar", [("a", None)]), "bad.tgz": b"\x1f\x8bno", "none": None,
    }
    found: dict[str, list] = {}
    for r in archives.members_of(spark.createDataFrame(list(cases.items()), "path string, content binary")).collect():
        found.setdefault(r.archive, []).append((r.member, bytes(r.content), r.size) if r.problem is None else r.problem.split(":")[0])
    assert found == {
        "good.zip": [("a/b.txt", b"x", 1), ("c", b"yy", 2)], "up.zip": ["traversal"], "root.zip": ["absolute"], "drive.zip": ["absolute"], "case.zip": ["duplicate"], "dot.zip": ["name"], "con.zip": ["name"], "link.zip": ["link"], "below.zip": ["below a file"],
        "good.tgz": [("d/a", b"x", 1), ("d/l", b"x", 1), ("l2", b"x", 1)], "loop.tgz": ["link loop"], "out.tgz": ["link to nothing inside"], "pipe.tgz": ["special"], "bad.tgz": ["damaged"], "none": ["damaged"],
    }


def test_pdf_errors_are_typed(spark):
    def extractor(content):
        raise {b"e": pdf.EncryptedError, b"m": pdf.MalformedError}.get(content, KeyError)("why")

    rows = pdf.pages_of(spark.createDataFrame([("a", b"e"), ("b", b"m"), ("c", b"x")], "path string, content binary"), extractor).collect()
    assert [(r.path, r.error_kind, r.page_number) for r in rows] == [("a", "encrypted", None), ("b", "malformed", None), ("c", "parser", None)]
