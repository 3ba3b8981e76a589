"""Command line: status, analyze, chat, shell, evaluate. Exit codes: 0 done, 1 nothing to answer or halted, 2 bad input, 3 unexpected."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import functions as F

from quirelake import config
from quirelake.durable import durable
from quirelake.functions.text import page_range
from quirelake.operators import analysis, conversation, evaluate, generate, preflight, report
from quirelake.operators.bm25 import retrieve
from quirelake.session import local_session
from quirelake.sources import corpora, pdf
from quirelake.sources.library import Library, SchemaVersionError


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("quirelake")
    parser.add_argument("--library", help="folder of the library")
    parser.add_argument("--config", default="quirelake.json")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("status")
    commands.add_parser("analyze").add_argument("target")
    chat = commands.add_parser("chat")
    chat.add_argument("question")
    chat.add_argument("--top-k", type=int, default=None)
    shell_ = commands.add_parser("shell")
    shell_.add_argument("--top-k", type=int, default=None)
    commands.add_parser("evaluate").add_argument("folder", help="folder with corpora/ and benchmarks/ of JSON files")
    return parser


def _analyze(spark, library: Library, target: str, generator: generate.Generator) -> int:
    library.initialise()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(target)
    files = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    results = durable(analysis.analyze_into(library, files, pdf.extract_with_pypdf, generator))
    print(report.batch_text(preflight.batch_summary(results).head(), results.orderBy("path").limit(report.LIMIT).collect()))
    return preflight.exit_code(results).head()["exit_code"]


_HELD = "paper_id string, passage_id string, text string, fragments array<struct<page:int,start:int,end:int,passage_start:int,passage_end:int>>"


def _chat(spark, library: Library, question: str, k: int, generator: generate.Generator) -> int:
    held = library.table("passages", _HELD)
    passages = held.select("paper_id", "passage_id", "text")
    asked = spark.createDataFrame([("q", question)], "request_id string, question string")
    evidence = durable(generate.evidence_for(passages, asked, k))
    row = generate.cited_chat(passages, asked, generator, k, evidence).head()
    titles = library.table("papers", "paper_id string, title string").select("paper_id", "title")
    named = F.concat(F.lit("e"), F.col("rank").cast("string"))
    pages = held.select("passage_id", F.transform("fragments", lambda f: f["page"]).alias("pages"))
    cited = evidence.filter(named.isin(list(row["citation_ids"] or []))).join(pages, "passage_id").join(titles, "paper_id")
    seen = F.flatten(F.collect_list("pages"))
    papers = cited.groupBy("paper_id", "title").agg(F.array_sort(F.collect_list("rank")).alias("ranks"), page_range(F.array_min(seen), F.array_max(seen)).alias("pages")).orderBy(F.col("ranks")[0])
    print(report.chat_text(row, papers.collect() if row["outcome"] == "answered" else []))
    return row["exit_code"]


def shell(session: generate.ChatSession, lines: Iterable[str], say: Callable[[str], object] = print) -> int:
    """Asks every line; ``/show`` lists what the last answer cites, ``/show e1`` one piece of it in full, ``/reset`` forgets earlier turns, ``/quit`` ends. A question that fails ends nothing."""
    for line in lines:
        said = line.strip()
        if said == "/quit":
            break
        if said == "/reset":
            session.reset()
            say("forgotten")
        elif said == "/show":
            say(", ".join(session.citations) or "nothing to show")
        elif said.startswith("/show "):
            piece = session.show(said.removeprefix("/show ").strip())
            say(report.wrapped(report.clean(f"{piece['paper_id']}  rank {piece['rank']}  score {piece['score']:.12g}\n\n{piece['text']}")) if piece else "not cited")
        elif said.startswith("/"):
            say("known: /show, /show ID, /reset, /quit")
        elif said:
            try:
                row = session.ask(said)
                say((f"(asked: {row['resolved_question']})\n" if row["resolved_question"] else "") + report.chat_text(row, []))
            except Exception as problem:
                say(f"failed: {problem}")
    return 0


def _shell(spark, library: Library, k: int) -> int:
    passages = library.table("passages", "paper_id string, passage_id string, text string").select("paper_id", "passage_id", "text")
    return shell(generate.ChatSession(passages, resolver=conversation.joining_resolver, k=k), sys.stdin)


def _evaluate(spark, folder: str) -> int:
    _, passages, problems = corpora.read_corpora(spark, f"{folder}/corpora")
    queries, judgments, thresholds, unusable = corpora.read_retrieval_benchmarks(spark, f"{folder}/benchmarks")
    found = retrieve(passages, queries, 5)
    measured = evaluate.metrics(evaluate.query_metrics(found, judgments))
    failures = evaluate.threshold_failures(measured, thresholds)
    print(report.json_report(metrics=measured.collect(), failures=failures.collect(), problems=problems.union(unusable).collect(), digest=evaluate.result_digest(found).head()))
    return 1 if failures.head(1) else 0


def main(arguments: list[str] | None = None) -> int:
    options = _parser().parse_args(arguments)
    try:
        settings = config.resolve({"library": options.library, "top_k": getattr(options, "top_k", None)}, config.load(options.config), {"library": "quirelake-library", "top_k": 5})
        spark = local_session("*", "4g")
        library = Library(spark, settings["library"])
        if options.command == "status":
            print(report.status_text(library.status()))
            return 0
        if options.command == "analyze":
            return _analyze(spark, library, options.target, generate.quoting_generator)
        if options.command == "chat":
            library.initialise(read_only=True)
            return _chat(spark, library, options.question, settings["top_k"], generate.quoting_generator)
        if options.command == "shell":
            library.initialise(read_only=True)
            return _shell(spark, library, settings["top_k"])
        return _evaluate(spark, options.folder)
    except (ValueError, SchemaVersionError, FileNotFoundError) as problem:
        print(problem, file=sys.stderr)
        return 2
    except Exception as problem:
        print(f"unexpected: {problem}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
