"""Generation around an injected model: prompts, strict answers, research questions, cited chat."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.operators import bm25, contracts, conversation, grounding
from quirelake.operators.ranking import running_total
from quirelake.shipping import shipped

#: prompts -> answers; an exception fails its prompt only
Generator = Callable[[str], str]

ANSWER = "request_id string, answer_text string, abstained boolean, abstention_reason string, citations array<struct<citation_id:string,paper_id:string,passage_id:string>>, claims array<struct<text:string,citation_ids:array<string>>>, error string"


def strict_object(text: str) -> dict:
    """The one JSON object that a text consists of, a code fence around it aside; anything else is an error."""
    body = text.strip()
    if body.startswith("```"):
        body = body.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    value, end = json.JSONDecoder().raw_decode(body)
    if body[end:].strip():
        raise ValueError("text behind the object")
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def exact_keys(value: dict, required: set[str]) -> dict:
    if value.keys() != required:
        raise ValueError(f"keys missing: {sorted(required - value.keys())}, unknown: {sorted(value.keys() - required)}")
    return value


def prompts(evidence: DataFrame, questions: DataFrame, template: str = "{payload}") -> DataFrame:
    """(request_id, prompt): the question and its ranked evidence as JSON with sorted keys, in a template."""
    item = F.struct(F.concat(F.lit("e"), F.col("rank").cast("string")).alias("citation_id"), F.col("paper_id").cast("string").alias("paper_id"), F.col("passage_id").cast("string").alias("passage_id"), "text")
    listed = evidence.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("l"))
    joined = questions.join(listed, "request_id", "left").withColumn("items", F.transform("l", lambda x: x["item"]))
    payload = F.to_json(F.struct(F.coalesce("items", F.array().cast("array<struct<citation_id:string,paper_id:string,passage_id:string,text:string>>")).alias("evidence"), "question"))
    return joined.select("request_id", F.replace(F.lit(template), F.lit("{payload}"), payload).alias("prompt"))


def quoting_generator(prompt: str) -> str:
    """A deterministic stand-in for a model: quotes the first sentence of every piece of evidence, abstains without any."""
    payload = json.loads(prompt)
    if not payload["evidence"]:
        return json.dumps({"answer_text": "No evidence.", "abstained": True, "abstention_reason": "no evidence", "citations": [], "claims": []})
    claims = [{"text": e["text"].split(".")[0].strip() or e["text"][:80], "citation_ids": [e["citation_id"]]} for e in payload["evidence"]]
    citations = [{k: e[k] for k in ("citation_id", "paper_id", "passage_id")} for e in payload["evidence"]]
    return json.dumps({"answer_text": " ".join(c["text"] for c in claims), "abstained": False, "abstention_reason": None, "citations": citations, "claims": claims})


_KEYS = {"answer_text", "abstained", "abstention_reason", "citations", "claims"}


def generate(asked: DataFrame, generator: Generator) -> DataFrame:
    """Answers to (request_id, prompt), parsed strictly; a failure gives a row with its error."""
    names = [c.split()[0] for c in ANSWER.split(", ")]
    kinds = [
        pa.string(),
        pa.string(),
        pa.bool_(),
        pa.string(),
        pa.list_(pa.struct([(c, pa.string()) for c in ("citation_id", "paper_id", "passage_id")])),
        pa.list_(pa.struct([("text", pa.string()), ("citation_ids", pa.list_(pa.string()))])),
        pa.string(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, prompt in zip(batch.column("request_id").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                try:
                    said = exact_keys(strict_object(generator(prompt)), _KEYS)
                    rows.append({"request_id": key, **said, "error": None})
                except Exception as problem:  # one request never ends the batch
                    rows.append({"request_id": key, "error": f"{type(problem).__name__}: {problem}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return shipped(asked).select(F.col("request_id").cast("string").alias("request_id"), "prompt").mapInArrow(run, ANSWER)


def evidence_for(passages: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(request_id, rank, score, paper_id, passage_id, text): the best k passages of every question."""
    asked = questions.select(F.col("request_id").cast("string").alias("request_id"), "question")
    found = bm25.retrieve(passages, asked, k, question_key="request_id", question="question").withColumnRenamed("query_id", "request_id")
    held = passages.select("passage_id", "paper_id", "text")
    return found.join(held, "passage_id").select("request_id", "rank", "score", F.col("paper_id").cast("string").alias("paper_id"), F.col("passage_id").cast("string").alias("passage_id"), "text")


def cited_chat(passages: DataFrame, questions: DataFrame, generator: Generator = quoting_generator, k: int = 3, evidence: DataFrame | None = None) -> DataFrame:
    """One row a question: outcome, exit code and the answer made of grounded claims.

    passages (paper_id, passage_id, text); questions (request_id, question);
    evidence, if it has been found already, as by ``evidence_for``.
    The ladder: empty library, no matches, error or broken contract, abstained,
    withheld (no claim grounded), answered.
    """
    asked = questions.select(F.col("request_id").cast("string").alias("request_id"), "question")
    # read by prompts, contracts and grounding: ranked once
    evidence = (durable(evidence_for(passages, questions, k)) if evidence is None else evidence).drop("score")
    matches = evidence.groupBy("request_id").agg(F.count(F.lit(1)).alias("matches"))
    answers = durable(generate(prompts(evidence, asked.join(matches, "request_id", "left_semi")), generator))
    citations = answers.filter("error is null").select("request_id", F.posexplode("citations").alias("position", "c")).select("request_id", "position", "c.*")
    claims = answers.filter("error is null").select("request_id", F.posexplode("claims").alias("claim_index", "c")).select("request_id", "claim_index", "c.*")
    broken = contracts.response_violations(answers.filter("error is null"), citations, claims, evidence).groupBy("request_id").agg(F.array_sort(F.collect_set("problem")).alias("violations"))
    named = evidence.select("request_id", F.concat(F.lit("e"), F.col("rank").cast("string")).alias("citation_id"), "paper_id", "text")
    judged = grounding.verdicts(claims, grounding.leaked_terms(claims, named, asked))
    answer, kept = grounding.surviving(claims, citations, judged)
    totals = judged.groupBy("request_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("grounded").alias("grounded_claims"))
    used = kept.groupBy("request_id").agg(F.array_sort(F.collect_set("citation_id")).alias("citation_ids"))
    size = passages.agg(F.count(F.lit(1)).alias("library_size"))
    all_ = asked.crossJoin(F.broadcast(size)).join(matches, "request_id", "left").join(answers.select("request_id", "abstained", "error"), "request_id", "left").join(broken, "request_id", "left")
    all_ = all_.join(totals, "request_id", "left").join(answer, "request_id", "left").join(used, "request_id", "left").fillna(0, ["matches", "claims", "grounded_claims"]).withColumn("abstained", F.coalesce("abstained", F.lit(False)))
    judged_all = grounding.chat_outcome(all_)
    bad = F.col("error").isNotNull() | F.col("violations").isNotNull()
    return judged_all.withColumns({"exit_code": F.when(bad, 3).otherwise(F.col("exit_code")), "outcome": F.when(bad, "error").otherwise(F.col("outcome"))}).select("request_id", "question", "outcome", "exit_code", "answer_text", "citation_ids", "violations", "error")


def research_question(sections: DataFrame, generator: Generator) -> DataFrame:
    """(paper_id, question, kind, sections_used, evidence, warnings) from (paper_id, kind, text, page, start, end).

    ``start`` and ``end`` are those of a section's first span. The answer is a
    JSON object with question and sections, or abstained. Blank, overlong
    (1,000 characters) and unreadable answers are malformed, uncited or unknown
    sections ungrounded.
    """
    rank = F.when(F.col("kind") == "abstract", 0).otherwise(1)
    usable = sections.filter(F.trim("text") != "")
    held = usable.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "kind", "text", "page", "start", "end"))).alias("s"))
    everyone = sections.select("paper_id").distinct().join(held, "paper_id", "left")
    asked = everyone.filter("s is not null").select(F.col("paper_id").cast("string").alias("request_id"), F.to_json(F.struct(F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))).alias("sections"))).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, prompt in zip(batch.column("request_id").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                known = {s["kind"] for s in json.loads(prompt)["sections"]}
                question, used, problem = None, [], None
                try:
                    said = generator(prompt)
                except Exception:
                    problem = "generation_failed"
                else:
                    try:
                        value = strict_object(said)
                        if value.get("abstained"):
                            problem = "model_abstained"
                        else:
                            exact_keys(value, {"question", "sections"})
                            question, used = value["question"].strip(), list(value["sections"])
                            if not question or len(question) > 1000:
                                raise ValueError("length")
                            if not used or not set(used) <= known:
                                question, used, problem = None, [], "ungrounded_output"
                    except (ValueError, AttributeError, TypeError):
                        question, used, problem = None, [], "malformed_output"
                rows.append((key, question, used, problem))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.string())], ["request_id", "question", "used", "problem"])

    said = shipped(asked).mapInArrow(run, "request_id string, question string, used array<string>, problem string")
    joined = everyone.join(said, F.col("paper_id").cast("string") == F.col("request_id"), "left")
    cited = F.filter("s", lambda x: F.array_contains("used", x["kind"]))
    none = F.array().cast("array<string>")
    warnings = F.array_compact(F.array(F.when(F.col("s").isNull(), "no_usable_sections"), F.when(F.size("s") == 1, "missing_section"), F.col("problem")))
    kind = F.when(F.col("question").isNull(), "unavailable").when(F.exists(cited, lambda x: F.contains(x["text"], F.lit("?"))), "explicit").otherwise("inferred")
    evidence = F.transform(cited, lambda x: F.struct(x["kind"].alias("kind"), x["page"].alias("page"), x["start"].alias("start"), x["end"].alias("end"), F.substring(x["text"], F.lit(1), x["end"] - x["start"]).alias("text")))
    return joined.select("paper_id", "question", kind.alias("kind"), F.coalesce("used", none).alias("sections_used"), evidence.alias("evidence"), warnings.alias("warnings"))


def generation_method(runtime_id: str, model_id: str, model_sha256: str, prompt_version: str, settings: dict) -> str:
    """A name for exactly this way to generate, free of paths: equal settings give equal names."""
    known = {**settings, "model_sha256": model_sha256, "prompt_version": prompt_version}
    digest = hashlib.sha256(json.dumps(known, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return f"{runtime_id}:{model_id}@sha256-{model_sha256}:prompt-{prompt_version}:config-sha256-{digest}"


class ChatSession:
    """Questions one after another over one snapshot of a library.

    Passages are stored once, when the session opens. Only answered turns enter
    the history, of which the last ``max_turns`` stay; citations are those of
    the latest turn, and only if it was answered.
    """

    def __init__(self, passages: DataFrame, generator: Generator = quoting_generator, resolver: conversation.Resolver | None = None, k: int = 3, max_turns: int = conversation.MAX_TURNS) -> None:
        self.passages = durable(passages.select("paper_id", "passage_id", "text"))
        self.shown: dict[str, Row] = {}
        self.generator, self.resolver, self.k, self.max_turns = generator, resolver, k, max_turns
        self.history: list[Row] = []
        self.citations: list[str] = []

    def reset(self) -> None:
        self.history, self.citations, self.shown = [], [], {}

    def show(self, citation_id: str) -> Row | None:
        """The piece of evidence that the latest answer cites under this id (like e1): rank, score, paper, passage and text."""
        return self.shown.get(citation_id)

    def ask(self, question: str) -> Row:
        """The outcome of one question, with resolved_question: what was asked in its place, or null."""
        spark = self.passages.sparkSession
        literal, rewritten = question.strip(), None
        if self.resolver and self.history:
            leans = spark.range(1).select(conversation.refers_back(F.lit(literal)).alias("leans")).head()["leans"]
            said = conversation.resolved(literal, [turn["resolved_question"] or turn["question"] for turn in self.history], self.resolver) if leans else literal
            rewritten = said if said != literal else None
        asked = spark.createDataFrame([("q", rewritten or literal)], "request_id string, question string")
        evidence = durable(evidence_for(self.passages, asked, self.k))
        row = cited_chat(self.passages, asked, self.generator, self.k, evidence).withColumn("question", F.lit(literal)).withColumn("resolved_question", F.lit(rewritten).cast("string")).head()
        answered = row["outcome"] == "answered"
        self.citations = list(row["citation_ids"] or []) if answered else []
        named = {f"e{e['rank']}": e for e in evidence.collect()} if self.citations else {}  # k rows
        self.shown = {c: named[c] for c in self.citations}
        if answered:
            self.history = [*self.history, row][-self.max_turns :]
        return row


def deterministic_order(cases: DataFrame, key: str, seed: int) -> DataFrame:
    """Cases numbered in a seeded order for blind review."""
    drawn = cases.withColumn("__draw", F.xxhash64(F.col(key), F.lit(seed)))
    return running_total(drawn, ["__draw", *cases.columns], name="position").drop("__draw")


def run_ledger(schedule: DataFrame, runs: DataFrame) -> DataFrame:
    """(status, runs) of a schedule (case_id, run): succeeded, failed or not_run."""
    joined = schedule.join(runs, ["case_id", "run"], "left").withColumn("status", F.coalesce("status", F.lit("not_run")))
    return joined.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def score_text(score: Column) -> Column:
    """Twelve significant digits, as shown to a reader."""
    return F.format_string("%.12g", score)
