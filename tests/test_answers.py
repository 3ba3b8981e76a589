from __future__ import annotations

import json

import pytest

from quirelake.operators import contracts, evaluate, generate, grounding

EVIDENCE = "request_id string, citation_id string, paper_id string, text string"


def leaks(spark, text, cited, question="", evidence=None, most=1):
    rows = evidence or [("q", "e1", "A", "urban transit spending rose"), ("q", "e2", "B", "grocery nutrition improved in 1999"), ("q", "e3", "C", "grocery prices")]
    claims = spark.createDataFrame([("q", 0, text, cited)], "request_id string, claim_index int, text string, citation_ids array<string>")
    asked = spark.createDataFrame([("q", question)], "request_id string, question string")
    found = grounding.leaked_terms(claims, spark.createDataFrame(rows, EVIDENCE), asked, most)
    row = grounding.verdicts(claims, found).head()
    return row.grounded, row.leaked_terms, row.leaked_from_papers


def test_grounding(spark):
    assert leaks(spark, "Transit spending rose", ["e1"]) == (True, [], [])
    assert leaks(spark, "The study finds nutrition in 1999", ["e1"]) == (False, ["nutrition", "1999"], ["B"])
    assert leaks(spark, "Grocery spending", ["e1"]) == (True, [], [])  # in two papers: field vocabulary
    assert leaks(spark, "Grocery spending", ["e1"], most=2) == (False, ["grocery"], ["B", "C"])
    assert leaks(spark, "Nutrition rose", ["e1"], "what of nutrition?")[0]
    assert leaks(spark, "Nutrition rose", ["e1", "e2"])[0]
    assert leaks(spark, "Entirely invented wording", ["e1"])[0]
    with pytest.raises(ValueError):
        leaks(spark, "x", ["e1"], most=0)


def test_papers_support_by_all_their_passages(spark):
    rows = [("q", "e1", "A", "first"), ("q", "e2", "B", "unique"), ("q", "e3", "A", "unique")]
    assert leaks(spark, "unique", ["e1"], evidence=rows)[0]


def test_response_contract(spark):
    evidence = spark.createDataFrame([("q", 1, "A", "p1"), ("q", 2, "B", "p2")], "request_id string, rank int, paper_id string, passage_id string")
    responses = spark.createDataFrame([("q", "text", False, None)], "request_id string, answer_text string, abstained boolean, abstention_reason string")

    def problems(citations, claims, answers=responses):
        c = spark.createDataFrame([("q", k, *x) for k, x in enumerate(citations)], "request_id string, position int, citation_id string, paper_id string, passage_id string")
        m = spark.createDataFrame([("q", k, "t", x) for k, x in enumerate(claims)], "request_id string, claim_index int, text string, citation_ids array<string>")
        return {r.problem for r in contracts.response_violations(answers, c, m, evidence).collect()}

    assert problems([("e1", "A", "p1"), ("e2", "B", "p2")], [["e1"]]) == set()
    assert problems([("e2", "B", "p2"), ("e1", "A", "p1")], []) == {"rank_order"}
    assert problems([("e1", "B", "p1")], []) == {"wrong_paper"}
    assert problems([("e9", "A", "p1")], []) == {"unknown_citation"}
    assert problems([("e1", "A", "p1"), ("e1", "A", "p1")], [["e2"], []]) == {"duplicate_citation", "duplicate_reference", "claim_cites_unknown", "uncited_claim"}
    silent = spark.createDataFrame([("q", "no", True, None)], "request_id string, answer_text string, abstained boolean, abstention_reason string")
    assert problems([("e1", "A", "p1")], [], silent) == {"abstained_with_citations", "abstained_without_reason"}


def test_strict_json():
    assert generate.strict_object('```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ('{"a":1} junk', "[1]", "", "{"):
        with pytest.raises(ValueError):
            generate.strict_object(bad)
    with pytest.raises(ValueError):
        generate.exact_keys({"a": 1, "x": 2}, {"a", "b"})


def library(spark):
    return spark.createDataFrame([("A", "p1", "roads and bridges. more"), ("B", "p2", "roads and tunnels")], "paper_id string, passage_id string, text string")


def chat(spark, question, generator=generate.quoting_generator, passages=None):
    asked = spark.createDataFrame([("q", question)], "request_id string, question string")
    return generate.cited_chat(library(spark) if passages is None else passages, asked, generator).head()


def test_chat_ladder(spark):
    row = chat(spark, "roads")
    assert (row.outcome, row.exit_code, row.citation_ids) == ("answered", 0, ["e1", "e2"])
    assert chat(spark, "zebras").outcome == "no_matches"
    assert chat(spark, "roads", passages=library(spark).limit(0)).outcome == "empty_library"
    assert chat(spark, "roads", lambda p: "not json").exit_code == 3

    def silent(prompt):
        return json.dumps({"answer_text": "none", "abstained": True, "abstention_reason": "unsure", "citations": [], "claims": []})

    assert chat(spark, "roads", silent).outcome == "abstained"

    def leaking(prompt):
        e = json.loads(prompt)["evidence"]
        other = "tunnels" if "bridges" in e[0]["text"] else "bridges"
        return json.dumps({"answer_text": other, "abstained": False, "abstention_reason": None, "citations": [{k: e[0][k] for k in ("citation_id", "paper_id", "passage_id")}], "claims": [{"text": other, "citation_ids": ["e1"]}]})

    row = chat(spark, "roads", leaking)
    assert (row.outcome, row.exit_code) == ("withheld", 1)


def test_research_question(spark):
    rows = spark.createDataFrame([(1, "abstract", "Do prices rise?", 1, 0, 15), (1, "introduction", "They do.", 1, 20, 28), (2, "abstract", " ", 1, 0, 1), (3, "abstract", "Prices.", 1, 0, 7)], "paper_id long, kind string, text string, page int, start int, end int")
    out = {r.paper_id: r for r in generate.research_question(rows, lambda p: json.dumps({"question": " Do they? ", "sections": ["abstract"]})).collect()}
    assert (out[1].question, out[1].kind, out[1].warnings) == ("Do they?", "explicit", [])
    assert out[1].evidence[0].text == "Do prices rise?"
    assert (out[2].kind, out[2].warnings) == ("unavailable", ["no_usable_sections"])
    assert (out[3].kind, out[3].warnings) == ("inferred", ["missing_section"])

    def warned(answer):
        return generate.research_question(rows.filter("paper_id = 1"), answer).head().warnings

    assert warned(lambda p: 1 / 0) == ["generation_failed"]
    assert warned(lambda p: "nope") == ["malformed_output"]
    assert warned(lambda p: json.dumps({"abstained": True})) == ["model_abstained"]
    assert warned(lambda p: json.dumps({"question": "x", "sections": ["methods"]})) == ["ungrounded_output"]
    assert warned(lambda p: json.dumps({"question": "x" * 1001, "sections": ["abstract"]})) == ["malformed_output"]


def test_metrics_by_hand(spark):
    found = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1), ("b", 4, 2)], "query_id string, passage_id long, rank int")
    judged = spark.createDataFrame([("a", 2), ("a", 9), ("b", 3), ("c", 7)], "query_id string, passage_id long")
    got = {(r.metric, r.k): r.value for r in evaluate.metrics(evaluate.query_metrics(found, judged, (1, 2))).collect()}
    assert got[("hit_rate", 1)] == pytest.approx(1 / 3, abs=1e-9) and got[("hit_rate", 2)] == pytest.approx(2 / 3, abs=1e-9)
    assert got[("recall", 2)] == pytest.approx(0.5) and got[("mrr", 2)] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        evaluate.query_metrics(found, judged, (2, 1))


def test_timing_summary(spark):
    row = evaluate.timing_summary(spark.createDataFrame([(float(x),) for x in range(1, 21)] + [(None,)], "value double")).head()
    assert (row["count"], row.minimum, row.median, row.p95, row.maximum) == (20, 1.0, 10.5, 19.0, 20.0)


def test_running_totals_over_a_whole_table(spark):
    from pyspark.sql import functions as F

    from quirelake.operators.ranking import running_total

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("w"))
    got = {r.v: (r.upto, r.w) for r in running_total(rows, ["v"], F.col("w")).collect()}
    total = 0
    for v in range(1000):
        total += got[v][1]
        assert got[v][0] == total
    assert running_total(rows.limit(0), ["v"]).count() == 0
    assert sorted(r.upto for r in running_total(rows, ["v"]).collect()) == list(range(1, 1001))


def test_fingerprint_tree(spark, monkeypatch):
    import hashlib

    from pyspark.sql import functions as F

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    rows = spark.createDataFrame([(k, f"t{k}") for k in range(10)], "k int, t string").repartition(5)
    monkeypatch.setattr(evaluate, "FAN", 3)
    level = [sha(f"t{k}") for k in range(10)]
    while len(level) > 1:
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    assert evaluate.fingerprint(rows, ["k"], F.col("t")).head().fingerprint == "sha256:" + level[0]
    assert evaluate.fingerprint(rows.limit(0), ["k"], F.col("t")).head().fingerprint == "sha256:" + sha("")
