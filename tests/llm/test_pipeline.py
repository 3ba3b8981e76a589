from __future__ import annotations

import collections

import corpus_pipeline
import pytest
from quirelake.llm import registry

from .common import awkward, empty, prose
from .test_dedup import brute_components

FUNCTIONS = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables with awkward documents, a leak, copies and a repeated passage."""
    path = str(tmp_path_factory.mktemp("tables"))
    leak = prose("de", 300, 30)
    passage = prose("fr", 301, 60).replace(".\n", ",")
    extra = [prose("en", 400 + k, 50) + "\n" + passage + "\n" + prose("en", 500 + k, 50) for k in range(4)] + [prose("en", 600) + " " + leak, prose("en", 700), prose("en", 700) + " tail"]
    awkward(spark, extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        held[name] = docs.collect()
    assert all(any(c.isalpha() for c in r.text) for r in held["language_id"])
    passage = prose("fr", 301, 60).replace(".\n", ",")
    assert sum(passage in r.text for r in held["line_dedup"]) == 1
    texts = [r.text for r in held["line_dedup"]]
    components, _ = brute_components(texts, 5, 80)
    assert len(held["near_dedup"]) == len(set(components))
    leak = prose("de", 300, 30)
    assert any(leak in r.text for r in held["near_dedup"]) and not any(leak in r.text for r in held["decontamination"])
    assert len(held["decontamination"]) == len(held["near_dedup"]) - 1
    mixed = held["source_mix"]
    assert {r.text for r in mixed} <= {r.text for r in held["decontamination"]}
    assert all(0 < r.copies <= 3 and r.taken == r.copies * len(r.text.split()) for r in mixed if r.text.isascii() and "\x00" not in r.text)
    total = collections.Counter((r.doc_id, r.taken) for r in mixed)
    assert collections.Counter((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, folder).collect()) == total


@pytest.mark.parametrize("name", list(FUNCTIONS))
def test_every_stage_takes_an_empty_table(spark, folder, name):
    docs = empty(spark)
    out = FUNCTIONS[name](spark, docs, folder)
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)


def test_registry():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert registry.oracle_sql().keys() <= registry.queries().keys()
