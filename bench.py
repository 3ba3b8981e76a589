"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to a no-op sink, once to warm up and then ``REPEATS``
times; the median counts. A fixed computation is timed in the same run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from quirelake.plans import catalogue
from quirelake.session import local_session

HEADLINE = [
    "bm25_topk",
    "bm25_single_query_limit",
    "bm25_doc_freq",
    "eval_metrics_at_k",
    "passage_split",
    "passage_fragments",
    "doc_quality",
    "quality_status",
    "preflight_duplicates",
    "grounding_verdicts",
    "column_width",
    "history_window",
    "corpus_fingerprint",
    "library_upsert",
]
REPEATS = 3


def calibration(spark) -> float:
    """Seconds of a fixed computation without any of this package: tells one machine's hour from another's."""
    times = []
    for _ in range(3):
        began = time.perf_counter()
        spark.range(20_000_000).selectExpr("id % 1000 AS k", "xxhash64(id) AS h").groupBy("k").agg({"h": "max"}).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "16g", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = catalogue.queries()
    took: dict[str, float] = {}
    fixed = calibration(spark)
    for name in HEADLINE:
        times = []
        for _ in range(1 + REPEATS):
            began = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "calibration_sec": fixed, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
