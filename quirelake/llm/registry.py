"""Queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm.decontaminate import OP2_SQL, op2_decontamination
from quirelake.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from quirelake.llm.fingerprints import op12_fingerprints
from quirelake.llm.language_id import op1_language_id
from quirelake.llm.licenses import op7_license_scan
from quirelake.llm.line_dedup import OP6_SQL, op6_line_dedup
from quirelake.llm.lm_score import op5_lm_score
from quirelake.llm.merkle import OP13_SQL, op13_merkle_manifest
from quirelake.llm.mixing import op3_source_mix
from quirelake.llm.near_dedup import OP9_SQL, op9_near_dedup
from quirelake.llm.quality_rules import op10_quality_rules
from quirelake.llm.url_filter import OP4_SQL, op4_url_filter
from quirelake.llm.warc import op8_warc_derivatives

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontamination": op2_decontamination,
        "op3_source_mix": op3_source_mix,
        "op4_url_filter": op4_url_filter,
        "op5_lm_score": op5_lm_score,
        "op6_line_dedup": op6_line_dedup,
        "op7_license_scan": op7_license_scan,
        "op8_warc_derivatives": op8_warc_derivatives,
        "op9_near_dedup": op9_near_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_fingerprints": op12_fingerprints,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_url_filter": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_near_dedup": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
