"""Preflight of files or texts: digests, duplicates, what is stored already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.durable import unpartitioned_text
from quirelake.operators.ranking import numbered

def preflight(files: DataFrame, stored: DataFrame, path: str = "path", checksum: str = "sha256", size: str = "size") -> DataFrame:
    """(path, size, sha256, is_stored, is_batch_duplicate, duplicate_of), the first path of equal digests being the original.

    ``stored`` (checksum) is matched without regard to case.
    """
    known = stored.select(F.lower("checksum").alias("known")).distinct().select(unpartitioned_text("known").alias("known"), F.lit(True).alias("is_stored"))
    # the smallest path of a digest by a pre-aggregated min: copies are never gathered, and the join with it may be split
    first = files.groupBy(F.col(checksum).alias("digest")).agg(F.min(path).alias("first")).select(unpartitioned_text("digest").alias("digest"), "first")
    joined = files.join(first, F.col(checksum) == F.col("digest")).join(known, F.lower(F.col(checksum)) == F.col("known"), "left")
    copy = F.col(path) != F.col("first")
    return joined.select(
        F.col(path).alias("path"), F.col(size).alias("size"), F.col(checksum).alias("sha256"), F.coalesce("is_stored", F.lit(False)).alias("is_stored"), copy.alias("is_batch_duplicate"), F.when(copy, F.col("first")).alias("duplicate_of")
    )


def preflight_counts(checked: DataFrame) -> DataFrame:
    """(total, new, stored, duplicates); stored counts every stored file, duplicates included."""
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_stored") & ~F.col("is_batch_duplicate")).alias("new"),
        F.count_if("is_stored").alias("stored"),
        F.count_if("is_batch_duplicate").alias("duplicates"),
    )


def checksum_conflicts(papers: DataFrame) -> DataFrame:
    """Digests, in lower case, that more than one paper has."""
    return papers.groupBy(F.lower("checksum").alias("checksum")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): files of the manifest (path, size, sha256) that are missing or differ in size or digest."""
    seen = files.select("path", F.col("size").alias("real_size"), F.col("sha256").alias("real_sha"))
    joined = manifest.join(seen, "path", "left")
    problem = F.when(F.col("real_size").isNull(), "missing").when(F.col("size") != F.col("real_size"), "size").when(F.lower("sha256") != F.lower("real_sha"), "checksum")
    return joined.select("path", problem.alias("problem")).filter("problem is not null")


def reuse_decision(candidates: DataFrame, analyses: DataFrame, library: DataFrame) -> DataFrame:
    """``candidates`` (sha256, fingerprint) with action: reuse, backfill or new.

    An analysis (sha256, fingerprint) without its library record is backfilled
    without the generator.
    """
    done = analyses.select("sha256", "fingerprint").distinct().withColumn("analysed", F.lit(True))
    kept = library.select("sha256", "fingerprint").distinct().withColumn("in_library", F.lit(True))
    joined = candidates.join(done, ["sha256", "fingerprint"], "left").join(kept, ["sha256", "fingerprint"], "left")
    action = F.when(F.col("analysed") & F.col("in_library"), "reuse").when(F.col("analysed"), "backfill").otherwise("new")
    return joined.withColumn("action", action).drop("analysed", "in_library")


def library_eligibility(analyses: DataFrame) -> DataFrame:
    """``analyses`` (checksum, stages array, quality, sections) with outcome: not_eligible, no_usable_sections or stored."""
    needed = F.array(*map(F.lit, ("preflight", "extraction", "quality", "sections")))
    eligible = F.col("checksum").isNotNull() & (F.size(F.array_except(needed, F.coalesce("stages", F.array().cast("array<string>")))) == 0) & F.col("quality").isin("usable", "usable_with_warnings")
    return analyses.withColumn("outcome", F.when(~F.coalesce(eligible, F.lit(False)), "not_eligible").when(F.coalesce("sections", F.lit(0)) == 0, "no_usable_sections").otherwise("stored"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Counters over results (sha256, action, status)."""
    return results.agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_distinct("sha256").alias("unique_files"),
        F.count_if(F.col("action") == "new").alias("new"),
        F.count_if(F.col("action") == "reuse").alias("reused"),
        F.count_if(F.col("action") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "halted").alias("halted"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "unexpected").alias("unexpected"),
    )


def exit_code(results: DataFrame) -> DataFrame:
    """The gravest outcome: 3 unexpected, 2 failed, 1 halted, else 0."""
    code = F.when(F.col("status") == "unexpected", 3).when(F.col("status") == "failed", 2).when(F.col("status") == "halted", 1).otherwise(0)
    return results.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))


def first_paths(files: DataFrame, path: str = "path", checksum: str = "sha256") -> DataFrame:
    """Files numbered within equal digests by path, which is unique."""
    return numbered(files, checksum, [path])
