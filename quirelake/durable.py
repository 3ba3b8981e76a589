"""Cutting lineage so that a lost executor costs one stage, not the whole job."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Where neither that setting
    nor a folder set on the context exists, a session on one machine (tests, a
    laptop) gets a temporary one; a cluster has none that its machines share,
    so there it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quirelake-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> None:
    """Deletes what ``durable`` stored for ``df``, which nothing may read any more."""
    jvm = df.sparkSession.sparkContext._jvm
    stored = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if stored.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(stored.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unpartitioned(key: str) -> Column:
    """The long column ``key`` through an expression that leaves its value alone.

    An aggregate is partitioned by its key, and a join would reuse that and
    deal the other side out to match: a hot key's rows would meet in one task
    that nothing may split. Seen through an expression, the partitioning is not
    recognised; both sides are plain shuffles, which adaptive execution can split.
    """
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def unpartitioned_text(key: str) -> Column:
    """The same for a string column."""
    return F.concat(F.col(key), F.lit(""))
