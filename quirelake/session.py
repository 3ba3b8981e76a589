"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "16g", app: str = "quirelake") -> SparkSession:
    """A session for one machine; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder`` (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: bytes of a table's files to a piece, where the number of pieces is not left to Spark
PIECE = 16_000_000


def pieces(rows: DataFrame) -> int:
    """The number of pieces for ``rows`` of a table: one a core, and more where its files hold more than ``PIECE`` bytes for each."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key`` to pieces of bounded size, at least one a core, if they were read in no more pieces than there are cores.

    One small file may hold a single row group, which a single task would work
    through; a table in many pieces is left as it is and not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(pieces(rows), key) if rows.rdd.getNumPartitions() <= cores else rows
