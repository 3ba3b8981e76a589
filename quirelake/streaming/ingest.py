"""Incremental ingestion: new files as a stream, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.durable import durable
from quirelake.sources.library import ConflictError, Library

FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256, content) of files as they appear below ``path``."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return stream.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def ingest(files: DataFrame, library: Library, table: str, process: Callable[[DataFrame], DataFrame], checkpoint: str, attempts: int = 5) -> StreamingQuery:
    """Runs ``process`` on the contents that the library's table does not hold yet and appends its rows (with their sha256).

    Exact reuse: a batch is reduced to new digests by an anti-join before any work. Exactly once: the
    number of the batch is published with its rows, under the name of the stream's checkpoint folder, so
    a batch that is repeated after a failure adds nothing, whatever ``process`` makes of it then. No
    stored file is rewritten. If another writer publishes in between, the digests are compared anew.
    """

    def batch(rows: DataFrame, number: int) -> None:
        for attempt in range(attempts):
            base = library.manifest()
            if base.get("batches", {}).get(checkpoint, -1) >= number:
                return
            fresh = rows.dropDuplicates(["sha256"])
            known = library.table(table, "sha256 string", base["version"]).select("sha256")
            made = durable(process(fresh.join(known, "sha256", "left_anti")))
            try:
                library.apply(put={table: (made.select("sha256").distinct(), made)}, base=base["version"], batch=(checkpoint, number))
                return
            except ConflictError:
                if attempt == attempts - 1:
                    raise

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
