"""Getting this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: list[object] = []


def ship_package(spark: SparkSession) -> None:
    """Adds the package, zipped, to the session's Python files, once for a Spark context.

    Spark's own file server brings it to the executors, so they need neither
    an installation nor a folder shared with the driver.
    """
    context = spark.sparkContext
    if any(context is c for c in _shipped):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quirelake-code-")) / "quirelake_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(here.rglob("*.py")):
            packed.write(path, f"{here.name}/{path.relative_to(here)}")
    context.addPyFile(str(target))
    _shipped[:] = [context]


def shipped(df: DataFrame) -> DataFrame:
    """``df``, whose Python functions will find this package."""
    ship_package(df.sparkSession)
    return df
