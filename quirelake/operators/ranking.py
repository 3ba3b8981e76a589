"""Numbers over a whole table's order, without a window that gathers the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.durable import durable, unpartitioned_text


def running_total(rows: DataFrame, order: list[str], weight: Column | None = None, name: str = "upto") -> DataFrame:
    """``rows`` with the sum of ``weight`` (1 if none) over all rows up to each in ``order``, a total order.

    Rows are range partitioned by the order; each partition sums its own and
    adds what the partitions before it hold, a number for each partition.
    """
    amount = F.lit(1) if weight is None else weight
    spread = durable(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    held = sorted((r["__part"], r["n"]) for r in spread.groupBy("__part").agg(F.sum(amount).alias("n")).collect())
    before, table = 0, []
    for part, n in held:
        table.append((part, before))
        before += n
    shift = rows.sparkSession.createDataFrame(table or [(0, 0)], "__part int, __before long")
    own = F.sum(amount).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spread.join(F.broadcast(shift), "__part").withColumn(name, own + F.col("__before")).drop("__part", "__before")


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "nth") -> DataFrame:
    """``rows`` numbered from 1 within equal values of the string column ``group``, in ``order``, which is total within a group.

    The number is the row's place in the whole order less the group's: no task
    needs a group's rows together.
    """
    placed = running_total(rows, [group, *order], name="__place")
    before = placed.groupBy(group).agg((F.min("__place") - 1).alias("__before")).select(unpartitioned_text(group).alias("__group"), "__before")
    joined = placed.join(before, F.col(group).eqNullSafe(F.col("__group")))
    return joined.select(*rows.columns, (F.col("__place") - F.col("__before")).cast("int").alias(name))


def parted(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` stored in range partitions of ``order``, numbered by ``__part``: a group of any size is cut into pieces that follow each other."""
    return durable(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def with_next(parts: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    """``parted`` rows with columns of the row that follows in ``order``, which is total; null for the last row.

    ``columns`` maps names to columns. The first row of a partition is handed to
    the partition before it, a row for each partition.
    """
    following = Window.partitionBy("__part").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(name) for name, c in columns.items()])
    local = parts.withColumn("__next", F.lead(packed).over(following)).withColumn("__last", F.lead(F.lit(1)).over(following).isNull())
    heads = parts.groupBy("__part").agg(F.min_by(packed, F.struct(*order)).alias("__head"))
    numbers = sorted(r["__part"] for r in heads.select("__part").collect())
    before = parts.sparkSession.createDataFrame([(b, a) for a, b in zip(numbers, numbers[1:], strict=False)] or [(-1, -1)], "__part int, __before int")
    handed = heads.join(before, "__part").select(F.col("__before").alias("__part"), "__head", F.lit(True).alias("__last"))
    joined = local.join(handed, ["__part", "__last"], "left")
    found = F.when(F.col("__last"), F.col("__head")).otherwise(F.col("__next"))
    return joined.select(*parts.columns, *[found[name].alias(name) for name in columns])
