"""Numbers within groups of any size, dealt to many tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def saved(rows: DataFrame) -> DataFrame:
    """Rows written to the folder that all executors share, and read from there from now on.

    A folder of our own serves only where none is set, in local mode.
    """
    sc = rows.sparkSession.sparkContext
    if not (rows.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="albumflow-"))
    return rows.checkpoint()


def _dealt(rows: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """rows dealt by ranges of (group, order), with the number of their range; ranges of a group rise with its order."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(rows.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()))


def _with_before(counted: DataFrame, totals: DataFrame, group: list[str], before: Column) -> DataFrame:
    """counted plus ``_before``: what ``before`` makes of the totals of the same group's earlier ranges.

    Only a range's first group has any, so that table has at most a row a range and is broadcast.
    """
    ahead = totals.withColumn("_before", before).where("_before is not null").select(F.col("_range").alias("_range_of"), *[F.col(g).alias(f"_own_{g}") for g in group], "_before")
    same = F.col("_range") == F.col("_range_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_own_{g}"))
    return counted.join(F.broadcast(ahead), same, "left")


def _earlier(group: list[str]):
    return Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, group: list[str], order: list[str | Column], name: str, amount: Column | None = None) -> DataFrame:
    """rows plus ``name``: the sum of ``amount`` (1 each) over the rows of the same group that come before.

    A large group spans many tasks; each range counts its own rows, and what the ranges before it have of the group is added.
    """
    dealt = _dealt(rows.withColumn("_amount", (F.lit(1) if amount is None else amount).cast("bigint")), group, order)
    totals = dealt.groupBy("_range", *group).agg(F.sum("_amount").alias("_total"))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    out = _with_before(counted, totals, group, F.sum("_total").over(_earlier(group)))
    return out.select(*rows.columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias(name))


def carried(rows: DataFrame, group: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """rows plus ``name``: the last ``value`` that is not null, of the row itself or of those of the same group before it.

    Large groups span many tasks, as in ``running``.
    """
    dealt = _dealt(rows.withColumn("_value", value), group, order)
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    totals = dealt.groupBy("_range", *group).agg(F.max_by("_value", place).alias("_total"))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    out = _with_before(counted, totals, group, F.last("_total", ignorenulls=True).over(_earlier(group)))
    return out.select(*rows.columns, F.coalesce("_inside", "_before").alias(name))
