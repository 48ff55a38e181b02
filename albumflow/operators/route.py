"""Routing: where each file goes, what happens when two go to one place, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumflow.functions.dates import bucket, year_bucket
from albumflow.functions.paths import kind_of, target_path
from albumflow.operators.numbering import running
from albumflow.schema import NO_DATE


def route(dated: DataFrame, root: str = "out", granularity: str = "day") -> DataFrame:
    """dated (path, name, ext, capture_ts, no_date) plus kind, year, bucket, target_path, message."""
    no_date, ts = F.col("no_date"), F.col("capture_ts")
    kind = F.when(no_date, NO_DATE).otherwise(kind_of(F.col("ext")))
    year = F.when(~no_date, year_bucket(ts))
    day = F.when(~no_date, bucket(ts, granularity))
    out = dated.select("*", kind.alias("kind"), year.alias("year"), day.alias("bucket"))
    out = out.withColumn("target_path", target_path(root, F.col("kind"), ts, no_date, F.col("name"), granularity))
    gone = F.concat(F.lit("NO DATE → "), F.col("name"))
    return out.withColumn("message", F.when(no_date, gone).otherwise(F.concat("name", F.lit(" → "), F.concat_ws("\\", "kind", "year", "bucket"))))


def winners(routed: DataFrame, keep: str = "last") -> DataFrame:
    """One row a target: the last (or first) source path, with ``sources``, how many there were."""
    best = (F.max if keep == "last" else F.min)("path").alias("path")
    return routed.groupBy("target_path").agg(best, F.count("*").alias("sources"))


def with_collisions(routed: DataFrame, policy: str = "last") -> DataFrame:
    """routed plus ``status``: ``copied``, or ``overwritten`` where another file takes the place.

    ``error`` marks every file of a contested target.
    """
    if policy not in ("last", "first", "error"):
        raise ValueError(f"unknown policy: {policy}")
    won = winners(routed, "first" if policy == "first" else "last").withColumnRenamed("path", "winner")
    status = F.when(F.col("path") == F.col("winner"), "copied").otherwise("overwritten")
    if policy == "error":
        status = F.when(F.col("sources") > 1, "error").otherwise("copied")
    return routed.join(won, "target_path").withColumn("status", status).drop("winner", "sources")


def collisions(routed: DataFrame) -> DataFrame:
    """Targets with several sources."""
    return winners(routed).where("sources > 1").withColumnRenamed("path", "kept_path")


def summary(routed: DataFrame) -> DataFrame:
    """total, photos, videos, no_date: files of each kind."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return routed.agg(F.count("*").alias("total"), count("photos").alias("photos"), count("videos").alias("videos"), count(NO_DATE).alias("no_date"))


def line_summary(lines: DataFrame) -> DataFrame:
    """Counts of report lines by what they mention: a line may count as both, and every line counts."""
    low = F.lower("message")
    return lines.agg(F.count("*").alias("total"), F.count_if(F.contains(low, F.lit("photo"))).alias("photos"), F.count_if(F.contains(low, F.lit("video"))).alias("videos"))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, by double division and truncation in that order."""
    return (done.cast("double") / total.cast("double") * 100).cast("int")


def number_in_folder(files: DataFrame) -> DataFrame:
    """files plus ``folder_number``, counted from 0 by path within each folder."""
    return running(files, ["dir"], ["path"], "folder_number")


def copy_numbers(routed: DataFrame) -> DataFrame:
    """routed plus ``copy_number``: 0 for the first file of a target, then 1, 2, ..."""
    return running(routed, ["target_path"], ["path"], "copy_number")
