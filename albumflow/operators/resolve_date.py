"""The capture date of each file: embedded dates first, the JSON record if they are invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.functions.dates import invalid_date
from albumflow.functions.text import sidecar_ts
from albumflow.operators.sidecar_join import choose


def embedded_date(files: DataFrame) -> DataFrame:
    """files plus ``embedded``: the first of EXIF, container header, container metadata.

    A date that was read counts even if it is invalid: a zero container header wins over
    later sources, and is rejected afterwards.
    """
    return files.withColumn("embedded", F.coalesce("exif_dto", "qt_header", "qt_meta"))


def resolve(files: DataFrame, sidecars: DataFrame, mode: str = "classic", pick: str = "ranked") -> DataFrame:
    """files (path, dir, name, stem, embedded) plus capture_ts, date_source and no_date.

    ``classic``: only files with an invalid embedded date are joined with records, and the
    record's date is checked again.  ``fast``: no records, and any date at all is good.
    """
    if mode == "fast":
        source = F.when(F.col("embedded").isNotNull(), "embedded")
        return files.select("*", F.col("embedded").alias("capture_ts"), source.alias("date_source"), F.col("embedded").isNull().alias("no_date"))
    if mode != "classic":
        raise ValueError(f"unknown mode: {mode}")
    bad = F.coalesce(invalid_date(F.col("embedded")), F.lit(True))
    good = files.where(~bad).select("*", F.col("embedded").alias("capture_ts"), F.lit("embedded").alias("date_source"))
    records = sidecars.select("dir", "json_name", "json_stem", sidecar_ts(F.col("body")).alias("json_ts"))
    rest = files.where(bad)
    rest = rest.join(choose(rest, records, pick, ["json_ts"]).select("path", "json_ts"), "path", "left")
    ts = F.coalesce("json_ts", "embedded")
    source = F.when(F.col("json_ts").isNotNull(), "sidecar").when(F.col("embedded").isNotNull(), "embedded")
    rest = rest.select(*files.columns, ts.alias("capture_ts"), source.alias("date_source"))
    both = good.unionByName(rest)
    return both.withColumn("no_date", invalid_date(F.col("capture_ts")))
