"""Routing of files as they arrive: an extension beside the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from albumflow.functions.dates import invalid_date
from albumflow.operators.route import route
from albumflow.plans.pipeline import Config, run


def route_stream(files: DataFrame, root: str = "out", granularity: str = "day") -> DataFrame:
    """A stream of (path, name, ext, capture_ts) routed without JSON records; stateless."""
    return route(files.withColumn("no_date", invalid_date(F.col("capture_ts"))), root, granularity)


def count_stream(routed: DataFrame, event_time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Files of each kind by window of arrival; windows close once ``late`` has passed."""
    timed = routed.withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, window), "kind").agg(F.count("*").alias("files"))


def first_of_each_target(routed: DataFrame, event_time: str, late: str = "1 hour") -> DataFrame:
    """Of files with one target, the first to arrive, as long as both come within ``late``."""
    return routed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["target_path"])


def watch(files: DataFrame, sidecars: DataFrame, manifest_path: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Run the whole pipeline on every batch of new files against the records there are,
    and append to the manifest.  A batch that is run again replaces its own part."""

    def batch(rows: DataFrame, number: int) -> None:
        run(rows, sidecars, config).manifest.write.mode("overwrite").parquet(f"{manifest_path}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
