"""The media pipeline: files and their metadata to a manifest, a report and a summary."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.functions.paths import is_media
from albumflow.operators import route as routing
from albumflow.operators.resolve_date import embedded_date, resolve


@dataclass(frozen=True)
class Config:
    """What a run does: bucket size, engine mode, choice of records, and of colliding files."""

    root: str = "out"
    granularity: str = "day"
    mode: str = "classic"
    sidecar_pick: str = "ranked"
    collision: str = "last"
    line_summary: bool = False


class Result(NamedTuple):
    manifest: DataFrame
    report: DataFrame
    summary: DataFrame
    collisions: DataFrame


def run(files: DataFrame, sidecars: DataFrame, config: Config = Config()) -> Result:
    """files: path, dir, name, stem, ext, exif_dto, qt_header, qt_meta, error."""
    media = embedded_date(files.where(is_media(F.col("ext"))))
    dated = resolve(media, sidecars, config.mode, config.sidecar_pick)
    routed = routing.route(dated, config.root, config.granularity)
    failed = F.col("error").isNotNull()
    message = F.when(failed, F.concat(F.lit("ERROR in "), F.col("name"), F.lit(": "), F.col("error"))).otherwise(F.col("message"))
    routed = routed.withColumn("message", message)
    manifest = routing.with_collisions(routed, config.collision)
    columns = [F.col("path").alias("source_path"), "target_path", "kind", "year", "bucket", "capture_ts", "date_source", "status", "message"]
    counts = routing.line_summary(routed) if config.line_summary else routing.summary(routed)
    return Result(manifest.select(*columns), routed.select("path", "message"), counts, routing.collisions(routed))
