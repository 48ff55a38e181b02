"""Media views over the driver's tables, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumflow.functions.dates import strict_parse, ts_to_epoch

EXTENSIONS = (".jpg", ".JPEG", ".png", ".tif", ".tiff", ".webp", ".mp4", ".MOV", ".m4v", ".heic", ".HEIF", ".txt", ".gif", ".bin")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, dir, name, stem, ext, meta, ts, event_id: one file an event."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    n = F.col("event_id")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (n % len(EXTENSIONS) + 1).cast("int"))
    stem = F.concat(F.lit("IMG_"), n.cast("string"))
    folder = F.concat(F.lit("album_"), (F.col("user_id") % 20).cast("string"))
    text = F.when(n % 11 == 0, None).when(n % 7 == 0, "1904:01:01 00:00:00").when(n % 13 == 0, "n/a").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    rows = e.select("event_id", "ts", folder.alias("dir"), stem.alias("stem"), ext.alias("ext"), text.alias("meta"))
    rows = rows.withColumn("name", F.concat("stem", "ext"))
    return rows.select(F.concat_ws("/", "dir", "name").alias("path"), "dir", "name", "stem", "ext", "meta", "ts", "event_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media with parsed dates, as the pipeline takes them."""
    none = F.lit(None)
    rows = media(spark, sf_dir).withColumn("exif_dto", strict_parse(F.col("meta")))
    return rows.select("path", "dir", "name", "stem", "ext", "exif_dto", none.cast("timestamp_ntz").alias("qt_header"), none.cast("timestamp_ntz").alias("qt_meta"), none.cast("string").alias("error"))


def dated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media with three nullable dates."""
    n, ts = F.col("event_id"), F.col("ts")
    day = lambda d: ts + F.make_dt_interval(F.lit(d))
    return media(spark, sf_dir).select(
        "path", "event_id", F.when(n % 2 == 0, ts).alias("exif_dto"), F.when(n % 3 == 0, day(1)).alias("qt_header"), F.when(n % 5 == 0, day(2)).alias("qt_meta")
    )


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records beside every third file; some are malformed or have one date only."""
    n = F.col("event_id")
    seconds = ts_to_epoch(F.col("ts")).cast("string")
    field = F.when(n % 15 == 0, "creationTime").otherwise("photoTakenTime")
    good = F.concat(F.lit('{"'), field, F.lit('": {"timestamp": "'), seconds, F.lit('"}}'))
    body = F.when(n % 21 == 0, "{broken").otherwise(good)
    stem = F.concat("name", F.lit(".supplemental-metadata"))
    rows = media(spark, sf_dir).where(n % 3 == 0)
    return rows.select("dir", F.concat(stem, F.lit(".json")).alias("json_name"), stem.alias("json_stem"), body.alias("body"), "event_id")


def track(spark: SparkSession, sf_dir: str, fixes: bool) -> DataFrame:
    """Even events are fixes, odd ones are media times."""
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("ts").alias("t"), "value", "event_id")
    return rows.where(F.col("event_id") % 2 == (0 if fixes else 1))


def contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed media whose names repeat across folders."""
    from albumflow.operators.route import route

    n = F.col("event_id")
    rows = files(spark, sf_dir).join(media(spark, sf_dir).select("path", "event_id", "ts"), "path")
    name = F.concat(F.lit("IMG_"), (n % 500).cast("string"), F.lower("ext"))
    path = F.concat_ws("/", "dir", n.cast("string"), name)
    rows = rows.select(path.alias("path"), name.alias("name"), "ext", F.col("ts").alias("capture_ts"), (n % 11 == 0).alias("no_date"))
    return route(rows)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, place, value: logs of NMEA sentences, one fix an event and a minute.

    RMC sentences (with the day) are missing from every fifth fix from the 200th on, ZDA sentences (with it too) from every second of those.
    """
    e = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("log"))
    n = F.col("event_id")
    t = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=n)
    named = (n % 5 != 0) | (n < 200)
    clock = F.date_format(t, "HHmmss")
    later = lambda s: F.date_format(t + F.make_dt_interval(secs=F.lit(s)), "HHmmss")
    lat, lon = F.format_string("%02d30.000,N", n % 60), F.format_string("%03d15.000,W", n % 120)
    lines = [
        F.when(named, F.format_string("$GPRMC,%s,A,%s,%s,10.0,%d.0,%s,,*00", clock, lat, lon, n % 360, F.date_format(t, "ddMMyy"))),
        F.when(~named & (n % 2 == 1), F.format_string("$GPZDA,%s,%s,00,00*00", clock, F.date_format(t, "dd,MM,yyyy"))),
        F.when(n % 3 != 0, F.format_string("$GPGGA,%s,%s,%s,1,08,0.9,%d.5,M,,M,,*00", clock, lat, lon, n % 1000)),
        F.when(n % 3 == 0, F.format_string("$GPGLL,%s,%s,%s,A*00", lat, lon, later(1))),
        F.format_string("$GPGGA,%s,%s,%s,1,08,2.5,99999.0,M,,M,,*00", later(2), lat, lon),
        F.format_string("$GPGLL,0000.000,N,00000.000,E,%s,V*00", later(3)),
    ]
    return e.select(F.concat(F.lit("log"), "log").alias("file"), "event_id", F.posexplode(F.array(*lines)).alias("at", "value")).select("file", F.struct("event_id", "at").alias("place"), "value").where("value is not null")
