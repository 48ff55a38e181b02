"""Track logs of several formats as one table of fixes: device, t, lat, lon, alt, speed, track, hdop."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from albumflow.functions.dates import epoch_to_ts, make_ts, zone_minutes
from albumflow.functions.numbers import from_dms
from albumflow.operators.numbering import carried, running, saved

COLUMNS = ("lat", "lon", "alt", "speed", "track", "hdop")

#: NMEA sentences that carry a time, keys of JSON logs, record letters of flight recorders, and elements of XML logs.
SENTENCES = ("RMC", "GGA", "GLL", "ZDA")
HISTORY_KEYS = ("locations", "latitudeE7", "placeVisit", "activitySegment", "timelineObjects")
TIMELINE_KEYS = ("startTime", "durationMinutesOffsetFromStartTime")
RECORDERS = ("AXSY", "AFLA", "AFIL", "HFDTE")
ELEMENTS = {"tcx": ("TrainingCenterDatabase", "Trackpoint"), "kml": ("kml", "Placemark"), "gpx": ("gpx", "trkpt")}


def _fixes(rows: DataFrame, device: Column, t: Column, **values: Column) -> DataFrame:
    made = [values.get(c, F.lit(None)).cast("double").alias(c) for c in COLUMNS]
    return rows.select(device.alias("device"), t.alias("t"), *made).where("t is not null and lat is not null and lon is not null")


def _zulu(text: Column) -> Column:
    """ISO time with Z or an offset, as UTC wall clock."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    schema = "_lat double, _lon double, ele double, time string, hdop double, speed double, course double"
    rows = spark.read.format("xml").option("recursiveFileLookup", "true").option("rowTag", "trkpt").schema(schema).load(path).withColumn("file", F.input_file_name())
    return _fixes(rows, F.col("file"), _zulu(F.col("time")), lat=F.col("_lat"), lon=F.col("_lon"), alt=F.col("ele"), speed=F.col("speed"), track=F.col("course"), hdop=F.col("hdop"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with a time stamp and a point."""
    schema = "TimeStamp struct<when:string>, Point struct<coordinates:string>"
    rows = spark.read.format("xml").option("recursiveFileLookup", "true").option("rowTag", "Placemark").schema(schema).load(path).withColumn("file", F.input_file_name())
    place = F.split(F.trim("Point.coordinates"), ",")
    number = lambda i: F.get(place, F.lit(i)).try_cast("double")
    return _fixes(rows, F.col("file"), _zulu(F.col("TimeStamp.when")), lon=number(0), lat=number(1), alt=number(2))


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, place, value: the lines of text files; places rise within a file."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), place.alias("place"), "value")


def csv_cells(line: Column, separator: str) -> Column:
    """The cells of a CSV line, quotes and the blanks around cells taken off; a quoted cell may hold separators and doubled quotes."""
    mark = re.escape(separator)
    cells = F.regexp_extract_all(F.concat(line, F.lit(separator)), F.lit(rf'(\s*"(?:[^"]|"")*"\s*|[^{mark}]*){mark}'), 1)
    return F.transform(cells, lambda c: F.when(F.trim(c).rlike('(?s)^".*"$'), F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(c)))


#: How a column's heading begins (letter case and a leading GPS aside), and what the column is; the first that fits counts.
HEADINGS = (
    ("time(seconds)", "runtime"), ("time (seconds)", "runtime"), ("time(text)", ""), ("time (text)", ""), ("datetime", "datetime"), ("date time", "datetime"), ("date", "date"), ("time", "time"),
    ("device", "device"), ("t", "datetime"), ("poslat", "lat"), ("lat", "lat"), ("poslon", "lon"), ("lon", "lon"), ("posalt", "alt"), ("posheight", "alt"), ("alt", "alt"), ("height", "alt"), ("speed", "speed"),
    ("angleheading", "track"), ("angletrack", "track"), ("anglebearing", "track"), ("heading", "track"), ("track", "track"), ("bearing", "track"), ("hdop", "hdop"),
)
#: Kilometres an hour in a unit of speed (fixed values); a column without one is in knots.
SPEEDS = {"km/h": 1.0, "kmh": 1.0, "mph": 1.609344, "m/s": 3.6}
KNOT = 1.852


def _role(heading: Column) -> Column:
    """What a column is by its heading, or an empty text."""
    own = F.regexp_replace(F.lower(heading), r"^gps ?", "")
    out = F.lit("")
    for start, role in reversed(HEADINGS):
        exact = start == "t"
        hit = own == start if exact else F.startswith(own, F.lit(start))
        name = F.when(own.endswith("ref"), role + "ref").otherwise(role) if role in ("lat", "lon") else F.lit(role)
        out = F.when(hit, name).otherwise(out)
    return out


def _csv_date(text: Column) -> Column:
    """Midnight of a date: four digits of a year first, or last after day and month, or six digits from a year's last two."""
    ymd = F.regexp_replace(text, r"^\D*(\d{4}).*?(\d{1,2}).*?(\d{1,2}).*$", "$1-$2-$3")
    ymd = F.when(text.rlike(r"^\s*\d{1,2}\D\d{1,2}\D\d{4}"), F.regexp_replace(text, r"^\s*(\d{1,2})\D(\d{1,2})\D(\d{4}).*$", "$3-$2-$1")).when(
        text.rlike(r"^\s*\d{6}\s*$"), F.regexp_replace(text, r"^\s*(\d\d)(\d\d)(\d\d)\s*$", "20$1-$2-$3")).otherwise(ymd)
    return ymd.try_cast("date").cast("timestamp_ntz")


def _csv_seconds(text: Column) -> Column:
    """Seconds since midnight in UTC of a clock time with or without separators, fraction and zone."""
    compact = F.regexp_replace(text, r"^\s*(\d\d)(\d\d)(\d\d)(?!\d)", "$1:$2:$3")
    part = lambda i: F.regexp_extract(compact, r"^\s*(\d{1,2}):(\d\d)(?::(\d\d(?:\.\d+)?))?", i)
    seconds = part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + F.coalesce(part(3).try_cast("double"), F.lit(0.0))
    return seconds - 60 * zone_minutes(F.regexp_extract(compact, r"([+-]\d{1,2}:?\d\d)\s*$", 1))


def csv_fixes(lines: DataFrame, separator: str = ",") -> DataFrame:
    """Fixes of CSV logs (file, place, value), each read by its own heading line.

    The heading is the first line with a latitude and a time, and tells what the columns are, in which order, and the
    unit of speed (knots unless it says other; km/h in logs whose first column is INDEX).  Dates and times may be one column, two, or
    seconds since a start that the file's name tells (``2024-01-02_[03-04-05]``).  Coordinates may be decimal or degrees, minutes and
    seconds, with a direction in the text or in a column of its own.
    """
    cells = lines.select("file", "place", csv_cells(F.col("value"), separator).alias("cells"))
    roles = F.transform("cells", _role)
    has = lambda name: F.array_contains("roles", name)
    named = cells.withColumn("roles", roles).where(has("lat") & has("lon") & (has("datetime") | has("time") | has("runtime")))
    unit = F.get(F.filter("cells", lambda c: F.lower(c).rlike(r"^(gps ?)?speed")), F.lit(0))
    factor = F.when(F.get("cells", F.lit(0)) == "INDEX", F.lit(1.0)).otherwise(F.lit(KNOT))
    for name, size in SPEEDS.items():
        factor = F.when(F.contains(F.lower(unit), F.lit(f"({name})")), size).otherwise(factor)
    heads = named.groupBy("file").agg(F.min_by(F.struct("roles", factor.alias("speed"), "place"), "place").alias("head"))
    rows = cells.join(heads, "file").where(F.col("place") > F.col("head.place"))
    cell = lambda name: F.when(F.array_contains("head.roles", name), F.nullif(F.get("cells", (F.array_position("head.roles", name) - 1).cast("int")), F.lit("")))
    number = lambda name: cell(name).try_cast("double")
    whole = F.regexp_replace(cell("datetime"), "T", " ")
    both = F.split(F.trim(whole), r"\s+", 2)
    began = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d{4}-\d\d-\d\d)[^/]*?(\d\d-\d\d-\d\d)", 1)
    clock = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"\d{4}-\d\d-\d\d[^/]*?(\d\d-\d\d-\d\d)", 1)
    day = F.coalesce(_csv_date(F.get(both, F.lit(0))), _csv_date(cell("date")), F.when(number("runtime").isNotNull(), _csv_date(began)))
    seconds = F.coalesce(_csv_seconds(F.get(both, F.lit(1))), _csv_seconds(cell("time")), number("runtime") + _csv_seconds(F.replace(clock, F.lit("-"), F.lit(":"))))
    degrees = lambda name, away: F.when(F.upper(F.substring(cell(f"{name}ref"), 1, 1)) == away, -F.abs(from_dms(cell(name)))).otherwise(from_dms(cell(name)))
    values = rows.select(
        F.coalesce(cell("device"), F.col("file")).alias("device"), day.alias("day"), seconds.alias("seconds"), degrees("lat", "S").alias("lat"), degrees("lon", "W").alias("lon"),
        number("alt").alias("alt"), (number("speed") * F.col("head.speed")).alias("speed"), number("track").alias("track"), number("hdop").alias("hdop"),
    )
    t = F.col("day") + F.make_dt_interval(secs=F.col("seconds").cast("decimal(18,6)"))
    return _fixes(values, F.col("device"), t, **{c: F.col(c) for c in COLUMNS})


def read_csv_track(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """CSV logs; see ``csv_fixes``."""
    return csv_fixes(text_lines(spark, path), separator)


def winplus_fixes(lines: DataFrame) -> DataFrame:
    """Fixes of beacon logs: ``TP,D, latitude, longitude, month/day/year, clock, ...``."""
    cells = lines.where(F.startswith("value", F.lit("TP,D,"))).select("file", csv_cells(F.col("value"), ",").alias("c"))
    cell = lambda i: F.get("c", F.lit(i))
    day = F.regexp_replace(cell(4), r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2").try_cast("date").cast("timestamp_ntz")
    t = day + F.make_dt_interval(secs=_csv_seconds(cell(5)).cast("decimal(18,6)"))
    return _fixes(cells, F.col("file"), t, lat=cell(2).try_cast("double"), lon=cell(3).try_cast("double"))


def bramor_fixes(lines: DataFrame) -> DataFrame:
    """Fixes of survey-drone logs: 12 columns that end in ``ypr``: number, index, latitude, longitude, altitude, track, day/month/year, clock, angles."""
    cells = lines.select("file", F.split(F.trim("value"), r"\s+").alias("c")).where((F.size("c") == 12) & (F.get("c", F.lit(11)) == "ypr"))
    number = lambda i: F.get("c", F.lit(i)).try_cast("double")
    t = _csv_date(F.get("c", F.lit(6))) + F.make_dt_interval(secs=_csv_seconds(F.get("c", F.lit(7))).cast("decimal(18,6)"))
    return _fixes(cells, F.col("file"), t, lat=number(2), lon=number(3), alt=number(4), track=number(5))


def _degrees(value: Column, half: Column) -> Column:
    """Degrees of the number ``dddmm.mmm`` with N, S, E or W."""
    whole = F.floor(value / 100)
    return F.when(half.isin("S", "W"), -1.0).otherwise(1.0) * (whole + (value - whole * 100) / 60)


#: Seconds within which sentences belong to one fix.
TOGETHER = 10


def _fields(row: Column) -> Column:
    """What the cells ``p`` of a sentence say, by its kind; null where it says nothing."""

    def field(name: str, **at: int) -> Column:
        place = F.lit(None).cast("int")
        for kind, i in at.items():
            place = F.when(row["kind"] == kind, i).otherwise(place)
        return F.get(row["p"], place).alias(name)

    number = lambda name, **at: field(name, **at).try_cast("double").alias(name)
    return F.struct(
        row["kind"].alias("kind"), field("clock", RMC=1, GGA=1, GLL=5, ZDA=1), field("short", RMC=9), field("year", ZDA=4), field("month", ZDA=3), field("day", ZDA=2), field("quality", GGA=6), field("state", RMC=2, GLL=6),
        number("lat", RMC=3, GGA=2, GLL=1), field("ns", RMC=4, GGA=3, GLL=2), number("lon", RMC=5, GGA=4, GLL=3), field("ew", RMC=6, GGA=5, GLL=4),
        number("alt", GGA=9), number("speed", RMC=7), number("track", RMC=8), number("hdop", GGA=8),
    )


def _values(f: Column) -> Column:
    """Kind, seconds of the day, midnight, validity and values of a sentence's fields."""
    two = lambda name, at: F.substring(f[name], at, 2)
    seconds = two("clock", 1).try_cast("int") * 3600 + two("clock", 3).try_cast("int") * 60 + F.substring(f["clock"], 5, 20).try_cast("double")
    century = F.when(two("short", 5) < "70", "20").otherwise("19")
    short = F.concat(century, two("short", 5), F.lit("-"), two("short", 3), F.lit("-"), two("short", 1))
    day = F.when(f["kind"] == "ZDA", F.concat_ws("-", f["year"], f["month"], f["day"])).otherwise(short)
    valid = F.when(f["kind"] == "ZDA", F.lit(True)).when(f["kind"] == "GGA", f["quality"] != "0").otherwise(F.coalesce(f["state"], F.lit("A")) != "V")
    return F.struct(
        f["kind"].alias("kind"), seconds.alias("seconds"), day.try_cast("date").cast("timestamp_ntz").alias("midnight"), valid.alias("valid"),
        _degrees(f["lat"], f["ns"]).alias("lat"), _degrees(f["lon"], f["ew"]).alias("lon"), f["alt"].alias("alt"), (f["speed"] * 1.852).alias("speed"), f["track"].alias("track"), f["hdop"].alias("hdop"),
    )


def _sentences(lines: DataFrame) -> DataFrame:
    """file, place, kind, seconds of the day, midnight and values of every valid sentence that has a time."""
    # each step is bound before the next uses it, so that a value is made once; as one projection, a row's code is too long for the JVM to compile
    cells = F.split(F.regexp_replace(F.regexp_extract("value", r"(\$[A-Z]{5},.*)$", 1), r"\*..\s*$", ""), ",")
    named = F.filter(F.transform(F.array(cells), lambda p: F.struct(p.alias("p"), F.substring(F.get(p, F.lit(0)), 4, 3).alias("kind"))), lambda r: r["kind"].isin(*SENTENCES))
    out = lines.select("file", "place", F.inline(F.transform(F.transform(named, _fields), _values)))
    out = saved(out)  # parsed once
    whole = ((F.col("kind") == "ZDA") & F.col("midnight").isNotNull()) | (F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return out.where(F.col("valid") & F.col("seconds").isNotNull() & whole)


def _fix_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the fixes of each stretch (file, stretch, place and seconds come first): a sentence opens one if it is ``TOGETHER`` seconds or more after the fix began, over midnight as well."""
    own = None
    for batch in batches:
        numbers, begun = [], []
        for file, stretch, seconds in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if own != (file, stretch):
                own, number, start = (file, stretch), 0, seconds
            elif (seconds - start) % 86_400 >= TOGETHER:
                number, start = number + 1, seconds
            numbers.append(number)
            begun.append(start)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(begun, pa.float64())], names=[*batch.schema.names, "number", "begun"])


def nmea_fixes(lines: DataFrame) -> DataFrame:
    """Fixes of NMEA lines (file, place, value), put together of RMC, GGA, GLL and ZDA sentences.

    A sentence of the kind that a file begins with opens a fix, as does one ``TOGETHER`` seconds after the fix began; the
    others add what it does not have yet.  A fix's day is that of its first sentence with one; without any it is
    that of the last fix before that has one, or else of the first after, and the next or last day where the clock has gone
    round in between.  Of several fixes of one time the last in the file stays.  Sentences that say they are void count for nothing.

    Files are dealt to tasks by stretches, which begin at the file's own first kind, so a long log is the work of many.
    """
    rows = _sentences(lines)
    first = rows.groupBy("file").agg(F.min_by("kind", "place").alias("first_kind"))
    rows = rows.join(first, "file").withColumn("opens", (F.col("kind") == F.col("first_kind")).cast("int")).drop("first_kind", "valid")
    rows = running(rows, ["file"], ["place"], "stretch", F.col("opens")).withColumn("stretch", F.col("stretch") + F.col("opens"))
    rows = rows.select("file", "stretch", "place", "seconds", "midnight", *COLUMNS)
    numbered = rows.repartition("file", "stretch").sortWithinPartitions("file", "stretch", "place").mapInArrow(_fix_numbers, StructType([*rows.schema.fields]).add("number", LongType()).add("begun", DoubleType()))
    early = F.min_by(F.struct("midnight", "seconds"), F.when(F.col("midnight").isNotNull(), F.col("place")))
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in COLUMNS]
    fixes = numbered.groupBy("file", "stretch", "number").agg(F.min("place").alias("place"), F.first("begun").alias("begun"), early.alias("dated"), *firsts)
    back = F.when(F.col("dated.seconds") < F.col("begun"), 1).otherwise(0)  # the day began within the fix
    own = F.when(F.col("dated.midnight").isNotNull(), F.struct((F.col("dated.midnight") - F.make_dt_interval(back)).alias("midnight"), F.col("begun").alias("seconds")))
    fixes = carried(fixes.withColumn("own", own), ["file"], ["place"], "last", F.col("own"))
    start = fixes.where("own is not null").groupBy("file").agg(F.min_by("own", "place").alias("coming"))
    fixes = fixes.join(start, "file", "left").withColumn("last", F.coalesce("last", "coming"))
    gap = F.col("begun") - F.col("last.seconds")
    wrapped = F.when(gap < -43_200, 86_400).when(gap > 43_200, -86_400).otherwise(0)
    t = F.col("last.midnight") + F.make_dt_interval(secs=(F.col("begun") + F.when(F.col("own").isNull(), wrapped).otherwise(0)).cast("decimal(18,6)"))
    latest = fixes.where("lat is not null").withColumn("t", t).groupBy("file", "t").agg(F.max_by(F.struct(*COLUMNS), "place").alias("fix"))
    return _fixes(latest, F.col("file"), F.col("t"), **{c: F.col(f"fix.{c}") for c in COLUMNS})


def read_nmea(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fixes of NMEA logs; see ``nmea_fixes``."""
    return nmea_fixes(text_lines(spark, path))


def read_tcx(spark: SparkSession, path: str) -> DataFrame:
    """Training files: track points with time, position and altitude."""
    schema = "Time string, Position struct<LatitudeDegrees:double,LongitudeDegrees:double>, AltitudeMeters double"
    rows = spark.read.format("xml").option("recursiveFileLookup", "true").option("rowTag", "Trackpoint").schema(schema).load(path).withColumn("file", F.input_file_name())
    return _fixes(rows, F.col("file"), _zulu(F.col("Time")), lat=F.col("Position.LatitudeDegrees"), lon=F.col("Position.LongitudeDegrees"), alt=F.col("AltitudeMeters"))


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """The newer JSON timeline: segments with a start and points ``geo:lat,lon``, minutes after it."""
    point = "array<struct<point:string,durationMinutesOffsetFromStartTime:string>>"
    rows = spark.read.schema(f"startTime string, timelinePath {point}").json(path, multiLine=True, recursiveFileLookup=True)
    rows = rows.select(F.input_file_name().alias("file"), _zulu(F.col("startTime")).alias("start"), F.explode("timelinePath").alias("p"))
    place = F.split(F.regexp_replace("p.point", r"^geo:|[°\s]", ""), ",")
    minutes = F.coalesce(F.col("p.durationMinutesOffsetFromStartTime").try_cast("double"), F.lit(0.0))
    t = F.col("start") + F.make_dt_interval(secs=(minutes * 60).cast("decimal(18,6)"))
    return _fixes(rows, F.col("file"), t, lat=F.get(place, F.lit(0)).try_cast("double"), lon=F.get(place, F.lit(1)).try_cast("double"))


def track_kind(head: Column) -> Column:
    """Kind of a track log by its first characters; null if it is none.

    XML logs have an element of their kind, JSON logs a key, sentences a dollar sign, two letters of the talker
    and the sentence's name; other text with one of a CSV log's column names in its first line is CSV.
    """
    squeezed = F.regexp_replace(head, r"\s+:", ":")
    any_of = lambda text, marks: F.greatest(*[F.contains(text, F.lit(m)) for m in marks]) if len(marks) > 1 else F.contains(text, F.lit(marks[0]))
    lines = F.split(head, r"\r?\n")
    sentence = F.exists(F.regexp_extract_all(head, F.lit(r"\$[A-Z]{2}([A-Z]{3}),"), 1), lambda x: x.isin(*SENTENCES))
    recorder = F.exists(lines, lambda line: F.greatest(*[F.startswith(line, F.lit(r)) for r in RECORDERS]))
    kinds = {name: any_of(head, tuple(f"<{e}" for e in names)) for name, names in ELEMENTS.items()}
    kinds |= {"nmea": sentence, "igc": recorder, "history": any_of(squeezed, tuple(f'"{k}":' for k in HISTORY_KEYS)), "timeline": any_of(squeezed, tuple(f'"{k}":' for k in TIMELINE_KEYS))}
    kinds["winplus"] = F.exists(lines, lambda line: F.startswith(line, F.lit("TP,D,")))
    kinds["bramor"] = F.exists(lines, lambda line: F.endswith(F.rtrim(line), F.lit(" ypr")))
    kinds["csv"] = F.exists(lines, lambda line: F.exists(F.split(F.lower(line), "[,;\t]"), lambda cell: F.trim(F.replace(cell, F.lit('"'), F.lit(""))).rlike(r"^(gps ?)?(pos)?lat")))
    out = F.lit(None).cast("string")
    for name, hit in reversed(kinds.items()):
        out = F.when(hit, name).otherwise(out)
    return out


def igc_fixes(lines: DataFrame) -> DataFrame:
    """Fixes of flight recorders' lines (file, place, value): B records, dated by the file's HFDTE record."""
    day = F.regexp_extract("value", r"^HFDTE(?:DATE:)?(\d{6})", 1)
    days = lines.where(day != "").groupBy("file").agg(F.min_by(day, "place").alias("day"))
    pattern = r"^B(\d{2})(\d{2})(\d{2})(\d{2})(\d{5})([NS])(\d{3})(\d{5})([EW])A(-?\d{4,5})"
    fixes = lines.where(F.col("value").rlike(pattern)).join(days, "file")
    part = lambda i: F.regexp_extract("value", pattern, i)
    year = F.substring("day", 5, 2).cast("int")
    t = make_ts(year + F.when(year < 70, 2000).otherwise(1900), F.substring("day", 3, 2), F.substring("day", 1, 2), part(1), part(2), part(3))
    size = lambda d, m, half: (part(d).cast("double") + part(m).cast("double") / 60_000) * F.when(part(half).isin("S", "W"), -1).otherwise(1)
    return _fixes(fixes, F.col("file"), t, lat=size(4, 5, 6), lon=size(7, 8, 9), alt=part(10))


def read_igc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Flight recorder files; see ``igc_fixes``."""
    return igc_fixes(text_lines(spark, path))


def read_location_history(spark: SparkSession, path: str) -> DataFrame:
    """JSON location history: ``locations`` with timestampMs and E7 degrees."""
    schema = "locations array<struct<timestampMs:string,latitudeE7:bigint,longitudeE7:bigint,altitude:double,velocity:double,heading:double>>"
    rows = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.explode("locations").alias("p"))
    t = epoch_to_ts(F.floor(F.col("p.timestampMs").try_cast("bigint") / 1000))
    return _fixes(rows, F.col("file"), t, lat=F.col("p.latitudeE7") / 1e7, lon=F.col("p.longitudeE7") / 1e7, alt=F.col("p.altitude"), speed=F.col("p.velocity") * 3.6, track=F.col("p.heading"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of all logs below a folder whatever their kind, which the first line that shows one tells.

    Lines are joined with their file's kind; XML and JSON readers look for their own elements in all files.  So each kind of log
    scans the folder once, but no file is loaded whole to be sniffed, and no list of names is made.
    """
    lines = text_lines(spark, path)
    kinds = lines.select("file", "place", track_kind(F.col("value")).alias("kind")).where("kind is not null").groupBy("file").agg(F.min_by("kind", "place").alias("kind"))
    kinds = saved(kinds)
    texts = {"nmea": nmea_fixes, "igc": igc_fixes, "winplus": winplus_fixes, "bramor": bramor_fixes, "csv": csv_fixes}
    trees = {"tcx": read_tcx, "kml": read_kml, "gpx": read_gpx, "history": read_location_history, "timeline": read_timeline}
    of = lambda kind: kinds.where(F.col("kind") == kind).select("file")
    out = None
    for kind, fixes in texts.items():
        own = fixes(lines.join(of(kind), "file", "left_semi"))
        out = own if out is None else out.unionByName(own)
    for kind, read in trees.items():
        out = out.unionByName(read(spark, path).join(of(kind).withColumnRenamed("file", "device"), "device", "left_semi"))
    return out


def number_fixes(fixes: DataFrame) -> DataFrame:
    """fixes in order of time, numbered per device from 0."""
    return running(fixes, ["device"], ["t"], "number")
