"""One query for each operator, over the driver's tables; ``oracles`` has the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumflow.functions import dates, filetypes, numbers, paths, text
from albumflow.functions.template import Template
from albumflow.operators import asof, edits, nearest, records, resolve_date, route, sidecar_join
from albumflow.operators import lenses as lenses_of
from albumflow.plans import pipeline, views
from albumflow.sources import records as read_records
from albumflow.sources import tracks

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}
col = F.col


def query(f: Query) -> Query:
    CATALOGUE[f.__name__] = f
    return f


# Files: filter, classify, parse.


@query
def ext_filter(spark, sf_dir):
    return views.media(spark, sf_dir).where(paths.is_media(col("ext"))).select("path", "ext")


@query
def ext_include_exclude(spark, sf_dir):
    ok = paths.extension_accepted(col("ext"), include=[".jpg", ".mov", "*"], exclude=[".gif", ".bin"])
    return views.media(spark, sf_dir).select("path", ok.alias("accepted"))


@query
def classify_kind(spark, sf_dir):
    return views.media(spark, sf_dir).select("path", paths.kind_of(col("ext")).alias("kind"))


@query
def classify_heic(spark, sf_dir):
    return views.media(spark, sf_dir).select("path", paths.is_video(col("ext")).alias("is_video"), paths.is_heic(col("ext")).alias("is_heic"))


@query
def file_types(spark, sf_dir):
    """Pages as files: their bytes, or behind the head of a picture, an archive, a movie or a text."""
    n, html = col("page_id"), F.encode("html", "UTF-8")
    heads = [b"", b"\x89PNG\r\n\x1a\n", b"PK\x03\x04", b"\0\0\0\x18ftypqt  ", b"RIFF\0\0\0\0WEBP", b"II*\0\0\0\0\0CR\x02", b"?"]
    content = F.concat(F.element_at(F.array(*[F.lit(bytearray(h)) for h in heads]), (n % len(heads) + 1).cast("int")), html)
    ext = F.when(n % 2 == 0, ".DOCX").otherwise(".mov")
    return views.load(spark, sf_dir, "pages").select("page_id", filetypes.file_type(content, ext).alias("kind"))


@query
def path_parts(spark, sf_dir):
    own = views.media(spark, sf_dir).select("path").unionByName(views.load(spark, sf_dir, "pages").select(col("url").alias("path")))
    name = paths.name_of(col("path"))
    return own.select("path", paths.dir_of(col("path")).alias("dir"), name.alias("name"), paths.stem_of(name).alias("stem"), paths.ext_of(name).alias("ext"))


@query
def file_template(spark, sf_dir):
    name = paths.fill_template("%d%3f_%f.%e", col("dir"), col("stem"), col("ext"))
    return views.media(spark, sf_dir).select("path", name.alias("target"))


@query
def strict_date_parse(spark, sf_dir):
    return views.media(spark, sf_dir).select("path", dates.strict_parse(col("meta")).alias("capture_ts"))


@query
def invalid_date_flag(spark, sf_dir):
    return views.media(spark, sf_dir).select("path", dates.invalid_date(dates.strict_parse(col("meta"))).alias("invalid"))


@query
def date_coalesce(spark, sf_dir):
    return resolve_date.embedded_date(views.dated_sources(spark, sf_dir)).select("path", col("embedded").alias("capture_ts"))


@query
def sidecar_json_extract(spark, sf_dir):
    return views.sidecars(spark, sf_dir).select("json_name", F.coalesce(text.sidecar_seconds(col("body")), F.lit(-1)).alias("seconds"))


@query
def json_number(spark, sf_dir):
    k = text.whole_number(F.get_json_object("props", "$.k"))
    return views.load(spark, sf_dir, "events").select("event_id", k.alias("k"))


@query
def epoch_to_ts_guarded(spark, sf_dir):
    n = text.sidecar_seconds(col("body")) * F.when(col("event_id") % 4 == 0, 1000).otherwise(1)
    return views.sidecars(spark, sf_dir).select("json_name", dates.epoch_to_ts(n).alias("ts"))


@query
def quicktime_dates(spark, sf_dir):
    raw = dates.ts_to_epoch(col("ts")) + F.when(col("event_id") % 2 == 0, dates.QUICKTIME_OFFSET).otherwise(0)
    return views.media(spark, sf_dir).select("path", dates.epoch_to_ts(dates.quicktime_epoch(raw)).alias("ts"))


@query
def exif_unix_roundtrip(spark, sf_dir):
    seconds = dates.exif_to_unix(col("meta"))
    return views.media(spark, sf_dir).select("path", F.coalesce(seconds, F.lit(0)).alias("seconds"), dates.unix_to_exif(seconds).alias("exif"))


# Sidecar joins and the pipeline.


@query
def sidecar_prefix_join(spark, sf_dir):
    return sidecar_join.match(views.media(spark, sf_dir), views.sidecars(spark, sf_dir)).select("path", "json_name", F.coalesce("rule", F.lit(0)).alias("rule"))


@query
def sidecar_first_listed(spark, sf_dir):
    return sidecar_join.match(views.media(spark, sf_dir), views.sidecars(spark, sf_dir), "first_listed").select("path", "json_name")


@query
def conditional_fallback(spark, sf_dir):
    own = resolve_date.embedded_date(views.files(spark, sf_dir))
    return resolve_date.resolve(own, views.sidecars(spark, sf_dir)).select("path", "capture_ts", "date_source", "no_date")


@query
def bucket_day(spark, sf_dir):
    day = col("o_orderdate")
    return views.load(spark, sf_dir, "orders").groupBy(dates.year_bucket(day).alias("year"), dates.bucket(day).alias("bucket")).agg(F.count("*").alias("files"))


@query
def bucket_month(spark, sf_dir):
    return views.load(spark, sf_dir, "lineitem").groupBy(dates.bucket(col("l_shipdate"), "month").alias("bucket")).agg(F.count("*").alias("files"))


def _routed(spark, sf_dir, **config):
    return pipeline.run(views.files(spark, sf_dir), views.sidecars(spark, sf_dir), pipeline.Config(**config))


@query
def route_path(spark, sf_dir):
    return _routed(spark, sf_dir).manifest.select("source_path", "target_path", "message")


@query
def route_path_month(spark, sf_dir):
    return _routed(spark, sf_dir, granularity="month").manifest.select("source_path", "target_path")


@query
def collision_last(spark, sf_dir):
    return route.with_collisions(views.contested(spark, sf_dir)).select("path", "target_path", "status")


@query
def collision_report(spark, sf_dir):
    return route.collisions(views.contested(spark, sf_dir)).select("target_path", "kept_path", "sources")


@query
def copy_number(spark, sf_dir):
    return route.copy_numbers(views.contested(spark, sf_dir)).select("path", "target_path", col("copy_number").cast("long").alias("copy_number"))


@query
def summary_by_kind(spark, sf_dir):
    return _routed(spark, sf_dir).summary


@query
def summary_compat(spark, sf_dir):
    return _routed(spark, sf_dir, line_summary=True).summary


@query
def progress_percent(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    return e.select("event_id", route.percent(col("event_id") % 101, F.lit(100)).alias("percent"))


@query
def pipeline_classic(spark, sf_dir):
    rows = _routed(spark, sf_dir).manifest
    return rows.groupBy("kind", "year", "bucket").agg(F.count("*").alias("files"))


@query
def pipeline_fast(spark, sf_dir):
    rows = _routed(spark, sf_dir, mode="fast").manifest
    return rows.groupBy("kind", "year", "bucket").agg(F.count("*").alias("files"))


@query
def sequence_per_dir(spark, sf_dir):
    return route.number_in_folder(views.media(spark, sf_dir)).select("path", col("folder_number").cast("long").alias("folder_number"))


# Overrides, tracks, places.


@query
def override_join(spark, sf_dir):
    people = views.load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    segments = people.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("limit")).where(F.substring("c_mktsegment", 1, 1) < "H")
    general = people.agg(F.lit("*").alias("c_mktsegment"), F.min("c_acctbal").alias("limit"))
    return records.override(people, segments.unionByName(general), "c_mktsegment", ["limit"]).select("c_custkey", "c_mktsegment", "limit")


@query
def asof_previous(spark, sf_dir):
    rows = asof.bracket(views.track(spark, sf_dir, False), views.track(spark, sf_dir, True), "device", "t", ["value"])
    return rows.select("event_id", "before.t", "before.value")


@query
def asof_interpolate(spark, sf_dir):
    points = views.track(spark, sf_dir, False).drop("value")
    rows = asof.interpolate(points, views.track(spark, sf_dir, True), "device", "t", ["value"], max_gap=40_000, max_reach=20_000)
    return rows.select("event_id", F.round("value", 4).alias("value"), "position")


@query
def clock_drift(spark, sf_dir):
    syncs = [(1704067200.0, 1704067260.0), (1704672000.0, 1704672030.0), (1705536000.0, 1705536090.0)]
    return views.load(spark, sf_dir, "events").select("event_id", F.round(asof.drift(dates.ts_to_epoch(col("ts")), syncs), 3).alias("corrected"))


@query
def quality_cut(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").select("event_id", F.when(col("event_id") % 4 != 0, col("value")).alias("hdop"), (col("event_id") % 9).alias("nsats"))
    return asof.quality_cut(e, max_hdop=50.0, min_satellites=4)


@query
def track_merge(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").select(col("user_id").alias("device"), F.date_trunc("day", col("ts")).cast("timestamp_ntz").alias("t"), "value")
    logs = [e.groupBy("device", "t").agg(F.max("value").alias("value")), e.where("value < 50").groupBy("device", "t").agg(F.min("value").alias("value"))]
    return asof.merge_tracks(logs)


def _spots(rows, key):
    n = col(key)
    return rows.select(key, (n * 37 % 1700 / 10.0 - 85).alias("lat"), (n * 91 % 3600 / 10.0 - 180).alias("lon"))


@query
def nearest_place(spark, sf_dir):
    points = _spots(views.load(spark, sf_dir, "customer"), "c_custkey")
    places = _spots(views.load(spark, sf_dir, "supplier"), "s_suppkey")
    rows = nearest.nearest(points, places, "c_custkey", "s_suppkey", max_km=2500.0, k=3)
    return rows.select("c_custkey", "s_suppkey", F.round("km", 2).alias("km"), col("rank").cast("long").alias("rank"))


@query
def haversine_bearing(spark, sf_dir):
    n = col("c_custkey")
    p = views.load(spark, sf_dir, "customer").select(n, (n % 170 - 85.0).alias("a"), (n * 7 % 360 - 180.0).alias("b"), (n * 13 % 170 - 84.5).alias("c"), (n * 29 % 360 - 179.5).alias("d"))
    km, way = numbers.haversine_km(*map(col, "abcd")), numbers.bearing(*map(col, "abcd"))
    return p.select("c_custkey", F.round(km, 2).alias("km"), way.alias("bearing"))


@query
def places_by_population(spark, sf_dir):
    s = views.load(spark, sf_dir, "supplier").select(
        col("s_name").alias("city"), F.lit("").alias("country"), F.lit("").alias("country_code"), F.floor("s_acctbal").alias("population"))
    return nearest.places_named(s, pattern="0[0-9]*[1-5]$", min_population=100).select("city", "population")


# Records.


@query
def full_outer_diff(spark, sf_dir):
    p = views.load(spark, sf_dir, "part").select("p_partkey", col("p_brand").alias("v"))
    n = col("p_partkey")
    old = p.where(n % 10 != 0)
    new = p.where(n % 11 != 0).withColumn("v", F.when(n % 7 == 0, F.concat("v", F.lit("x"))).when(n % 13 == 0, None).otherwise(col("v")))
    return records.diff(old, new, ["p_partkey"], "v").select("p_partkey", "left_value", "right_value", "side")


@query
def sentence_fixes(spark, sf_dir):
    return tracks.nmea_fixes(views.sentences(spark, sf_dir)).select("device", "t", *[F.round(c, 6).alias(c) for c in tracks.COLUMNS])


@query
def tag_descriptions(spark, sf_dir):
    """Parts as tags, named in some languages and not in others."""
    p = views.load(spark, sf_dir, "part").select(F.concat(F.lit("PartNo"), "p_partkey").alias("tag"), "p_partkey", "p_name")
    k = col("p_partkey")
    texts = F.array(*[F.struct(F.lit(lang).alias("language"), F.when(k % step != 0, F.concat(F.lit(f"{lang}: "), "p_name")).alias("text")) for lang, step in (("fr_CA", 2), ("FR", 3), ("de", 1), ("en", 5))])
    names = p.select(F.upper("tag").alias("tag"), F.inline(texts))
    return records.localised(p.select("p_partkey", "tag"), names, "fr-ca")


@query
def diff_repeats(spark, sf_dir):
    """Orders as records whose values repeat: some lines go, some change, some are written twice."""
    n, v = col("l_linenumber"), (col("l_quantity") % 5).cast("int")
    lines = views.load(spark, sf_dir, "lineitem").select("l_orderkey", n, F.when(col("l_partkey") % 23 != 0, v).alias("v"))
    again = F.when((col("l_orderkey") + n) % 9 == 0, 2).otherwise(1)
    new = lines.where((col("l_orderkey") * 3 + n) % 11 != 0).withColumn("v", F.when((col("l_orderkey") + n) % 7 == 0, col("v") + 1).otherwise(col("v")))
    new = new.select("l_orderkey", "v", F.explode(F.array_repeat(F.lit(1), again)))
    return records.diff(lines, new, ["l_orderkey"], "v")


@query
def natural_sort_rank(spark, sf_dir):
    from pyspark.sql import Window

    rows = views.media(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(*records.file_order(rows, ["name"], "path")))
    return rows.select("path", rank.cast("long").alias("rank"))


@query
def dedupe_by_priority(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    return records.first_by(e, ["user_id", "event_type"], [-col("value"), col("event_id")], ["event_id", "value"])


@query
def duplicate_tags(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    return records.copies(e, ["user_id", "event_type"], [col("ts").desc(), col("event_id")]).select("event_id", col("copy_no").cast("long").alias("copy_no"))


@query
def tag_selection(spark, sf_dir):
    t = views.load(spark, sf_dir, "events").select("event_id", col("event_type").alias("tag"), F.when(col("event_id") % 2 == 0, "EXIF").otherwise("XMP").alias("group0"), F.lit("Main").alias("group1"))
    return records.select_tags(t, ["*i*", "XMP:all"], exclude=["EXIF:c*"]).select("event_id", "tag", "group0")


@query
def combine_first_wins(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    first = e.where("value > 60").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    rest = e.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return records.combine([first, rest], ["user_id"])


@query
def pivot_union_columns(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("string").alias("n"))
    return records.wide_report(e, "user_id", "event_type", "n", missing="-")


@query
def list_join_distinct(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    own = F.array_sort(F.collect_list("event_type"))
    rows = e.groupBy("user_id").agg(text.join_list(own).alias("types"))
    twice = F.concat("types", F.lit(", "), "types")
    return rows.select("user_id", text.distinct_list(twice).alias("types"), text.list_item(text.split_list(col("types")), 1).alias("second"))


@query
def json_flatten(spark, sf_dir):
    return read_records.flatten_json(views.load(spark, sf_dir, "events"), "props", ["event_id"]).select("event_id", "tag", "value")


@query
def json_flatten_deep(spark, sf_dir):
    """Objects in lists in objects, some deeper than others, some no JSON."""
    n, text = col("event_id"), lambda c: F.to_json(F.struct(c.alias("x")))
    body = F.concat(
        F.lit('{"own":'), col("props"), F.lit(',"user":{"id":'), col("user_id").cast("string"), F.lit(',"seen":['), F.to_json(F.struct(col("event_type").alias("kind"))), F.lit(",true,null,"), n.cast("string"),
        F.when(n % 3 == 0, F.concat(F.lit(',{"deep":{"er":['), text(n % 7), F.lit(","), text(n % 5), F.lit("]}}"))).otherwise(""), F.lit(']},"none":{},"empty":[]}'))
    rows = views.load(spark, sf_dir, "events").select("event_id", F.when(n % 50 == 7, "{broken").otherwise(body).alias("body"))
    return read_records.flatten_json(rows, "body", ["event_id"])


@query
def lens_matches(spark, sf_dir):
    """Every part as a lens, of 50 types, and every line as a photo."""
    lenses_of.long_dictionaries(spark)
    k = col("p_partkey")
    short, spread = k % 9 * 10 + 18, k % 4 * 30
    wide, more = (k % 5 + 14) / 5, k % 3
    span = lambda a, b: F.concat(a.cast("string"), F.when(b > a, F.concat(F.lit("-"), b.cast("string"))).otherwise(""))
    name = F.concat(F.lit("No. "), k.cast("string"), F.lit(" "), span(short, short + spread), F.lit("mm F"), span(wide, wide + more))
    lenses = views.load(spark, sf_dir, "part").select((k % 50).alias("lens_type"), k.alias("place"), name.alias("name")).select("*", lenses_of.lens_ranges(col("name")).alias("r")).select("lens_type", "place", "name", "r.*")
    lines = views.load(spark, sf_dir, "lineitem")
    photos = lines.select(
        "l_orderkey", "l_linenumber", (col("l_partkey") % 51).alias("lens_type"), F.when(col("l_suppkey") % 10 != 0, col("l_quantity") * 3 + 5).alias("focal"), F.when(col("l_suppkey") % 7 != 0, F.round(col("l_discount") * 30 + 2.7, 2)).alias("aperture"))
    return lenses_of.identify(photos, lenses).select("l_orderkey", "l_linenumber", "lens")


@query
def shift_runs(spark, sf_dir):
    """Every user's events move as far as a month moves the first of them."""
    return edits.shift_runs(views.load(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], ["ts"], "+0:1:0 0:0:30")


@query
def shift_by_anchor(spark, sf_dir):
    """Orders as files whose tags are dates: all move as far as 13 months before move the date of the anchor."""
    o = views.load(spark, sf_dir, "orders").select(col("o_orderkey").alias("source_file"), col("o_orderdate").alias("d"))
    day = lambda n: col("d") + F.make_dt_interval(F.lit(n))
    anchor = F.when(col("source_file") % 6 == 0, "Other").otherwise("CreateDate")
    dated = F.array(*[F.struct(tag.alias("tag"), value.alias("value"), F.lit(i).alias("file_order")) for i, (tag, value) in enumerate([(F.lit("ModifyDate"), day(40)), (anchor, col("d")), (F.lit("CreateDate"), F.when(col("source_file") % 3 == 0, day(1)))])])
    return edits.shift_by_tag(o.select("source_file", F.inline(dated)), "createdate", "-1:1:0 0")


@query
def struct_json(spark, sf_dir):
    o = views.load(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(col("o_orderstatus").alias("status"), col("o_custkey").alias("customer"))).alias("body"))


# Scalar functions.


@query
def date_shift_overflow(spark, sf_dir):
    day = col("o_orderdate")
    return views.load(spark, sf_dir, "orders").select("o_orderkey", dates.shift_by(day, "1:1:0 5:30").alias("later"), dates.shift_by(day, "-0:2:3 0").alias("earlier"))


@query
def date_shift_seconds(spark, sf_dir):
    o = views.load(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.shift_seconds(col("o_orderdate"), F.pmod("o_orderkey", F.lit(100_000))).alias("shifted"))


@query
def month_lengths(spark, sf_dir):
    return views.load(spark, sf_dir, "orders").select("o_orderkey", dates.days_in_month(col("o_orderdate")).alias("days"))


@query
def date_format_tolerant(spark, sf_dir):
    return views.media(spark, sf_dir).select("path", dates.format_tolerant(col("meta"), "%Y/%m/%d at %H.%M").alias("shown"))


@query
def subsecond_merge(spark, sf_dir):
    n = col("event_id")
    own = dates.merge_subseconds(col("meta"), (n % 1000).cast("string"), F.when(n % 2 == 0, dates.zone_text(n % 1440 - 720)))
    return views.media(spark, sf_dir).select("path", own.alias("full"))


@query
def human_size(spark, sf_dir):
    n = col("n_chars") * col("n_chars") * 7
    return views.load(spark, sf_dir, "documents").select("doc_id", numbers.human_size(n).alias("shown"))


@query
def human_duration(spark, sf_dir):
    return views.load(spark, sf_dir, "documents").select("doc_id", dates.human_span(col("n_chars") * 31 % 400_000).alias("shown"))


@query
def human_bitrate(spark, sf_dir):
    return views.load(spark, sf_dir, "documents").select("doc_id", numbers.human_bitrate(col("n_chars") * col("n_chars") + 0.25).alias("shown"))


@query
def dms_roundtrip(spark, sf_dir):
    n = col("c_custkey")
    lat = (n * 7919 % 1_800_000) / 10_000.0 - 90
    dms = numbers.to_dms(lat, "N", "S")
    return views.load(spark, sf_dir, "customer").select(n, dms.alias("dms"), F.round(numbers.from_dms(dms), 5).alias("degrees"))


def _camera(spark, sf_dir):
    p = views.load(spark, sf_dir, "part")
    return p.select("p_partkey", (col("p_size") % 20 + 1.4).alias("f"), (1.0 / (col("p_partkey") % 500 + 1)).alias("t"), (col("p_size") % 7 * 100.0).alias("iso"), (col("p_size") + 10.0).alias("focal"), (col("p_partkey") % 40 + 1.0).alias("distance"))


@query
def light_value(spark, sf_dir):
    return _camera(spark, sf_dir).select("p_partkey", F.round(numbers.light_value(col("f"), col("t"), col("iso")), 4).alias("lv"), numbers.exposure_text(col("t")).alias("exposure"))


@query
def megapixels(spark, sf_dir):
    w, h = col("p_size") * 100, col("p_partkey") % 4000 + 1
    return views.load(spark, sf_dir, "part").select("p_partkey", F.round(numbers.megapixels(w, h), 6).alias("mp"), numbers.image_size(w, h).alias("size"))


@query
def depth_of_field(spark, sf_dir):
    coc = numbers.circle_of_confusion(F.lit(1.5))
    d = numbers.depth_of_field(col("focal"), col("f"), coc, col("distance"))
    fov, hyper = numbers.field_of_view(col("focal"), F.lit(1.5)), numbers.hyperfocal(col("focal"), col("f"), coc)
    return _camera(spark, sf_dir).select("p_partkey", F.round(d["near"], 4).alias("near"), F.round(d["far"], 3).alias("far"), F.round(fov, 4).alias("fov"), F.round(hyper, 4).alias("hyper"))


@query
def derived_columns(spark, sf_dir):
    table = {
        "lv": records.Derived(("f", "t", "iso"), numbers.light_value),
        "lv_text": records.Derived(("lv",), lambda v: F.format_string("%.1f", v)),
        "never": records.Derived(("missing",), lambda v: v),
    }
    return records.add_derived(_camera(spark, sf_dir), table).select("p_partkey", "lv_text")


@query
def bitmask_decode(spark, sf_dir):
    names = {0: "fired", 1: "returned", 2: "auto", 3: "red-eye"}
    own = numbers.bits_set(col("p_size"), names, 8)
    return views.load(spark, sf_dir, "part").select("p_partkey", own.alias("bits"), numbers.bits_from(own, names).alias("known"))


@query
def enum_decode(spark, sf_dir):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    return views.load(spark, sf_dir, "orders").select("o_orderkey", numbers.decode(col("o_orderpriority"), names).alias("priority"))


@query
def content_hash_duplicates(spark, sf_dir):
    d = views.load(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query
def histogram20(spark, sf_dir):
    rows = views.load(spark, sf_dir, "lineitem")
    return rows.groupBy(numbers.histogram_bin(col("l_quantity"), 1.0, 50.0).alias("bin")).agg(F.count("*").alias("rows"))


@query
def truncation_recovery(spark, sf_dir):
    t = col("text")
    short = F.when(col("doc_id") % 3 == 0, F.concat(F.substring(t, 1, 31), F.lit("#"))).otherwise(F.substring(t, 1, 32))
    return views.load(spark, sf_dir, "documents").select("doc_id", F.md5(text.recovered(short, t, 32)).alias("digest"))


@query
def filter_expr_null_semantics(spark, sf_dir):
    bad = dates.strict_parse(col("meta")) < F.lit("2024-01-15").cast("timestamp_ntz")
    rows = views.media(spark, sf_dir)
    return rows.select("path", edits.condition(bad).alias("passes"), edits.negated(bad).alias("negated"))


@query
def conditional_edit(spark, sf_dir):
    o = views.load(spark, sf_dir, "orders")
    new = edits.overwrite_if(col("o_orderstatus"), F.lit("O"), F.lit("open"))
    return o.select("o_orderkey", new.alias("status"))


@query
def list_edit(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    out = edits.remove_items(edits.add_items(col("types"), F.array(F.lit("zoom")), distinct=True), F.array(F.lit("click")))
    return e.select("user_id", text.join_list(out).alias("types"))


@query
def csv_quote(spark, sf_dir):
    return views.load(spark, sf_dir, "documents").select("doc_id", F.md5(text.csv_cell(col("text"))).alias("digest"))


@query
def json_escape(spark, sf_dir):
    return views.load(spark, sf_dir, "documents").select("doc_id", F.md5(text.json_text(col("text"))).alias("digest"))


@query
def xml_escape(spark, sf_dir):
    p = views.load(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(text.xml_escape(col("html"))).alias("digest"), (text.xml_unescape(text.xml_escape(col("html"))) == col("html")).alias("same"))


@query
def report_template(spark, sf_dir):
    rows = records.section_report(views.media(spark, sf_dir), ["dir"], ["event_id"], F.concat(F.lit("# "), F.coalesce(F.substring("meta", 1, 10), F.lit("none"))), F.concat(F.lit("- "), col("name")))
    return rows.select("path", "line")


@query
def tag_names(spark, sf_dir):
    n = F.concat(F.initcap("event_type"), F.lit("Date"), col("user_id").cast("string"), F.lit("GPSInfo!"))
    return views.load(spark, sf_dir, "events").select("event_id", text.describe_tag(text.clean_tag(n)).alias("label"))


@query
def csv_report(spark, sf_dir):
    o = views.load(spark, sf_dir, "orders").withColumn("note", F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')))
    return o.select("o_orderkey", records.csv_lines(o, ["o_orderkey", "note", "o_custkey"]).alias("line"))


# Smaller operators.


@query
def date_texts(spark, sf_dir):
    compact = F.date_format("ts", "yyyyMMdd")
    clock = F.concat(F.date_format("ts", "HHmmss"), F.lit("+0100"))
    return views.media(spark, sf_dir).select("path", dates.normal_date(compact).alias("day"), dates.normal_time(clock).alias("clock"), dates.date_problem(col("meta")).alias("problem"))


@query
def gps_times(spark, sf_dir):
    n = col("event_id")
    own = dates.gps_time(n % 24, (n % 60).cast("double"), n % 60 + F.when(n % 2 == 0, 0.25).otherwise(0.0))
    return views.media(spark, sf_dir).select("path", own.alias("clock"))


@query
def shift_every_date(spark, sf_dir):
    rows = views.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.add_months("o_orderdate", 0).cast("timestamp_ntz").alias("day"))
    return dates.shift_all(rows, "0:0:1 2")


@query
def rational_text(spark, sf_dir):
    return views.load(spark, sf_dir, "part").select("p_partkey", numbers.rational(col("p_size") / 8.0, 16).alias("fraction"))


@query
def list_texts(spark, sf_dir):
    o = views.load(spark, sf_dir, "orders")
    items = F.array("o_orderstatus", F.concat("o_orderpriority", F.lit('; "x"')))
    joined = text.quoted_list(items)
    back = text.filter_items(text.unquoted_list(joined), F.lower)
    return o.select("o_orderkey", joined.alias("joined"), text.join_list(back, "|").alias("items"))


@query
def struct_texts(spark, sf_dir):
    o = views.load(spark, sf_dir, "orders")
    pairs = F.create_map(F.lit("b"), F.concat("o_orderpriority", F.lit(",}")), F.lit("a"), col("o_orderstatus"))
    shown = text.struct_text(pairs)
    return o.select("o_orderkey", shown.alias("shown"), text.same_map(text.text_struct(shown), pairs).alias("same"))


@query
def bytes_as_text(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    data = F.when(col("event_id") % 2 == 0, F.unhex(F.lit("FF00"))).otherwise(F.encode("event_type", "UTF-8"))
    return e.select("event_id", text.decode_bytes(data).alias("shown"), text.decode_bytes(F.encode("event_type", "UTF-16BE"), "UTF-16BE").alias("wide"))


@query
def tag_sort_rank(spark, sf_dir):
    from pyspark.sql import Window

    t = views.load(spark, sf_dir, "events").select(col("user_id").alias("source_file"), col("event_type").alias("tag"), F.substring("event_type", 1, 1).alias("group0"), col("event_id").alias("file_order"))
    keyed = t
    for i, key in enumerate(records.tag_order(t, "group")):
        keyed = keyed.withColumn(f"k{i}", key)
    rank = F.row_number().over(Window.partitionBy("source_file").orderBy("k0", "k1"))
    return keyed.select("file_order", rank.cast("long").alias("rank"))


@query
def copy_from_other_file(spark, sf_dir):
    m = views.media(spark, sf_dir).select("event_id", "meta")
    return records.tags_from_file(m.where("event_id % 2 = 0"), m.where("event_id % 2 = 1"), col("event_id") + 1, "event_id", ["meta"])


@query
def alternate_source(spark, sf_dir):
    m = views.media(spark, sf_dir)
    listing = m.where("event_id % 3 <> 0").select("path")
    options = [col("path"), F.concat_ws("/", "dir", F.concat("stem", F.lit(".mp4")))]
    return records.first_existing(m.select("path", "dir", "stem"), listing, options).select("path", "source")


@query
def run_counts(spark, sf_dir):
    rows = route.with_collisions(views.contested(spark, sf_dir)).withColumn("dir", F.substring_index("path", "/", 1))
    return records.run_counters(rows)


@query
def interpolate_each_value(spark, sf_dir):
    fixes = views.track(spark, sf_dir, True).select("device", "t", "value", F.when(col("event_id") % 4 == 0, col("value") * 2).alias("alt"))
    points = views.track(spark, sf_dir, False).select("event_id", "device", "t")
    rows = asof.interpolate_each(points, fixes, "device", "t", ["value", "alt"], max_gap=200_000, max_reach=50_000)
    return rows.select("event_id", F.round("value", 4).alias("value"), F.round("alt", 4).alias("alt"))


@query
def camera_fallbacks(spark, sf_dir):
    n = col("p_partkey")
    p = views.load(spark, sf_dir, "part").select(n, F.when(n % 3 == 0, 0.0).when(n % 3 == 1, n * 1.0).alias("a"), (n % 5).cast("double").alias("b"), F.when(n % 7 == 0, 30.0).alias("bulb"))
    return p.select("p_partkey", numbers.aperture(col("a"), col("b")).alias("aperture"), numbers.shutter_speed(col("a"), col("b"), col("bulb")).alias("shutter"), numbers.balance(col("b"), n.cast("double")).alias("red"))


# Dates, numbers and texts that are shown or typed in.


@query
def elapsed_time(spark, sf_dir):
    return views.load(spark, sf_dir, "documents").select("doc_id", dates.elapsed_text(col("n_chars") * 37).alias("shown"))


@query
def shortened_text(spark, sf_dir):
    return views.load(spark, sf_dir, "documents").select("doc_id", text.shortened(col("text")).alias("shown"))


@query
def gated_sources(spark, sf_dir):
    n = col("event_id")
    digest = F.when(n % 3 == 0, "new").when(n % 3 == 1, "old")
    return views.media(spark, sf_dir).select("path", text.gated_coalesce(digest, F.lit("new"), F.when(n % 5 != 0, col("name")), col("meta"), col("dir")).alias("value"))


@query
def safe_names(spark, sf_dir):
    raw = F.concat("dir", F.lit('/<"'), "name", F.lit('":?*|\\'))
    return views.media(spark, sf_dir).select("path", paths.safe_name(raw).alias("safe"))


@query
def signed_positions(spark, sf_dir):
    n = col("event_id")
    lat = numbers.signed_degrees(n % 90 + 0.5, F.when(n % 2 == 0, "South").otherwise("N"))
    lon = numbers.signed_degrees(n % 180 + 0.25, F.when(n % 3 == 0, "w").otherwise("E"))
    return views.media(spark, sf_dir).select("path", lat.alias("lat"), lon.alias("lon"))


@query
def written_dates(spark, sf_dir):
    n, stamp = col("event_id"), lambda form: F.date_format("ts", form)
    typed = (
        F.when(n % 5 == 0, stamp("yyyy-M-d H:mm")).when(n % 5 == 1, F.concat(stamp("yyyy/MM/dd HH:mm:ss"), F.lit(".25 +2:30")))
        .when(n % 5 == 2, F.concat(stamp("yyyyMMddHHmmss"), F.lit("Z"))).when(n % 5 == 3, F.concat(F.lit("2024:13:"), stamp("dd HH:mm:ss"))).otherwise("soon")
    )
    formed = dates.written_date(stamp("d.M.yyyy HH:mm:ss"), strftime="%d.%m.%Y %H:%M:%S")
    return views.media(spark, sf_dir).select("path", dates.written_date(typed).alias("value"), dates.written_date(typed, keep_zone=False).alias("bare"), formed.alias("formed"))


@query
def date_format_strict(spark, sf_dir):
    return views.media(spark, sf_dir).select("path", dates.format_tolerant(col("meta"), "%d/%m/%y", strict=True).alias("shown"))


@query
def date_directives(spark, sf_dir):
    full = F.concat("meta", F.lit("."), F.lpad((col("event_id") % 1000).cast("string"), 3, "0"), F.when(col("event_id") % 2 == 0, "+05:30").otherwise(""))
    return views.media(spark, sf_dir).select(
        "path", dates.format_tolerant(full, "%Y-%m-%dT%H:%M:%S%1f%:z").alias("iso"), dates.format_tolerant(full, "%s %-f %z%%", strict=True).alias("epoch"))


@query
def xmp_dates(spark, sf_dir):
    n = col("event_id")
    own = F.when(n % 4 == 0, F.date_format("ts", "yyyy:MM")).when(n % 4 == 1, F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm"), F.lit("Z"))).when(n % 4 == 2, F.concat("meta", F.lit("+01:00"))).otherwise("2024:00:10")
    return views.media(spark, sf_dir).select("path", dates.xmp_date_problem(own).alias("problem"))


@query
def lens_texts(spark, sf_dir):
    c = _camera(spark, sf_dir)
    lens = numbers.lens_text(col("focal"), F.when(col("p_partkey") % 2 == 0, col("focal") + 50), F.lit(3.5), F.lit(5.6))
    return c.select("p_partkey", numbers.f_number_text(col("f") * 0.31).alias("f_number"), numbers.focal_length_text(col("focal"), numbers.scale_factor(col("focal") + 20, col("focal"))).alias("focal"), lens.alias("lens"))


@query
def significant_digits(spark, sf_dir):
    p = views.load(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(numbers.round_digits(col("p_retailprice"), 2), 4).alias("two"), numbers.first_number(col("p_brand")).alias("number"))


@query
def coordinate_forms(spark, sf_dir):
    lat = (col("c_custkey") * 7919 % 1_800_000) / 10_000.0 - 90
    forms = {"full": "%d deg %d' %.2f", "short": "%d %.3f'", "plain": "%+.4f"}
    return views.load(spark, sf_dir, "customer").select("c_custkey", *[numbers.degrees_text(lat, form).alias(name) for name, form in forms.items()])


@query
def binary_sizes(spark, sf_dir):
    return views.load(spark, sf_dir, "documents").select("doc_id", numbers.human_size(col("n_chars") * col("n_chars") * 7, binary=True).alias("shown"))


@query
def php_report(spark, sf_dir):
    cells = {"id": col("o_orderkey").cast("string"), "note": F.concat(F.lit('$"'), "o_orderpriority", F.lit("\t\x01"))}
    return views.load(spark, sf_dir, "orders").select("o_orderkey", text.php_array(cells).alias("line"))


@query
def json_literals(spark, sf_dir):
    n = col("event_id")
    raw = F.when(n % 5 == 0, n.cast("string")).when(n % 5 == 1, F.concat(F.lit("0"), n.cast("string"))).when(n % 5 == 2, "TRUE").when(n % 5 == 3, F.concat("event_type", F.lit("\x02\n"))).otherwise("-1.5E3")
    return views.load(spark, sf_dir, "events").select("event_id", text.json_value(raw).alias("value"))


@query
def escapes_of_c(spark, sf_dir):
    raw = F.concat("o_orderstatus", F.lit("\n\\\t"), "o_orderpriority")
    out = text.c_escape(raw)
    return views.load(spark, sf_dir, "orders").select("o_orderkey", out.alias("escaped"), (text.c_unescape(out) == raw).alias("same"))


@query
def html_entities(spark, sf_dir):
    own = text.html_unescape(F.concat(F.lit("&eacute;&#65;&lt;"), "o_orderstatus", F.lit("&nosuch;")))
    return views.load(spark, sf_dir, "orders").select("o_orderkey", own.alias("shown"))


@query
def nested_changes(spark, sf_dir):
    rows = views.load(spark, sf_dir, "orders").select("o_orderkey", F.struct(col("o_orderstatus").alias("s"), F.array("o_orderpriority", F.lit("x")).alias("l"), F.create_map(F.lit("k"), F.array("o_orderstatus")).alias("m"), F.lit(1).alias("n")).alias("v"))
    out = text.change_nested(col("v"), rows.schema["v"].dataType, lambda c: F.concat(F.lower(c), F.lit("!")))
    return rows.select("o_orderkey", F.to_json(out).alias("body"))


@query
def nested_struct_text(spark, sf_dir):
    own = F.concat(F.lit("{a={b="), "o_orderstatus", F.lit("|,},c=[x,"), "o_orderpriority", F.lit("],d=}"))
    return views.load(spark, sf_dir, "orders").select("o_orderkey", text.struct_text_json(own).alias("body"))


# Templates, reports and outputs.


@query
def file_template_forms(spark, sf_dir):
    number = col("event_id") % 3
    forms = {"skip": "%.4f%-2f", "case": "%1:d%lf.%ue", "copy": "%f%-.2c%E", "letters": "%f%+lc", "sequence": "%5C_%.3nC"}
    cells = [paths.fill_template(form, col("dir"), col("stem"), col("ext"), number, col("event_id") % 7).alias(name) for name, form in forms.items()]
    return views.media(spark, sf_dir).select("path", *cells)


@query
def tag_templates(spark, sf_dir):
    rows = views.media(spark, sf_dir).withColumn("words", F.array("dir", "stem"))
    line = Template("$$ $Name by ${EXIF:Dir;upper(_)} ${words@;lower(_)} $owner ${ext#;substring(_, 2)}$/", {"Owner": "it's me"})
    return rows.select("path", line.column(rows).alias("line"), Template("${meta}!").column(rows, missing="-").alias("dated"))


@query
def sectioned_report(spark, sf_dir):
    rows = views.media(spark, sf_dir)
    return records.template_report(
        rows, ["dir"], ["event_id"], col("name"), head=F.concat(F.lit("= "), "dir"), section=F.date_format("ts", "yyyy-MM-dd"), condition=col("meta").isNotNull(),
        ends=F.when(col("event_id") % 10 == 0, F.concat(F.lit("- "), "stem")), tail=F.when(col("event_id") % 50 == 0, F.concat(F.lit(". "), "stem")),
    ).withColumn("place", col("place").cast("long"))


@query
def output_actions(spark, sf_dir):
    rows = views.media(spark, sf_dir)
    there = rows.where("event_id % 97 = 0").select(F.concat("dir", F.lit("/"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".txt")).alias("path"))
    name = F.concat("dir", F.lit("/"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".txt"))
    out = [records.output_plan(rows, name, there, mode).select("path", "output", col("action").alias(mode)) for mode in ("new", "append_new")]
    return out[0].join(out[1].drop("output"), "path")


@query
def report_columns(spark, sf_dir):
    t = views.load(spark, sf_dir, "events").select(col("user_id").alias("source_file"), "event_type", col("event_id").alias("file_order"))
    return records.report_columns(t, "source_file", "event_type", "file_order")


# Tags: groups, labels, documents, records.


def _tags(spark, sf_dir):
    e, n = views.load(spark, sf_dir, "events"), col("event_id")
    group = F.element_at(F.array(*map(F.lit, ("EXIF", "XMP", "IPTC"))), (n % 3 + 1).cast("int"))
    tag = F.element_at(F.array(*map(F.lit, ("CreateDate", "ModifyDate", "DateTimeOriginal", "GPSImgDir2Ab", "Model"))), (n % 5 + 1).cast("int"))
    return e.select(col("user_id").alias("source_file"), tag.alias("tag"), group.alias("group0"), F.lit("Main").alias("group1"), n.alias("file_order"), col("value").cast("int").cast("string").alias("raw"), F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(" mm"))).alias("printed"), n.cast("string").alias("value"))


@query
def group_priority(spark, sf_dir):
    return records.by_group_order(_tags(spark, sf_dir), ["XMP", "EXIF"], ["source_file", "tag"]).select("source_file", "tag", "group0", "file_order")


@query
def group_removal(spark, sf_dir):
    return records.without_group(_tags(spark, sf_dir), "exif", keep=["AllDates"]).select("file_order", "tag", "group0")


@query
def alternate_files(spark, sf_dir):
    t = _tags(spark, sf_dir)
    parts = [t.where(F.least(col("file_order") % 4, F.lit(2)) == i) for i in range(3)]
    return records.with_alternates(parts[0], parts[1:]).select("file_order", "group8")


@query
def raw_and_printed(spark, sf_dir):
    t = _tags(spark, sf_dir)
    return records.shown_values(t).withColumn("raw", F.lit(False)).unionByName(records.shown_values(t, raw=True).withColumn("raw", F.lit(True)))


@query
def tag_headings(spark, sf_dir):
    t = records.tag_labels(_tags(spark, sf_dir), ["group0", "group1"], number="file_order", hexadecimal=True).withColumnRenamed("label", "long")
    return records.tag_labels(t, described=True).select("file_order", "long", "label")


@query
def description_order(spark, sf_dir):
    from pyspark.sql import Window

    t = _tags(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("source_file").orderBy(*records.tag_order(t, "descr")))
    return t.select("file_order", rank.cast("long").alias("rank"))


@query
def documents_inside(spark, sf_dir):
    e = views.load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return records.embedded_documents(e.withColumn("types", F.when(col("user_id") % 3 != 0, col("types"))), "types", "user_id")


@query
def tag_catalogue(spark, sf_dir):
    return records.known_tags(_tags(spark, sf_dir))


@query
def status_lists(spark, sf_dir):
    rows = route.with_collisions(views.contested(spark, sf_dir))
    return records.names_by_status(rows, ["overwritten", "error"])


@query
def folder_rows(spark, sf_dir):
    from albumflow.sources.listing import like_glob, list_folders

    rows = views.media(spark, sf_dir).withColumn("length", col("event_id"))
    return list_folders(rows.where(like_glob(col("path"), "ALBUM_1?/*.JP*g")))


@query
def deleted_values(spark, sf_dir):
    m, n = views.media(spark, sf_dir), col("event_id") % 3
    r = m.select("path", F.when(n == 0, "typed in").alias("meta"), F.when(n == 1, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")).alias("_delete"), F.lit(None).cast("string").alias("name"))
    return records.apply_records(m.select("path", "name", "meta"), r, "path")


# Places and tracks.


def _towns(spark, sf_dir):
    s = _spots(views.load(spark, sf_dir, "supplier"), "s_suppkey").join(views.load(spark, sf_dir, "supplier"), "s_suppkey")
    return s.select("s_suppkey", "lat", "lon", col("s_name").alias("city"), F.floor("s_acctbal").alias("population"), F.concat(F.lit("PPL"), (col("s_nationkey") % 3).cast("string")).alias("feature_code"), F.concat(F.lit("Region "), (col("s_nationkey") % 4).cast("string")).alias("region"))


@query
def nearest_large_place(spark, sf_dir):
    points = _spots(views.load(spark, sf_dir, "customer"), "c_custkey")
    rows = nearest.nearest(points, _towns(spark, sf_dir), "c_custkey", "s_suppkey", max_km=700.0, min_population=2000, features=["PPL0", "PPL1"])
    return rows.select("c_custkey", "s_suppkey", F.round("km", 2).alias("km"))


@query
def places_by_patterns(spark, sf_dir):
    rows = nearest.places_named(_towns(spark, sf_dir), region="region 1", patterns={"city": "![05]$"}, features=["PPL0", "PPL1"], most=100_000)
    return rows.select("city", "population")


@query
def interpolate_spans(spark, sf_dir):
    fixes = views.track(spark, sf_dir, True).withColumn("span", F.dayofmonth("t")).withColumn("first", col("event_id") % 6 == 0).drop("event_id")
    points = views.track(spark, sf_dir, False).drop("value")
    rows = asof.interpolate(points, fixes, "device", "t", ["value"], max_gap=20_000, max_reach=60_000)
    return rows.select("event_id", F.round("value", 4).alias("value"), "position")


@query
def content_digests(spark, sf_dir):
    d = views.load(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))
