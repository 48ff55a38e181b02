"""Readers and writers over files synthesised here."""

from __future__ import annotations

import io
import json
import os
import random
import struct
from datetime import datetime, timedelta
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from albumflow.functions.filetypes import SIGNATURES, file_type, type_of
from albumflow.plans.pipeline import Config, run
from albumflow.sources import files as sinks
from albumflow.sources import records, tracks
from albumflow.sources.listing import list_files, read_sidecars
from albumflow.sources.metadata import read_dates, with_metadata
from albumflow.streaming import watch

DATE = "2021:02:03 04:05:06"


def tiff(date=DATE, order="<"):
    head = b"II*\0" if order == "<" else b"MM\0*"
    first = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x8769, 4, 1, 26) + bytes(4)
    exif = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x9003, 2, 20, 44) + bytes(4)
    return head + struct.pack(order + "I", 8) + first + exif + date.encode() + b"\0"


def jpeg():
    body = b"Exif\0\0" + tiff()
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2"


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"eXIf", tiff(order=">")) + chunk(b"IEND", b"")


def webp():
    body = b"Exif\0\0" + tiff()
    return b"RIFF\0\0\0\0WEBP" + b"VP8X" + struct.pack("<I", 10) + bytes(10) + b"EXIF" + struct.pack("<I", len(body)) + body


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def movie(seconds):
    return box(b"ftyp", b"qt  \0\0\0\0") + box(b"free", bytes(5)) + box(b"moov", box(b"mvhd", bytes(4) + struct.pack(">I", seconds) + bytes(20)))


def heic():
    item = struct.pack(">I", 0) + tiff()
    infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + b"Exif\0")
    iinf = box(b"iinf", bytes(4) + struct.pack(">H", 1) + infe)

    def meta(at):
        iloc = box(b"iloc", bytes(4) + b"\x44\0" + struct.pack(">HHHH", 1, 1, 0, 1) + struct.pack(">II", at, len(item)))
        return box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", bytes(4) + iinf + iloc)

    return meta(len(meta(0)) + 8) + box(b"mdat", item)


@pytest.mark.parametrize(("ext", "data"), [(".jpg", jpeg()), (".JPEG", jpeg()), (".png", png()), (".webp", webp()), (".tif", tiff()), (".tiff", tiff(order=">")), (".heic", heic())])
def test_dates_of_images(ext, data):
    assert read_dates(io.BytesIO(data), ext) == (DATE, None, None, None)


@pytest.mark.parametrize("order", ["<", ">"])
def test_date_of_a_tiff_with_its_directory_past_16_mb(spark, tmp_path, order):
    at = 17 << 20
    first = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x8769, 4, 1, at + 18) + bytes(4)
    exif = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x9003, 2, 20, at + 36) + bytes(4)
    data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + bytes(at - 8) + first + exif + DATE.encode() + b"\0"
    (tmp_path / "large.tif").write_bytes(data)
    (r,) = with_metadata(list_files(spark, str(tmp_path), mounted=True)).collect()
    assert (r.exif_dto, r.error) == (datetime(2021, 2, 3, 4, 5, 6), None)


def test_dates_of_movies():
    assert read_dates(io.BytesIO(movie(3_700_000_000)), ".mp4") == (None, 3_700_000_000, None, None)


def movie_with_metadata(seconds, date, plain=True):
    keys = box(b"keys", bytes(4) + struct.pack(">I", 2) + b"".join(struct.pack(">I", len(k) + 8) + b"mdta" + k for k in (b"com.apple.quicktime.make", b"com.apple.quicktime.creationdate")))
    value = lambda number, text: box(struct.pack(">I", number), box(b"data", struct.pack(">II", 1, 0) + text))
    meta = (b"" if plain else bytes(4)) + box(b"hdlr", bytes(24)) + keys + box(b"ilst", value(1, b"Maker") + value(2, date.encode()))
    header = box(b"mvhd", bytes(4) + struct.pack(">I", seconds) + bytes(20)) if seconds is not None else b""
    return box(b"ftyp", b"qt  \0\0\0\0") + box(b"moov", header + box(b"meta", meta))


@pytest.mark.parametrize("plain", [True, False])
def test_third_date_source(spark, tmp_path, plain):
    written = "2024-05-06T07:08:09+0200"
    assert read_dates(io.BytesIO(movie_with_metadata(5, written, plain)), ".mov") == (None, 5, written, None)
    (tmp_path / "a.mov").write_bytes(movie_with_metadata(None, written, plain))
    (tmp_path / "b.mov").write_bytes(movie_with_metadata(3_700_000_000, "none", plain))
    found = run(with_metadata(list_files(spark, str(tmp_path), mounted=True)), read_sidecars(spark, str(tmp_path)))
    assert {r.source_path[-5:]: r.capture_ts for r in found.manifest.collect()} == {"a.mov": datetime(2024, 5, 6, 7, 8, 9), "b.mov": datetime(2021, 3, 31, 1, 46, 40)}


def test_heic_with_a_wide_item_table():
    item = struct.pack(">I", 0) + tiff()
    infe = box(b"infe", b"\3\0\0\0" + struct.pack(">IH", 70_000, 0) + b"Exif\0")
    iinf = box(b"iinf", b"\1\0\0\0" + struct.pack(">I", 1) + infe)

    def meta(at):
        iloc = box(b"iloc", b"\2\0\0\0" + b"\x44\0" + struct.pack(">IIHHH", 1, 70_000, 0, 0, 1) + struct.pack(">II", at, len(item)))
        return box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", bytes(4) + iinf + iloc)

    data = meta(len(meta(0)) + 8) + box(b"mdat", item)
    assert read_dates(io.BytesIO(data), ".heic") == (DATE, None, None, None)


@pytest.mark.parametrize("ext", [".jpg", ".png", ".webp", ".tif", ".heic", ".mp4"])
@pytest.mark.parametrize("data", [b"", b"II*\0", jpeg()[:30], heic()[:60], bytes(100), b"\xff" * 100])
def test_broken_files_do_not_raise(ext, data):
    read_dates(io.BytesIO(data), ext)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "a" / "deep").mkdir(parents=True)
    (root / "a" / "one.jpg").write_bytes(jpeg())
    (root / "a" / "deep" / ".hidden.jpg").write_bytes(jpeg())
    (root / "a" / "zero.mov").write_bytes(movie(0))
    (root / "a" / "zero.mov.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "1600000000"}}))
    (root / "two.heic").write_bytes(heic())
    (root / "note.txt").write_text("x")
    return root


def test_whole_run(spark, tree, tmp_path):
    listed = list_files(spark, str(tree), mounted=True)
    assert listed.count() == 6 and listed.where("name = '.hidden.jpg'").count() == 1
    assert list_files(spark, str(tree)).where("name = '.hidden.jpg'").count() == 0
    out = str(tmp_path / "out")
    result = run(with_metadata(listed), read_sidecars(spark, str(tree)), Config(root=out))
    done = sinks.copy_files(result.manifest).collect()
    assert all(r.error is None for r in done)
    found = sorted(os.path.relpath(os.path.join(d, n), out) for d, _, names in os.walk(out) for n in names)
    assert found == ["photos/2021/2021-02-03/.hidden.jpg", "photos/2021/2021-02-03/one.jpg", "photos/2021/2021-02-03/two.heic", "videos/2020/2020-09-13/zero.mov"]
    sinks.write_manifest(result.manifest, str(tmp_path / "manifest"))
    assert spark.read.parquet(str(tmp_path / "manifest")).where("kind = 'photos'").count() == 3
    missing = result.manifest.withColumn("source_path", F.lit("/nowhere/x"))
    assert all("FileNotFoundError" in r.error for r in sinks.copy_files(missing).collect())


def test_listing_leaves_out_the_output(spark, tree):
    assert list_files(spark, str(tree), mounted=True, outside=str(tree / "a")).count() == 2


def test_file_types(spark):
    data = [(jpeg(), "JPEG"), (png(), "PNG"), (tiff(), "TIFF"), (webp(), "WEBP"), (heic(), "HEIC"), (movie(1), "MOV"), (b"abc", None)]
    rows = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(data)], "i int, content binary")
    assert [r[0] for r in rows.orderBy("i").select(file_type(F.col("content"))).collect()] == [k for _, k in data]


def test_tracks(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    want = datetime(2024, 1, 2, 3, 4, 5)
    gpx = put("t.gpx", '<gpx><trk><trkseg><trkpt lat="1.5" lon="-2.5"><ele>7</ele><time>2024-01-02T03:04:05Z</time></trkpt></trkseg></trk></gpx>')
    kml = put("t.kml", "<kml><Placemark><TimeStamp><when>2024-01-02T03:04:05Z</when></TimeStamp><Point><coordinates>-2.5,1.5,7</coordinates></Point></Placemark></kml>")
    csv = put("t.csv", "device,t,lat,lon,alt\nx,2024-01-02T03:04:05Z,1.5,-2.5,7\n")
    nmea = put("t.nmea", "$GPGGA,030405,0130.000,N,00230.000,W,1,8,0.9,7.0,M,,M,,*47\n$GPRMC,030405,A,0130.000,N,00230.000,W,1.0,90.0,020124,,*6A\n")
    igc = put("t.igc", "HFDTE020124\nB0304050130000N00230000WA0000700008\n")
    history = put("t.json", json.dumps({"locations": [{"timestampMs": "1704164645000", "latitudeE7": 15000000, "longitudeE7": -25000000, "altitude": 7.0}]}))
    readers = ((tracks.read_gpx, gpx), (tracks.read_kml, kml), (tracks.read_csv_track, csv), (tracks.read_nmea, nmea), (tracks.read_igc, igc), (tracks.read_location_history, history))
    for read, path in readers:
        (r,) = read(spark, path).collect()
        assert (r.t, r.lat, r.lon, r.alt) == (want, 1.5, -2.5, 7.0), path


def test_logs_of_any_kind_in_one_folder(spark, tmp_path):
    (tmp_path / "a.tcx").write_text("<TrainingCenterDatabase><Trackpoint><Time>2024-01-02T03:04:05Z</Time><Position><LatitudeDegrees>1.5</LatitudeDegrees><LongitudeDegrees>-2.5</LongitudeDegrees></Position><AltitudeMeters>7</AltitudeMeters></Trackpoint></TrainingCenterDatabase>")
    (tmp_path / "b.log").write_text("$GPRMC,030405,A,0130.000,N,00230.000,W,1.0,90.0,020124,,*6A\n")
    (tmp_path / "c.json").write_text(json.dumps([{"startTime": "2024-01-02T03:00:00Z", "timelinePath": [{"point": "geo:1.5,-2.5", "durationMinutesOffsetFromStartTime": "4"}]}]))
    (tmp_path / "d.txt").write_text("nothing")
    got = sorted((r.t, r.lat, r.lon) for r in tracks.read_tracks(spark, str(tmp_path)).collect())
    assert got == [(datetime(2024, 1, 2, 3, 4), 1.5, -2.5)] + [(datetime(2024, 1, 2, 3, 4, 5), 1.5, -2.5)] * 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    assert tracks.read_tracks(spark, str(tmp_path / "none")).count() == 0


def test_a_sentence_is_cut_up_once(spark, monkeypatch):
    """Neither a filter nor a value cuts the line again, and lines of other kinds, broken ones and nulls give nothing."""
    seen = []
    saved = tracks.saved
    monkeypatch.setattr(tracks, "saved", lambda rows: seen.append(rows) or saved(rows))
    values = ["$GPGGA,030405,0130.000,S,00230.000,W,1,8,0.9,7.0,M,,M,,*47", "$GPGSV,1,1,00*79", "$GPRMC,030405", None, "", "x$GPGLL,0130.000,N,00230.000,E,030406.5,A*00", "$GPZDA,030407,02,01,2024,00,00*00"]
    lines = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "file string, place int, value string")
    got = [tuple(r)[1:] for r in tracks._sentences(lines).orderBy("place").collect()]
    day = datetime(2024, 1, 2)
    assert got == [
        (0, "GGA", 11045.0, None, True, -1.5, -2.5, 7.0, None, None, 0.9), (5, "GLL", 11046.5, None, True, 1.5, 2.5, None, None, None, None), (6, "ZDA", 11047.0, day, True, None, None, None, None, None, None),
    ]
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_sentences_of_several_days(spark, tmp_path):
    rmc = "$GPRMC,{},A,0130.000,N,00230.000,W,1.0,90.0,{},,*6A"
    gga = "$GPGGA,{},0130.000,N,00230.000,W,1,8,0.9,{},M,,M,,*47"
    lines = [gga.format("235950", 1.0), rmc.format("235950", "010124"), rmc.format("235955", "010124"), gga.format("000005", 2.0), gga.format("235955", 3.0), rmc.format("000005", "020124"), rmc.format("235950", "020124"), gga.format("235950", 4.0), gga.format("235950", 5.0)]
    (tmp_path / "t.nmea").write_text("\n".join(lines))
    got = [(r.t, r.alt) for r in tracks.read_nmea(spark, str(tmp_path / "t.nmea")).orderBy("t").collect()]
    day = lambda d, h, m, s: datetime(2024, 1, d, h, m, s)
    assert got == [(day(1, 23, 59, 50), 1.0), (day(1, 23, 59, 55), 3.0), (day(2, 0, 0, 5), None), (day(2, 23, 59, 50), 5.0)]


def fixes_by_hand(sentences):
    """One sentence at a time: (kind, seconds, day or None, altitude or None, speed or None)."""
    fixes = []
    for kind, seconds, day, alt, speed in sentences:
        if not fixes or kind == sentences[0][0] or (seconds - fixes[-1]["begun"]) % 86400 >= 10:
            fixes.append({"begun": seconds, "day": None})
        fix = fixes[-1]
        for name, value in (("alt", alt), ("speed", speed), ("lat", 1.5 if kind != "ZDA" else None)):
            fix[name] = value if fix.get(name) is None else fix[name]
        if fix["day"] is None and day is not None:
            fix["day"] = day - (seconds < fix["begun"])
    dated = [f for f in fixes if f["day"] is not None]
    out = {}
    for i, fix in enumerate(fixes):
        last = next((f for f in reversed(fixes[: i + 1]) if f["day"] is not None), dated[0] if dated else None)
        if last is None or fix["lat"] is None:
            continue
        gap = fix["begun"] - last["begun"]
        turn = 0 if fix["day"] is not None else 1 if gap < -43200 else -1 if gap > 43200 else 0
        out[datetime(2024, 1, 1) + timedelta(days=last["day"] + turn, seconds=fix["begun"])] = (fix["alt"], fix["speed"])
    return sorted((t, *v) for t, v in out.items())


@pytest.mark.parametrize("seed", range(4))
def test_sentences_make_fixes(spark, tmp_path, seed):
    rng = random.Random(seed)
    logs = {}
    for log in range(3):
        at, sentences = rng.randrange(80_000), []
        for _ in range(120):
            at += rng.choice([0, 0, 1, 1, 2, 5, 9, 10, 60, 900])
            seconds, day = at % 86400, at // 86400
            kind = rng.choice(["RMC", "GGA", "GGA", "GLL", "ZDA"])
            sentences.append((kind, seconds, day if kind in ("RMC", "ZDA") else None, float(rng.randrange(99)) if kind == "GGA" else None, float(rng.randrange(99)) if kind == "RMC" else None))
        logs[f"log{log}"] = sentences
    rows = []
    for log, sentences in logs.items():
        for place, (kind, seconds, day, alt, speed) in enumerate(sentences):
            clock = f"{seconds // 3600:02d}{seconds // 60 % 60:02d}{seconds % 60:02d}"
            where = "0130.000,N,00230.000,W"
            when = datetime(2024, 1, 1) + timedelta(days=day or 0)
            line = {
                "RMC": lambda: f"$GPRMC,{clock},A,{where},{(speed or 0) / 1.852:.9f},90.0,{when:%d%m%y},,*6A", "GGA": lambda: f"$GPGGA,{clock},{where},1,8,0.9,{alt},M,,M,,*47",
                "GLL": lambda: f"$GPGLL,{where},{clock},A*00", "ZDA": lambda: f"$GPZDA,{clock},{when:%d,%m,%Y},00,00*00",
            }[kind]()
            rows.append((log, place, line))
        rows += [(log, 1000, "$GPGSA,x"), (log, 1001, "junk"), (log, 1002, "$GPRMC,010101,V,0130.000,N,00230.000,W,1,1,010124,,*00")]
    lines = spark.createDataFrame(rows, "file string, place int, value string").repartition(4)
    got = {}
    for r in tracks.nmea_fixes(lines).collect():
        got.setdefault(r.device, []).append((r.t, r.alt, None if r.speed is None else round(r.speed, 3)))
    assert {log: sorted(v, key=str) for log, v in got.items()} == {log: sorted(fixes_by_hand(s), key=str) for log, s in logs.items()}


def test_hashes_and_listing_rules(spark, tree):
    import hashlib

    from albumflow.sources.listing import list_folders

    (tree / "empty.jpg").write_bytes(b"")
    os.symlink(tree / "two.heic", tree / "link.heic")
    listed = list_files(spark, str(tree), mounted=True)
    got = {r.path: (r.digest, r.error is None) for r in sinks.file_hashes(listed.unionByName(listed.limit(1).withColumn("path", F.lit("/nowhere"))), "sha256").collect()}
    assert got[str(tree / "two.heic")] == (hashlib.sha256(heic()).hexdigest(), True) and got[str(tree / "empty.jpg")] == (None, True) and got["/nowhere"] == (None, False)
    names = {r.name for r in list_files(spark, str(tree), mounted=True, ignore=["deep"], hidden=False, symlinks=False).collect()}
    assert names == {"one.jpg", "zero.mov", "zero.mov.json", "two.heic", "note.txt", "empty.jpg"}
    assert {r.dir: r.files for r in list_folders(listed).collect()}[str(tree / "a" / "deep")] == 1


def test_places_and_php(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Here\tR\tXX\tLand\tUTC\tPPL\t5\t1.5\t2.5\nNowhere\tR\tXX\tLand\tUTC\tPPL\t5\t\t2.5\n")
    rows = records.read_places(spark, str(tmp_path / "p.txt"))
    assert [(r.city, r.population, r.lat) for r in rows.collect()] == [("Here", 5, 1.5)]
    records.write_php(rows.select("city", "population"), str(tmp_path / "php"))
    assert spark.read.text(str(tmp_path / "php")).first()[0] == 'Array("city" => "Here","population" => 5)'


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text('SourceFile,Title,Note\na.jpg,old,x\na.jpg,"new, ""2""",\nb.jpg,-,y\n')
    got = {r.SourceFile: (r.Title, r.Note) for r in records.read_csv_records(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {"a.jpg": ('new, "2"', None), "b.jpg": (None, "y")}
    (tmp_path / "r.json").write_text(json.dumps([{"Title": "t", "GPS": {"lat": 1}}]))
    flat = records.flatten(records.read_json_records(spark, str(tmp_path / "r.json")))
    assert {(r.SourceFile, r.tag, r.value) for r in records.unpivot(flat).collect()} == {("*", "Title", "t"), ("*", "GPSLat", "1")}


def test_reports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y", z'), ("b", None)], "SourceFile string, Title string")
    records.write_csv(rows, str(tmp_path / "csv"))
    records.write_json(rows, str(tmp_path / "json"))
    records.write_lines(rows, "SourceFile", str(tmp_path / "text"))
    records.write_xml(rows, str(tmp_path / "xml"))
    for back in (spark.read.csv(str(tmp_path / "csv"), header=True, escape='"'), spark.read.json(str(tmp_path / "json")), spark.read.format("xml").option("rowTag", "Description").load(str(tmp_path / "xml"))):
        assert {(r.SourceFile, r.Title) for r in back.collect()} == {("a", 'x "y", z'), ("b", None)}


def test_stream(spark, tmp_path):
    day = datetime(2024, 1, 2)
    rows = spark.createDataFrame([("a/1.jpg", "1.jpg", ".jpg", day), ("a/2.mp4", "2.mp4", ".mp4", None)], "path string, name string, ext string, capture_ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "in"))
    stream = watch.route_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    done = stream.writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert {(r.path, r.kind) for r in spark.table("routed").collect()} == {("a/1.jpg", "photos"), ("a/2.mp4", "NO_DATE")}


def test_flatten_json_of_any_shape(spark):
    bodies = [
        '{"a":{"b":[1,{"c":"x"},[2.50,null,true]],"d e":null},"k":87}', '[1,2,{"q":{}}]', '"s"', "{broken", None, "{}", "null", "12", '{"a":{"b":"z"},"ab":1}', '{"é":[[["deep"]]]}',
    ]
    rows = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "i int, body string, tag string")
    got = sorted(tuple(r) for r in records.flatten_json(rows.select("i", "body"), "body", ["i"]).collect())
    assert got == [
        (0, "AB", 0, "1"), (0, "AB", 1, "2.5"), (0, "AB", 2, "true"), (0, "ABC", 0, "x"), (0, "K", 0, "87"), (1, "Value", 0, "1"), (1, "Value", 1, "2"), (2, "Value", 0, "s"), (7, "Value", 0, "12"),
        (8, "AB", 0, "z"), (8, "Ab", 0, "1"), (9, "É", 0, "deep"),
    ]
    with pytest.raises(ValueError, match="nested"):
        records.flatten_json(rows, "body", ["i"], deepest=2)


CSV_LOGS = {
    "plain.csv": ("device,t,lat,lon,alt,speed\nx,2024-01-02T03:04:05Z,1.5,-2.5,7,10\n", ("x", 1.5, -2.5, 7.0, 18.52)),
    "columbus.csv": ("INDEX,TAG,DATE,TIME,LATITUDE N/S,LONGITUDE E/W,HEIGHT,SPEED,HEADING\n1,T,240102,030405,1.5N,2.5W,7,10,90\n", (None, 1.5, -2.5, 7.0, 10.0)),
    "refs.csv": ('# made by hand\n"GPS Date","GPS Time","GPSLatitude","GPSLatitudeRef","GPSLongitude","GPSLongitudeRef","Altitude (m)","Speed (m/s)"\n02/01/2024,04:04:05+01:00,"1 deg 30\' 0.00""",N,2.5,W,7,10\n', (None, 1.5, -2.5, 7.0, 36.0)),
    "two.csv": ("PosLat,PosLon,PosAlt,Date Time,Speed (mph)\n-1.5,2.5,7,2024:01:02 03:04:05,10\n1.5,-2.5,,,\n,,1,2024:01:02 03:04:05,1\n", (None, -1.5, 2.5, 7.0, 16.09344)),
    "DJI_2024-01-02_[03-04-00].csv": ("Time(seconds),Time(text),Lat,Lon,Alt\n5.0,x,1.5,-2.5,7\n", (None, 1.5, -2.5, 7.0, None)),
    "german.csv": ("DateTime,Lat,Lon\n02.01.2024 03:04:05,1.5,-2.5\n", (None, 1.5, -2.5, None, None)),
}


def test_csv_tracks_by_their_headings(spark, tmp_path):
    for name, (body, _) in CSV_LOGS.items():
        (tmp_path / name).write_text(body)
    got = {}
    for r in tracks.read_csv_track(spark, str(tmp_path)).collect():
        name = next((n for n in CSV_LOGS if n in unquote(r.device)), "plain.csv")
        assert name not in got and r.t == datetime(2024, 1, 2, 3, 4, 5)
        got[name] = (r.device if r.device == "x" else None, r.lat, r.lon, r.alt, None if r.speed is None else round(r.speed, 6))
    assert got == {n: want for n, (_, want) in CSV_LOGS.items()}


def test_cells_of_a_line(spark):
    lines = ['a,"b, ""c""",,d ', '', '"x"', "a;b", ' "q" ,r']
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", tracks.csv_cells(F.col("x"), ",").alias("c")).orderBy("i").collect()]
    assert got == [["a", 'b, "c"', "", "d"], [""], ["x"], ["a;b"], ["q", "r"]]
    assert spark.range(1).select(tracks.csv_cells(F.lit('a;"b;c"'), ";").alias("c")).first().c == ["a", "b;c"]


def test_other_text_logs(spark, tmp_path):
    (tmp_path / "w.txt").write_text("TP,D, 44.933666667, -93.186555556, 10/26/2011, 19:07:28, 0\nTP,D, 1,\nXX\n")
    (tmp_path / "b.log").write_text("  1 0015   18.723675   50.672752  149 169.31 22/04/2015 07:06:55 169.31    8.88   28.07 ypr\n2 x ypr\n")
    got = sorted((r.t, round(r.lat, 3), round(r.lon, 3), r.alt, r.track) for r in tracks.read_tracks(spark, str(tmp_path)).collect())
    assert got == [(datetime(2011, 10, 26, 19, 7, 28), 44.934, -93.187, None, None), (datetime(2015, 4, 22, 7, 6, 55), 18.724, 50.673, 149.0, 169.31)]


def test_types_of_all_signatures(spark):
    """Every signature, with junk around it, in Spark and in Python; shorter heads have no type."""
    rows = []
    for kind, pieces in SIGNATURES:
        head = bytearray(b"\x55" * 300)
        for at, piece in pieces:
            head[at : at + len(piece)] = piece
        rows.append((kind, bytes(head)))
        rows.append((None, b"\x55" * 8 + bytes(head)[:1]))
    rows += [(None, b""), (None, None)]
    df = spark.createDataFrame([(i, h) for i, (_, h) in enumerate(rows)], "i int, content binary")
    got = {r.i: r.kind for r in df.select("i", file_type(F.col("content")).alias("kind")).collect()}
    for i, (kind, head) in enumerate(rows):
        assert got[i] == kind == (type_of(head) if head is not None else None), (i, kind, got[i])
    named = [(b"PK\x03\x04", ".DOCX", "DOCX"), (b"PK\x03\x04", ".zip", "ZIP"), (b"II*\0", ".nef", "NEF"), (b"\xff\xd8\xff", ".docx", "JPEG"), (b"<?xml", ".gpx", "GPX"), (b"?", ".jpg", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(named)], "i int, content binary, ext string, want string")
    assert all(r.kind == r.want == type_of(r.content, r.ext) for r in df.withColumn("kind", file_type(F.col("content"), F.col("ext"))).collect())


def test_a_file_is_read_as_what_it_is():
    """A PNG that is named .jpg, and a JPEG that is named .mov."""
    assert read_dates(io.BytesIO(png()), ".jpg")[0] == DATE and read_dates(io.BytesIO(jpeg()), ".mov")[0] == DATE
