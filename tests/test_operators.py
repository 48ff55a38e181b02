from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from albumflow.operators import asof, edits, lenses, nearest, numbering, records, route
from albumflow.operators.sidecar_join import match
from albumflow.plans.catalogue import CATALOGUE
from albumflow.plans.pipeline import Config, run

MEDIA = "path string, dir string, name string, stem string, ext string"
SIDECAR = "dir string, json_name string, json_stem string, body string"


def media(spark, *names):
    rows = []
    for full in names:
        folder, name = full.rsplit("/", 1)
        stem, dot, ext = name.rpartition(".")
        rows.append((full, folder, name, stem if dot else name, dot + ext if dot else ""))
    return spark.createDataFrame(rows, MEDIA)


def sidecar(spark, *names):
    rows = [(n.rsplit("/", 1)[0], n.rsplit("/", 1)[1], n.rsplit("/", 1)[1].removesuffix(".json"), "{}") for n in names]
    return spark.createDataFrame(rows, SIDECAR)


def chosen(df):
    return {r.path: r.json_name for r in df.collect()}


def test_sidecar_ranking(spark):
    m = media(spark, "a/IMG_1.jpg", "a/IMG_10.jpg", "b/IMG_1.jpg", "a/.jpg")
    s = sidecar(spark, "a/IMG_10.jpg.meta.json", "a/IMG_1.jpg.meta.json", "a/IMG_1.json")
    assert chosen(match(m, s)) == {"a/IMG_1.jpg": "IMG_1.jpg.meta.json", "a/IMG_10.jpg": "IMG_10.jpg.meta.json", "b/IMG_1.jpg": None, "a/.jpg": "IMG_1.jpg.meta.json"}
    assert chosen(match(m, s, "first_listed"))["a/IMG_1.jpg"] == "IMG_1.jpg.meta.json"


def test_sidecar_long_stems(spark):
    long = "x" * 25
    m = media(spark, f"a/{long}one.jpg")
    assert chosen(match(m, sidecar(spark, f"a/{long.upper()}two.json"))) == {f"a/{long}one.jpg": f"{long.upper()}two.json"}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aB1", min_size=1, max_size=4), min_size=1, max_size=5, unique=True), st.lists(st.text("aB1.jpg", min_size=1, max_size=8), min_size=1, max_size=5, unique=True))
def test_sidecar_against_nested_loops(spark, stems, others):
    m, s = media(spark, *(f"d/{x}.jpg" for x in stems)), sidecar(spark, *(f"d/{x}.json" for x in others))
    got = chosen(match(m, s))
    for stem in stems:
        hits = [o for o in others if o.lower().startswith(stem.lower()[:25])]
        name = f"{stem}.jpg".lower()
        hits.sort(key=lambda o: (1 if o.lower().startswith(name) else 2 if o.lower() == stem.lower() else 3, f"{o}.json".lower(), f"{o}.json"))
        assert got[f"d/{stem}.jpg"] == (f"{hits[0]}.json" if hits else None)


def _files(spark, rows):
    none = F.lit(None)
    base = media(spark, *(r[0] for r in rows))
    dated = spark.createDataFrame(rows, "path string, exif_dto timestamp_ntz")
    return base.join(dated, "path").select("*", none.cast("timestamp_ntz").alias("qt_header"), none.cast("timestamp_ntz").alias("qt_meta"), none.cast("string").alias("error"))


def test_pipeline(spark):
    good = datetime(2024, 5, 6, 7, 8, 9)
    files = _files(spark, [("a/1.jpg", good), ("b/1.jpg", good), ("a/2.MOV", datetime(1904, 1, 1)), ("a/3.png", None), ("a/4.txt", good)])
    body = '{"photoTakenTime": {"timestamp": "1700000000"}}'
    s = spark.createDataFrame([("a", "2.MOV.json", "2.MOV", body), ("a", "3.png.json", "3.png", '{"photoTakenTime": {"timestamp": "-2082844800"}}')], SIDECAR)
    result = run(files, s)
    got = {r.source_path: (r.target_path, r.status, r.date_source) for r in result.manifest.collect()}
    assert got == {
        "a/1.jpg": ("out/photos/2024/2024-05-06/1.jpg", "overwritten", "embedded"),
        "b/1.jpg": ("out/photos/2024/2024-05-06/1.jpg", "copied", "embedded"),
        "a/2.MOV": ("out/videos/2023/2023-11-14/2.MOV", "copied", "sidecar"),
        "a/3.png": ("out/NO_DATE/3.png", "copied", "sidecar"),
    }
    assert tuple(result.summary.first()) == (4, 2, 1, 1)
    assert [tuple(r) for r in result.collisions.collect()] == [("out/photos/2024/2024-05-06/1.jpg", "b/1.jpg", 2)]
    fast = {r.source_path: r.target_path for r in run(files, s, Config(mode="fast", granularity="month")).manifest.collect()}
    assert fast["a/2.MOV"] == "out/videos/1904/1904-01/2.MOV"


@pytest.mark.parametrize(("policy", "want"), [("last", ["overwritten", "copied"]), ("first", ["copied", "overwritten"]), ("error", ["error", "error"])])
def test_collision_policies(spark, policy, want):
    rows = spark.createDataFrame([("a/x", "t"), ("b/x", "t")], "path string, target_path string")
    assert [r.status for r in route.with_collisions(rows, policy).orderBy("path").collect()] == want


def test_percent_is_truncated_after_division(spark):
    assert spark.range(1).select(route.percent(F.lit(29), F.lit(100))).first()[0] == 28


def test_bracket_across_buckets(spark):
    d = lambda day, hour: datetime(2024, 1, day, hour)
    fixes = spark.createDataFrame([("a", d(1, 1), 1.0), ("a", d(9, 1), 2.0)], "device string, t timestamp_ntz, value double")
    points = spark.createDataFrame([(1, "a", d(1, 0)), (2, "a", d(1, 1)), (3, "a", d(5, 0)), (4, "a", d(9, 2)), (5, "b", d(5, 0))], "id int, device string, t timestamp_ntz")
    got = {r.id: (r.before and r.before.value, r.after and r.after.value) for r in asof.bracket(points, fixes, "device", "t", ["value"]).collect()}
    assert got == {1: (None, 1.0), 2: (1.0, 2.0), 3: (1.0, 2.0), 4: (2.0, None), 5: (None, None)}


def test_interpolate_round_the_circle(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    fixes = spark.createDataFrame([("a", t(0), 179.0), ("a", t(10), -179.0)], "device string, t timestamp_ntz, lon double")
    points = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(40)), (3, "a", datetime(2024, 1, 1, 2))], "id int, device string, t timestamp_ntz")
    got = {r.id: (r.lon, r.position) for r in asof.interpolate(points, fixes, "device", "t", ["lon"], cyclic=["lon"]).collect()}
    assert got == {1: (180.0, "between"), 2: (-179.0, "nearest"), 3: (None, None)}


def test_nearest_against_all_pairs(spark):
    import math
    import random

    rng = random.Random(1)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    points = spark.createDataFrame(spots[:30], "p int, lat double, lon double")
    places = spark.createDataFrame(spots[30:], "q int, lat double, lon double")

    def km(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1, x)))

    want = {}
    for a in spots[:30]:
        near = sorted((km(a, b), b[0]) for b in spots[30:] if km(a, b) <= 3000)[:2]
        for rank, (_, q) in enumerate(near, 1):
            want[a[0], rank] = q
    got = nearest.nearest(points, places, "p", "q", 3000.0, 2).collect()
    assert {(r.p, r["rank"]): r.q for r in got} == want


def test_diff_pairs_repeats(spark):
    left = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None), ("c", "3")], "k string, v string")
    right = spark.createDataFrame([("a", "1"), ("b", None), ("c", "4"), ("d", None)], "k string, v string")
    got = {(r.k, r.left_value, r.right_value, r.side) for r in records.diff(left, right, ["k"], "v").collect()}
    assert got == {("a", "2", None, "<"), ("c", "3", "4", "<>"), ("d", None, None, ">")}


def diff_by_hand(left, right):
    out = []
    for key in {k for k, _ in left + right}:
        a, b = ([v for k, v in side if k == key] for side in (left, right))
        for v in list(a):
            if v in b:
                a.remove(v)
                b.remove(v)
        order = lambda v: (v is None, v or "")
        a, b = sorted(a, key=order), sorted(b, key=order)
        for i in range(max(len(a), len(b))):
            side = "<" if i >= len(b) else ">" if i >= len(a) else "<>"
            out.append((key, i + 1, a[i] if i < len(a) else None, b[i] if i < len(b) else None, side))
    return sorted(out, key=str)


PAIRS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["1", "2", "3", None])), max_size=14)


@settings(deadline=None, max_examples=20, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PAIRS, PAIRS)
def test_diff_is_a_difference_of_multisets(spark, left, right):
    frames = (spark.createDataFrame(side, "k string, v string") for side in (left, right))
    assert sorted(map(tuple, records.diff(*frames, ["k"], "v").collect()), key=str) == diff_by_hand(left, right)


def test_one_missing_repeat_is_one_difference(spark):
    left = spark.createDataFrame([("k", v) for v in "abc"], "k string, v string")
    assert [tuple(r) for r in records.diff(left, left.where("v <> 'a'"), ["k"], "v").collect()] == [("k", 1, "a", None, "<")]


def test_running_numbers_of_a_large_group(spark):
    """A group that holds most rows spans many tasks and is numbered whole; null is a group too."""
    rows = spark.range(4000).select(F.when(F.col("id") % 8 == 1, None).when(F.col("id") % 8 == 2, "small").otherwise("large").alias("g"), F.col("id").alias("x"), (F.col("id") % 3).alias("n"))
    got = numbering.running(rows, ["g"], ["x"], "number").collect()
    for group in (None, "small", "large"):
        own = sorted((r.x, r.number) for r in got if r.g == group)
        assert [n for _, n in own] == list(range(len(own)))
    sums = numbering.running(rows, ["g"], [F.col("x").desc()], "before", F.col("n")).collect()
    own = sorted(((r.x, r.n, r.before) for r in sums if r.g == "large"), reverse=True)
    assert [b for *_, b in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))]


def test_wide_report_drops_no_tags(spark):
    rows = spark.range(10_001).select(F.lit("a").alias("k"), F.format_string("t%05d", "id").alias("tag"), F.lit("v").alias("v"))
    with pytest.raises(ValueError, match="long form"):
        records.wide_report(rows, "k", "tag", "v")
    few = records.wide_report(rows.where("id % 5000 = 0"), "k", "tag", "v")
    assert few.columns == ["k", "t00000", "t05000", "t10000"] and [tuple(r) for r in few.collect()] == [("a", "v", "v", "v")]


def test_file_order_puts_missing_last(spark):
    rows = spark.createDataFrame([(1, "b2"), (2, "10"), (3, None), (4, "b10"), (5, "9")], "id int, v string")
    assert [r.id for r in rows.orderBy(*records.file_order(rows, ["v"], "id")).collect()] == [5, 2, 1, 4, 3]
    assert [r.id for r in rows.orderBy(*records.file_order(rows, ["-v"], "id")).collect()] == [3, 4, 1, 2, 5]


def test_derived_columns(spark):
    rows = spark.createDataFrame([(2, None), (3, 5)], "a int, b int")
    table = {
        "d": records.Derived(("c",), lambda c: c * 10),
        "c": records.Derived(("a",), lambda a, b: a + F.coalesce(b, F.lit(0)), desire=("b",)),
        "only_without_b": records.Derived(("a",), lambda a: a, inhibit=("b",)),
    }
    assert [tuple(r) for r in records.add_derived(rows, table).select("c", "d", "only_without_b").orderBy("c").collect()] == [(2, 20, 2), (8, 80, None)]


def test_clock_drift(spark):
    got = [spark.range(1).select(asof.drift(F.lit(float(t)), [(0, 10), (100, 120)])).first()[0] for t in (-100, 0, 50, 100, 200)]
    assert got == pytest.approx([-100, 10, 65, 120, 230])


def test_interpolate_each_keeps_all_points(spark):
    """Points with nulls, and points that repeat."""
    from albumflow.operators import asof

    t = lambda m: datetime(2024, 1, 1, 0, m)
    points = spark.createDataFrame([("d", t(5), None), ("d", t(5), "x"), ("d", t(5), "x"), ("d", None, "y")], "device string, t timestamp_ntz, note string")
    fixes = spark.createDataFrame([("d", t(0), 0.0, None), ("d", t(4), None, 8.0), ("d", t(10), 10.0, 20.0)], "device string, t timestamp_ntz, lat double, alt double")
    got = asof.interpolate_each(points, fixes, "device", "t", ["lat", "alt"]).collect()
    assert sorted((str(r.note), r.lat, r.alt) for r in got if r.t) == [("None", 5.0, 10.0), ("x", 5.0, 10.0), ("x", 5.0, 10.0)] and len(got) == 4


def test_nearest_against_all_pairs(spark):
    """Round the poles and the date line, at small and large reach."""
    import math
    import random

    from albumflow.operators.nearest import nearest

    rng = random.Random(4)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), rng.uniform(-90, -88)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), -180.0]))
    points, places = ([(i, *spot()) for i in range(n)] for n in (120, 150))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, lat double, lon double")

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1)))

    for reach in (150.0, 1200.0, 9000.0):
        want = {(p[0], q[0]) for p in points for q in places if km(p, q) <= reach}
        got = [(r.p, r.q) for r in nearest(frame(points, "p"), frame(places, "q"), "p", "q", reach, k=1000).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_of_dense_places_makes_few_pairs(spark):
    """All points are in reach of all places: 3,600,000 pairs, of which the joins must not make more than a part; copies of a spot and of an id too."""
    import math
    import random

    from albumflow.operators.nearest import nearest

    rng = random.Random(7)
    spot = lambda: (round(rng.uniform(60, 70), 2), round(rng.uniform(-5, 5), 2))
    points, places = ([(i, *spot()) for i in range(n)] for n in (2000, 1800))
    points = [*points, *((i, *points[3][1:]) for i in range(2000, 2020)), (5, *spot())]
    places = [*places, *((i, *places[8][1:]) for i in range(1800, 1840)), (9999, 12.0, 4.0), (10000, None, None)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1)))

    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, lat double, lon double")
    got = {}
    for r in nearest(frame(points, "p"), frame(places, "q"), "p", "q", 4000.0, k=3).collect():
        got.setdefault(r.p, []).append((r["rank"], round(r.km, 6)))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    rows, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
    metrics = [m for n in map(nodes.apply, range(nodes.size())) if "Join" in n.name() for m in map(n.metrics().apply, range(n.metrics().size())) if m.name() == "number of output rows"]
    counts = [int(rows.get(m.accumulatorId()).get().replace(",", "")) for m in metrics if rows.get(m.accumulatorId()).isDefined()]
    assert counts and max(counts) < 200_000
    assert len(got) == 2020
    for p in [*points[:40], *points[2000:2020]]:
        own = [x for x in points if x[0] == p[0]]
        want = sorted(round(km(x, q), 6) for x in own for q in places if q[1] is not None)[:3]
        assert [d for _, d in sorted(got[p[0]])] == want


def test_too_many_places_are_an_error(spark):
    from albumflow.operators.nearest import places_named

    rows = spark.createDataFrame([(f"c{i}", i) for i in range(10)], "city string, population int")
    assert places_named(rows, pattern="c", most=10).count() == 10
    with pytest.raises(ValueError, match="more than 9"):
        places_named(rows, pattern="c", most=9)


def test_unknown_directives_are_an_error():
    from albumflow.functions.dates import format_tolerant

    with pytest.raises(ValueError, match="%Q"):
        format_tolerant(F.lit("2024"), "%Y %Q")


def test_shift_runs(spark):
    at = lambda *x: datetime(2024, *x)
    rows = [("a", 1, at(1, 31, 10), None), ("a", 2, at(2, 1), at(2, 2)), ("b", 1, None, at(1, 31)), ("b", 2, at(3, 1), None), ("c", 1, None, None), (None, 1, at(5, 5), None)]
    df = spark.createDataFrame(rows, "run string, n int, t timestamp_ntz, u timestamp_ntz").withColumn("other", F.lit("x"))
    got = {(r.run, r.n): (r.t, r.u) for r in edits.shift_runs(df, ["run"], ["n"], ["t", "u"], "+0:1:0 0").collect()}
    # January 31 and a month run over to March 2: 31 days
    assert got == {("a", 1): (at(3, 2, 10), None), ("a", 2): (at(3, 3), at(3, 4)), ("b", 1): (None, at(3, 2)), ("b", 2): (at(4, 1), None), ("c", 1): (None, None), (None, 1): (at(6, 5), None)}
    anchored = edits.shift_runs(df, ["run"], ["n"], ["t", "u"], "-0:0:1 0", F.when(F.col("n") == 2, F.col("t")))
    assert {(r.run, r.n): r.t for r in anchored.collect()} == {("a", 1): at(1, 30, 10), ("a", 2): at(1, 31), ("b", 1): None, ("b", 2): at(2, 29), ("c", 1): None, (None, 1): at(5, 5)}


def test_lens_ranges(spark):
    names = ["Canon EF 24-70mm f/2.8L", "Sigma 18-200mm F3.5-6.3 DC", "50mm f/1.8", "Tokina AT-X 11-20 mm F2.8", "No lens", None, "Zoom 70 - 300 mm f/4 - 5.6"]
    got = [tuple(r.r) for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", lenses.lens_ranges(F.col("n")).alias("r")).orderBy("i").collect()]
    none = (None,) * 4
    assert got == [(24, 70, 2.8, 2.8), (18, 200, 3.5, 6.3), (50, 50, 1.8, 1.8), (11, 20, 2.8, 2.8), none, none, (70, 300, 4, 5.6)]


def test_lenses_by_hand(spark):
    """Against all lenses of the type, one photo at a time; no join without equality in the plan."""
    rng = random.Random(3)
    table = []
    for place in range(60):
        short = rng.choice([14, 18, 24, 35, 50, 70, 100])
        wide = rng.choice([1.4, 1.8, 2.8, 3.5, 4.0])
        table.append((rng.randrange(4), place, f"lens {place}", float(short), float(short * rng.choice([1, 1, 2, 4])), wide, wide * rng.choice([1, 1, 1.4, 1.6])))
    table.append((1, 99, "broken", None, None, None, None))
    photos = [(i, rng.choice([0, 1, 2, 3, 9, None]), rng.choice([None, 14.0, 20.0, 35.0, 50.4, 85.0, 200.0, 0.0]), rng.choice([None, 1.4, 1.9, 2.8, 3.9, 5.6])) for i in range(400)]

    def name(kind, focal, aperture):
        own = [x for x in table if x[0] == kind]
        fit = []
        for _, place, text, short, long, wide, narrow in own:
            if short is None or focal == 0.0 or (focal is not None and not short - 0.5 <= focal <= long + 0.5) or (aperture is not None and not wide - 0.15 <= aperture <= narrow + 0.15):
                continue
            want = wide if short == long or wide == narrow or focal is None or focal <= short else narrow if focal >= long else math.exp(math.log(wide) + math.log(narrow / wide) / math.log(long / short) * math.log(focal / short))
            fit.append((round(abs(aperture - want), 6) if aperture is not None else 0.0, place, text))
        near = [x[2] for x in sorted(fit, key=lambda x: x[1]) if round(x[0] - min(fit)[0], 6) <= 0.15]
        return " or ".join(near) if near else own[0][2] if own else None

    lens = spark.createDataFrame(table, "lens_type int, place int, name string, short double, long double, wide double, narrow double")
    df = spark.createDataFrame(photos, "i int, lens_type int, focal double, aperture double")
    out = lenses.identify(df, lens)
    want = {i: name(*x) if x[1] != 0.0 else None for i, *x in photos}
    got = {r.i: r.lens for r in out.collect()}
    zero = {p[0] for p in photos if p[2] == 0.0}
    assert {i: v for i, v in got.items() if i not in zero} == {i: v for i, v in want.items() if i not in zero} and any(v and " or " in v for v in got.values())
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("CartesianProduct", "NestedLoop"))


def test_long_lens_texts_are_not_broadcast(spark):
    """3,000 lenses of two ranges make one text for each set of ranges, which joins by sorting and does not pass the driver."""
    lens = spark.createDataFrame([(1, i, f"lens {i}", 18.0 + 10 * (i % 2), 55.0, 3.5, 5.6) for i in range(3000)], "lens_type int, place int, name string, short double, long double, wide double, narrow double")
    df = spark.createDataFrame([(i, 1, 16.0 + i % 40, None) for i in range(200)], "i int, lens_type int, focal double, aperture double")
    out = lenses.identify(df, lens)
    got = {r.i: r.lens for r in out.collect()}
    name = lambda some: " or ".join(f"lens {i}" for i in some)
    want = {n: name(range(0, 3000, 2)) if n < 27.5 else name(range(3000)) for n in range(18, 56)} | {16: "lens 0", 17: "lens 0"}
    assert got == {i: want[16 + i % 40] for i in range(200)}
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in x and "_text" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_common_lens_texts_are_dealt(spark, monkeypatch):
    """Photos of one text, with or without a lens that fits, go to several tasks and get the same text."""
    monkeypatch.setattr(lenses, "SHARED", 50, raising=False)
    lens = spark.createDataFrame([(k, i, f"lens {k} {i}", 18.0, 55.0, 3.5, 5.6) for k in (1, 2) for i in (5, 3, 4)], "lens_type int, place int, name string, short double, long double, wide double, narrow double")
    photos = [(i, (1, 2, 3, None)[i % 4], (20.0, 500.0)[i // 4 % 2], None) for i in range(4000)]
    out = lenses.identify(spark.createDataFrame(photos, "i int, lens_type int, focal double, aperture double"), lens)
    rows = out.withColumn("at", F.spark_partition_id()).collect()
    want = {(k, f): (f"lens {k} 3 or lens {k} 4 or lens {k} 5" if f == 20.0 else f"lens {k} 3") if k in (1, 2) else None for _, k, f, _ in photos}
    assert {r.i: r.lens for r in rows} == {i: want[k, f] for i, k, f, _ in photos} and len(rows) == 4000
    assert all(len({r.at for r in rows if (r.lens_type, r.focal) == x}) > 1 for x in want)


def test_long_lens_texts_are_written_once(spark, tmp_path):
    """A text longer than the usual dictionary of Parquet, for 40 lines."""
    spark.conf.unset("parquet.dictionary.page.size")
    spark.range(0, 2_000_000, 50).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "0L AS l_partkey", "70L AS l_suppkey", "9.0D AS l_quantity", "0.01D AS l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    CATALOGUE["lens_matches"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    spark.conf.unset("parquet.dictionary.page.size")
    texts = {r.lens for r in spark.read.parquet(f"{tmp_path}/out").distinct().collect()}
    assert len(texts) == 1 and len(names := texts.pop().split(" or ")) == 40_000 and [x.split()[1] for x in names] == [str(k) for k in range(0, 2_000_000, 50)]
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1_500_000


def test_descriptions_by_language(spark):
    assert records.language_chain("pt_BR") == ["pt-br", "pt", "en"] and records.language_chain("en-GB") == ["en-gb", "en"] and records.language_chain("de", "fr") == ["de", "fr"]
    names = spark.createDataFrame([("make", "de", "Hersteller"), ("Make", "en", "Maker"), ("MODEL", "de-AT", "Modell"), ("model", "de", None), ("Model", "en", "B"), ("Model", "en", "A"), (None, "de", "x")], "tag string, language string, text string")
    tags = spark.createDataFrame([(1, "Make"), (2, "Model"), (3, "LensModel"), (4, None)], "i int, tag string")
    got = lambda language: [r.description for r in records.localised(tags, names, language).orderBy("i").collect()]
    assert got("de") == ["Hersteller", "A", "Lens Model", None] and got("de_AT") == ["Hersteller", "Modell", "Lens Model", None] and got("fr") == ["Maker", "A", "Lens Model", None]


def test_report_columns_as_rows(spark):
    """As the list for a pivot, where the first file has all tags and where a later one adds some."""
    rows = [("b", "z", 1), ("a", "Y", 2), ("a", "x", 1), ("a", "z", 3), ("b", "x", 2)]
    for more in ([], [("c", "w", 1), ("c", "Q", 2)]):
        df = spark.createDataFrame(rows + more, "f string, tag string, n int")
        got = [r.tag for r in records.report_columns(df, "f", "tag", "n").orderBy("place").collect()]
        assert got == records.columns_of_first(df, "f", "tag", "n") == (["Q", "w", "x", "Y", "z"] if more else ["x", "Y", "z"])
    assert records.report_columns(df.where("n > 9"), "f", "tag", "n").count() == 0
