from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from albumflow.functions import dates, numbers, paths, text


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_strict_parse(spark):
    good = datetime(2024, 2, 29, 23, 59, 59)
    rows = ["2024:02:29 23:59:59", " 2024:02:29 23:59:59\t", "2023:02:29 00:00:00", "2024:02:29 23:59:60", "2024:02:29 24:00:00", "2024:02:29 23:59:59.5", "2024:02:29 23:59:59Z", "0000:00:00 00:00:00", "2024-02-29 23:59:59", "", None]
    assert values(spark, dates.strict_parse, rows) == [good, good] + [None] * 9


def test_invalid_date(spark):
    rows = ["1899:12:31 00:00:00", "1900:01:01 00:00:00", "1903:01:01 00:00:00", "1904:01:01 00:00:00", "1905:01:01 00:00:00", None]
    assert values(spark, lambda c: dates.invalid_date(dates.strict_parse(c)), rows) == [True, False, False, True, False, True]


def test_epoch_bounds(spark):
    rows = [0, -2082844800, 253402300799, 253402300800, -62135596801, 2**62, None]
    got = values(spark, lambda c: dates.epoch_to_ts(c).cast("string"), rows, "bigint")
    assert got == ["1970-01-01 00:00:00", "1904-01-01 00:00:00", "9999-12-31 23:59:59", None, None, None, None]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)), st.integers(0, 40), st.integers(0, 40), st.sampled_from([1, -1]))
def test_month_shift_runs_over(spark, ts, months, days, sign):
    ts = ts.replace(microsecond=0)
    shift = f"{'-' if sign < 0 else ''}0:{months}:{days} 0"
    total = ts.year * 12 + ts.month - 1 + sign * months
    want = datetime(total // 12, total % 12 + 1, 1, ts.hour, ts.minute, ts.second) + timedelta(days=ts.day - 1 + sign * days)
    assert values(spark, lambda c: dates.shift_by(c, shift), [ts], "timestamp_ntz") == [want]


def test_month_shift_from_the_31st(spark):
    rows = [datetime(2024, 1, 31), datetime(2023, 1, 31)]
    assert values(spark, lambda c: dates.shift_by(c, "0:1:0 0"), rows, "timestamp_ntz") == [datetime(2024, 3, 2), datetime(2023, 3, 3)]


def test_tolerant_format(spark):
    rows = ["2024:03:05 06:07:08", "20240305", "2024", "0999:01:01", "none"]
    assert values(spark, lambda c: dates.format_tolerant(c, "%Y-%m-%d"), rows) == ["2024-03-05", "2024-03-05", "2024-01-01", "0999:01:01", "none"]


def test_exif_zone(spark):
    rows = ["1970:01:01 01:00:00+01:00", "1970-01-01 00:00:10Z", "1970:01:01 00:00:00-00:30", "bad"]
    assert values(spark, dates.exif_to_unix, rows) == [0, 10, 1800, None]


def test_human_span(spark):
    rows = [0.0, 12.345, 90.0, 86400.0, 90000.0, -45.0]
    assert values(spark, dates.human_span, rows, "double") == ["0 s", "12.35 s", "0:01:30", "24:00:00", "1 days 1:00:00", "-0:00:45"]


@pytest.mark.parametrize(("name", "stem", "ext"), [("a.jpg", "a", ".jpg"), (".jpg", "", ".jpg"), ("a.", "a", ""), ("a", "a", ""), ("a.b.MOV", "a.b", ".MOV")])
def test_names(spark, name, stem, ext):
    assert values(spark, lambda c: F.concat_ws("|", paths.stem_of(c), paths.ext_of(c)), [name]) == [f"{stem}|{ext}"]


def test_template(spark):
    got = values(spark, lambda c: paths.fill_template("%d%f%c.%e%%", F.lit("d"), c, F.lit(".JPG"), F.lit(2)), ["x"])
    assert got == ["d/x2.JPG%"]


def test_whole_number(spark):
    rows = ["42", " +42 ", "-1", "4.2", "1e3", "", None, "99999999999999999999"]
    assert values(spark, text.whole_number, rows) == [42, 42, -1, None, None, None, None, None]


def test_sidecar_seconds(spark):
    rows = ['{"photoTakenTime":{"timestamp":"5"},"creationTime":{"timestamp":"6"}}', '{"creationTime":{"timestamp":"6"}}', '{"photoTakenTime":{"timestamp":""},"creationTime":{"timestamp":"7"}}', '{"photoTakenTime":{"timestamp":8}}', "{broken", "{}"]
    assert values(spark, text.sidecar_seconds, rows) == [5, 6, 7, 8, None, None]


def test_natural_key(spark):
    rows = ["img10", "img9", "img1"]
    assert [rows[i] for i in sorted(range(3), key=values(spark, text.natural_key, rows).__getitem__)] == ["img1", "img9", "img10"]


def test_escapes(spark):
    assert values(spark, text.csv_cell, ['a,b"', "plain", " x"]) == ['"a,b"""', "plain", '" x"']
    assert values(spark, text.json_value, ["12", "012", "1.50", "TRUE", 'a"b']) == ["12", '"012"', "1.50", "true", '"a\\"b"']
    assert values(spark, lambda c: text.xml_unescape(text.xml_escape(c)), ["<a href='x'>&\"</a>"]) == ["<a href='x'>&\"</a>"]


def test_list_item(spark):
    assert values(spark, lambda c: F.concat_ws("|", text.list_item(text.split_list(c), 0), text.list_item(text.split_list(c), -1)), ["a, b, c"]) == ["a|c"]


def test_dms(spark):
    rows = [12.99999999, -0.5, 0.0]
    assert values(spark, lambda c: numbers.to_dms(c, "N", "S"), rows, "double") == ["13 deg 0' 0.00\" N", "0 deg 30' 0.00\" S", "0 deg 0' 0.00\" N"]
    assert values(spark, numbers.from_dms, ["12 30 0 S", "1.5", ""]) == [-12.5, 1.5, None]


def test_round_digits(spark):
    assert values(spark, lambda c: numbers.round_digits(c, 3), [0.0, 1234.5, 0.0012345], "double") == pytest.approx([0.0, 1230.0, 0.00123])


def test_bits(spark):
    assert values(spark, lambda c: numbers.bits_set(c, {0: "a", 2: "c"}), [5, 2, 0], "int") == ["a, c", "[1]", "(none)"]


@settings(deadline=None, max_examples=15, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.integers(-4000, 4000).map(lambda n: n / 16), st.integers(-9999, 9999).map(lambda n: n / 1000)), min_size=1, max_size=60))
def test_fixed_rounds_as_c_does(spark, rows):
    rows = [float(f"{x:.15g}") for x in rows]
    for digits in range(5):
        assert values(spark, lambda c: numbers.fixed(c, digits), rows, "double") == [f"{x:.{digits}f}" for x in rows]


def test_ties_of_printed_numbers(spark):
    assert values(spark, numbers.human_bitrate, [16.25, 49.25, 2.345, 99.95, 1500.5], "double") == ["16.2 bps", "49.2 bps", "2.35 bps" if f"{2.345:.2f}" == "2.35" else "2.34 bps", "100 bps" if f"{99.95:.1f}" == "100.0" else "100 bps", "1.5 kbps"]
    assert values(spark, numbers.human_size, [2250, 12500, 13500], "bigint") == ["2.2 kB", "12 kB", "14 kB"]
    assert values(spark, numbers.exposure_text, [0.35, 0.25002, 2.25, 2.5], "double") == ["0.3" if f"{0.35:.1f}" == "0.3" else "0.4", "0.3", "2.2", "2.5"]
    assert values(spark, numbers.f_number_text, [2.25, 0.125, 0.375], "double") == ["2.2", "0.12", "0.38"]


def test_letters(spark):
    def by_hand(n):
        out = ""
        while n >= 0:
            out, n = chr(97 + n % 26) + out, n // 26 - 1
        return out

    rows = [0, 25, 26, 27, 701, 702, 18277, 18278, 10**6, 10**9, 10**12, 10**16]
    assert values(spark, paths.letters, rows, "bigint") == [by_hand(n) for n in rows] and values(spark, paths.letters, [-1], "bigint") == [""]


def test_template_pieces():
    own = [x if isinstance(x, str) else tuple(x) for x in paths.template_pieces("a%-3.1lf%%b%d%5C%z%") if x]
    assert own == ["a", ("f", "-", "3", ".", "1", "l"), "%", "b", ("d", "", "", "", "", ""), ("C", "", "5", "", "", ""), "%z", "%"]


def test_directives():
    own = [(d.text, d.code, d.digits, d.bare, d.colon) for d in dates.directives("x%Y%%z%-.3f%:z%z%fy%-d") if d.text]
    assert own[:3] == [("x", "", "", False, False), ("%Y", "Y", "", False, False), ("%", "%", "", False, False)] and own[3][0] == "z"
    assert [(c, n, bare, colon) for _, c, n, bare, colon in own if c in "fz" and c] == [("f", "3", True, False), ("z", "", False, True), ("z", "", False, False), ("f", "", False, False)]
    assert own[-2:] == [("%-", "-", "", False, False), ("d", "", "", False, False)]


@pytest.mark.parametrize(
    "strftime, text, want",
    [
        ("%Y-%m-%d %H:%M:%S%f%z", "2024-02-29 1:02:03.25+0530", "2024:02:29 01:02:03.25+05:30"), ("%Y-%m-%d %H:%M:%S%f%z", "2024-02-29 01:02:03", "2024:02:29 01:02:03"),
        ("%Y%m%d", "20240229", "2024:02:29 00:00:00"), ("%e %b %Y", " 5 Mar 2024", "2024:03:05 00:00:00"), ("%u %Y/%m/%d", "4 2024/02/29", "2024:02:29 00:00:00"), ("%Y%n%j", "2024  60", "2024:02:29 00:00:00"),
        ("%Y.%m", "2024x02", None), ("%s", "86400", "1970:01:02 00:00:00"), ("%d.%m.%Y %%", "1.2.2024 %", "2024:02:01 00:00:00"), ("%I:%M %p %F", "01:05 PM 2024-02-29", "2024:02:29 13:05:00"), ("%Y%m%dT%H%M%S%z", "20240229T010203Z", "2024:02:29 01:02:03Z"),
    ],
)
def test_written_dates_of_a_form(spark, strftime, text, want):
    assert values(spark, lambda c: dates.written_date(c, strftime=strftime), [text]) == [want]


def test_unknown_directives_are_errors(spark):
    for bad in ("%Q", "%Y%_", "%"):
        with pytest.raises(ValueError, match="directive"):
            dates.parse_by(F.col("x"), bad)


def test_written_dates_compute_their_text_once(spark):
    """A text that is dear to make is not made again for each part of a date; single digits do not fail a form first."""
    text = F.concat(F.col("t"), F.lit(" mark"))
    for form in (None, "%d.%m.%Y %H:%M:%S mark"):
        df = spark.createDataFrame([("3.4.2024 5:06:07",), ("30.2.2024 05:06:07",), (None,)], "t string").select(dates.written_date(text, strftime=form).alias("d"))
        assert df._jdf.queryExecution().analyzed().toString().count(" mark)") == 1
        if form:
            assert [r.d for r in df.collect()] == ["2024:04:03 05:06:07", None, None]
