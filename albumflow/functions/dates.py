"""Dates and times of media files.  All are wall-clock times without a zone."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumflow.functions.numbers import fixed

#: Seconds from 1904 to 1970, and the range of years 1 to 9999 in epoch seconds.
QUICKTIME_OFFSET = 2082844800
EPOCH_LOW, EPOCH_HIGH = -62135596800, 253402300799
ZERO_DATE = "0000:00:00 00:00:00"

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(text: Column) -> Column:
    """Trim Unicode white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def make_ts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A time from its parts, null where they make none."""
    whole = [x.cast("int") for x in (year, month, day, hour, minute)]
    return F.try_make_timestamp_ntz(*whole, second.cast("decimal(8,6)"))


def strict_parse(text: Column) -> Column:
    """``yyyy:MM:dd HH:mm:ss`` and nothing else, after trimming; null on any deviation."""
    own = F.regexp_extract(text, r"(?U)^\s*(?!0000)([0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-5][0-9])\s*$", 1)
    return F.overlay(F.overlay(own, F.lit("-"), 5), F.lit("-"), 8).try_cast("timestamp_ntz")


def invalid_date(ts: Column) -> Column:
    """No date, before 1900, or in 1904, the zero year of video containers."""
    return ts.isNull() | (F.year(ts) < 1900) | (F.year(ts) == 1904)


def epoch_to_ts(seconds: Column) -> Column:
    """Epoch seconds to UTC wall clock; null outside years 1 to 9999."""
    seconds = seconds.cast("bigint")
    inside = F.when(seconds.between(EPOCH_LOW, EPOCH_HIGH), seconds)
    return F.expr(_EPOCH) + F.make_dt_interval(secs=inside.cast("decimal(18,6)"))


def ts_to_epoch(ts: Column) -> Column:
    """Whole epoch seconds of a UTC wall clock."""
    return (F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)))


def quicktime_epoch(seconds: Column) -> Column:
    """Seconds since 1904, or since 1970 where the number is too small for that, as epoch seconds."""
    return F.when(seconds >= QUICKTIME_OFFSET, seconds - QUICKTIME_OFFSET).otherwise(seconds)


def unix_to_exif(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy:MM:dd HH:mm:ss``; 0 is the zero date."""
    return F.when(seconds == 0, F.lit(ZERO_DATE)).otherwise(F.date_format(epoch_to_ts(seconds), "yyyy:MM:dd HH:mm:ss"))


def exif_to_unix(text: Column) -> Column:
    """Epoch seconds of ``yyyy:MM:dd HH:mm:ss`` with either date separator and an optional zone."""
    pattern = r"^\s*(\d{4})[-:](\d{2})[-:](\d{2}) (\d{2}):(\d{2}):([0-5]\d)(?:\.\d+)?(Z|[+-]\d{2}:\d{2})?\s*$"
    ok = text.rlike(pattern)
    part = [F.when(ok, F.regexp_extract(text, pattern, i)) for i in range(1, 7)]
    return ts_to_epoch(make_ts(*part)) - zone_minutes(F.regexp_extract(text, pattern, 7)) * 60


def year_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy")


def bucket(ts: Column, granularity: str = "day") -> Column:
    return F.date_format(ts, {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[granularity])


def split_shift(shift: str) -> tuple[int, list[float]]:
    """Sign and the parts years, months, days, hours, minutes, seconds of ``[+-]Y:M:D h:m:s``.

    Without a blank the text is a time (``h``, ``h:m`` or ``h:m:s``).
    """
    sign, text = (-1 if shift.startswith("-") else 1), shift.lstrip("+-").strip()
    date, _, time = text.rpartition(" ")
    days = [float(x) for x in date.split(":")] if date else []
    hours = [float(x) for x in time.split(":")]
    if date:
        days = [0.0] * (3 - len(days)) + days
    return sign, (days or [0.0] * 3) + (hours + [0.0] * 3)[:3]


def shift_by(ts: Column, shift: str) -> Column:
    """Shift by components; a day past the month's end runs over into the next month."""
    sign, (years, months, days, hours, minutes, seconds) = split_shift(shift)
    months_total = F.year(ts) * 12 + F.month(ts) - 1 + int(sign * (years * 12 + months))
    first = F.make_timestamp_ntz(F.floor(months_total / 12).cast("int"), F.pmod(months_total, F.lit(12)) + 1, F.lit(1), F.hour(ts), F.minute(ts), F.extract(F.lit("SECOND"), ts))
    moved = first + F.make_dt_interval(F.dayofmonth(ts) - 1)
    total = sign * (days * 86400 + hours * 3600 + minutes * 60 + seconds)
    return moved + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(total).cast("decimal(18,6)"))


def shift_seconds(ts: Column, seconds: Column | float) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def tolerant_parse(text: Column) -> Column:
    """Digits in reading order as year, month, day, hour, minute, second; missing ones are 1 or 0.

    Null unless the year is from 1000 to 2999.
    """
    compact = F.regexp_replace(text, r"^\s*(\d{4})(\d{2})(\d{2})(?!\d)", "$1:$2:$3 ")
    digits = F.regexp_extract_all(compact, F.lit(r"(\d+)"), 1)
    part = lambda i, missing: F.coalesce(F.substring(F.get(digits, F.lit(i)), 1, 4), F.lit(missing)).cast("int")
    year = part(0, "0")
    ok = year.between(1000, 2999)
    rest = [part(i, m) for i, m in ((1, "1"), (2, "1"), (3, "0"), (4, "0"), (5, "0"))]
    second = F.when(rest[4] < 60, rest[4])
    return F.try_make_timestamp_ntz(F.when(ok, year), *rest[:4], second.cast("decimal(8,6)"))


#: Strftime directives and their Spark patterns.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%p": "a", "%b": "MMM", "%h": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD",
    "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%D": "MM/dd/yy",
}


class Directive(NamedTuple):
    """A piece of a strftime pattern: a literal text (no code), or a code letter with its options."""

    text: str
    code: str = ""
    digits: str = ""  # of a fraction
    bare: bool = False  # a fraction without its point
    colon: bool = False  # a zone with a colon


def directives(strftime: str) -> Iterator[Directive]:
    """The pieces of a pattern, in order.  Only f takes a minus sign, a point or digits, and only z a colon."""
    first, *rest = strftime.split("%")
    yield Directive(first)
    pieces = iter(rest)
    for piece in pieces:
        if not piece:  # two percent signs
            after = next(pieces, None)
            if after is None:
                raise ValueError(f"unknown strftime directive: % at the end of {strftime}")
            yield Directive("%", "%")
            yield Directive(after)
            continue
        lead = len(piece) - len(piece.lstrip("-.0123456789"))
        options, code = piece[:lead], piece[lead : lead + 1]
        if code == "f" and options.lstrip("-").lstrip(".").isdigit() | (options in ("", "-", ".", "-.")):
            yield Directive("%" + options + code, "f", options.strip("-."), options.startswith("-"))
            yield Directive(piece[lead + 1 :])
        elif piece.startswith((":z", "z")):
            yield Directive("%" + piece[: piece.index("z") + 1], "z", colon=piece[0] == ":")
            yield Directive(piece[piece.index("z") + 1 :])
        else:
            yield Directive("%" + piece[0], piece[0])
            yield Directive(piece[1:])


def zone_form(zone: Column) -> Column:
    """``+5:30``, ``+530`` and the like as ``+05:30``; other texts stay."""
    two_hours = F.regexp_replace(zone, r"^([+-])(\d:?\d\d)$", "$10$2")
    return F.regexp_replace(two_hours, r"^([+-]\d\d):?(\d\d)$", "$1:$2")


def zone_minutes(zone: Column) -> Column:
    """Minutes of a zone at a text's end: a sign, one or two digits of hours, two of minutes, a colon or none; 0 for Z and for none."""
    own = F.regexp_replace(zone, r"[^0-9+-]", "")
    size = F.regexp_extract(own, r"(\d+)\d\d$", 1).try_cast("int") * 60 + F.right(own, F.lit(2)).try_cast("int")
    return F.coalesce(F.when(own.startswith("-"), -size).otherwise(size), F.lit(0))


def format_ts(ts: Column, strftime: str, fraction: Column | None = None, zone: Column | None = None) -> Column:
    """Format by a strftime pattern.

    ``%f`` is the fraction (``.25``) as it is, ``%3f`` three digits of it, ``%-f`` without its point;
    rounding carries into the seconds.  ``%z`` and ``%:z`` are the zone (``+hh:mm``, else UTC) without and
    with colon, and ``%s`` the epoch seconds of the wall clock in that zone.
    """
    fraction = F.lit("") if fraction is None else F.coalesce(fraction, F.lit(""))
    zone = F.lit("") if zone is None else F.coalesce(zone, F.lit(""))
    offset = F.when(zone.rlike(r"^[+-]\d{2}:\d{2}$"), zone).otherwise("+00:00")
    pieces = list(directives(strftime))
    digits = next((p.digits for p in pieces if p.code == "f"), "")
    if digits:
        rounded = fixed(F.coalesce(F.concat(F.lit("0"), fraction).try_cast("double"), F.lit(0.0)), int(digits))
        ts = shift_seconds(ts, F.regexp_extract(rounded, r"^(\d+)", 1).cast("int"))
        fraction = F.regexp_replace(rounded, r"^\d+", "")
    simple = {
        "%": lambda: F.lit("%"), "n": lambda: F.lit("\n"), "t": lambda: F.lit("\t"), "e": lambda: F.lpad(F.dayofmonth(ts).cast("string"), 2, " "),
        "u": lambda: (F.weekday(ts) + 1).cast("string"), "w": lambda: (F.dayofweek(ts) - 1).cast("string"), "s": lambda: (ts_to_epoch(ts) - 60 * zone_minutes(offset)).cast("string"),
    }
    parts = []
    for p in pieces:
        if not p.code:
            parts.append(F.lit(p.text))
        elif p.code == "f":
            parts.append(F.regexp_replace(fraction, r"^\.", "") if p.bare else fraction)
        elif p.code == "z":
            parts.append(offset if p.colon else F.replace(offset, F.lit(":"), F.lit("")))
        elif p.code in simple:
            parts.append(simple[p.code]())
        elif p.text in STRFTIME:
            parts.append(F.date_format(ts, STRFTIME[p.text]))
        else:
            raise ValueError(f"unknown strftime directive: {p.text}")
    return F.when(ts.isNotNull(), F.concat(*parts))


def format_tolerant(text: Column, strftime: str, strict: bool = False) -> Column:
    """Reformat a date text; one that is no date stays as it is, or is null if ``strict``."""
    zone = F.regexp_extract(text, r"([-+]\d{2}:\d{2}|Z)$", 1)
    body = F.regexp_replace(text, r"([-+]\d{2}:\d{2}|Z)$", "")
    out = format_ts(tolerant_parse(body), strftime, F.regexp_extract(body, r"(\.\d+)", 1), zone)
    return out if strict else F.coalesce(out, text)


class Parsed(NamedTuple):
    ts: Column
    fraction: Column  # with its point, or empty
    zone: Column  # as +hh:mm or Z, or empty


#: What a code matches in a text.  %n and %t match white space.
_MATCHES = {
    "f": r"(?:\.?\d+)?", "z": r"(?:Z|[+-]\d{1,2}:?\d{2})?", "n": r"\s+", "t": r"\s+", "%": "%", "e": r"\s*\d{1,2}", "u": r"[1-7]", "w": r"[0-6]", "Y": r"\d{4}", "j": r"\d{1,3}",
    "b": r"[^\W\d_]+", "h": r"[^\W\d_]+", "B": r"[^\W\d_]+", "a": r"[^\W\d_]+", "A": r"[^\W\d_]+", "p": r"(?i:[ap]m)", "F": r"\d{4}-\d{1,2}-\d{1,2}", "T": r"\d{1,2}:\d{1,2}:\d{1,2}", "R": r"\d{1,2}:\d{1,2}",
    "D": r"\d{1,2}/\d{1,2}/\d{2}",
}


def parse_by(text: Column, strftime: str) -> Parsed:
    """The time in a text of a strftime pattern, with fraction and zone where it has them; null where it is none.

    Weekdays as numbers (%u, %w) are read over, blanks in the text match %n and %t.
    """
    if strftime == "%s":
        return Parsed(epoch_to_ts(text.try_cast("bigint")), F.lit(""), F.lit(""))
    own, form, values, marks = "^", "", [], {}
    group = 0
    for p in directives(strftime):
        if not p.code:
            own += re.escape(p.text)
            continue
        if p.text not in STRFTIME and p.code not in _MATCHES:
            raise ValueError(f"unknown strftime directive: {p.text}")
        own += f"({_MATCHES.get(p.code, r'\d{1,2}')})"
        group += 1
        if p.code in ("f", "z"):
            marks[p.code] = group
        elif p.text in STRFTIME or p.code == "e":
            values.append((group, len(STRFTIME.get(p.text, "dd")) if _MATCHES.get(p.code, r"\d{1,2}") in (r"\d{1,2}", r"\s*\d{1,2}", r"\d{1,3}") else 0))
            form += STRFTIME.get(p.text, "dd") + "'\u0001'"
    own += "$"
    piece = lambda group: F.regexp_extract(text, own, group)
    # numbers get their leading zeros, as a text that a form refuses costs far more than one it takes
    full = lambda group, width: F.lpad(F.trim(piece(group)), width, "0") if width else F.trim(piece(group))
    joined = F.concat(*[F.concat(full(*v), F.lit("\u0001")) for v in values]) if values else F.lit(None).cast("string")
    loose = re.sub(r"(?<![a-zA-Z])(MM|dd|HH|hh|mm|ss|DDD)(?![a-zA-Z])", lambda m: m[0][0], form)  # single digits
    parsed = bound(joined, lambda x: F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in (form, loose)]))
    ts = F.when(text.rlike(own), parsed.cast("timestamp_ntz"))
    fraction = piece(marks["f"]) if "f" in marks else F.lit("")
    zone = piece(marks["z"]) if "z" in marks else F.lit("")
    return Parsed(ts, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), F.regexp_replace(fraction, r"^\.", ""))), zone_form(zone))


def written_date(text: Column, keep_zone: bool | None = None, date_only: bool = False, strftime: str | None = None, now: Column | None = None) -> Column:
    """A date as it is typed in, as ``YYYY:MM:DD HH:MM:SS[.ss][zone]``; null if it is none.

    Any separators will do; minutes and seconds may be missing.  ``keep_zone`` False drops fraction and
    zone, True adds UTC where there is none.  ``date_only`` also takes years, months or days alone.
    ``now`` in the text is the current time.  With ``strftime`` the text must have that form.
    """
    if strftime is not None:
        return bound(text, lambda own: _of_form(own, keep_zone, strftime))
    clock = F.date_format(F.localtimestamp() if now is None else now, "yyyy:MM:dd HH:mm:ss")
    clock = F.concat(clock, F.lit("Z")) if keep_zone else clock
    own = F.regexp_replace(trim_all(text), r"(?i)(?<=\d) *dst$", "")
    return bound(own, lambda own: F.when(F.lower(own) == "now", clock).otherwise(_typed(own, keep_zone, date_only)))


def _of_form(text: Column, keep_zone: bool | None, strftime: str) -> Column:
    found = parse_by(text, strftime)
    out = F.date_format(found.ts, "yyyy:MM:dd HH:mm:ss")
    if keep_zone is False:
        return out
    return F.concat(out, found.fraction, bound(found.zone, lambda zone: F.when(zone == "", "Z").otherwise(zone)) if keep_zone else found.zone)


def _typed(own: Column, keep_zone: bool | None, date_only: bool) -> Column:
    """``written_date`` of a trimmed text in any form."""

    def of_parts(body: Column, rest: Column, tail: Column) -> Column:
        zone = F.upper(zone_form(tail))
        year = F.regexp_extract(body, r"(\d{4})", 1)
        part = lambda i, missing="00": F.lpad(F.coalesce(F.get(rest, F.lit(i)), F.lit(missing)), 2, "0")
        seconds = F.when(F.get(rest, F.lit(4)).try_cast("int") < 60, F.concat(F.lit(":"), part(4))).otherwise(F.lit("" if date_only else ":00"))
        fraction = F.when(F.size(rest) > 5, F.regexp_extract(body, r"(\.\d+)\s*$", 1)).otherwise("")
        if keep_zone is False:
            fraction = zone = F.lit("")
        elif keep_zone:
            zone = bound(zone, lambda zone: F.when(zone == "", "Z").otherwise(zone))
        inside = part(0).cast("int").between(1, 12) & part(1).cast("int").between(1, 31) & (part(2).cast("int") <= 24) & (part(3).cast("int") <= 59)
        full = F.when(inside, F.concat(year, F.lit(":"), part(0), F.lit(":"), part(1), F.lit(" "), part(2), F.lit(":"), part(3), seconds, fraction, zone))
        short = F.concat_ws(":", year, F.transform(rest, lambda x: F.lpad(x, 2, "0"))) if date_only else F.lit(None).cast("string")
        return F.when(year != "", F.when(F.size(rest) >= 3, full).otherwise(short))

    rest = lambda body: F.regexp_extract_all(F.regexp_extract(body, r"\d{4}(.*)$", 1), F.lit(r"(\d{1,2})"), 1)
    body = lambda tail: F.substring(own, F.lit(1), F.length(own) - F.length(tail))
    of_body = lambda tail: bound(body(tail), lambda b: bound(rest(b), lambda r: of_parts(b, r, tail)))
    return bound(F.regexp_extract(own, r"([+-]\d{1,2}:?\d{2}|[zZ])$", 1), of_body)


def merge_subseconds(base: Column, subsec: Column, offset: Column) -> Column:
    """``base[.subsec][offset]`` as text."""
    digits = F.regexp_extract(subsec, r"^\s*(\d+)", 1)
    return F.concat(base, F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.coalesce(trim_all(offset), F.lit("")))


def zone_text(minutes: Column) -> Column:
    """An offset in minutes as ``+hh:mm``."""
    size = F.abs(minutes)
    return F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60), F.pmod(size, F.lit(60)))


def human_span(seconds: Column) -> Column:
    """``0 s``, ``12.34 s`` under half a minute, else ``h:mm:ss``, and days above 24 hours."""
    sign = F.when(seconds < 0, "-").otherwise("")
    size = F.abs(seconds)
    whole = F.floor(size + 0.5)
    hours, minutes, rest = F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60))
    clock = lambda h: F.format_string("%d:%02d:%02d", h, minutes, rest)
    long = F.when(hours > 24, F.concat(F.floor(hours / 24).cast("string"), F.lit(" days "), clock(F.pmod(hours, F.lit(24))))).otherwise(clock(hours))
    return F.when(seconds == 0, "0 s").when(size < 30, F.concat(sign, fixed(size, 2), F.lit(" s"))).otherwise(F.concat(sign, long))


def elapsed_text(seconds: Column) -> Column:
    """``hh:mm:ss``; hours wrap at 24."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.pmod(F.floor(whole / 3600), F.lit(24)), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)))


def normal_date(text: Column) -> Column:
    """``YYYYMMDD`` or any separators as ``YYYY:MM:DD``; other texts stay."""
    digits = r"^\s*(\d{4})[-:/. ]?(\d{2})[-:/. ]?(\d{2})\s*$"
    return F.regexp_replace(text, digits, "$1:$2:$3")


def normal_time(text: Column) -> Column:
    """``HHMMSS``, with or without a zone, as ``HH:MM:SS[+HH:MM]``; other texts stay."""
    sign = F.regexp_extract(text, r"([+-])", 1)
    clock, zone = (F.regexp_replace(F.get(F.split(text, r"[+-]", 2), F.lit(i)), r"[\s:]", "") for i in (0, 1))
    pairs = lambda digits, count: [F.substring(digits, 2 * i + 1, 2) for i in range(count)]
    shown = F.concat(F.concat_ws(":", *pairs(clock, 3)), F.substring(clock, 7, 20))
    shown = F.when(sign == "", shown).when(zone.rlike(r"^\d{4}$"), F.concat(shown, sign, F.concat_ws(":", *pairs(zone, 2))))
    return F.when(clock.rlike(r"^\d{6}(\.\d+)?$"), F.coalesce(shown, text)).otherwise(text)


def date_problem(text: Column) -> Column:
    """What is wrong with an EXIF date text; null if nothing is.  A blank date is allowed."""
    pattern = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})$"
    part = lambda i: F.regexp_extract(text, pattern, i).cast("int")
    shape = F.when(text.rlike(pattern), F.when(part(2).between(1, 12) & part(3).between(1, 31), F.when((part(4) > 23) | (part(5) > 59) | (part(6) > 59), "bad time")).otherwise("bad date")).otherwise("bad format")
    return F.when(F.coalesce(text.rlike(r"^[\s:]*$") | (text == ZERO_DATE), F.lit(True)), None).otherwise(shape)


def gps_time(hour: Column, minute: Column, second: Column) -> Column:
    """``HH:MM:SS`` of three numbers whose fractions carry down and whose seconds carry up."""
    total = F.round((hour * 3600 + minute * 60 + second) * 1000) / 1000
    whole = F.floor(total)
    rest = total - whole
    clock = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)))
    return F.concat(clock, F.when(rest > 0, F.regexp_replace(F.substring(fixed(rest, 3), 2, 4), "0+$", "")).otherwise(""))


def shift_all(rows, shift: str):
    """rows with every time column shifted."""
    names = [name for name, kind in rows.dtypes if kind == "timestamp_ntz"]
    return rows.withColumns({n: shift_by(F.col(n), shift) for n in names})


def xmp_date_problem(text: Column) -> Column:
    """What is wrong with an XMP date: a year, a month, a day, or a day with a time; null if nothing is."""
    pattern = r"^(\d{4})(?::(\d{2}))?(?::(\d{2}))?(?: (\d{2}):(\d{2})(?::(\d{2})(?:\.\d*)?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    bad_day = (~F.coalesce(part(2), F.lit(1)).between(1, 12)) | (~F.coalesce(part(3), F.lit(1)).between(1, 31))
    bad_time = (part(4) > 23) | (part(5) > 59) | (part(6) > 59)
    shape = F.when(text.rlike(pattern), F.when(bad_day, "bad date").when(bad_time, "bad time")).otherwise("bad format")
    return F.when(text.isNotNull(), shape)
