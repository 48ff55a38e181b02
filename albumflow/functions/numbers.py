"""Photographic, geographic and display columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals as C prints it: rounded by the exact value of the double, a tie to the even digit.

    ``format_string`` rounds the shortest decimal form instead, and its ties up.  Digits beyond that form are zeros.
    """
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def megapixels(width: Column, height: Column) -> Column:
    return width * height / 1_000_000


def image_size(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def shutter_speed(exposure: Column, shutter: Column, bulb: Column) -> Column:
    """A bulb exposure's duration, else the first speed there is."""
    return F.when(bulb > 0, bulb).otherwise(F.coalesce(exposure, shutter))


def aperture(f_number: Column, value: Column) -> Column:
    """The first aperture that is not zero."""
    return F.coalesce(F.nullif(f_number, F.lit(0.0)), F.nullif(value, F.lit(0.0)))


def light_value(aperture: Column, shutter: Column, iso: Column) -> Column:
    """log2(A^2 * 100 / (T * ISO)) of positive values, else null."""
    ok = (aperture > 0) & (shutter > 0) & (iso > 0)
    return F.when(ok, F.log2(F.when(ok, aperture * aperture * 100 / (shutter * iso))))


def scale_factor(focal_35: Column, focal: Column) -> Column:
    return F.when(focal > 0, focal_35 / F.when(focal > 0, focal))


def circle_of_confusion(scale: Column) -> Column:
    """Millimetres: the diagonal of full frame over 1440, over the scale."""
    return math.sqrt(24 * 24 + 36 * 36) / (scale * 1440)


def hyperfocal(focal: Column, aperture: Column, coc: Column) -> Column:
    """Metres."""
    ok = (aperture > 0) & (coc > 0)
    return F.when(ok, focal * focal / F.when(ok, aperture * coc * 1000))


def depth_of_field(focal: Column, aperture: Column, coc: Column, distance: Column) -> Column:
    """Near and far limits in metres; far is 0 beyond the hyperfocal distance."""
    blur = coc * aperture * (distance * 1000 - focal)
    near = distance * focal * focal / (focal * focal + blur)
    rest = focal * focal - blur
    far = F.when(rest > 0, distance * focal * focal / F.when(rest > 0, rest)).otherwise(0.0)
    return F.struct(near.alias("near"), far.alias("far"))


def field_of_view(focal: Column, scale: Column) -> Column:
    """Degrees across the 36 mm side."""
    return F.degrees(2 * F.atan2(F.lit(36.0), 2 * focal * scale))


def balance(first: Column, green: Column) -> Column:
    """Red or blue level over green."""
    return F.when(green > 0, first / F.when(green > 0, green))


def signed_degrees(value: Column, ref: Column) -> Column:
    return F.when(F.upper(F.substring(ref, 1, 1)).isin("S", "W"), -value).otherwise(value)


def to_dms(value: Column, positive: str, negative: str) -> Column:
    """``12 deg 34' 56.78" N``, with seconds carried at 60."""
    hundredths = F.round(F.abs(value) * 360000).cast("bigint")
    seconds = F.pmod(hundredths, F.lit(6000)) / 100.0
    minutes = F.pmod(F.floor(hundredths / 6000), F.lit(60))
    return F.format_string("%d deg %d' %.2f\" %s", F.floor(hundredths / 360000), minutes, seconds, F.when(value < 0, negative).otherwise(positive))


def from_dms(text: Column) -> Column:
    """Signed degrees of one to three numbers and an optional letter of direction."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).cast("double"), F.lit(0.0))
    size = number(0) + number(1) / 60 + number(2) / 3600
    size = F.when(F.size(parts) > 0, size)
    return F.when(text.rlike(r"(?i)[SW]\s*$") | text.rlike(r"^\s*-"), -size).otherwise(size)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
    a = a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whole degrees from north, 0 to 359."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.floor(F.degrees(F.atan2(y, x)) + 360.5), F.lit(360))


def human_size(size: Column, binary: bool = False) -> Column:
    """Bytes in decimal or binary units, with one decimal below ten."""
    value, out = size.cast("double"), F.concat(size.cast("string"), F.lit(" bytes"))
    step = 1024 if binary else 1000
    for i, unit in enumerate(("KiB", "MiB", "GiB") if binary else ("kB", "MB", "GB"), 1):
        scaled = value / step**i
        shown = F.concat(F.when(scaled < 10, fixed(scaled, 1)).otherwise(fixed(scaled, 0)), F.lit(f" {unit}"))
        out = F.when(value < 2 * step**i, out).otherwise(shown)
    return out


def three_digits(value: Column) -> Column:
    """A number below 1000 with at most three significant digits and no zeros at the end."""
    out = fixed(value, 0)
    for decimals, limit in ((1, 100.0), (2, 10.0), (3, 1.0), (4, 0.1), (5, 0.01), (6, 0.001)):
        out = F.when(value < limit, F.regexp_replace(fixed(value, decimals), r"\.?0+$", "")).otherwise(out)
    return F.when(value == 0, "0").otherwise(out)


def human_bitrate(rate: Column) -> Column:
    """Bits a second, three significant digits below 100, whole numbers above."""
    value = rate.cast("double")
    out = None
    for n, unit in ((1.0, "bps"), (1e3, "kbps"), (1e6, "Mbps"), (1e9, "Gbps")):
        own = value / n
        text = F.concat(F.when(own < 100, three_digits(own)).otherwise(fixed(own, 0)), F.lit(f" {unit}"))
        hit = (own < 1000) | F.lit(unit == "Gbps")
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def exposure_text(seconds: Column) -> Column:
    """``1/250`` for short exposures, else decimal seconds."""
    short = (seconds < 0.25001) & (seconds > 0)
    fraction = F.concat(F.lit("1/"), F.floor(0.5 + 1 / F.when(short, seconds)).cast("string"))
    plain = F.regexp_replace(fixed(seconds, 1), r"\.0$", "")
    return F.when(short, fraction).otherwise(plain)


def bits_set(value: Column, names: dict[int, str], width: int = 32) -> Column:
    """Names of the bits that are set, joined; unnamed bits as ``[n]``, and ``(none)`` without any."""
    named = F.create_map(*[x for n, name in names.items() for x in (F.lit(n), F.lit(name))])
    on = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.expr("1") == F.call_function("bit_get", value.cast("bigint"), i))
    text = F.transform(on, lambda i: F.coalesce(F.try_element_at(named, i), F.concat(F.lit("["), i.cast("string"), F.lit("]"))))
    return F.when(F.size(on) == 0, "(none)").otherwise(F.array_join(text, ", "))


def bits_from(text: Column, names: dict[int, str]) -> Column:
    """The number whose named bits occur in a joined list of names."""
    bit = F.create_map(*[x for n, name in names.items() for x in (F.lit(name), F.lit(1 << n))])
    values = F.transform(F.split(text, ", "), lambda name: F.coalesce(F.try_element_at(bit, name), F.lit(0)).cast("bigint"))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def decode(value: Column, names: dict[str, str]) -> Column:
    """A fixed name of each value; others read ``Unknown (value)``."""
    named = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return F.coalesce(F.try_element_at(named, value), F.concat(F.lit("Unknown ("), value, F.lit(")")))


def round_digits(value: Column, digits: int) -> Column:
    """Round to significant digits."""
    power = F.floor(F.log10(F.abs(F.nullif(value, F.lit(0.0))))) + 1 - digits
    scale = F.pow(F.lit(10.0), power)
    return F.when(value == 0, 0.0).otherwise(F.round(value / scale) * scale)


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def histogram_bin(value: Column, low: float, high: float, bins: int = 20) -> Column:
    """Bin 0 to bins-1; the greatest value is in the last bin."""
    width = (high - low) / bins or 1.0
    return F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")


def rational(value: Column, largest: int = 1000) -> Column:
    """The fraction ``n/d`` nearest to a number, d at most ``largest``, the smallest d of equals."""
    tries = F.transform(F.sequence(F.lit(1), F.lit(largest)), lambda d: F.struct(F.round(F.abs(value - F.round(value * d) / d), 9).alias("error"), d.alias("d")))
    d = F.array_min(tries)["d"]
    return F.concat(F.round(value * d).cast("bigint").cast("string"), F.lit("/"), d.cast("string"))


def f_number_text(value: Column) -> Column:
    """An f-number with one decimal, two below 1."""
    number = value.cast("double")
    return F.when(number < 1, fixed(number, 2)).otherwise(fixed(number, 1))


def focal_length_text(focal: Column, scale: Column) -> Column:
    """``50.0 mm``, and what that is in 35 mm film where the scale is known."""
    plain = F.concat(fixed(focal, 1), F.lit(" mm"))
    film = F.concat(F.lit(" (35 mm equivalent: "), fixed(focal * scale, 1), F.lit(" mm)"))
    return F.concat(plain, F.when(scale.isNotNull() & (scale > 0), film).otherwise(""))


def scale_from_sensor(width: Column, height: Column) -> Column:
    """Scale to 35 mm film from a sensor's size in millimetres."""
    size = F.sqrt(width * width + height * height)
    return F.when((width > 0) & (height > 0), math.sqrt(24 * 24 + 36 * 36) / size)


def lens_text(short: Column, long: Column, wide: Column, narrow: Column) -> Column:
    """``18-55mm f/3.5-5.6`` of focal lengths and f-numbers; one number where both are equal, ``?`` for none."""
    plain = lambda x: F.when((x > 0), F.regexp_replace(fixed(x, 3), r"\.?0+$", "")).otherwise("?")
    span = lambda a, b: F.when(b.isNull() | (a == b), plain(a)).otherwise(F.concat(plain(a), F.lit("-"), plain(b)))
    return F.concat(span(short, long), F.lit("mm f/"), span(wide, narrow))


def degrees_text(value: Column, form: str = "%d deg %d' %.2f\"") -> Column:
    """Degrees by a printf form of one to three numbers: degrees, minutes, seconds; the last one has the fraction.

    Whole numbers carry, so no part reads 60.
    """
    kinds = re.findall(r"%[-+ 0]*\d*(?:\.(\d+))?([a-zA-Z])", form)[:3]
    decimals = int(kinds[-1][0] or 6) if kinds[-1][1] in "fFeEgG" else 0
    unit = (1, 60, 3600)[len(kinds) - 1] * 10**decimals
    total = F.round(F.abs(value) * unit).cast("bigint")
    last = 60 * 10**decimals
    parts = [F.when(value < 0, -total).otherwise(total) / float(10**decimals)] if len(kinds) == 1 else [F.pmod(total, F.lit(last)) / float(10**decimals)]
    rest = F.floor(total / last)
    for i in range(len(kinds) - 1):
        top = i == len(kinds) - 2
        parts.insert(0, rest if top else F.pmod(rest, F.lit(60)))
        rest = F.floor(rest / 60)
    whole = [p.cast("double") if k[1] in "fFeEgG" else F.round(p).cast("bigint") for p, k in zip(parts, kinds, strict=True)]
    return F.format_string(form, *whole)
