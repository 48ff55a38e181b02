"""Text, list and JSON columns."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from albumflow.functions.dates import epoch_to_ts


def whole_number(text: Column) -> Column:
    """A signed 64-bit integer with blanks around it, else null."""
    return F.regexp_extract(text, r"(?U)^\s*([+-]?[0-9]+)\s*$", 1).try_cast("bigint")


def sidecar_seconds(body: Column) -> Column:
    """Epoch seconds of ``photoTakenTime``, else of ``creationTime``; null in malformed JSON.

    An empty time falls through to the other; one that is no integer, or no possible
    time, does too, except that an impossible time ends the search.
    """
    first = whole_number(F.get_json_object(body, "$.photoTakenTime.timestamp"))
    second = whole_number(F.get_json_object(body, "$.creationTime.timestamp"))
    return F.coalesce(first, second)


def sidecar_ts(body: Column) -> Column:
    return epoch_to_ts(sidecar_seconds(body))


def csv_cell(text: Column, separator: str = ",") -> Column:
    """A CSV cell, quoted only if it must be; quotes are doubled."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    needs = F.contains(text, F.lit(separator)) | text.rlike('["\\r\\n]') | text.rlike(r"^\s|\s$")
    return F.when(needs, quoted).otherwise(text)


_CONTROL = [chr(c) for c in (*range(1, 32), 127) if chr(c) not in "\t\n\r"]


def _escaped(text: Column, marks: str, control: str) -> Column:
    """Backslashes before ``marks`` and for line ends and tabs; other control characters by ``control``."""
    out = F.regexp_replace(text, "([" + re.escape(marks) + "])", r"\\$1")
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for c in _CONTROL:
        rare = F.replace(rare, F.lit(c), F.lit(control % ord(c)))
    return F.when(out.rlike(r"[\x01-\x1f\x7f]"), rare).otherwise(out)


def json_text(text: Column) -> Column:
    """A JSON string literal; null characters are left out."""
    return F.concat(F.lit('"'), _escaped(F.replace(text, F.lit("\0"), F.lit("")), '\\"', "\\u%04X"), F.lit('"'))


def is_json_number(text: Column, digits: int = 15, decimals: int = 16, exponent: int = 3) -> Column:
    """A number by the JSON grammar, of at most so many digits in each of its parts."""
    grammar = r"^-?(0|[1-9][0-9]*)(?:[.]([0-9]+))?(?:[eE][+-]?([0-9]+))?$"
    size = lambda i: F.length(F.regexp_extract(text, grammar, i))
    return F.coalesce(text.rlike(grammar) & (size(1) <= digits) & (size(2) <= decimals) & (size(3) <= exponent), F.lit(False))


def json_value(text: Column) -> Column:
    """A JSON literal: plain numbers and booleans bare, all else a string."""
    return F.when(is_json_number(text), text).when(F.lower(text).isin("true", "false"), F.lower(text)).otherwise(json_text(text))


def php_text(text: Column) -> Column:
    """A PHP string literal in double quotes; null characters at its end are left out."""
    out = _escaped(F.regexp_replace(text, r"\x00+$", ""), '\\"$', "\\x%02X")
    return F.concat(F.lit('"'), F.replace(out, F.lit("\0"), F.lit("\\x00")), F.lit('"'))


def php_value(text: Column) -> Column:
    return F.when(is_json_number(text), text).otherwise(php_text(text))


def php_array(cells: dict[str, Column]) -> Column:
    """A PHP array of named texts."""
    entries = [F.concat(php_text(F.lit(name)), F.lit(" => "), php_value(value)) for name, value in cells.items()]
    return F.concat(F.lit("Array("), F.concat_ws(",", *entries), F.lit(")"))


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ("'", "#39"), ('"', "quot")):
        text = F.replace(text, F.lit(raw), F.lit(f"&{name};"))
    return text


def xml_unescape(text: Column) -> Column:
    for raw, name in (('"', "quot"), ("'", "#39"), (">", "gt"), ("<", "lt"), ("&", "amp")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(raw))
    return text


def describe_tag(tag: Column) -> Column:
    """A tag name as words: ``dateTime_original`` becomes ``Date Time original``.

    Words begin after a lower-case letter, at the last capital of several, and after a number unless a
    single letter follows it.  A number in hexadecimal at the end stays as it is.
    """
    name = F.replace(F.concat(F.upper(F.substring(tag, 1, 1)), F.substring(tag, 2, 1_000_000)), F.lit("_"), F.lit(" "))
    number = F.regexp_extract(name, r"(?i)( 0x[0-9a-f]+)$", 1)
    body = F.regexp_replace(name, r"(?i) 0x[0-9a-f]+$", "")
    body = F.regexp_replace(body, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.concat(F.regexp_replace(body, r"(?<=[0-9])(?=[A-Z]\S)", " "), number)


def clean_tag(name: Column) -> Column:
    """Name with only letters, digits, dash and underscore, first letter upper case."""
    own = F.regexp_replace(name, r"[^-\w]", "")
    own = F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, 2, 1_000_000))
    return F.when((F.length(own) < 2) | own.rlike(r"^[-\d]"), F.concat(F.lit("Tag"), own)).otherwise(own)


def split_list(text: Column, separator: str = ", ") -> Column:
    return F.split(text, f"\\Q{separator}\\E", -1)


def join_list(values: Column, separator: str = ", ") -> Column:
    return F.array_join(values, separator)


def distinct_list(text: Column, separator: str = ", ") -> Column:
    """Items of a joined list, each once, in order of first appearance."""
    return join_list(F.array_distinct(split_list(text, separator)), separator)


def list_item(values: Column, number: int) -> Column:
    """One item; negative numbers count from the end; null where there is none."""
    return F.get(values, F.lit(number)) if number >= 0 else F.get(F.reverse(values), F.lit(-number - 1))


def recovered(short: Column, long: Column, limit: int) -> Column:
    """The longer text where the shorter was cut at ``limit`` and is its beginning."""
    return F.when((F.length(short) == limit) & F.startswith(long, short), long).otherwise(F.coalesce(short, long))


def gated_coalesce(digest: Column, current: Column, first: Column, *others: Column) -> Column:
    """``first``, unless its digest shows that it is out of date; then the others before it."""
    stale = digest.isNotNull() & (digest != current)
    return F.when(stale, F.coalesce(*others, first)).otherwise(F.coalesce(first, *others))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers (padded to 12)."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d{1,11}$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def shortened(text: Column, limit: int = 60) -> Column:
    """Text cut to ``limit`` characters with a mark of what is missing."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 5), F.lit("[...]"))).otherwise(text)


def decode_bytes(data: Column, charset: str = "UTF-8") -> Column:
    """Bytes as text; those that are no text in UTF-8 as ``base64:...``."""
    if charset.upper() != "UTF-8":
        return F.decode(data, charset)
    raw = data.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.concat(F.lit("base64:"), F.base64(data)))


def quoted_list(values: Column) -> Column:
    """Items joined by ``; ``; those with a separator or a quote are quoted, quotes doubled."""
    one = lambda x: F.when(x.rlike('[;"]') | (x == ""), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.array_join(F.transform(values, one), "; ")


def unquoted_list(text: Column) -> Column:
    """The items of ``quoted_list``."""
    items = F.regexp_extract_all(text, F.lit(r'(?:^|; )("(?:[^"]|"")*"|[^";]*)'), 1)
    bare = lambda x: F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(items, lambda x: F.when(x.startswith('"'), bare(x)).otherwise(x))


def struct_text(pairs: Column) -> Column:
    """A map as ``{a=b,c=d}``, keys in order; ``|`` escapes what would end a value."""
    escaped = lambda v: F.regexp_replace(v, r"([\|,\}\]])", r"|$1")
    entries = F.array_sort(F.map_entries(pairs))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), escaped(e["value"]))), ","), F.lit("}"))


def text_struct(text: Column) -> Column:
    """The map of a flat ``struct_text``."""
    parts = F.regexp_extract_all(text, F.lit(r"(\w+=(?:[^|,}\]]|\|.)*)"), 1)
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.regexp_replace(p, r"^\w+=", ""), r"\|(.)", "$1").alias("value"))
    return F.map_from_entries(F.transform(parts, entry))


def same_map(a: Column, b: Column) -> Column:
    """Whether two maps hold the same entries, in any order; nulls are equal."""
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def filter_items(values: Column, change: Callable[[Column], Column]) -> Column:
    """Apply a text function to every item of a list."""
    return F.transform(values, change)


def html_unescape(text: Column) -> Column:
    """Named and numbered HTML entities as characters."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return F.when(F.contains(text, F.lit("&")), plain(text)).otherwise(text)


#: Escapes of C strings.
C_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "\\": "\\"}


def c_unescape(text: Column) -> Column:
    """Backslash escapes as characters; a backslash before anything else stays."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\.|[^\\]+|\\$)"), 1)
    known = F.create_map(*[F.lit(x) for k, v in C_ESCAPES.items() for x in ("\\" + k, v)])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def c_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for code, raw in C_ESCAPES.items():
        if raw != "\\":
            out = F.replace(out, F.lit(raw), F.lit("\\" + code))
    return out


def change_nested(value: Column, kind: DataType, change: Callable[[Column], Column]) -> Column:
    """Apply a text function to every text in a value of any depth: lists, maps and structs."""
    if isinstance(kind, StringType):
        return change(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: change_nested(x, kind.elementType, change))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: change_nested(x, kind.valueType, change))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[change_nested(value[f.name], f.dataType, change).alias(f.name) for f in kind.fields]))
    return value


_STRUCT_TOKEN = re.compile(r"(\|.|[^|={}\[\],])+|[={}\[\],]", re.DOTALL)


def _struct_value(tokens: list[str]):
    """The value at the front of a reversed token list: an object, a list, or a text."""
    if not tokens:
        return ""
    first = tokens.pop()
    if first not in "{[":
        if first in "=}],":
            tokens.append(first)
            return ""
        return re.sub(r"\|(.)", r"\1", first)
    out, end = ({}, "}") if first == "{" else ([], "]")
    while tokens and tokens[-1] != end:
        if first == "{":
            name = tokens.pop().strip()
            if tokens and tokens[-1] == "=":
                tokens.pop()
            out[name] = _struct_value(tokens)
        else:
            out.append(_struct_value(tokens))
        if tokens and tokens[-1] == ",":
            tokens.pop()
    if tokens:
        tokens.pop()
    return out


def struct_text_json(text: Column) -> Column:
    """A nested ``{a={b=c},d=[x,y]}`` as JSON; ``|`` escapes what would end a value."""

    def one(value: str) -> str:
        return json.dumps(_struct_value([m[0] for m in _STRUCT_TOKEN.finditer(value)][::-1]), ensure_ascii=False)

    @F.pandas_udf("string")
    def parsed(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return parsed(text)
