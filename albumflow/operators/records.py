"""Records of tags: overrides, differences, selection, duplicates, order, reports."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumflow.functions.text import csv_cell, describe_tag, is_number, natural_key
from albumflow.operators.numbering import running

#: Names that stand for several tags.
SHORTCUTS = {
    "alldates": ("DateTimeOriginal", "CreateDate", "ModifyDate"),
    "common": ("FileName", "FileSize", "Model", "DateTimeOriginal", "ImageSize", "Quality", "FocalLength", "ShutterSpeed", "Aperture", "ISO", "WhiteBalance", "Flash"),
}
#: A wide report has at most so many columns of tags.
MOST_COLUMNS = 10_000


def override(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str], default: str = "*") -> DataFrame:
    """rows with ``columns`` from the override of the same key, else of the ``default`` row, else their own."""
    specific = overrides.where(F.col(key) != default).select(key, *[F.col(c).alias(f"_own_{c}") for c in columns])
    general = overrides.where(F.col(key) == default).agg(*[F.first(c).alias(f"_all_{c}") for c in columns])
    joined = rows.join(specific, key, "left").join(F.broadcast(general))  # general has one row
    chosen = [F.coalesce(f"_own_{c}", f"_all_{c}", c).alias(c) if c in rows.columns else F.coalesce(f"_own_{c}", f"_all_{c}").alias(c) for c in columns]
    return joined.select(*[c for c in rows.columns if c not in columns], *chosen)


def diff(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, occurrence, left_value, right_value, side of what the two sides do not share (null-safe).

    A key may have several values, and a value several times: equal ones of both sides cancel first, as often as
    both have them.  What is left of a key pairs up in order of value, and its ``occurrence`` counts from 1; ``side`` is
    ``<``, ``>`` or ``<>``.  Counting combines before the shuffle, and keys with very many values are numbered by many tasks.
    """
    signed = lambda rows, n: rows.select(*key, F.col(value).alias("_value"), F.lit(n).cast("bigint").alias("_n"))
    counts = signed(left, 1).unionByName(signed(right, -1)).groupBy(*key, "_value").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    surplus = counts.select(*key, "_value", F.abs("_n").alias("_n"), (F.col("_n") > 0).alias("_left"))
    placed = running(surplus, [*key, "_left"], [F.col("_value").asc_nulls_last()], "_before", F.col("_n"))
    each = placed.select(*key, "_value", "_left", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_n"))).alias("occurrence"))
    own = lambda side: F.max(F.when(side, F.struct("_value")))
    pairs = each.groupBy(*key, "occurrence").agg(own(F.col("_left")).alias("_l"), own(~F.col("_left")).alias("_r"))
    side = F.when(F.col("_r").isNull(), "<").when(F.col("_l").isNull(), ">").otherwise("<>")
    return pairs.select(*key, F.col("occurrence").cast("int").alias("occurrence"), F.col("_l._value").alias("left_value"), F.col("_r._value").alias("right_value"), side.alias("side"))


def _like(pattern: str) -> str:
    import re

    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def tag_filter(names: list[str]) -> Column:
    """Tags wanted by name: wildcards, ``group:tag``, ``all``, and shortcuts."""
    wanted = F.lit(False)
    for name in names:
        group, _, tag = name.rpartition(":")
        for own in SHORTCUTS.get(tag.lower(), (tag,)):
            hit = F.lit(True) if own.lower() == "all" else F.col("tag").rlike(_like(own))
            if group:
                hit = hit & (F.col("group0").rlike(_like(group)) | F.col("group1").rlike(_like(group)))
            wanted = wanted | hit
    return wanted


def select_tags(tags: DataFrame, names: list[str], exclude: list[str] | None = None) -> DataFrame:
    rows = tags.where(tag_filter(names))
    return rows.where(~tag_filter(exclude)) if exclude else rows


def first_by(rows: DataFrame, key: list[str], priority: list[Column], columns: list[str]) -> DataFrame:
    """One row a key: the smallest by ``priority``, which must end in a unique column."""
    ranked = F.struct(*[p.alias(f"_p{i}") for i, p in enumerate(priority)], *columns)
    return rows.groupBy(*key).agg(F.min(ranked).alias("_best")).select(*key, *[f"_best.{c}" for c in columns])


def copies(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """rows plus ``copy_no``: 0 for the row that takes the bare name, then 1, 2, ..."""
    return rows.withColumn("copy_no", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def combine(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which the first source that has a key wins."""
    rows = None
    for i, source in enumerate(sources):
        own = source.withColumn("_order", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    names = [c for c in rows.columns if c not in (*key, "_order")]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*names), "_order").alias("_best")).select(*key, "_best.*")


def file_order(rows: DataFrame, tags: list[str], tie: str) -> list[Column]:
    """Sort columns for ``[-]tag`` lists: numbers before texts, digits in texts by value,
    missing values last, or first where the order is reversed."""
    out = []
    for tag in tags:
        name, down = tag.lstrip("-"), tag.startswith("-")
        value = F.col(name).cast("string")
        number = is_number(value)
        keys = [(~number).cast("int"), F.when(number, value.try_cast("double")), F.when(~number, F.coalesce(natural_key(value), F.lit("~")))]
        out += [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]
    return [*out, F.col(tie).asc()]


def wide_report(rows: DataFrame, key: str, tag: str, value: str, columns: list[str] | None = None, missing: str | None = None) -> DataFrame:
    """One row a key and one column a tag, in alphabetical order unless given.

    More than ``MOST_COLUMNS`` tags are an error: such rows stay long (key, tag, value).
    """
    names = columns
    if names is None:
        names = [r[0] for r in rows.select(tag).distinct().orderBy(F.lower(tag), tag).limit(MOST_COLUMNS + 1).collect()]
        if len(names) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} distinct values of {tag}: keep the long form ({key}, {tag}, {value}), or give the columns")
    wide = rows.groupBy(key).pivot(tag, names).agg(F.first(value, ignorenulls=True))
    return wide.na.fill(missing, names) if missing is not None else wide


def csv_lines(rows: DataFrame, columns: list[str], separator: str = ",") -> Column:
    """A CSV line of each row; null cells are empty."""
    return F.concat_ws(separator, *[F.coalesce(csv_cell(F.col(c).cast("string"), separator), F.lit("")) for c in columns])


def columns_of_first(rows: DataFrame, key: str, tag: str, order: str) -> list[str]:
    """Tags for a wide report: in the order of the first file if no later file adds one, else alphabetical.

    ``order`` numbers a file's tags; the first file has the smallest key.
    """
    start = rows.agg(F.min(key).alias("_start"))
    own = rows.join(F.broadcast(start)).groupBy(tag).agg(F.min(F.when(F.col(key) == F.col("_start"), F.col(order))).alias("place"))
    found = own.limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} distinct values of {tag}: keep the long form")
    if all(r["place"] is not None for r in found):
        return [r[0] for r in sorted(found, key=lambda r: r["place"])]
    return sorted((r[0] for r in found), key=lambda name: (name.lower(), name))


def report_columns(rows: DataFrame, key: str, tag: str, order: str) -> DataFrame:
    """(place, tag): the columns of ``columns_of_first`` as rows, however many there are; places count from 0."""
    start = rows.agg(F.min(key).alias("_start"))
    own = rows.join(F.broadcast(start)).groupBy(tag).agg(F.min(F.when(F.col(key) == F.col("_start"), F.col(order))).alias("_own"))  # start has one row
    every = own.agg(F.coalesce(F.bool_and(F.col("_own").isNotNull()), F.lit(True)).alias("_every"))
    placed = own.join(F.broadcast(every)).select(tag, F.when(F.col("_every"), F.col("_own")).alias("_first"), F.when(~F.col("_every"), F.lower(tag)).alias("_low"), F.lit(0).alias("_report"))
    return running(placed, ["_report"], ["_first", "_low", tag], "place").select("place", F.col(tag).alias("tag"))


def template_report(
    rows: DataFrame, output: list[str], order: list[str], body: Column, head: Column | None = None, section: Column | None = None,
    condition: Column | None = None, ends: Column | None = None, tail: Column | None = None,
) -> DataFrame:
    """The lines of a report of each ``output``: its columns, ``place`` (from 0, in order) and ``line``.

    ``head`` is written for the first row; ``section`` whenever it differs from the row before; ``body`` for rows
    that pass the ``condition``; the ``ends`` of a section's rows after its last row, and the ``tail`` of all rows at the end.
    Lines that are null are left out.
    """
    nothing = F.lit(None).cast("string")
    by = Window.partitionBy(*output)
    in_order = by.orderBy(*order)
    header = nothing if section is None else section
    row = rows.withColumn("_n", F.row_number().over(in_order)).withColumn("_opens", ~header.eqNullSafe(F.lag(header).over(in_order)) | (F.col("_n") == 1))
    row = row.withColumn("_section", F.sum(F.col("_opens").cast("int")).over(in_order))
    row = row.withColumns({"_last": F.max("_n").over(Window.partitionBy(*output, "_section")), "_end": F.max("_n").over(by)})
    line = lambda at, kind, text: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.col("_n").alias("n"), text.alias("line"))
    n = F.col("_n")
    lines = [
        line(n, 0, F.when(n == 1, head) if head is not None else nothing), line(n, 1, F.when(F.col("_opens"), header)),
        line(n, 2, F.when(F.coalesce(condition, F.lit(False)), body) if condition is not None else body),
        line(F.col("_last"), 3, nothing if ends is None else ends), line(F.col("_end"), 4, nothing if tail is None else tail),
    ]
    out = row.select(*output, F.inline(F.array(*lines))).where("line is not null")
    return out.select(*output, (F.row_number().over(by.orderBy("at", "kind", "n")) - 1).alias("place"), "line")


def section_report(rows: DataFrame, partition: list[str], order: list[str], header: Column, body: Column) -> DataFrame:
    """rows plus ``line``: the body, led by the section header where it changes."""
    changed = ~header.eqNullSafe(F.lag(header).over(Window.partitionBy(*partition).orderBy(*order)))
    return rows.withColumn("line", F.when(changed, F.concat(header, F.lit("\n"), body)).otherwise(body))


class Derived(NamedTuple):
    """A column computed from others: all of ``require`` must be there and not null, none of ``inhibit``."""

    require: tuple[str, ...]
    make: Callable[..., Column]
    desire: tuple[str, ...] = ()
    inhibit: tuple[str, ...] = ()


def add_derived(rows: DataFrame, table: dict[str, Derived]) -> DataFrame:
    """rows plus every derived column whose inputs exist, in order of dependence."""
    waiting, have = dict(table), set(rows.columns)
    while waiting:
        ready = [n for n, d in waiting.items() if all(r in have for r in d.require) and not any(x in waiting for x in (*d.desire, *d.inhibit))]
        if not ready:  # a cycle of wishes: build what its requirements allow
            ready = [n for n, d in waiting.items() if all(r in have for r in d.require)][:1]
        if not ready:
            break
        for name in sorted(ready):
            d = waiting.pop(name)
            values = [F.col(c) for c in d.require] + [F.col(c) if c in have else F.lit(None) for c in d.desire]
            ok = F.lit(True)
            for c in d.require:
                ok = ok & F.col(c).isNotNull()
            for c in d.inhibit:
                ok = ok & (F.col(c).isNull() if c in have else F.lit(True))
            rows = rows.withColumn(name, F.when(ok, d.make(*values)))
            have.add(name)
    return rows


def tag_order(rows: DataFrame, order: str = "file", group: str = "group0", partition: str = "source_file") -> list[Column]:
    """Sort columns of tags: ``file`` order, by ``tag``, by its description (``descr``), or by ``group`` in order of
    appearance, then file order."""
    if order == "descr":
        return [F.lower(describe_tag(F.col("tag"))), F.col("file_order")]
    if order == "tag":
        return [F.lower("tag"), F.col("file_order")]
    if order == "group":
        return [F.min("file_order").over(Window.partitionBy(partition, group)), F.col("file_order")]
    return [F.col("file_order")]


def tags_from_file(rows: DataFrame, source: DataFrame, path: Column, key: str, columns: list[str]) -> DataFrame:
    """rows with ``columns`` taken from the row of ``source`` whose key is ``path``; their own stay without one."""
    other = source.select(F.col(key).alias("_from"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(other, path == F.col("_from"), "left")
    return joined.select(*[c for c in rows.columns if c not in columns], *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def first_existing(rows: DataFrame, listing: DataFrame, candidates: list[Column], name: str = "source") -> DataFrame:
    """rows plus the first of the candidate paths that is in ``listing`` (path), or null."""
    out = rows
    found = []
    for i, candidate in enumerate(candidates):
        here = listing.select(F.col("path").alias(f"_there_{i}")).distinct()
        out = out.join(here, candidate == F.col(f"_there_{i}"), "left")
        found.append(F.col(f"_there_{i}"))
    return out.select(*rows.columns, F.coalesce(*found).alias(name))


def run_counters(report: DataFrame) -> DataFrame:
    """files, copied, overwritten, failed, folders, and the exit code: 1 if a file failed, 2 if none passed a condition."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = report.agg(F.count("*").alias("files"), is_("copied").alias("copied"), is_("overwritten").alias("overwritten"), is_("error").alias("failed"), F.countDistinct("dir").alias("folders"))
    return counts.withColumn("exit_code", F.when(F.col("files") == 0, 2).when(F.col("failed") > 0, 1).otherwise(0))


def by_group_order(tags: DataFrame, groups: list[str], key: list[str], column: str = "group0") -> DataFrame:
    """One row a key of the tags in ``groups``: that of the group named first, then first in file order."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, g in enumerate(groups) for x in (g, i)]), F.col(column))
    rest = [c for c in tags.columns if c not in key]
    return first_by(tags.where(F.col(column).isin(*groups)), key, [rank, F.col("file_order")], rest)


def without_group(tags: DataFrame, group: str, keep: list[str] | None = None) -> DataFrame:
    """tags without those of a group (``all`` for every one), but for the tags named in ``keep``."""
    gone = F.lit(True) if group.lower() == "all" else (F.lower("group0") == group.lower()) | (F.lower("group1") == group.lower())
    return tags.where(~gone | (tag_filter(keep) if keep else F.lit(False)))


def with_alternates(tags: DataFrame, others: list[DataFrame], column: str = "group8") -> DataFrame:
    """tags of the main files and of alternate files, told apart by a group ``Main``, ``File1``, ``File2``, ..."""
    out = tags.withColumn(column, F.lit("Main"))
    for i, other in enumerate(others, 1):
        out = out.unionByName(other.withColumn(column, F.lit(f"File{i}")))
    return out


def apply_records(rows: DataFrame, records: DataFrame, key: str, deleted: str = "_delete") -> DataFrame:
    """rows with the values of records of the same key; a column named in the record's list ``deleted`` becomes null."""
    columns = [c for c in records.columns if c in rows.columns and c != key]
    new = records.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.col(deleted).alias("_gone"))
    gone = lambda c: F.coalesce(F.array_contains("_gone", c), F.lit(False))
    chosen = [F.when(~gone(c), F.coalesce(f"_new_{c}", c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(new, key, "left").select(*chosen)


def shown_values(tags: DataFrame, raw: bool = False) -> DataFrame:
    """source_file, tag and the value as it is stored (``raw``) or as it is printed."""
    return tags.select("source_file", "tag", (F.col("raw") if raw else F.coalesce("printed", "value")).alias("value"))


def tag_labels(tags: DataFrame, groups: list[str] | None = None, described: bool = False, number: str | None = None, hexadecimal: bool = False) -> DataFrame:
    """tags plus ``label``: ``[group:...]`` prefixes, the tag or its description, and the tag's number if ``number`` names it."""
    parts = [F.concat(F.col(g), F.lit(":")) for g in groups or []]
    if number:
        own = F.lower(F.hex(F.col(number).cast("bigint"))) if hexadecimal else F.col(number).cast("string")
        shown = F.concat(F.lit("0x"), F.lpad(own, 4, "0")) if hexadecimal else own
        parts.append(F.concat(shown, F.lit(" ")))
    return tags.withColumn("label", F.concat(*parts, describe_tag(F.col("tag")) if described else F.col("tag")))


def language_chain(language: str, default: str = "en") -> list[str]:
    """Languages to look a text up in: ``fr-CA`` first, then ``fr``, then the default."""
    parts = language.lower().replace("_", "-").split("-")
    chain = ["-".join(parts[:n]) for n in range(len(parts), 0, -1)]
    return [*chain, *([default] if default not in chain else [])]


def localised(tags: DataFrame, names: DataFrame, language: str, default: str = "en") -> DataFrame:
    """tags plus ``description``: the tag's name in the first language of the chain that has one, else made of the tag itself.

    ``names`` is (tag, language, text); letter case counts for neither tags nor languages.  Of several texts of a tag and language the
    smallest serves.  The choice is an aggregate that combines before the shuffle, so each tag has one row to be joined with.
    """
    chain = language_chain(language, default)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, own in enumerate(chain) for x in (own, i)]), F.lower(F.replace(F.col("language"), F.lit("_"), F.lit("-"))))
    known = names.where("text is not null").select(F.lower("tag").alias("_tag"), rank.alias("_rank"), "text").where("_rank is not null")
    best = known.groupBy("_tag").agg(F.min(F.struct("_rank", "text"))["text"].alias("_text"))
    joined = tags.join(best, F.lower("tag") == F.col("_tag"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in tags.columns], F.coalesce("_text", describe_tag(F.col("tag"))).alias("description"))


def embedded_documents(rows: DataFrame, documents: str, key: str) -> DataFrame:
    """A row for each file and for each document embedded in it: key, ``doc`` (null, Doc1, Doc2, ...) and the document."""
    own = rows.select(key, F.posexplode_outer(documents).alias("_place", "document"))
    return own.select(key, F.when(F.col("document").isNotNull(), F.concat(F.lit("Doc"), F.col("_place") + 1)).alias("doc"), "document")


def known_tags(tags: DataFrame) -> DataFrame:
    """Every group and tag there is, with how many files have it."""
    return tags.groupBy("group0", "tag").agg(F.countDistinct("source_file").alias("files"))


def names_by_status(report: DataFrame, statuses: list[str]) -> DataFrame:
    """status and path of the files with one of the statuses, to be written as lists."""
    return report.where(F.col("status").isin(*statuses)).select("status", "path").distinct()


def output_plan(rows: DataFrame, name: Column, existing: DataFrame, mode: str = "new") -> DataFrame:
    """rows plus ``output`` and ``action``: ``write``, ``append``, or ``skip`` where the file is there already.

    ``mode`` is ``new`` (never over a file), ``overwrite``, ``append``, or ``append_new`` (only to files
    that this run began).  The first row of an output, by path, is the one that may begin it.
    """
    if mode not in ("new", "overwrite", "append", "append_new"):
        raise ValueError(f"unknown mode: {mode}")
    there = existing.select(F.col("path").alias("output"), F.lit(True).alias("_there")).distinct()
    own = rows.withColumn("output", name).join(there, "output", "left")
    later = F.row_number().over(Window.partitionBy("output").orderBy("path")) > 1
    found = F.coalesce("_there", F.lit(False))
    taken = found | later
    action = {
        "new": F.when(taken, "skip").otherwise("write"), "overwrite": F.lit("write"),
        "append": F.when(taken, "append").otherwise("write"), "append_new": F.when(later, "append").otherwise("write"),
    }[mode]
    return own.withColumn("action", action).drop("_there")
