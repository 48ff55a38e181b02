"""Planned changes of tag values: set, add, remove, conditional overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumflow.functions.dates import shift_by


def overwrite_if(current: Column, expected: Column, new: Column) -> Column:
    """``new`` where the current value is as expected, else unchanged."""
    return F.when(current.eqNullSafe(expected), new).otherwise(current)


def add_items(values: Column, items: Column, distinct: bool = False) -> Column:
    """List with items at its end; a null list is empty."""
    out = F.concat(F.coalesce(values, F.array().cast("array<string>")), items)
    return F.array_distinct(out) if distinct else out


def remove_items(values: Column, items: Column) -> Column:
    return F.filter(values, lambda x: ~F.array_contains(items, x))


def condition(test: Column) -> Column:
    """A row passes only if the test is true: a missing value fails it, and so does its negation's input."""
    return F.coalesce(test, F.lit(False))


def negated(test: Column) -> Column:
    """``not`` of a test in which a missing value counts as false."""
    return ~F.coalesce(test, F.lit(False))


def shift_runs(rows: DataFrame, run: list[str], order: list[str], columns: list[str], shift: str, anchor: Column | None = None) -> DataFrame:
    """rows with the times of ``columns`` moved by what the shift makes of each run's first one.

    A shift of years and months is a different number of seconds for each time; here the first value of a run (of the first
    of ``columns`` that has one, in ``order``) is shifted, and all others move as far, so that times stay as far apart as they were.
    ``anchor`` names the value to shift instead: the first row of the run where it is not null counts.  Runs without any
    such value stay.  The offset of a run is an aggregate that combines before the shuffle.
    """
    value = F.coalesce(*columns) if anchor is None else anchor
    first = F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))
    names = [F.col(c).alias(f"_run_{c}") for c in run]
    offsets = rows.groupBy(*names).agg(first.alias("_first")).withColumn("_moved", shift_by(F.col("_first"), shift))
    offset = F.col("_moved") - F.col("_first")
    same = F.lit(True)
    for c in run:
        same = same & F.col(c).eqNullSafe(F.col(f"_run_{c}"))
    moved = rows.join(offsets.select(*[f"_run_{c}" for c in run], F.coalesce(offset, F.make_dt_interval()).alias("_offset")), same, "left")
    return moved.select(*[(F.col(c) + F.col("_offset")).alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])


def shift_by_tag(tags: DataFrame, anchor: str, shift: str, value: str = "value", key: str = "source_file", order: str = "file_order") -> DataFrame:
    """tags (key, order, tag, a column of times) whose times move as far as the shift moves the ``anchor`` tag of the same file."""
    return shift_runs(tags, [key], [order], [value], shift, F.when(F.lower("tag") == anchor.lower(), F.col(value)))
