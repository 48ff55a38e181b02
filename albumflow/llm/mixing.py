"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Every document of a source is wanted ``target / source_size`` times.  The whole part is
taken outright; the fractional parts are rounded dependently: two documents at a time
pass words between their copy probabilities, in a random direction that keeps both
expectations, until one probability is 0 or 1.  The sum of probability times size never
changes, so a source misses its target by less than one document; large documents go first, so
that the last one open tends to be small.  Rounding runs as a
reduction tree: blocks of about ``BLOCK`` documents fold to one residual document each,
and the residuals meet in blocks again, level by level.  Random numbers are hashes of
doc_id, so reruns agree.

Edge cases: a null text has size 0; documents of size 0 take nothing.  Null sources are
one source, ordered last.  Rows that repeat a doc_id are mixed as rows of their own.  An
empty table, or one without words, gives targets of 0.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumflow.llm.shared import fresh, saved

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 256
SEED = 20240
SMALL_SOURCES = 10_000  # so many source rows are broadcast at most

_UNIT = "struct<order:bigint,doc_id:bigint,size:bigint,p:double,u:double>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """number, source, source_size, documents, target of each source of (source, size).

    Targets stop at ``most`` times the source; what is cut off goes to the others by weight.
    Sources in rising order of cap over weight reach their caps first, so prefix sums of
    caps and weights give the level at which the rest is shared.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "number")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1)
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    out = out.withColumn("number", F.row_number().over(by_name)).withColumn("weight", pick)
    out = out.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("fair", left / weight)
    full = F.col("level") <= F.col("fair")
    # the first source that stays below its cap sets the level of all that follow
    out = out.withColumn("shared", F.min(F.when(~full, F.struct("level", "number", "fair"))).over(every)["fair"])
    target = F.when(full, F.col("cap")).otherwise(F.col("shared") * F.col("weight"))
    return out.select("number", "source", "source_size", "documents", target.alias("target"))


def _random(seed: int) -> Column:
    """A number in [0, 1) from doc_id."""
    return F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def _unit(x: Column, p: Column) -> Column:
    return F.struct(x["order"].alias("order"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"), x["u"].alias("u"))


def _snapped(p: Column) -> Column:
    return F.when(p < 1e-9, F.lit(0.0)).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)


def _settled(unit: Column) -> Column:
    return (unit["p"] <= 0) | (unit["p"] >= 1)


def _pivot(state: Column, new: Column) -> Column:
    """Pair the residual with a new unit: one of the two becomes whole and is done."""
    old = state["rest"]
    rise = F.least((1 - old["p"]) * old["size"], new["p"] * new["size"])
    fall = F.least(old["p"] * old["size"], (1 - new["p"]) * new["size"])
    moved = F.when(new["u"] * (rise + fall) < fall, rise).otherwise(-fall)
    pair = F.array(
        _unit(old, _snapped(old["p"] + moved / old["size"])),
        _unit(new, _snapped(new["p"] - moved / new["size"])),
    )
    first = F.transform(pair, lambda x, i: F.when((i == 0) == _settled(pair[0]), x))
    done = F.coalesce(first[0], first[1])
    rest = F.when(_settled(pair[0]), pair[1]).otherwise(pair[0])
    return F.struct(rest.alias("rest"), F.concat(state["done"], F.array(done)).alias("done"))


def _folded(units: Column) -> Column:
    """Sequential pivotal rounding of one block: its residual, and the units done."""
    start = F.struct(units[0].alias("rest"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    return F.aggregate(F.slice(units, 2, F.size(units)), start, _pivot)


def rounded(units: DataFrame, largest: int) -> DataFrame:
    """(number, doc_id, size, p) with p 0 or 1, of (number, documents, doc_id, size, p).

    ``largest`` is the number of units of the largest source; it sets the tree's height.
    """
    random = _random(SEED).alias("u")
    blocks = F.ceil(F.col("documents") / BLOCK)
    block = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), blocks)
    level = units.select("number", block.alias("block"), F.struct((-F.col("size")).alias("order"), "doc_id", "size", "p", random).alias("unit"))
    count, out = math.ceil(max(largest, 1) / BLOCK), None
    while True:
        units_of = F.array_sort(F.collect_list("unit"))
        level = saved(level.groupBy("number", "block").agg(_folded(units_of).alias("fold")))
        done = level.select("number", F.inline("fold.done"))
        out = done if out is None else out.unionByName(done)
        level = level.select("number", F.floor(F.col("block") / BLOCK).alias("block"), F.col("fold.rest").alias("unit"))
        if count <= 1:
            break
        count = math.ceil(count / BLOCK)
    last = level.select("number", "unit.*").withColumn("p", F.when(_random(SEED + 2) < F.col("p"), 1.0).otherwise(0.0))
    return out.unionByName(last).select("number", "doc_id", "size", "p")


def _size() -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every row of docs."""
    rows = saved(docs.select("doc_id", "source", _size().alias("size")))
    sources = saved(source_targets(rows, weights, share, most))
    count, largest = sources.agg(F.count("*"), F.max("documents")).first()
    names = F.broadcast(sources) if count <= SMALL_SOURCES else sources
    names = names.withColumnRenamed("source", "name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("rate", rate)
    rows = rows.withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.col("base"))
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    settled = rows.where(~open_).select("number", "doc_id", "size", F.lit(0.0).alias("p"))
    chosen = settled.unionByName(rounded(rows.where(open_).select("number", "documents", "doc_id", "size", "p"), largest or 0))
    out = chosen.join(F.broadcast(sources) if count <= SMALL_SOURCES else sources, "number")
    base = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    copies = F.when(F.col("size") > 0, base + F.col("p")).otherwise(0).cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame) -> DataFrame:
    """Rows of docs that the mix takes, all columns, with ``copies`` and ``target`` (underscores
    are added to names that docs has).

    Rows alike in doc_id, source and size share the copies that the mix takes of them as evenly
    as can be, in the order of the hash of their text.
    """
    names = {name: fresh(docs.columns, name) for name in ("copies", "target", "of_id", "of_source", "of_size", "rows", "size")}
    copies, target, of_id, of_source, of_size, alike, size = names.values()
    mixed = mix(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias(alike), F.sum("copies").alias(copies), F.first("target").alias(target)).where(F.col(copies) > 0)
    mixed = saved(mixed.withColumnsRenamed({"doc_id": of_id, "source": of_source, "size": of_size}))
    sized = docs.withColumn(size, _size())
    same = sized["doc_id"].eqNullSafe(F.col(of_id)) & sized["source"].eqNullSafe(F.col(of_source)) & (sized[size] == F.col(of_size))
    out = sized.join(mixed.where(F.col(alike) == 1), same)
    several = mixed.where(F.col(alike) > 1)
    if not several.isEmpty():
        order = Window.partitionBy(of_id, of_source, of_size).orderBy(F.xxhash64("text"))
        place = F.row_number().over(order)
        dealt = F.floor(F.col(copies) / F.col(alike)) + (place <= F.col(copies) % F.col(alike)).cast("long")
        out = out.unionByName(sized.join(several, same).withColumn(copies, dealt).where(F.col(copies) > 0))
    return out.select(*docs.columns, copies, target)
