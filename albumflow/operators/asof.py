"""As-of and interpolating joins of times with tracks.

Rows are dealt by key and time bucket, so a key with very many fixes is spread over tasks;
each bucket takes the last fix before it and the first one after it from its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumflow.functions.dates import ts_to_epoch

MAX_INTERPOLATE = 1800
MAX_EXTRAPOLATE = 1800
BUCKET_SECONDS = 86400


def bracket(points: DataFrame, fixes: DataFrame, key: str, time: str, values: list[str], bucket: int = BUCKET_SECONDS) -> DataFrame:
    """points plus structs ``before`` (latest fix at or before) and ``after`` (earliest fix after).

    Both hold ``time`` and ``values``; null where there is none.
    """
    slot = F.floor(ts_to_epoch(F.col(time)) / bucket).alias("_slot")
    fix = F.struct(F.col(time).alias(time), *values)
    marks = fixes.select(key, slot, F.col(time), fix.alias("_fix"))
    ends = marks.groupBy(key, "_slot").agg(F.max("_fix").alias("_last"), F.min("_fix").alias("_first"))
    slots = ends.select(key, "_slot").unionByName(points.select(key, slot)).distinct().join(ends, [key, "_slot"], "left")
    over = Window.partitionBy(key).orderBy("_slot")
    past = F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    edges = slots.select(key, "_slot", past.alias("_past"), coming.alias("_coming"))
    nothing = F.lit(None)
    left = points.select(key, slot, F.col(time), F.struct(*[F.col(c) for c in points.columns]).alias("_point"), nothing.cast(dict(marks.dtypes)["_fix"]).alias("_fix"))
    right = marks.select(key, "_slot", time, nothing.cast(dict(left.dtypes)["_point"]).alias("_point"), "_fix")
    rows = left.unionByName(right)
    # a fix at a point's own time comes before it
    inner = Window.partitionBy(key, "_slot").orderBy(F.col(time), F.col("_fix").isNull())
    before = F.last("_fix", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("_before")
    after = F.first("_fix", ignorenulls=True).over(inner.rowsBetween(1, Window.unboundedFollowing)).alias("_after")
    rows = rows.select(key, "_slot", "_point", before, after).where(F.col("_point").isNotNull())
    rows = rows.join(edges, [key, "_slot"], "left")
    return rows.select("_point.*", F.coalesce("_before", "_past").alias("before"), F.coalesce("_after", "_coming").alias("after"))


def _cyclic(a: Column, b: Column, share: Column, turn: float) -> Column:
    """Interpolate on a circle the short way round."""
    gap = b - a
    gap = F.when(gap > turn / 2, gap - turn).when(gap < -turn / 2, gap + turn).otherwise(gap)
    out = a + share * gap
    half = turn / 2
    return F.when(out > half, out - turn).when(out < -half, out + turn).otherwise(out) if turn == 360.0 else out


def interpolate(
    points: DataFrame, fixes: DataFrame, key: str, time: str, values: list[str], cyclic: list[str] | None = None,
    max_gap: float = MAX_INTERPOLATE, max_reach: float = MAX_EXTRAPOLATE,
) -> DataFrame:
    """points plus interpolated ``values`` and ``position``.

    Between two fixes at most ``max_gap`` seconds apart the values are linear; else the nearer
    fix counts if it is within ``max_reach`` seconds.  ``position`` is ``between``, ``nearest`` or null.
    Where fixes have a column ``span``, two of the same span are linear however far apart; where they have
    ``first`` (the first fix of a track), ``max_reach`` is the limit of the gap before it.
    """
    marks = [c for c in ("span", "first") if c in fixes.columns and c not in values]
    rows = bracket(points, fixes, key, time, [*values, *marks])
    t = ts_to_epoch(F.col(time)).cast("double")
    t0, t1 = ts_to_epoch(F.col("before")[time]).cast("double"), ts_to_epoch(F.col("after")[time]).cast("double")
    exact = t0 == t
    limit = F.when(F.col("after")["first"], max_reach).otherwise(max_gap) if "first" in marks and max_gap else F.lit(max_gap)
    between = exact | (t1 - t0 <= limit)
    if "span" in marks:
        between = between | F.coalesce(F.col("before")["span"] == F.col("after")["span"], F.lit(False))
    nearest = F.when(t1.isNull() | (t - t0 <= t1 - t), "before").otherwise("after")
    near_gap = F.when(nearest == "before", t - t0).otherwise(t1 - t)
    position = F.when(F.coalesce(between, F.lit(False)), "between").when(near_gap <= max_reach, "nearest")
    rows = rows.withColumn("position", position)
    share = F.when(exact, 0.0).otherwise((t - t0) / F.nullif(t1 - t0, F.lit(0.0)))
    out = []
    for v in values:
        a, b = F.col("before")[v], F.col("after")[v]
        line = _cyclic(a, b, share, 360.0) if v in (cyclic or []) else a + share * (b - a)
        line = F.when(exact, a).otherwise(line)
        near = F.when(nearest == "before", a).otherwise(b)
        out.append(F.when(F.col("position") == "between", line).when(F.col("position") == "nearest", near).alias(v))
    kept = [c for c in points.columns if c not in values]
    return rows.select(*kept, *out, "position")


def drift(t: Column, syncs: list[tuple[float, float]]) -> Column:
    """Correct clock seconds by sync points (clock, true): one gives an offset, more a
    piecewise line that goes on beyond both ends."""
    points = sorted(syncs)
    if not points:
        return t.cast("double")
    if len(points) == 1:
        return t.cast("double") + (points[0][1] - points[0][0])
    out = None
    for (c0, r0), (c1, r1) in zip(points, points[1:], strict=False):
        line = F.lit(float(r0)) + (t - float(c0)) * ((r1 - r0) / (c1 - c0))
        last = (c1, r1) == points[-1]
        hit = F.lit(True) if last else t < float(c1)
        out = F.when(hit, line) if out is None else out.when(hit, line)
    return out


def quality_cut(fixes: DataFrame, max_pdop: float | None = None, max_hdop: float | None = None, min_satellites: int | None = None) -> DataFrame:
    """Fixes that are good enough; a missing quality value passes."""
    passes = F.lit(True)
    for name, limit in (("pdop", max_pdop), ("hdop", max_hdop)):
        if limit is not None:
            passes = passes & F.coalesce(F.col(name) <= limit, F.lit(True))
    if min_satellites is not None:
        passes = passes & F.coalesce(F.col("nsats") >= min_satellites, F.lit(True))
    return fixes.where(passes)


def merge_tracks(tracks: list[DataFrame], key: str = "device", time: str = "t") -> DataFrame:
    """One track of several logs; of fixes at one time the last log's stays."""
    rows = None
    for i, track in enumerate(tracks):
        numbered = track.withColumn("_order", F.lit(i))
        rows = numbered if rows is None else rows.unionByName(numbered, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in (key, time, "_order")]
    best = F.max_by(F.struct(*names), "_order").alias("_best")
    return rows.groupBy(key, time).agg(best).select(key, time, "_best.*")


def interpolate_each(points: DataFrame, fixes: DataFrame, key: str, time: str, values: list[str], **limits) -> DataFrame:
    """Like ``interpolate``, but each value from the fixes around the point that have it."""
    for v in values:
        points = interpolate(points, fixes.where(F.col(v).isNotNull()), key, time, [v], **limits).drop("position")
    return points
