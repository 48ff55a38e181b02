"""Match media files with the JSON records beside them.

A record matches if it is in the same folder and its stem starts with the first 25
characters (or all, if fewer) of the media stem, letter case aside.  Comparing every file
of a folder with every record would grow with the square of the folder, so only the first record
of each folder and prefix is kept (a minimum that combines before the shuffle), and a
file looks up its prefix, its whole name and its stem there: three equality joins in one.
Bodies do not take part; the chosen record's is fetched afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = 25
NAME, STEM, START = 1, 2, 3  # what of a media file the record starts with, or is equal to


def choose(media: DataFrame, sidecars: DataFrame, pick: str = "ranked", carry: list[str] | None = None) -> DataFrame:
    """path, json_name and rule of the record chosen for each media file that has one.

    ``carry`` names narrow columns of the records that come along.
    """
    if pick not in ("ranked", "first_listed"):
        raise ValueError(f"unknown pick: {pick}")
    own, carry = F.lower("json_stem"), carry or []
    first = F.min(F.struct(F.lower("json_name").alias("listed"), "json_name", F.col("own"), *carry)).alias("first")
    look = lambda rule, key, whole: F.struct(F.lit(rule).alias("rule"), key.alias("key"), F.lit(whole).alias("whole"))
    looks = [look(START, F.substring(F.lower(F.substring("stem", 1, PREFIX)), 1, PREFIX), False)]
    if pick == "ranked":
        looks += [look(NAME, F.lower("name"), False), look(STEM, F.lower("stem"), True)]
    sought = media.select("path", "dir", F.lower("name").alias("name"), F.lower("stem").alias("stem"), F.inline(F.array(*looks)))
    # one row: the lengths that are looked up, of which file names have some dozens
    lengths = sought.where("not whole").agg(F.collect_set(F.length("key")).alias("lengths"))
    records = sidecars.select("dir", "json_name", own.alias("own"), *carry)
    sizes = F.explode(F.filter("lengths", lambda n: n <= F.length("own")))
    starts = records.join(F.broadcast(lengths)).withColumn("key", sizes).withColumn("key", F.expr("substring(own, 1, key)")).drop("lengths")
    starts = starts.withColumn("whole", F.lit(False))
    if pick == "ranked":
        starts = starts.unionByName(records.select("*", F.col("own").alias("key"), F.lit(True).alias("whole")))
    listed = starts.groupBy("dir", "whole", "key").agg(first)
    found = sought.join(listed, ["dir", "whole", "key"])
    best = found.groupBy("path").agg(F.min_by(F.struct("name", "stem", "first"), "rule").alias("best")).select("path", "best.*")
    rule = F.when(F.startswith("first.own", "name"), NAME).when(F.col("first.own") == F.col("stem"), STEM).otherwise(START)
    return best.select("path", "first.json_name", rule.alias("rule"), *[f"first.{c}" for c in carry])


def match(media: DataFrame, sidecars: DataFrame, pick: str = "ranked", keep_all: bool = True) -> DataFrame:
    """media plus json_name, body and rule of the record chosen for each path.

    ``pick="ranked"`` prefers a stem that starts with the whole media name (1), then one that
    equals the media stem (2), then any prefix (3), then the name; ``"first_listed"`` takes
    the first name of the folder.  Without a match the new columns are null
    (``keep_all``) or the row is left out.  Two records of one name in a folder are one.
    """
    chosen = media.select("path", "dir").join(choose(media, sidecars, pick), "path")
    bodies = sidecars.groupBy("dir", "json_name").agg(F.min("body").alias("body"))
    with_body = chosen.join(bodies, ["dir", "json_name"]).select("path", "json_name", "rule", "body")
    return media.join(with_body, "path", "left" if keep_all else "inner")
