"""Which lens took a photo: lenses of one type told apart by focal length and aperture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOCAL_SLACK, APERTURE_SLACK = 0.5, 0.15
#: Bins of focal length to a doubling.
BINS = 8
#: Photos that one copy of a text serves.
SHARED = 100_000


def lens_ranges(name: Column) -> Column:
    """Focal lengths (short, long) and f-numbers (wide, narrow: at these) that a lens's name tells; equal ones for one number, null for none."""
    pair = lambda pattern: [F.regexp_extract(name, pattern, i).try_cast("double") for i in (1, 2)]
    short, long = pair(r"(?i)(\d+(?:\.\d+)?)(?:\s*-\s*(\d+(?:\.\d+)?))?\s*mm")
    wide, narrow = pair(r"(?i)(?<![a-z\d])f/?\s*(\d+(?:\.\d+)?)(?:\s*-\s*(\d+(?:\.\d+)?))?")
    return F.struct(short.alias("short"), F.coalesce(long, short).alias("long"), wide.alias("wide"), F.coalesce(narrow, wide).alias("narrow"))


def expected_aperture(focal: Column, short: Column, long: Column, wide: Column, narrow: Column) -> Column:
    """The largest aperture of a zoom lens at a focal length: both logarithms vary together between its ends."""
    slope = (F.ln(narrow) - F.ln(wide)) / (F.ln(long) - F.ln(short))
    between = F.exp(F.ln(wide) + slope * (F.ln(focal) - F.ln(short)))
    return F.when((short == long) | (wide == narrow) | focal.isNull() | (focal <= short), wide).when(focal >= long, narrow).otherwise(between)


def long_dictionaries(spark: SparkSession, size: int = 32 << 20) -> None:
    """Parquet columns keep dictionaries of up to ``size`` bytes from now on (1 MB otherwise), so that long texts which repeat are
    written once a row group, not once a row.  Larger settings of the user's stay."""
    key = "parquet.dictionary.page.size"
    if int(spark.conf.get(key, None) or 0) < size:
        spark.conf.set(key, str(size))


def _bin(focal: Column) -> Column:
    return F.floor(F.log2(focal) * BINS).cast("int")


def identify(photos: DataFrame, lenses: DataFrame, kind: str = "lens_type", focal: str = "focal", aperture: str = "aperture", name: str = "name") -> DataFrame:
    """photos plus ``lens``: the names of the lenses of the photo's type that fit, joined with `` or ``, in the order of ``place``.

    lenses: type, place, name, short, long, wide, narrow.  A lens fits if the photo's focal length and aperture are within its
    ranges (with some slack), and its expected aperture at that focal length is within ``APERTURE_SLACK`` of the nearest one's.  A photo
    without one of the two is judged by the other; if none fits, ``lens`` is the name of the type's first lens.

    Types, focal lengths and apertures repeat, so their distinct combinations are matched with the distinct ranges of a type's lenses, by
    equality of type and bin: ranges lie in all bins of focal length that they reach, a photo in one.  Combinations that the same
    ranges fit share one text, which is made once and never broadcast: with many lenses of one range it is long.  So do those of a type
    that no range fits.  A photo moves with a short key of its text, and the photos of one text come out together; where a text has more than
    ``SHARED`` photos, several tasks have them, and a copy of it each.  Parquet files hold such a text once with ``long_dictionaries``.
    """
    kinds = [F.col(kind).alias("_kind"), F.col(focal).cast("double").alias("_focal"), F.col(aperture).cast("double").alias("_aperture")]
    combos = photos.groupBy(*kinds).agg(F.count("*").alias("_rows"))
    sizes = [F.col(f"_{c}") for c in ("short", "long", "wide", "narrow")]
    own = lenses.select(F.col(kind).alias("_type"), F.col("place").alias("_place"), F.col(name).alias("_name"), *[F.col(c).cast("double").alias(f"_{c}") for c in ("short", "long", "wide", "narrow")])
    first = own.groupBy("_type").agg(F.min_by("_name", "_place").alias("_lens"))
    usable = own.where("_short > 0 and _long >= _short and _wide > 0 and _narrow > 0").withColumn("_range", F.struct(*sizes))
    low, high = F.greatest(F.col("_short") - FOCAL_SLACK, F.lit(0.01)), F.col("_long") + FOCAL_SLACK
    reach = usable.select("_type", "_range", *sizes).distinct().withColumn("_bin", F.explode(F.array_append(F.sequence(_bin(low), _bin(high)), F.lit(None).cast("int"))))
    known = combos.drop("_rows").withColumn("_bin", F.when(F.col("_focal") > 0, _bin(F.col("_focal"))))
    fits = F.coalesce(F.col("_focal").between(low, high), F.lit(True)) & F.coalesce(F.col("_aperture").between(F.col("_wide") - APERTURE_SLACK, F.col("_narrow") + APERTURE_SLACK), F.lit(True))
    bins = F.coalesce(F.col("_bin"), F.lit(-1 << 20))  # all ranges of the type, for a photo without a focal length
    lens_side = reach.withColumn("_bin", bins).withColumnRenamed("_type", "_kind")
    met = known.withColumn("_bin", bins).join(lens_side, ["_kind", "_bin"]).where(fits)
    off = F.round(F.abs(F.col("_aperture") - expected_aperture(F.col("_focal"), *sizes)), 6)
    met = met.withColumn("_off", F.coalesce(off, F.lit(0.0))).select("_kind", "_focal", "_aperture", "_off", F.struct("_range", "_off").alias("_one"))
    found = met.unionByName(combos, allowMissingColumns=True).groupBy("_kind", "_focal", "_aperture").agg(F.collect_list("_one").alias("_all"), F.min("_off").alias("_least"), F.sum("_rows").alias("_rows"))
    near = F.filter("_all", lambda x: F.round(x["_off"] - F.col("_least"), 6) <= APERTURE_SLACK)
    found = found.withColumn("_ranges", F.array_sort(F.transform(near, lambda x: x["_range"])))
    found = found.withColumn("_set", F.substring(F.unhex(F.sha2(F.to_json(F.struct("_kind", "_ranges")), 256)), 1, 16))
    sets = found.groupBy("_set").agg(F.first("_kind").alias("_kind"), F.first("_ranges").alias("_ranges"), F.ceil(F.sum("_rows") / SHARED).cast("int").alias("_copies"))
    named = sets.select("_kind", "_set", "_copies", F.explode("_ranges").alias("_range")).join(usable.select(F.col("_type").alias("_kind"), "_range", "_place", "_name"), ["_kind", "_range"])
    texts = named.groupBy("_set", "_copies").agg(F.sort_array(F.collect_list(F.struct("_place", "_name"))).alias("_lenses")).select("_set", "_copies", F.array_join(F.col("_lenses._name"), " or ").alias("_lens"))
    none = sets.where(F.size("_ranges") == 0).join(first, F.col("_kind") == F.col("_type"), "left").select("_set", "_copies", "_lens")
    texts = texts.unionByName(none).select(F.col("_set").alias("_text"), "_lens", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    found = found.join(sets.select("_set", "_copies"), "_set").select(F.col("_kind").alias("_k"), F.col("_focal").alias("_f"), F.col("_aperture").alias("_a"), "_set", "_copies")
    same = F.col(kind).eqNullSafe(F.col("_k")) & F.col(focal).cast("double").eqNullSafe(F.col("_f")) & F.col(aperture).cast("double").eqNullSafe(F.col("_a"))
    plain = [F.col(f"`{c}`") for c, t in photos.dtypes if "map<" not in t and "variant" not in t]
    share = F.when(F.col("_copies") > 1, F.pmod(F.xxhash64(*plain), F.col("_copies")).cast("int") + 1).otherwise(1)
    tasks = int(photos.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are short here and long after, so tasks are not put together by what they read
    out = photos.join(found, same, "left").withColumn("_share", share).repartition(tasks, "_set", "_share")
    out = out.join(texts.repartition(tasks, "_text", "_copy").hint("merge"), (F.col("_set") == F.col("_text")) & (F.col("_share") == F.col("_copy")), "left")
    return out.select(*[F.col(f"`{c}`") for c in photos.columns], F.col("_lens").alias("lens"))
