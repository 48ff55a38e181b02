"""Tag records from CSV and JSON files, and reports to files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from albumflow.functions.text import php_array
from albumflow.operators.numbering import running, saved
from albumflow.schema import PLACES

KEY = "SourceFile"


def read_csv_records(spark: SparkSession, path: str, missing: str = "-", separator: str = ",") -> DataFrame:
    """SourceFile, a column a tag, and ``_delete``: the tags whose cell is the ``missing`` marker, to be deleted.

    Blank cells are null, as are marked ones; a file's last row stays, by its place in the file.
    """
    rows = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', multiLine=True)
    tags = [c for c in rows.columns if c != KEY]
    placed = rows.select(KEY, F.struct(*tags).alias("_tags"), F.monotonically_increasing_id().alias("_place"))
    best = placed.groupBy(KEY).agg(F.max_by("_tags", "_place").alias("_tags"))
    cell = lambda c: F.trim(f"_tags.`{c}`")
    marked = F.filter(F.array(*[F.when(cell(c) == missing, F.lit(c)) for c in tags]), lambda c: c.isNotNull()) if tags else F.array().cast("array<string>")
    return best.select(KEY, *[F.when(cell(c) != missing, F.nullif(cell(c), F.lit(""))).alias(c) for c in tags], marked.alias("_delete"))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """An object or an array of objects; an object without SourceFile stands for all files (``*``)."""
    rows = spark.read.json(path, multiLine=True)
    key = F.coalesce(F.col(KEY), F.lit("*")) if KEY in rows.columns else F.lit("*")
    return rows.withColumn(KEY, key)


def flatten(rows: DataFrame) -> DataFrame:
    """Nested struct fields as columns of joined, capitalised names; fields of structs in a list as lists."""

    def columns(value, name: str, kind) -> list:
        inner = kind.elementType if isinstance(kind, ArrayType) else kind
        if isinstance(inner, ArrayType):
            return columns(F.flatten(value), name, inner)
        if not isinstance(inner, StructType):
            return [value.alias(name)]
        listed = isinstance(kind, ArrayType)
        return [c for f in inner.fields for c in columns(value[f.name], name + f.name[:1].upper() + f.name[1:], ArrayType(f.dataType) if listed else f.dataType)]

    return rows.select(*[c for f in rows.schema.fields for c in columns(F.col(f"`{f.name}`"), f.name, f.dataType)])


#: Levels of nesting that ``flatten_json`` follows.
DEEPEST = 64


def flatten_json(rows: DataFrame, body: str, keep: list[str], deepest: int = DEEPEST) -> DataFrame:
    """keep, tag, place, value of every leaf of JSON texts of any shape, without a schema.

    A field's tag is the names on the way to it, joined, each with a capital; items of a list have their list's tag and count
    on in order, from 0.  Values are text, as JSON writes numbers; null and empty objects and lists have no rows, as have
    texts that are no JSON, of which a scalar alone has the tag ``Value``.  Documents are parsed once, to variants, whose levels
    are opened one after the other until no row has another; deeper than ``deepest`` is an error.
    """
    column = lambda name: F.col(f"`{name}`")
    level = rows.select(*[column(c) for c in keep], F.lit("").alias("tag"), F.array().cast("array<int>").alias("_steps"), F.try_parse_json(body).alias("_v"))
    nested = lambda: F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)<")
    leaves = None
    for depth in range(deepest + 1):
        level = saved(level.withColumn("_open", F.coalesce(nested(), F.lit(False))))
        own = level.where(~F.col("_open")).select(*[column(c) for c in keep], F.when(F.col("tag") == "", "Value").otherwise(F.col("tag")).alias("tag"), "_steps", F.expr("try_variant_get(_v, '$', 'string')").alias("value"))
        own = own.where("value is not null")
        leaves = own if leaves is None else leaves.unionByName(own)
        inner = level.where("_open")
        if inner.isEmpty():
            break
        if depth == deepest:
            raise ValueError(f"{body} is nested more than {deepest} levels deep")
        inner.createOrReplaceTempView(view := f"_level_{uuid.uuid4().hex}")
        opened = rows.sparkSession.sql(f"SELECT l.*, e.pos AS _pos, e.key AS _key, e.value AS _inner FROM {view} l, LATERAL variant_explode(l._v) e")
        rows.sparkSession.catalog.dropTempView(view)
        name = F.when(F.col("_key").isNull(), F.col("tag")).otherwise(F.concat("tag", F.upper(F.substring("_key", 1, 1)), F.substring("_key", 2, 1 << 30)))
        level = opened.select(*[column(c) for c in keep], name.alias("tag"), F.concat("_steps", F.array("_pos")).alias("_steps"), F.col("_inner").alias("_v"))
    return running(leaves, [*keep, "tag"], ["_steps"], "place").select(*keep, "tag", F.col("place").cast("int").alias("place"), "value")


def unpivot(rows: DataFrame, key: str = KEY) -> DataFrame:
    """key, tag, value of every cell that is not null."""
    tags = [c for c in rows.columns if c != key]
    return rows.unpivot(key, [F.col(f"`{c}`").cast("string").alias(c) for c in tags], "tag", "value").where("value is not null")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, quote='"', escape='"')


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.text(path)


def write_xml(rows: DataFrame, path: str, row_tag: str = "Description") -> None:
    rows.write.format("xml").option("rowTag", row_tag).option("rootTag", "RDF").save(path)


def write_php(rows: DataFrame, path: str) -> None:
    """A PHP array a line."""
    cells = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns}
    rows.select(php_array(cells).alias("line")).write.text(path)


def read_places(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A city table from Parquet, or from text with the columns of ``PLACES`` in order; rows without coordinates are left out."""
    names = [p.strip().split()[0] for p in PLACES.split(",")]
    rows = spark.read.parquet(path).select(*names) if path.rstrip("/").endswith(".parquet") else spark.read.schema(PLACES).csv(path, sep=separator)
    return rows.where("lat between -90 and 90 and lon between -180 and 180")
