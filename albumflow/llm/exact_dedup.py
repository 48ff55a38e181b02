"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes every normalised text and builds a counting Bloom filter of bounded size
over the hashes, each task a piece of it; pass 2 tests every row against it.  Only rows whose
hash possibly repeats shuffle, by their full SHA-256; all other rows pass straight through.

Edge cases: a null text counts as empty, and empty texts are copies of each other.
Rows that repeat both doc_id and text get the same decision.  An empty table gives an
empty result.  Other columns of the input are neither read nor returned by
``copy_groups``; ``drop_copies`` returns all of them unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from albumflow.llm import bloom
from albumflow.llm.shared import arrow_map, fresh, saved

POPULAR = 10_000  # a text's rows beyond which they are dealt to SALTS tasks
SALTS = 64


def _digests(texts: pa.Array) -> list[bytes]:
    """SHA-256 of each text with A-Z lower-cased, in UTF-8."""
    folded = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    return [hashlib.sha256(x.as_buffer()).digest() for x in folded]


def _short(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=np.int64)


def _repeat_filter(docs: DataFrame, text: str) -> bloom.Filter:
    def hashes(batch):
        yield pa.RecordBatch.from_arrays([pa.array(_short(_digests(batch.column(0))))], names=["key"])

    keys = arrow_map(docs.select(text), hashes, "key bigint")
    return bloom.build(keys, docs.count(), at_least=2)


def _tagged(docs: DataFrame, text: str, digest: str, maybe: str) -> DataFrame:
    """docs with each text's digest and whether it possibly repeats."""
    spread = docs.sparkSession.sparkContext.broadcast(_repeat_filter(docs, text))
    at = docs.columns.index(text)

    def tag(batch):
        digests = _digests(batch.column(at))
        arrays = [*batch.columns, pa.array([d.hex() for d in digests], pa.string()), pa.array(spread.value(_short(digests)), pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, digest, maybe])

    schema = StructType([*docs.schema.fields]).add(digest, StringType()).add(maybe, BooleanType())
    return arrow_map(docs, tag, schema)


def copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (largest doc_id of equal texts), group_size, kept, text_sha256."""
    rows = saved(_tagged(docs.select("doc_id", "text"), "text", "text_sha256", "maybe").drop("text"))
    again = rows.where("maybe").select("doc_id", "text_sha256", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    groups = saved(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    popular = groups.where(F.col("group_size") > POPULAR).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    marked = again.join(popular, ["text_sha256", "salt"], "left")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    few = marked.where("group_size is null").select("doc_id", "text_sha256").join(groups.where(F.col("group_size") <= POPULAR), "text_sha256")
    shuffled = few.select(*columns).unionByName(marked.where("group_size is not null").select(*columns))
    alone = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    both = shuffled.unionByName(alone)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each text: that with the largest doc_id."""
    digest, maybe = fresh(docs.columns, "text_digest"), fresh(docs.columns, "possible_copy")
    keep = fresh(docs.columns, "keep_id")
    tagged = _tagged(docs, "text", digest, maybe)
    again = tagged.where(F.col(maybe))
    kept = again.groupBy(digest).agg(F.max("doc_id").alias(keep)).withColumnRenamed(digest, keep + "_digest")
    same = (F.col(digest) == F.col(keep + "_digest")) & F.col("doc_id").eqNullSafe(F.col(keep))
    stays = again.join(kept, same, "left_semi").dropDuplicates([digest])
    return tagged.where(~F.col(maybe)).unionByName(stays).select(*docs.columns)
