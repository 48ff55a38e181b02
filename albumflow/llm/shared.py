"""What the operators share: the folder all executors see, fresh column names, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set, in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="albumflow-")
        sc.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and of about ``size`` bytes from now on, so that tasks on
    long texts hold little outside the JVM's heap.  Smaller settings of the user's stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column has it (case aside)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """Apply ``f`` to every Arrow batch."""

    def run(batches):
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sample(df: DataFrame, limit: int, id_column: str = "doc_id") -> DataFrame:
    """The ``limit`` rows with the smallest hash of an id.

    With many more rows than that, rows with a large hash are left out before the sort, so
    that no task sorts or gathers more than a small multiple of ``limit`` rows, and the driver no more than that.
    """
    key = F.xxhash64(id_column)
    count = df.count()
    if count > 4 * limit:
        df = df.where(key < int(2**64 * 2 * limit / count) - 2**63)
    return df.orderBy(key, id_column).limit(limit)
