"""Writing a manifest, and copying the files it names."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUFFER = 128 * 1024


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Parquet, partitioned by kind, year and bucket."""
    manifest.write.partitionBy("kind", "year", "bucket").parquet(path)


def copy_files(manifest: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Copy each source_path with status ``copied`` to its target_path; gives target_path, bytes, error.

    Both folders must be mounted where tasks run.  A copy is written beside its target and
    then renamed, so a task that is run again leaves whole files, and a failed file
    does not fail the job.  The copying happens when the result is written or counted.
    """

    def run(batches):
        for batch in batches:
            size, error = [], []
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{target}.{uuid.uuid4().hex}.part"
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(source, "rb") as a, open(part, "wb") as b:
                        shutil.copyfileobj(a, b, buffer)
                    shutil.copystat(source, part)
                    os.replace(part, target)
                    size.append(os.path.getsize(target))
                    error.append(None)
                except OSError as problem:
                    size.append(None)
                    error.append(f"{type(problem).__name__}: {problem}")
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(size, pa.int64()), pa.array(error, pa.string())], names=["target_path", "bytes", "error"])

    wanted = manifest.where(F.col("status") == "copied").select("source_path", "target_path")
    return wanted.mapInArrow(run, "target_path string, bytes bigint, error string")


def file_hashes(files: DataFrame, kind: str = "md5", buffer: int = 64 * 1024) -> DataFrame:
    """path, digest (``md5``, ``sha256`` or ``sha512``, null for an empty file) and error of every path, read piece by piece."""

    def run(batches):
        for batch in batches:
            digest, error = [], []
            for path in batch.column(0).to_pylist():
                own, size = hashlib.new(kind), 0
                try:
                    with open(path, "rb") as f:
                        while piece := f.read(buffer):
                            own.update(piece)
                            size += len(piece)
                    digest.append(own.hexdigest() if size else None)
                    error.append(None)
                except OSError as problem:
                    digest.append(None)
                    error.append(f"{type(problem).__name__}: {problem}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.string()), pa.array(error, pa.string())], names=["path", "digest", "error"])

    return files.select("path").mapInArrow(run, "path string, digest string, error string")
