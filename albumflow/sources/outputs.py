"""Sinks that write files named by rows, whole or not at all.

1. Stage: tasks write into a folder of their own under ``<root>/.staging/<run>``: the lines of each output, or a
   copy of each file.  Nothing is seen outside of it.  Each task lists its pieces in a manifest; its
   commit message is the folder's name.
2. Commit: when all tasks are done, one small file that names the folders of the attempts that count is put in place by
   renaming.  Pieces of killed or repeated attempts are in no such folder.  A failed job aborts and leaves no trace.
3. Publish: pieces of one output get their offsets, tasks write them side by side into a file next to the
   target, and that is renamed to the target; an output of one piece is only renamed.  So a large output is
   the work of many tasks, and readers see the old file or the new one.

Each step may run again: a run that is committed is not staged anew, publishing writes the same bytes to the same
places, and what a file to be appended to had before the run is remembered by its length.  The root
must be mounted where tasks run.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MODES = ("new", "overwrite", "append")
BUFFER = 1 << 20
_PIECE = "output string, part int, place int, piece string, size bigint, base bigint, error string"
_REPORT = "output string, action string, bytes bigint, pieces int, error string"


@dataclass
class Staged(WriterCommitMessage):
    folder: str


def _inside(root: str, output: str) -> str:
    """The output's path, which may not lead out of the root."""
    path = os.path.normpath(os.path.join(root, output))
    if os.path.commonpath([path, os.path.normpath(root)]) != os.path.normpath(root) or path == os.path.normpath(root):
        raise ValueError(f"outside of {root}: {output}")
    return path


def _size(path: str) -> int:
    try:
        return os.path.getsize(path)
    except FileNotFoundError:
        return -1


class StagedWriter(DataSourceArrowWriter):
    """Writes (output, line) rows, those of one output one after the other, or (output, source) rows."""

    def __init__(self, options: dict[str, str]):
        self.root, self.run, self.mode, self.kind = (options[k] for k in ("root", "run", "mode", "kind"))
        self.stage = os.path.join(self.root, ".staging", self.run)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        task = TaskContext.get()
        part = task.partitionId()
        folder = f"{part:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        own = os.path.join(self.stage, folder)
        os.makedirs(own, exist_ok=True)
        with open(os.path.join(own, "manifest.json"), "w", encoding="utf-8") as manifest:
            for place, row in enumerate((self._lines if self.kind == "lines" else self._files)(iterator, own)):
                manifest.write(json.dumps({"part": part, "place": place} | row) + "\n")
            manifest.flush()
            os.fsync(manifest.fileno())
        return Staged(folder)

    def _begin(self, output: str) -> dict:
        return {"output": output, "piece": None, "size": 0, "base": _size(_inside(self.root, output)), "error": None}

    def _lines(self, batches: Iterator[pa.RecordBatch], own: str) -> Iterator[dict]:
        row = out = None
        count = 0
        for batch in batches:
            for output, line in zip(batch.column("output").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if row is None or output != row["output"]:
                    if row is not None:
                        yield self._done(row, out)
                    out, count = None, count + 1
                    try:
                        row = self._begin(output)
                        if self.mode != "new" or row["base"] < 0:
                            row["piece"] = os.path.join(own, f"{count:08d}")
                            out = open(row["piece"], "wb", BUFFER)  # noqa: SIM115
                    except (OSError, ValueError) as problem:
                        row = {"output": output, "piece": None, "size": 0, "base": -1, "error": f"{type(problem).__name__}: {problem}"}
                if out is not None and line is not None:
                    out.write(line.encode() + b"\n")
        if row is not None:
            yield self._done(row, out)

    @staticmethod
    def _done(row: dict, out) -> dict:
        if out is not None:
            out.flush()
            os.fsync(out.fileno())
            out.close()
            row["size"] = os.path.getsize(row["piece"])
        return row

    def _files(self, batches: Iterator[pa.RecordBatch], own: str) -> Iterator[dict]:
        count = 0
        for batch in batches:
            for output, source in zip(batch.column("output").to_pylist(), batch.column("source").to_pylist(), strict=True):
                count += 1
                try:
                    row = self._begin(output)
                    if self.mode != "new" or row["base"] < 0:
                        piece = os.path.join(own, f"{count:08d}")
                        shutil.copy2(source, piece)
                        row |= {"piece": piece, "size": os.path.getsize(piece)}
                except (OSError, ValueError) as problem:
                    row = {"output": output, "piece": None, "size": 0, "base": -1, "error": f"{type(problem).__name__}: {problem}"}
                yield row

    def commit(self, messages: list[Staged | None]) -> None:
        os.makedirs(self.stage, exist_ok=True)
        new = os.path.join(self.stage, "committed.new")
        with open(new, "w", encoding="utf-8") as f:
            json.dump(sorted(m.folder for m in messages if m is not None), f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, os.path.join(self.stage, "committed.json"))

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class StagedOutputs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_outputs"

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        return StagedWriter(dict(self.options))


def _stage(rows: DataFrame, root: str, mode: str, kind: str, run: str | None) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    run = run or uuid.uuid4().hex
    if not os.path.exists(os.path.join(root, ".staging", run, "committed.json")):
        rows.sparkSession.dataSource.register(StagedOutputs)
        rows.write.format("staged_outputs").options(root=root, run=run, mode=mode, kind=kind).mode("append").save()
    return run


def _report(target: str, row: dict, run: str, append: bool) -> tuple[str, int, str | None]:
    """Rename what was staged to its target; action, bytes and error."""
    made = f"{target}.{run}.part"
    if row["error"] is not None:
        return "failed", 0, row["error"]
    if row["piece"] is None:
        return "skipped", 0, None
    whole = row["size"] + (max(row["base"], 0) if append else 0)
    ready = row["piece"] if row["pieces"] == 1 and whole == row["size"] else made
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if os.path.exists(ready):
        if os.path.getsize(ready) != whole:
            raise OSError(f"{ready} has {os.path.getsize(ready)} bytes, {whole} are due")
        os.replace(ready, target)
    elif _size(target) != whole:  # else an earlier attempt has renamed it
        raise FileNotFoundError(ready)
    return ("appended" if append and row["base"] >= 0 else "written" if row["base"] < 0 else "replaced"), whole, None


def publish(spark: SparkSession, root: str, run: str, mode: str) -> DataFrame:
    """Put the outputs of a committed run in place: output, action (written, replaced, appended, skipped or failed), bytes, pieces, error."""
    stage = os.path.join(root, ".staging", run)
    done = os.path.join(stage, "report")
    if not os.path.exists(os.path.join(done, "_SUCCESS")):
        with open(os.path.join(stage, "committed.json"), encoding="utf-8") as f:
            folders = json.load(f)
        manifests = [os.path.join(stage, x, "manifest.json") for x in folders]
        pieces = spark.read.schema(_PIECE).json(manifests) if manifests else spark.createDataFrame([], _PIECE)
        append = mode == "append"
        of = Window.partitionBy("output").orderBy("part", "place")
        ahead = F.coalesce(F.sum("size").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        start = F.greatest("base", F.lit(0)) if append else F.lit(0)
        placed = pieces.where("piece is not null").withColumn("offset", start + ahead).withColumn("pieces", F.count("*").over(Window.partitionBy("output")))
        moved = placed.where((F.col("pieces") > 1) | (F.col("offset") > 0))

        def write(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    target = _inside(root, row["output"])
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    made = os.open(f"{target}.{run}.part", os.O_CREAT | os.O_WRONLY, 0o644)
                    try:
                        if row["offset"] == (row["base"] if append else -1):  # the first piece brings what was there
                            _copy_range(target, made, 0, row["base"])
                        _copy_range(row["piece"], made, row["offset"], row["size"])
                        os.fsync(made)
                    finally:
                        os.close(made)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["pieces"])

        moved.select("output", "piece", "size", "base", "offset").mapInArrow(write, "pieces bigint").agg(F.sum("pieces")).collect()
        outputs = pieces.groupBy("output").agg(
            F.max("piece").alias("piece"), F.sum("size").alias("size"), F.max("base").alias("base"), F.count("piece").cast("int").alias("pieces"), F.max("error").alias("error"))

        def rename(batches):
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    try:
                        own = ("failed", 0, row["error"]) if row["error"] else _report(_inside(root, row["output"]), row, run, append)
                    except OSError as problem:
                        own = ("failed", 0, f"{type(problem).__name__}: {problem}")
                    rows.append((row["output"], own[0], own[1], row["pieces"], own[2]))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["output", "action", "bytes", "pieces", "error"])

        outputs.mapInArrow(rename, _REPORT).write.mode("overwrite").parquet(done)
        for folder in folders:
            shutil.rmtree(os.path.join(stage, folder), ignore_errors=True)
    return spark.read.schema(_REPORT).parquet(done)


def _copy_range(source: str, target: int, offset: int, size: int) -> None:
    """The first ``size`` bytes of a file, to an offset of an open one."""
    with open(source, "rb", 0) as f:
        while size > 0 and (data := f.read(min(size, BUFFER))):
            written = 0
            while written < len(data):
                written += os.pwrite(target, data[written:], offset + written)
            offset, size = offset + len(data), size - len(data)
    if size > 0:
        raise OSError(f"{source} is shorter than it was")


def write_outputs(rows: DataFrame, root: str, mode: str = "new", run: str | None = None) -> DataFrame:
    """Write rows (output, place, line) to the files they name under the root, lines in order of place; gives the report.

    ``new`` leaves files that are there alone, ``overwrite`` replaces them, ``append`` adds to them.  With the name of
    a run that is committed already nothing is written twice.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = rows.where("output is not null").repartitionByRange(tasks, "output", "place").sortWithinPartitions("output", "place").select("output", "line")
    return publish(rows.sparkSession, root, _stage(lines, root, mode, "lines", run), mode)


def place_files(manifest: DataFrame, root: str, mode: str = "overwrite", run: str | None = None) -> DataFrame:
    """Copy each source_path with status ``copied`` to its target_path under the root, all of them or none; gives the report.

    A file that cannot be read is reported and does not keep the others back.  A target is named once.
    """
    if mode == "append":
        raise ValueError("files are not appended to")
    relative = F.when(F.startswith("target_path", F.lit(root.rstrip("/") + "/")), F.substring("target_path", len(root.rstrip("/")) + 2, 1 << 30)).otherwise(F.col("target_path"))
    files = manifest.where((F.col("status") == "copied") & F.col("target_path").isNotNull()).groupBy(relative.alias("output")).agg(F.max("source_path").alias("source"))
    return publish(manifest.sparkSession, root, _stage(files, root, mode, "files", run), mode)
