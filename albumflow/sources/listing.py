"""Folders as rows of files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from albumflow.functions import paths


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, symlinks: bool):
        self.root, self.symlinks = root, symlinks

    def partitions(self) -> list[_Folder]:
        """The root's own files, and each of its folders with all below it."""
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [_Folder(self.root, False), *(_Folder(p, True) for p in below)]

    def read(self, part: _Folder) -> Iterator[tuple]:
        for folder, below, names in os.walk(part.path):
            below.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not self.symlinks and os.path.islink(path):
                    continue
                info = os.stat(path)
                yield path, info.st_size, datetime.fromtimestamp(info.st_mtime, UTC)
            if not part.deep:
                return


class ListingSource(DataSource):
    """``spark.read.format("media_listing").load(folder)``: every file below a mounted folder.

    Unlike Spark's file sources it lists names that begin with a dot or an underscore.
    """

    @classmethod
    def name(cls) -> str:
        return "media_listing"

    def schema(self) -> str:
        return "path string, length bigint, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("symlinks", "true") == "true")


def list_folders(files: DataFrame) -> DataFrame:
    """dir, files, length of every folder that holds a file."""
    return files.groupBy("dir").agg(F.count("*").alias("files"), F.sum("length").alias("length"))


def like_glob(path, glob: str, case: bool = False):
    """Whether a path fits a wildcard: ``*`` and ``?`` within a folder, ``**`` across folders; letter case aside unless ``case``."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    pattern = "".join(parts.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*|\?)", glob))
    return path.rlike(("" if case else "(?i)") + f"^{pattern}$")


def list_files(
    spark: SparkSession, root: str, mounted: bool = False, outside: str | None = None, ignore: list[str] | None = None, hidden: bool = True, symlinks: bool = True,
) -> DataFrame:
    """path, dir, name, stem, ext, length, modified of every file below ``root``.

    ``mounted`` reads a folder that driver and executors all see, hidden names included;
    otherwise Spark's own file source lists it, from any store, without reading contents.
    Files below ``outside`` (an output folder, say) are left out, as are those in folders named in ``ignore``,
    names that begin with a dot unless ``hidden``, and (of a mounted folder) links unless ``symlinks``.
    """
    if mounted:
        spark.dataSource.register(ListingSource)
        rows = spark.read.format("media_listing").option("symlinks", str(symlinks).lower()).load(root)
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rows = rows.select(F.regexp_replace("path", "^file:", "").alias("path"), "length", F.col("modificationTime").alias("modified"))
    if outside:
        rows = rows.where(~F.startswith("path", F.lit(outside.rstrip("/") + "/")))
    for folder in ignore or []:
        rows = rows.where(~F.contains(F.concat(paths.dir_of(F.col("path")), F.lit("/")), F.lit(f"/{folder.strip('/')}/")))
    name = paths.name_of(F.col("path"))
    if not hidden:
        rows = rows.where(~F.startswith(name, F.lit(".")))
    return rows.select("path", paths.dir_of(F.col("path")).alias("dir"), name.alias("name"), paths.stem_of(name).alias("stem"), paths.ext_of(name).alias("ext"), "length", "modified")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """dir, json_name, json_stem, body of every JSON file below ``root``, from one listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").load(root)
    path = F.regexp_replace("path", "^file:", "")
    name = paths.name_of(path)
    return files.select(paths.dir_of(path).alias("dir"), name.alias("json_name"), paths.stem_of(name).alias("json_stem"), F.decode("content", "UTF-8").alias("body"))
