"""Capture dates embedded in media files.

Files are read where Spark tasks run, headers only: a task opens each path, follows the
container's index to the few bytes with dates, and never loads a whole file.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumflow.functions.dates import QUICKTIME_OFFSET, epoch_to_ts, quicktime_epoch, strict_parse
from albumflow.functions.filetypes import LONGEST, type_of
from albumflow.functions.paths import is_media

#: Tag numbers of the date, and of the block that holds it.
DATE_TAG, EXIF_BLOCK = 0x9003, 0x8769
LONGEST_DATE = 1024  # bytes; a date has 20


def tiff_date(f: BinaryIO, base: int = 0, size: int | None = None) -> str | None:
    """The original date in the TIFF structure of ``size`` bytes at ``base``; offsets are sought in the file."""

    def piece(at: int, count: int) -> bytes:
        f.seek(base + at)
        return f.read(count if size is None else max(0, min(count, size - at)))

    head = piece(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack_from(order + "H", head, 2)[0] != 42:
        return None

    def entries(at: int) -> dict[int, tuple[int, int]]:
        many = struct.unpack(order + "H", piece(at, 2))[0]
        rows = piece(at + 2, 12 * many)
        fields = (struct.unpack_from(order + "HHII", rows, 12 * i) for i in range(many))
        return {tag: (count, value) for tag, _, count, value in fields}

    found = first = entries(struct.unpack_from(order + "I", head, 4)[0])
    if DATE_TAG not in first and EXIF_BLOCK in first:
        found = entries(first[EXIF_BLOCK][1])
    if DATE_TAG not in found:
        return None
    count, at = found[DATE_TAG]
    return piece(at, min(count, LONGEST_DATE)).split(b"\0")[0].decode("ascii", "replace")


def _jpeg(f: BinaryIO) -> str | None:
    f.seek(2)
    while len(head := f.read(4)) == 4 and head[0] == 0xFF and head[1] not in (0xD9, 0xDA):
        size = struct.unpack(">H", head[2:])[0] - 2
        body = f.read(size)
        if head[1] == 0xE1 and body[:6] == b"Exif\0\0":
            return tiff_date(io.BytesIO(body[6:]))
    return None


def _png(f: BinaryIO) -> str | None:
    f.seek(8)
    while len(head := f.read(8)) == 8:
        size, kind = struct.unpack(">I4s", head)
        if kind == b"eXIf":
            return tiff_date(f, f.tell(), size)
        f.seek(size + 4, io.SEEK_CUR)
    return None


def _webp(f: BinaryIO) -> str | None:
    f.seek(12)
    while len(head := f.read(8)) == 8:
        kind, size = struct.unpack("<4sI", head)
        if kind == b"EXIF":
            at = f.tell()
            skip = 6 if f.read(6) == b"Exif\0\0" else 0
            return tiff_date(f, at + skip, size - skip)
        f.seek(size + size % 2, io.SEEK_CUR)
    return None


def _boxes(f: BinaryIO, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of each box's content up to ``end``."""
    while f.tell() + 8 <= end:
        at = f.tell()
        size, kind = struct.unpack(">I4s", f.read(8))
        start = at + 8
        if size == 1:
            size, start = struct.unpack(">Q", f.read(8))[0], at + 16
        to = end if size == 0 else at + size
        if to <= at:
            return
        yield kind, start, min(to, end)
        f.seek(to)


def _length(f: BinaryIO) -> int:
    end = f.seek(0, io.SEEK_END)
    f.seek(0)
    return end


#: Fixed value: the name under which QuickTime metadata keep the creation date.
CREATION_KEY = b"com.apple.quicktime.creationdate"


class MovieDates(NamedTuple):
    seconds: int | None  # of the movie header, since 1904 (or 1970 in some files)
    written: str | None  # the creation date in the metadata


def _metadata_date(f: BinaryIO, start: int, end: int) -> str | None:
    """The creation date in a ``meta`` box: its keys number the values."""
    f.seek(start)
    plain = f.read(8)[4:] == b"hdlr"  # else four bytes of version and flags come first
    f.seek(start if plain else start + 4)
    number = None
    for kind, at, to in _boxes(f, end):
        f.seek(at)
        if kind == b"keys":
            body, place = f.read(to - at), 8
            for i in range(struct.unpack_from(">I", body, 4)[0]):
                size = struct.unpack_from(">I", body, place)[0]
                if body[place + 8 : place + size] == CREATION_KEY:
                    number = i + 1
                place += max(size, 8)
        elif kind == b"ilst" and number is not None:
            for item, first, last in _boxes(f, to):
                if int.from_bytes(item) == number:
                    f.seek(first)
                    return f.read(min(last - first, LONGEST_DATE))[16:].decode("utf-8", "replace").strip("\0 ")
    return None


def _movie(f: BinaryIO) -> MovieDates:
    """Creation times in the movie header and in its metadata."""
    seconds = written = None
    for kind, start, end in _boxes(f, _length(f)):
        if kind == b"moov":
            f.seek(start)
            for inner, at, to in _boxes(f, end):
                f.seek(at)
                if inner == b"mvhd":
                    body = f.read(12)
                    seconds = struct.unpack(">Q" if body[0] == 1 else ">I", body[4 : 12 if body[0] == 1 else 8])[0]
                elif inner == b"meta":
                    written = _metadata_date(f, at, to)
            break
    return MovieDates(seconds, written)


def _heic(f: BinaryIO) -> str | None:
    """The date of the item of type Exif, found through the item tables."""
    for kind, start, end in _boxes(f, _length(f)):
        if kind != b"meta":
            continue
        f.seek(start + 4)
        item, places = None, {}
        for inner, at, to in _boxes(f, end):
            f.seek(at)
            body = f.read(to - at)
            if inner == b"iinf":
                at_ = 6 if body[0] == 0 else 8
                while at_ + 8 <= len(body):
                    size = struct.unpack_from(">I", body, at_)[0]
                    entry = body[at_ + 8 : at_ + size]
                    wide = entry[0] == 3
                    number = struct.unpack_from(">I" if wide else ">H", entry, 4)[0]
                    if entry[10 if wide else 8 :][:4] == b"Exif":
                        item = number
                    at_ += max(size, 8)
            elif inner == b"iloc" and body[0] < 3:
                offset, length, base = body[4] >> 4, body[4] & 15, body[5] >> 4
                extra = body[5] & 15 if body[0] else 0
                wide = 4 if body[0] == 2 else 2  # bytes of an item's number
                at_ = 6 + wide
                for _ in range(int.from_bytes(body[6 : 6 + wide])):
                    number = int.from_bytes(body[at_ : at_ + wide])
                    at_ += wide + 2 + (2 if body[0] else 0)
                    start_ = int.from_bytes(body[at_ : at_ + base])
                    at_ += base
                    for _ in range(struct.unpack_from(">H", body, at_)[0]):
                        one = int.from_bytes(body[at_ + 2 + extra :][:offset])
                        two = int.from_bytes(body[at_ + 2 + extra + offset :][:length])
                        places.setdefault(number, (start_ + one, two))
                        at_ += extra + offset + length
                    at_ += 2
        if item in places:
            at, size = places[item]
            f.seek(at)
            skip = 4 + struct.unpack(">I", f.read(4))[0]
            return tiff_date(f, at + skip, size - skip)
    return None


def _tiff(f: BinaryIO) -> str | None:
    return tiff_date(f)


READERS: dict[str, Callable[[BinaryIO], str | MovieDates | None]] = {
    ".jpg": _jpeg, ".jpeg": _jpeg, ".png": _png, ".webp": _webp, ".tif": _tiff, ".tiff": _tiff,
    ".heic": _heic, ".heif": _heic, ".mp4": _movie, ".mov": _movie, ".m4v": _movie,
}


#: The reader of each type that a file shows by its content, whatever its name.
BY_TYPE = {"JPEG": _jpeg, "PNG": _png, "WEBP": _webp, "TIFF": _tiff, "DNG": _tiff, "HEIC": _heic, "HEIF": _heic, "MP4": _movie, "MOV": _movie, "M4V": _movie, "3GP": _movie}


def read_dates(f: BinaryIO, ext: str) -> tuple[str | None, int | None, str | None, str | None]:
    """Date text, movie seconds, movie metadata date, and error of an open file, read as its content says, or else as its name does."""
    try:
        kind = type_of(f.read(LONGEST), ext)
        f.seek(0)
        found = (BY_TYPE.get(kind) or READERS[ext.lower()])(f)
    except (KeyError, ValueError, IndexError, struct.error, OSError, RecursionError) as problem:
        return None, None, None, f"{type(problem).__name__}: {problem}"
    return (None, *found, None) if isinstance(found, MovieDates) else (found, None, None, None)


def metadata_ts(text: Column) -> Column:
    """The wall clock of an ISO date in movie metadata, its zone left out; null if it is none."""
    clock = F.regexp_extract(text, r"^\s*(\d{4}[-:]\d{2}[-:]\d{2}[T ]\d{2}:\d{2}:\d{2})", 1)
    return strict_parse(F.translate(clock, "-T", ": "))


def with_metadata(files: DataFrame) -> DataFrame:
    """Media rows of ``files`` plus exif_dto, qt_header, qt_meta, heic_text and error."""
    media = files.where(is_media(F.col("ext")))
    found = "path string, text string, seconds bigint, written string, error string"

    def run(batches):
        for batch in batches:
            out = []
            for path, ext in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open(path, "rb") as f:
                        out.append((path, *read_dates(f, ext)))
                except OSError as problem:
                    out.append((path, None, None, None, f"{type(problem).__name__}: {problem}"))
            names, kinds = ("path", "text", "seconds", "written", "error"), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    dates = media.select("path", "ext").mapInArrow(run, found)
    heic = F.lower("ext").isin(".heic", ".heif")
    text = strict_parse(F.col("text"))
    # a zero header is the date 1904, which counts as read and is rejected later
    seconds = F.when(F.col("seconds") == 0, -QUICKTIME_OFFSET).otherwise(quicktime_epoch(F.col("seconds")))
    return media.join(dates, "path").select(
        *files.columns, text.alias("exif_dto"), epoch_to_ts(seconds).alias("qt_header"), metadata_ts(F.col("written")).alias("qt_meta"),
        F.when(heic, F.col("text")).alias("heic_text"), "error",
    )
