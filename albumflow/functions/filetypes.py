"""File types by content: signatures at fixed places, with the extension where several fit."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types and what their files hold at which places (place, bytes); in the order in which they are tried.
SIGNATURES: list[tuple[str, tuple[tuple[int, bytes], ...]]] = [
    ("JPEG", ((0, b"\xff\xd8\xff"),)), ("PNG", ((0, b"\x89PNG\r\n\x1a\n"),)), ("GIF", ((0, b"GIF87a"),)), ("GIF", ((0, b"GIF89a"),)), ("WEBP", ((0, b"RIFF"), (8, b"WEBP"))),
    ("AVI", ((0, b"RIFF"), (8, b"AVI "))), ("WAV", ((0, b"RIFF"), (8, b"WAVE"))), ("BMP", ((0, b"BM"),)), ("PSD", ((0, b"8BPS"),)), ("CR2", ((0, b"II*\0"), (8, b"CR\x02"))),
    ("ORF", ((0, b"IIRO"),)), ("ORF", ((0, b"MMOR"),)), ("RW2", ((0, b"IIU\0"),)), ("TIFF", ((0, b"II*\0"),)), ("TIFF", ((0, b"MM\0*"),)), ("BTF", ((0, b"II+\0"),)), ("BTF", ((0, b"MM\0+"),)),
    ("RAF", ((0, b"FUJIFILM"),)), ("JP2", ((0, b"\0\0\0\x0cjP  \r\n\x87\n"),)), ("JXL", ((0, b"\xff\x0a"),)), ("JXL", ((0, b"\0\0\0\x0cJXL \r\n\x87\n"),)), ("ICO", ((0, b"\0\0\x01\0"),)),
    ("AVIF", ((4, b"ftypavif"),)), ("HEIC", ((4, b"ftypheic"),)), ("HEIC", ((4, b"ftypheix"),)), ("HEIC", ((4, b"ftyphevc"),)), ("HEIF", ((4, b"ftypmif1"),)), ("HEIF", ((4, b"ftypmsf1"),)), ("CR3", ((4, b"ftypcrx "),)),
    ("MOV", ((4, b"ftypqt  "),)), ("M4A", ((4, b"ftypM4A "),)), ("3GP", ((4, b"ftyp3gp"),)), ("MP4", ((4, b"ftyp"),)), ("MOV", ((4, b"moov"),)), ("MOV", ((4, b"wide"),)), ("MOV", ((4, b"mdat"),)),
    ("MKV", ((0, b"\x1aE\xdf\xa3"),)), ("FLV", ((0, b"FLV\x01"),)), ("ASF", ((0, b"\x30\x26\xb2\x75\x8e\x66\xcf\x11"),)), ("MPEG", ((0, b"\0\0\x01\xba"),)), ("MPEG", ((0, b"\0\0\x01\xb3"),)), ("OGG", ((0, b"OggS"),)),
    ("FLAC", ((0, b"fLaC"),)), ("MP3", ((0, b"ID3"),)), ("AIFF", ((0, b"FORM"), (8, b"AIFF"))), ("AIFF", ((0, b"FORM"), (8, b"AIFC"))), ("PDF", ((0, b"%PDF-"),)), ("PS", ((0, b"%!PS"),)), ("RTF", ((0, b"{\\rtf"),)),
    ("ZIP", ((0, b"PK\x03\x04"),)), ("GZIP", ((0, b"\x1f\x8b\x08"),)), ("BZ2", ((0, b"BZh"),)), ("XZ", ((0, b"\xfd7zXZ\0"),)), ("7Z", ((0, b"7z\xbc\xaf\x27\x1c"),)), ("RAR", ((0, b"Rar!\x1a\x07"),)),
    ("TAR", ((257, b"ustar"),)), ("DICOM", ((128, b"DICM"),)), ("SQLITE", ((0, b"SQLite format 3\0"),)), ("PARQUET", ((0, b"PAR1"),)), ("ELF", ((0, b"\x7fELF"),)), ("EXE", ((0, b"MZ"),)),
    ("TTF", ((0, b"\0\x01\0\0\0"),)), ("OTF", ((0, b"OTTO"),)), ("WOFF", ((0, b"wOFF"),)), ("WOFF2", ((0, b"wOF2"),)), ("DJVU", ((0, b"AT&TFORM"),)), ("SWF", ((0, b"FWS"),)), ("SWF", ((0, b"CWS"),)),
    ("ICS", ((0, b"BEGIN:VCALENDAR"),)), ("VCARD", ((0, b"BEGIN:VCARD"),)), ("SVG", ((0, b"<svg"),)), ("HTML", ((0, b"<!DOCTYPE html"),)), ("HTML", ((0, b"<!doctype html"),)), ("HTML", ((0, b"<html"),)), ("XML", ((0, b"<?xml"),)), ("JSON", ((0, b'{"'),)), ("JSON", ((0, b"[{"),)),
]
#: Types whose files look like those of another type, and their extensions.
BY_EXTENSION = {
    ".docx": ("ZIP", "DOCX"), ".xlsx": ("ZIP", "XLSX"), ".pptx": ("ZIP", "PPTX"), ".epub": ("ZIP", "EPUB"), ".odt": ("ZIP", "ODT"), ".kmz": ("ZIP", "KMZ"), ".jar": ("ZIP", "JAR"), ".dng": ("TIFF", "DNG"),
    ".nef": ("TIFF", "NEF"), ".arw": ("TIFF", "ARW"), ".pef": ("TIFF", "PEF"), ".heif": ("HEIC", "HEIF"), ".m4v": ("MP4", "M4V"), ".m4a": ("MP4", "M4A"), ".mov": ("MP4", "MOV"), ".webm": ("MKV", "WEBM"), ".ai": ("PDF", "AI"),
    ".svg": ("XML", "SVG"), ".gpx": ("XML", "GPX"), ".kml": ("XML", "KML"), ".xmp": ("XML", "XMP"), ".plist": ("XML", "PLIST"), ".xhtml": ("XML", "XHTML"),
}
LONGEST = max(place + len(piece) for _, pieces in SIGNATURES for place, piece in pieces)


def _lookups() -> list[tuple[tuple[tuple[int, int], ...], dict[bytes, int]]]:
    """Signatures of the same places and lengths as one table: the bytes there, joined, to the signature's rank."""
    tables: dict[tuple[tuple[int, int], ...], dict[bytes, int]] = defaultdict(dict)
    for rank, (_, pieces) in enumerate(SIGNATURES):
        tables[tuple((place, len(piece)) for place, piece in pieces)].setdefault(b"".join(piece for _, piece in pieces), rank)
    return list(tables.items())


LOOKUPS = _lookups()


def type_of(head: bytes, ext: str = "") -> str | None:
    """Type of a file by its first ``LONGEST`` bytes and its extension; null if no signature is there."""
    ranks = [table.get(b"".join(head[at : at + size] for at, size in spans)) for spans, table in LOOKUPS]
    found = min((r for r in ranks if r is not None), default=None)
    if found is None:
        return None
    kind = SIGNATURES[found][0]
    like, own = BY_EXTENSION.get(ext.lower(), (None, None))
    return own if kind == like else kind


def file_type(content: Column, ext: Column | None = None) -> Column:
    """``type_of`` as a column: a table lookup for each combination of places, and the first signature in the list's order."""
    ranks = []
    for spans, table in LOOKUPS:
        named = F.create_map(*[x for key, rank in table.items() for x in (F.lit(bytearray(key)), F.lit(rank))])
        ranks.append(F.try_element_at(named, F.concat(*[F.substring(content, at + 1, size) for at, size in spans])))
    kinds = F.array(*[F.lit(kind) for kind, _ in SIGNATURES])
    kind = F.get(kinds, F.least(*ranks, F.lit(1 << 20)))
    if ext is None:
        return kind
    like = F.create_map(*[x for e, (base, own) in BY_EXTENSION.items() for x in (F.lit(f"{base} {e}"), F.lit(own))])
    return F.coalesce(F.try_element_at(like, F.concat(kind, F.lit(" "), F.lower(ext))), kind)
