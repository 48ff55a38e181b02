"""Schemas and fixed sets of the media data model."""

from __future__ import annotations

#: The extensions that count as media.
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp", ".heic", ".heif")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".m4v")
HEIC_EXTENSIONS = (".heic", ".heif")
MEDIA_EXTENSIONS = PHOTO_EXTENSIONS + VIDEO_EXTENSIONS

FILES = "path string, dir string, name string, stem string, ext string, length bigint, modified timestamp"
METADATA = "path string, exif_dto timestamp_ntz, qt_header timestamp_ntz, qt_meta timestamp_ntz, heic_text string, error string"
SIDECARS = "dir string, json_name string, json_stem string, body string"
EXTRACTED = "path string, capture_ts timestamp_ntz, is_video boolean"
TAGS = "source_file string, tag string, copy_no int, group0 string, group1 string, file_order int, raw string, value string, printed string"
TRACK = "device string, t timestamp_ntz, lat double, lon double, alt double, track double, speed double, hdop double, pdop double, nsats int"
PLACES = "city string, region string, country_code string, country string, timezone string, feature_code string, population bigint, lat double, lon double"

NO_DATE = "NO_DATE"
