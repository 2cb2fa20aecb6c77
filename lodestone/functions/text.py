"""Scalar functions on names, paths, URLs and JSON text: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of combined lens texts, the prefixes of image paths, vendor folders.
FOCAL = r"(?i)[\d.,]+\s*mm(?:\s*to\s*[\d.,]+\s*mm)?"
FIELD_OF_VIEW = r"(?i)horizontal\s+(?:field\s+of\s+view\s*:?\s*)?([\d.,]+\s*°?\s*(?:to\s*[\d.,]+\s*°?)?)"
IMAGE_ROOT, IMAGE_ROUTE = "data/images/", "/api/v1/images/"
VENDOR_FOLDERS = {"AXIS_COMMUNICATIONS": "Axis Communications", "HIKVISION": "HikVision"}


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def slug(name: Column) -> Column:
    """Lower case, spaces and slashes to hyphens: one rule for every source."""
    return F.translate(F.lower(name), " /", "--")


def folder(name: Column, keep_case: bool = False) -> Column:
    """Name of a vendor's or category's folder; a series keeps its case."""
    return F.replace(name if keep_case else F.upper(name), F.lit(" "), F.lit("_"))


def folder_title(name: Column) -> Column:
    """Underscores to spaces, and a capital after everything that isn't a letter (initcap() looks at spaces only)."""
    runs = F.regexp_extract_all(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), "")


def vendor_name(vendor_folder: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in VENDOR_FOLDERS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, vendor_folder), vendor_folder)


def absolute_url(url: Column, base: str) -> Column:
    """A leading slash gets the site's base; empty becomes null."""
    return F.when(F.coalesce(url, F.lit("")) == "", None).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def https_url(url: Column) -> Column:
    """A leading // gets https:; empty becomes null."""
    return F.when(F.coalesce(url, F.lit("")) == "", None).when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def thumbnail_url(path: Column) -> Column:
    clean = F.when(path.startswith(IMAGE_ROOT), F.substr(path, F.lit(len(IMAGE_ROOT) + 1))).otherwise(path)
    return F.concat(F.lit(IMAGE_ROUTE), clean)


def focal_length(text: Column) -> Column:
    return F.trim(F.nullif(F.regexp_extract(text, FOCAL, 0), F.lit("")))


def horizontal_fov(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, FIELD_OF_VIEW, 1), F.lit(""))


def json_strings(text: Column) -> Column:
    """A JSON list of strings; null, blank or broken text is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_map(text: Column) -> Column:
    """A JSON object's entries in document order, nested values as JSON text; broken text is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def percent(part: Column, whole: Column) -> Column:
    """12.3% — null when the whole is 0."""
    return F.when(whole != 0, F.format_string("%.1f%%", F.try_divide(part * F.lit(100.0), whole)))


def file_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def fourcc(code: Column) -> Column:
    """Four characters of an integer, lowest byte first."""
    return F.concat(*[F.chr(F.shiftright(code, 8 * i).bitwiseAND(255)) for i in range(4)])


def video_seconds(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1048576.0), 2)
