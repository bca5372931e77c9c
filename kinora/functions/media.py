"""File names, EXIF fields and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file kinds and EXIF fields that the catalog knows.
RAW_SUFFIXES = (".cr2", ".cr3", ".nef", ".arw", ".dng", ".rw2", ".orf", ".raf", ".pef")
IMAGE_SUFFIXES = (*RAW_SUFFIXES, ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")
EXIF_KEPT = ("DateTimeOriginal", "CreateDate", "Model", "Make", "LensModel", "FocalLength", "FNumber", "ISO", "ExposureTime", "ImageWidth", "ImageHeight", "GPSLatitude", "GPSLongitude")
EXIF_SHOWN = ("DateTimeOriginal", "CreateDate", "Make", "Model", "LensModel", "FocalLength", "FNumber", "ISO", "ExposureTime", "GPSLatitude", "GPSLongitude")
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def suffix(path: Column) -> Column:
    """The lower-cased suffix of the last path component; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def file_thumb(root_id: Column, rel_path: Column) -> Column:
    return F.concat(F.lit("files/"), root_id.cast("string"), F.lit("/"), F.translate(rel_path, "/\\", "__"), F.lit(".jpg"))


def face_thumb(file_id: Column, face_index: Column) -> Column:
    return F.concat(F.lit("faces/"), file_id.cast("string"), F.lit("_"), face_index.cast("string"), F.lit(".jpg"))


def exif_kept(exif: Column) -> Column:
    """The known fields of a JSON object, those present only, as a map of strings."""
    everything = F.from_json(exif, "map<string,string>")
    return F.map_filter(everything, lambda k, v: k.isin(*EXIF_KEPT))


def exif_shown(exif: Column) -> Column:
    """``key=value`` of the shown fields that are neither null nor empty, in their order, joined by ``; ``."""
    everything = F.from_json(exif, "map<string,string>")
    one = [F.when(F.coalesce(everything[k], F.lit("")) != "", F.concat(F.lit(f"{k}="), everything[k])) for k in EXIF_SHOWN]
    return F.concat_ws("; ", *one)


def human_size(size: Column) -> Column:
    """With one decimal, exact halves to even, in steps of 1024 up to TB."""
    shown = lambda k: F.format_string(f"%.1f {SIZE_UNITS[k]}", F.bround(size.cast("double") / float(1024**k), 1))
    out = shown(4)
    for k in range(3, -1, -1):
        out = F.when(size.cast("double") / float(1024**k) < 1024, shown(k)).otherwise(out)
    return out


def shown_time(at: Column, zone: str = "UTC") -> Column:
    """A timestamp in the zone, with its name, ``never`` if there is none."""
    return F.coalesce(F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"), F.lit(f" {zone}")), F.lit("never"))


def html_escaped(text: Column) -> Column:
    """Text that may stand in markup and in quoted attributes."""
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def is_local(target: Column) -> Column:
    """Whether a redirect to ``target`` stays on this host: a path, and not one that browsers read as another host's."""
    return target.startswith("/") & ~F.substring(target, 2, 1).isin("/", "\\")
