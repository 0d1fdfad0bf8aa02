"""Name, path and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column) -> Column:
    """Without dots, lower case."""
    return F.lower(F.replace(name, F.lit("."), F.lit("")))


def safe_name(name: Column) -> Column:
    """Letters, digits, blank, _ and - stay; right-trimmed; blanks become _."""
    return F.replace(F.rtrim(F.regexp_replace(name, r"[^\p{L}\p{Nd} _-]", "")), F.lit(" "), F.lit("_"))


def display_name(name: Column) -> Column:
    """_ becomes a blank; a letter after anything but a letter is a capital, other letters are small."""
    parts = F.split(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def identity_key(name: Column) -> Column:
    """Key of a new identity; null where nothing is left."""
    key = safe_name(F.lower(F.trim(name)))
    return F.when(key != "", key)


def source_of_file(file: Column) -> Column:
    """P5: the film a file came from: text before the first _."""
    return F.substring_index(file, "_", 1)


def owner_of_path(path: Column, folder: str = "labeled_faces") -> Column:
    """The path segment after folder, null without one."""
    found = F.regexp_extract(path, f"(?:^|/){folder}/([^/]+)", 1)
    return F.when(found != "", found)


def percent(score: Column) -> Column:
    """P25: whole percent, truncated."""
    return (score * 100).cast("int")


def percent_one(score: Column) -> Column:
    """P25: percent with one decimal."""
    return F.round(score * 100, 1)


def is_guest(name: Column, prefix: str = "Misafir") -> Column:
    """P28."""
    return F.startswith(name, F.lit(prefix))


def is_unknown(name: Column) -> Column:
    """P28."""
    return F.startswith(name, F.lit("Unknown"))


def identification_rate(labeled: Column, pending: Column) -> Column:
    """Whole percent of labelled faces; 0 without faces."""
    total = labeled + pending
    return F.when(total > 0, F.floor(100 * labeled / F.nullif(total, F.lit(0)))).otherwise(0).cast("int")


def quality_rate(labeled: Column, pending: Column) -> Column:
    """100 without pending faces, else 100 less their share, 0 at least."""
    return F.when(pending == 0, 100).otherwise(F.greatest(F.lit(0), 100 - F.floor(100 * pending / (labeled + pending + 1)))).cast("int")


def upload_title(ts: Column) -> Column:
    """Title of an upload without a film."""
    return F.concat(F.lit("Upload_"), F.date_format(ts, "yyyyMMdd_HHmm"))


def enrolled_file(ts: Column, guest: Column) -> Column:
    """File name of an enrolled guest."""
    return F.concat(F.unix_millis(ts).cast("string"), F.lit("_"), guest, F.lit(".jpg"))


def parse_box(text: Column) -> Column:
    """A stored box as array<double>."""
    return F.from_json(text, "array<double>")


def box_json(box: Column) -> Column:
    """A box as stored."""
    return F.to_json(box)


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """Box cut at the frame's edges."""
    limit = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    return F.array(limit(box[0], width), limit(box[1], height), limit(box[2], width), limit(box[3], height))


def size_text(box: Column) -> Column:
    """WxH of a box in whole pixels."""
    return F.concat_ws("x", (box[2] - box[0]).cast("int").cast("string"), (box[3] - box[1]).cast("int").cast("string"))


def like_text(column: Column, needle: str) -> Column:
    """case-insensitive contains."""
    return F.contains(F.lower(column), F.lit(needle.lower()))
