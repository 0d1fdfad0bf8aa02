"""Filters and gates on detections and the gallery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import eye_ratio
from ..functions.text import like_text


def reject_reason(width: float, height: float, margin: float = 10, det: float = 0.65, size: float = 50, blur: float = 80, dark: float = 30, bright: float = 230) -> Column:
    """the first failing check of a detection, or 'passed'. Brightness is the whole frame's mean grey."""
    b = F.col("bbox")
    edge = (b[0] < margin) | (b[1] < margin) | (b[2] > width - margin) | (b[3] > height - margin)
    small = (b[2] - b[0] < size) | (b[3] - b[1] < size)
    return (
        F.when(edge, "edge_face").when(F.col("det_score") < det, "low_det_score").when(small, "too_small")
        .when(F.col("blur_var") < blur, "blur").when(F.col("brightness") < dark, "too_dark").when(F.col("brightness") > bright, "too_bright").otherwise("passed")
    )


def recognition_gate(quality: Column, min_height: float = 50, min_blur: float = 0.0, ratio: tuple[float, float] = (0.2, 0.7), min_quality: float = 0.3) -> Column:
    """whether a detection is good enough to be recognised. Ratios are compared at nine digits."""
    b = F.col("bbox")
    eyes = F.round(eye_ratio(F.col("landmarks"), b), 9)
    sharp = F.col("blur_var") >= min_blur if min_blur > 0 else F.lit(True)
    return (b[3] - b[1] >= min_height) & eyes.between(*ratio) & sharp & (F.round(quality, 9) >= min_quality)


def upload_reason(min_size: float = 50, min_blur: float = 80) -> Column:
    """F3."""
    b = F.col("bbox")
    small = (b[2] - b[0] < min_size) | (b[3] - b[1] < min_size)
    return F.when(small, "too_small").when(F.col("blur_var") < min_blur, "blur").otherwise("ok")


def stride(n: int, offset: int) -> Column:
    """every n-th frame."""
    return F.pmod(F.col("frame"), F.lit(n)) == offset


def cast_only(gallery: DataFrame, names: DataFrame) -> DataFrame:
    """the gallery's identities that names (identity) holds."""
    return gallery.join(names, "identity", "left_semi")


def size_window(gallery: DataFrame, least: int, most: int, dim: int) -> DataFrame:
    """identities with least to most vectors, counted before the vectors of another dimension go; nothing
    if fewer than two identities remain."""
    n = gallery.groupBy("identity").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(least, most))
    kept = gallery.join(n.select("identity"), "identity", "left_semi").where(F.size("embedding") == dim)
    enough = kept.select("identity").distinct().limit(2).count() >= 2
    return kept if enough else kept.limit(0)


def search(rows: DataFrame, column: str, needle: str, limit: int | None = None, shortest: int = 0) -> DataFrame:
    """Rows whose column contains the needle, or the needle with _ for blanks; ordered; the first limit."""
    if len(needle.strip()) < shortest:
        return rows.limit(0)
    found = rows.where(like_text(F.col(column), needle) | like_text(F.col(column), needle.replace(" ", "_"))).orderBy(column)
    return found.limit(limit) if limit else found


def usable(detections: DataFrame) -> DataFrame:
    """F8: valid detections that are no outliers."""
    return detections.where("is_valid and not is_outlier")


def drop_small(groups: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(groups with at least so many faces, one row with the number dropped)."""
    return groups.where(F.col("face_count") >= least), groups.where(F.col("face_count") < least).agg(F.count(F.lit(1)).alias("dropped"))
