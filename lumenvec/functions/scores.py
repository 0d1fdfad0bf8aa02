"""Quality, pose and status expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed weights of the combined score.
WEIGHTS = {"blur": 0.30, "brightness": 0.20, "pose": 0.25, "det": 0.25}


def clamp(v: Column) -> Column:
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def risk_level(similarity: Column) -> Column:
    """P12."""
    return F.when(similarity > 0.70, "LOW").when(similarity > 0.55, "MEDIUM").otherwise("HIGH")


def quality_label(score: Column) -> Column:
    """P13."""
    return F.when(score >= 0.8, "Excellent").when(score >= 0.6, "Good").when(score >= 0.4, "Fair").when(score >= 0.2, "Poor").otherwise("Rejected")


def detection_status(is_outlier: Column, is_valid: Column) -> Column:
    """Outlier before invalid before valid."""
    return F.when(is_outlier, "outlier").when(~is_valid, "invalid").otherwise("valid")


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once: repeated in nested conditions, distances make methods too long to compile."""
    return F.transform(F.array(value), body)[0]


def pose_ratio(landmarks: Column) -> Column:
    """Longer over shorter distance of the eyes from the nose; 1 with fewer than 3 points, 0 for no distance."""
    both = F.struct(distance(landmarks[0], landmarks[2]).alias("a"), distance(landmarks[1], landmarks[2]).alias("b"))
    ratio = _bind(both, lambda d: F.when(F.least(d["a"], d["b"]) <= 0, 0.0).otherwise(F.greatest(d["a"], d["b"]) / F.nullif(F.least(d["a"], d["b"]), F.lit(0.0))))
    return F.when(F.coalesce(F.size(landmarks) < 3, F.lit(True)), 1.0).otherwise(ratio)


def pose_label(landmarks: Column) -> Column:
    """P15."""
    label = lambda r: F.when(r == 0, "Unknown").when(r < 1.4, "Frontal").when(r < 2.0, "Tilted").otherwise("Profile")
    return F.when(F.coalesce(F.size(landmarks) < 3, F.lit(True)), "Unknown").otherwise(_bind(pose_ratio(landmarks), label))


def pose_score(landmarks: Column) -> Column:
    """0.6 horizontal symmetry + 0.4 vertical place of the nose; 0.5 with fewer than 5 points, 0 without eye distance."""
    left, right, nose = landmarks[0], landmarks[1], landmarks[2]
    parts = F.struct(distance(left, right).alias("eye"), (nose[0] - (left[0] + right[0]) / 2).alias("x"), (nose[1] - (left[1] + right[1]) / 2).alias("y"))

    def score(p: Column) -> Column:
        horizontal = F.greatest(F.lit(0.0), 1 - 2 * F.try_divide(F.abs(p["x"]), p["eye"]))
        vertical = _bind(F.try_divide(p["y"], p["eye"]), lambda drop: F.when(drop.between(0.4, 1.0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(drop - 0.7))))
        return F.when(p["eye"] < 1e-6, 0.0).otherwise(0.6 * horizontal + 0.4 * vertical)

    return F.when(F.coalesce(F.size(landmarks) < 5, F.lit(True)), 0.5).otherwise(_bind(parts, score))


def blur_score(variance: Column) -> Column:
    """P17."""
    return clamp((variance - 50) / 450)


def brightness_score(mean: Column) -> Column:
    """Highest in the middle of 80 to 180, scaled by 0.7 outside."""
    inside = 1 - F.abs(mean - 130) / 50 * 0.3
    return F.when(mean < 80, F.greatest(F.lit(0.0), mean / 80) * 0.7).when(mean > 180, F.greatest(F.lit(0.0), (255 - mean) / 75) * 0.7).otherwise(inside)


def combined_quality(blur: Column, brightness: Column, pose: Column, det: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum; a missing part counts 0.5; the detector's score is clamped."""
    half = lambda c: F.coalesce(c, F.lit(0.5))
    return weights["blur"] * half(blur) + weights["brightness"] * half(brightness) + weights["pose"] * half(pose) + weights["det"] * half(clamp(det))


def eye_ratio(landmarks: Column, box: Column) -> Column:
    """Eye distance over box width; 0 without width."""
    width = box[2] - box[0]
    return F.when(width > 0, distance(landmarks[0], landmarks[1]) / F.nullif(width, F.lit(0.0))).otherwise(0.0)


def template_count(n: Column) -> Column:
    """P26."""
    return F.when(n < 3, 1).when(n < 8, 2).otherwise(3)


def screen_time(count: Column, frame_skip: int, fps: float) -> Column:
    """Seconds."""
    return count * frame_skip / F.lit(float(fps))
