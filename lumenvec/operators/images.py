"""Image features as Spark jobs (I1-I3, W7) on Spark's image struct: BGR bytes, row after row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import blur_score, brightness_score
from ..sources.sinks import staged


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance of BGR pixels, rounded to whole numbers."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[:, :, 0] if channels == 1 else np.rint(0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2])


@lru_cache(maxsize=64)
def _weights(n: int, size: int) -> np.ndarray:
    """How much of each of n pixels falls into each of size equal parts."""
    edges = np.linspace(0, n, size + 1)
    at = np.arange(n)
    return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * size / n


def area_mean(x: np.ndarray, size: int) -> np.ndarray:
    """x as size by size means over equal areas, fractions of pixels included."""
    return _weights(x.shape[0], size) @ x @ _weights(x.shape[1], size).T


def laplacian_variance(x: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian; edges mirror without repeating."""
    p = np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x).var())


@lru_cache(maxsize=1)
def _basis(n: int) -> np.ndarray:
    """Rows of the orthonormal cosine transform."""
    k = np.arange(n)
    basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis


def dct_hash(x: np.ndarray) -> str:
    """64 low DCT frequencies of the 32 by 32 image, over their median without the first, as 16 digits."""
    low = (_basis(32) @ area_mean(x, 32) @ _basis(32).T)[:8, :8].ravel().round(6).astype(np.float32)  # no sign of rounding errors
    return f"{int(''.join('1' if b else '0' for b in low > np.median(low[1:])), 2):016x}"


def image_features(images: DataFrame) -> DataFrame:
    """Origin, height, width, channels, brightness, blur_var, phash; an empty image has nulls and an empty hash."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                x = grey(r.data, r.height, r.width, r.nChannels) if r.height > 0 and r.width > 0 else None
                told = (None, None, "") if x is None else (float(x.mean()), laplacian_variance(x), dct_hash(x))
                rows.append((r.origin, r.height, r.width, r.nChannels, *told))
            yield pd.DataFrame(rows, columns=["origin", "height", "width", "channels", "brightness", "blur_var", "phash"])

    schema = "origin string, height int, width int, channels int, brightness double, blur_var double, phash string"
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, schema)


def audit(images: DataFrame, most_bits: int = 5) -> DataFrame:
    """Features with blur and brightness scores, and repeats: in the order of origins, an image goes whose hash
    is less than most_bits away from that of an earlier image that stays. An empty hash is like no other."""
    from .maintenance import greedy_keep
    from .similarity import hamming_join

    f = staged(image_features(images), "features")
    # Numbers that ascend with origin over all ranges of a sort; they are fixed by being written.
    placed = staged(f.select("origin", "phash").orderBy("origin").withColumn("id", F.monotonically_increasing_id()), "placed")
    first = staged(placed.where("phash <> ''").groupBy("phash").agg(F.min("id").alias("id")), "first")
    stays = greedy_keep(first, hamming_join(first, most_bits, [255 << 8 * k for k in range(8)]).where("distance > 0"))
    goes = placed.where("phash <> ''").join(stays.hint("merge"), "id", "left_anti").select("origin", F.lit(True).alias("repeats")).distinct()
    scores = {"blur_score": F.coalesce(blur_score(F.col("blur_var")), F.lit(0.0)), "brightness_score": F.coalesce(brightness_score(F.col("brightness")), F.lit(0.0))}
    return f.withColumns(scores).join(goes.hint("merge"), "origin", "left").withColumn("repeats", F.coalesce("repeats", F.lit(False)))


def drop_similar_images(images: DataFrame, group: str, threshold: float = 0.92) -> DataFrame:
    """Origin, kept: an image that correlates by more than threshold with the last kept one of its group
    (by origin) goes. Images are compared as 64 by 64 grey means; one without pixels is kept and is
    no one's last. images: group, image.

    Pictures (32 KB at most each) are cut into ranges of group and origin, so a large group is many tasks. Each range
    is first read as if nothing came before; then ranges that begin within a group are read again after the last kept
    picture of the range before, until no range hands on another picture than it did. Chains soon agree, so a second
    reading of such ranges is mostly the last."""

    def small(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pictures larger than their means are carried as means (float64)."""
        for pdf in parts:
            large = [len(r.data) > 8 * 64 * 64 for r in pdf.itertuples(index=False)]
            data = [area_mean(grey(r.data, r.height, r.width, r.nChannels), 64).tobytes() if big else r.data for r, big in zip(pdf.itertuples(index=False), large)]
            yield pdf.assign(data=data, means=large)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Flags of a range's pictures, and a row without origin: the group and picture that it hands on."""
        part, group, last = None, None, None

        def handed() -> pd.DataFrame:
            return pd.DataFrame([(part, None, None, group, None if last is None else last.tobytes())], columns=names)

        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                if r.part != part:
                    if part is not None:
                        yield pd.DataFrame(out, columns=names)
                        yield handed()
                        out = []
                    part, group, last = r.part, None, None
                if r.key != group:
                    group, last = r.key, None
                if r.before:
                    last = np.frombuffer(r.data).reshape(64, 64)
                    continue
                if r.height <= 0 or r.width <= 0:
                    out.append((part, r.origin, True, None, None))
                    continue
                x = np.frombuffer(r.data).reshape(64, 64) if r.means else area_mean(grey(r.data, r.height, r.width, r.nChannels), 64)
                x = x - x.mean()
                n = np.sqrt((x * x).sum())
                x = x / n if n > 0 else x
                keep = last is None or float((x * last).sum()) <= threshold
                out.append((part, r.origin, keep, None, None))
                last = x if keep else last
            yield pd.DataFrame(out, columns=names)
        if part is not None:
            yield handed()

    def read(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        dealt = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.desc("before"), "key", "origin")
        out = staged(dealt.mapInPandas(run, "part int, origin string, kept boolean, key string, data binary"), "chains")
        return out.where("kept is not null").select("part", "origin", "kept"), out.where("kept is null").select("part", "key", "data")

    names = ["part", "origin", "kept", "key", "data"]
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # json keeps null, every type and every value of the group apart
    key = F.to_json(F.struct(F.col(group).alias("g"))).alias("key")
    rows = images.select(key, "image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    carried = rows.mapInPandas(small, "key string, origin string, height int, width int, nChannels int, data binary, means boolean")
    cut = carried.repartitionByRange(parts, "key", "origin").withColumn("part", F.spark_partition_id()).withColumn("before", F.lit(False))
    cut = staged(cut, "pictures")
    first = cut.groupBy("part").agg(F.min("key").alias("key"))  # a row for each range
    follows = staged(first.withColumn("prior", F.lag("part").over(Window.orderBy("part"))), "ranges").where("prior is not null")
    flags, states = read(cut)
    used = states.select("part", F.lit(None).cast("long").alias("used")).limit(0)
    while True:
        handed = follows.join(states.where("data is not null").withColumnRenamed("part", "prior"), ["prior", "key"]).select("part", "key", "data", F.xxhash64("data").alias("now"))
        new = staged(handed.join(used, "part", "left").where("used is null or used <> now").select("part", "key", "data", "now"), "handed")
        if not new.limit(1).count():
            return flags.select("origin", "kept")
        given = new.select("key", F.lit(None).cast("string").alias("origin"), F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(1).alias("nChannels"), "data", F.lit(True).alias("means"), "part", F.lit(True).alias("before"))
        more, after = read(cut.join(new.select("part"), "part", "left_semi").unionByName(given))
        flags = staged(flags.join(new.select("part"), "part", "left_anti").unionByName(more), "flags")
        states = staged(states.join(new.select("part"), "part", "left_anti").unionByName(after), "states")
        used = staged(used.join(new.select("part"), "part", "left_anti").unionByName(new.select("part", F.col("now").alias("used"))), "used")
