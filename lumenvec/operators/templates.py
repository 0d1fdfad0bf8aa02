"""Spherical k-means templates of groups of unit vectors.

A group has one, two or three clusters by its size. Seeds are drawn by squared distance, (1 - similarity)^2 to the
nearest seed so far, from uniform numbers that are hashes of (group, place, draw): the row with the least
-ln(u) / weight is drawn with a chance in proportion to its weight, and the same rows are drawn each time, however
rows are dealt out. Rounds assign each vector to the most similar centroid and take the unit means, until no entry of
a group's centroids moves by tolerance (equal assignments move none). A cluster without vectors starts anew from the
vector least like its centroid.

Groups of at most LARGEST vectors are one task's work each. Larger ones are many tasks': draws are a least row of
partial minima, a round is partial sums per cluster, and all large groups take their rounds at once. Both give the
same templates (a test compares them); LARGEST only says who does the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from ..sources.sinks import staged
from .similarity import matrix

LARGEST = 100_000
ROUNDS = 100
TOLERANCE = 1e-4
#: Most clusters of a group.
SEEDS = 3


def clusters(n: Column) -> Column:
    """How many templates a group of n vectors has."""
    return F.least(n, F.when(n < 3, 1).when(n < 8, 2).otherwise(SEEDS)).cast("int")


def _drawn(key: str, draw: int) -> Column:
    """-ln of a uniform number in (0, 1] of a row's own."""
    h = F.pmod(F.xxhash64(key, "pos", F.lit(draw)), F.lit(1 << 53))
    return -F.ln((h + 1) / F.lit(float(1 << 53)))


def templates(rows: DataFrame, key: str, rounds: int = ROUNDS, tolerance: float = TOLERANCE, largest: int = LARGEST) -> DataFrame:
    """Key, template, n, centroid. rows: key, pos (whole numbers), embedding."""
    rows = rows.select(key, F.col("pos").cast("long").alias("pos"), "embedding")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= largest:
        return _small(rows, key, rounds, tolerance)
    sized = rows.join(sizes, key)
    small = _small(sized.where(F.col("_n") <= largest).drop("_n"), key, rounds, tolerance)
    large = sized.where(F.col("_n") > largest).withColumn("_k", clusters(F.col("_n"))).drop("_n")
    return small.unionByName(_large(staged(large, "large-groups"), key, rounds, tolerance))


def _small(rows: DataFrame, key: str, rounds: int, tolerance: float) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        x = matrix(group.column("embedding"))
        n = len(x)
        k = min(n, 1 if n < 3 else 2 if n < 8 else SEEDS)
        chosen: list[int] = []
        for j in range(k):
            weight = ((1 - x @ x[chosen].T) ** 2).min(axis=1) if chosen else np.ones(n)
            with np.errstate(divide="ignore", invalid="ignore"):
                race = np.where(weight > 0, group.column(f"_u{j}").to_numpy() / weight, np.inf)
            chosen.append(int(race.argmin()))
        c = x[chosen].copy()
        for _ in range(rounds):
            sim = x @ c.T
            label = sim.argmax(axis=1)
            fresh = np.zeros_like(c)
            for j in range(k):
                own = x[label == j]
                v = own.sum(axis=0) if len(own) else x[int(sim.max(axis=1).argmin())]
                fresh[j] = v / (np.linalg.norm(v) or 1.0)
            moved, c = np.abs(fresh - c).max(), fresh
            if moved < tolerance:
                break
        name = group.column(key)[0].as_py()
        return pa.table([pa.array([name] * k, group.schema.field(key).type), pa.array(range(k), pa.int32()), pa.array([int((label == j).sum()) for j in range(k)], pa.int64()), pa.array(list(c), pa.list_(pa.float64()))], [key, "template", "n", "centroid"])

    kind = rows.schema[key].dataType.simpleString()
    wide = rows.withColumns({f"_u{j}": _drawn(key, j) for j in range(SEEDS)})
    return wide.groupBy(key).applyInArrow(run, f"{key} {kind}, template int, n long, centroid array<double>")


def _large(rows: DataFrame, key: str, rounds: int, tolerance: float) -> DataFrame:
    """The same for groups that are cut over tasks. rows: key, pos, embedding, _k (a written table)."""

    def with_centroids(some: DataFrame, now: DataFrame) -> DataFrame:
        """some with its group's centroids, in order, as _c."""
        lists = now.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("template", "centroid"))), lambda t: t["centroid"]).alias("_c"))
        return some.join(lists, key).withColumn("_s", F.transform("_c", lambda c: dot(F.col("embedding"), c)))

    now = None
    for j in range(SEEDS):
        more = rows.where(F.col("_k") > j)
        weight = F.lit(1.0) if now is None else F.pow(1 - F.array_max("_s"), 2)
        race = F.when(weight > 0, _drawn(key, j) / weight).otherwise(F.lit(float("inf")))
        drawn = (more if now is None else with_centroids(more, now)).groupBy(key).agg(F.min_by("embedding", F.struct(race.alias("r"), "pos")).alias("centroid"))
        drawn = drawn.select(key, F.lit(j).alias("template"), "centroid")
        now = staged(drawn if now is None else now.unionByName(drawn), "seeds")
    now = now.withColumns({"n": F.lit(0).cast("long"), "open": F.lit(True)})
    for _ in range(rounds):
        going = now.where("open")
        met = with_centroids(rows, going).withColumns({"template": F.expr("cast(array_position(_s, array_max(_s)) - 1 as int)"), "_best": F.array_max("_s")})
        cells = met.select(key, "template", F.posexplode("embedding").alias("_at", "_x")).groupBy(key, "template", "_at").agg(F.sum(F.col("_x").cast("double")).alias("_x"), F.count(F.lit(1)).alias("n"))
        sums = cells.groupBy(key, "template").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_at", "_x"))), lambda t: t["_x"]).alias("_v"))
        least = met.groupBy(key).agg(F.min_by("embedding", F.struct("_best", "pos")).alias("_least"))
        fresh = going.drop("n").join(sums, [key, "template"], "left").join(least, key).withColumn("_v", F.coalesce("_v", "_least"))
        fresh = fresh.select(key, "template", F.coalesce(unit(F.col("_v")), F.col("_v")).alias("_new"), F.coalesce("n", F.lit(0)).alias("n"), "centroid")
        moved = F.array_max(F.zip_with("_new", "centroid", lambda a, b: F.abs(a - b)))
        rated = staged(fresh.withColumn("_moved", moved), "round")
        still = rated.groupBy(key).agg((F.max("_moved") >= tolerance).alias("open"))
        now = staged(rated.join(still, key).select(key, "template", F.col("_new").alias("centroid"), "n", "open").unionByName(now.where("not open")), "centroids")
        if not now.where("open").limit(1).count():
            break
    return now.select(key, "template", "n", "centroid")
