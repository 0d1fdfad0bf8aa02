"""Scans in an order over ranges of rows: running sums or maxima of groups that may fill any number of tasks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

#: Rows of one range.
ROWS = 1 << 19


def parts(df: DataFrame, rows: int = ROWS) -> int:
    return max(shuffle_partitions(df.sparkSession), math.ceil(df.count() / rows))


def ranged(df: DataFrame, keys: list[str], name: str, rows: int = ROWS) -> DataFrame:
    """df (a written table) over ranges of keys, with part, the number of a row's range."""
    return staged(df.repartitionByRange(parts(df, rows), *keys).withColumn("part", F.spark_partition_id()), name)


def running(df: DataFrame, group: str, order: list[str], values: list[str], whole: Callable[[str], Column] = F.sum) -> DataFrame:
    """df of ranged(), by group and order, with total_ columns: sums of values (or maxima, with F.max) of a group's rows
    up to each. A group may fill any number of ranges: each range has two groups at most that others share, whose
    totals are carried on."""
    within = Window.partitionBy("part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = df.groupBy("part").agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    # A row or two for each range, here and below: broadcasts of a size bounded by the number of ranges.
    spans = df.join(F.broadcast(edges), "part").where((F.col(group) == F.col("lo")) | (F.col(group) == F.col("hi"))).groupBy(group, "part").agg(*(whole(c).alias(c) for c in values))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(group, "part", *(whole(c).over(before).alias(f"carried_{c}") for c in values)).where(" or ".join(f"carried_{c} is not null" for c in values))
    wide = df.withColumns({f"within_{c}": whole(c).over(within) for c in values}).join(F.broadcast(carried), ["part", group], "left")
    both = (lambda c: F.col(f"within_{c}") + F.coalesce(f"carried_{c}", F.lit(0))) if whole is F.sum else (lambda c: F.greatest(f"within_{c}", f"carried_{c}"))
    return wide.select(*df.columns, *(both(c).alias(f"total_{c}") for c in values))
