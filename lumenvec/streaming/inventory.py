"""Incremental sync of folders and rows (S5, J6, U1): a checkpointed stream of inventory changes.

The feed tells files that came or went. A batch adds up the changes of each group of files and writes the new counts of
the buckets that it touches, a folder a batch, so that a batch which runs again starts from the batches before it and
writes the same. Only touched groups are held against the rows; their actions are a folder a batch, too. Groups of
rows that no file was ever told of are a last difference, by key alone. The latest action of each group, and those,
are what the full join of all folders and all rows gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import inventory
from ..sources.sinks import staged

BUCKETS = 32


def _bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def grouped_changes(feed: DataFrame, key: list[str]) -> DataFrame:
    """key (owner, group_id) and face_count: files that came less files that went, of a feed of (path, removed)."""
    change = F.when(F.coalesce("removed", F.lit(False)), -1).otherwise(1).cast("long").alias("change")
    files = inventory(feed.select("path", change), keep=("change",))
    return files.where(F.col("group_id").isNotNull()).groupBy(*key).agg(F.sum("change").alias("change"))


def counts(spark: SparkSession, state: str, key: list[str], schema: str, before: int | None = None) -> DataFrame:
    """key, face_count of all groups that files were told of, 0 for those that lost all, after the batches before one."""
    try:
        every = spark.read.schema(f"{schema}, face_count long, batch int, bucket int").parquet(state)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, face_count long, bucket int")
    if before is not None:
        every = every.where(F.col("batch") < before)
    last = every.select("batch", "bucket").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))  # BUCKETS rows at most
    return every.join(F.broadcast(last), ["bucket", "batch"]).select(*key, "face_count", "bucket")


def sync_batches(rows: Callable[[], DataFrame], key: list[str], schema: str, state: str, actions: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over the feed. rows: key, face_count of the table as it is then; schema: of key."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes = staged(grouped_changes(batch, key).withColumn("bucket", _bucket(key)), "changes")
        touched = changes.select("bucket").distinct()  # BUCKETS rows at most
        old = counts(spark, state, key, schema, number).join(F.broadcast(touched), "bucket", "left_semi")
        both = old.join(changes.drop("bucket"), key, "full_outer")
        count = F.greatest(F.coalesce("face_count", F.lit(0)) + F.coalesce("change", F.lit(0)), F.lit(0)).alias("face_count")
        new = staged(both.select(*key, count, _bucket(key).alias("bucket"), F.col("change").isNotNull().alias("told")), "counts")
        new.drop("told").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(state)
        now = new.where("told").select(*key, F.when(F.col("face_count") > 0, F.col("face_count")).alias("folder_count"))
        held = now.join(rows().select(*key, F.col("face_count").alias("row_count")), key, "left")
        folder, row = F.col("folder_count").isNotNull(), F.col("row_count").isNotNull()
        action = F.when(folder & row, "keep").when(folder, "insert").when(row, "delete").otherwise("none")  # as sync has them, of touched groups
        count = F.coalesce("folder_count", "row_count", F.lit(0).cast("long"))
        held.select(*key, count.alias("face_count"), F.when(action == "insert", "HIGH").alias("risk_level"), action.alias("action")).write.mode("overwrite").parquet(f"{actions}/batch={number}")

    return write


def current_actions(spark: SparkSession, actions: str, rows: DataFrame, key: list[str]) -> DataFrame:
    """key, face_count, risk_level, action as J6's full join has them: each group's latest action, and delete for rows
    that no file was told of. Groups without files and without a row have none."""
    told = spark.read.parquet(actions)
    names = ["face_count", "risk_level", "action"]
    last = told.groupBy(*key).agg(F.max_by(F.struct(*names), "batch").alias("a")).select(*key, "a.*")
    never = rows.join(last.select(*key), key, "left_anti").select(*key, "face_count", F.lit(None).cast("string").alias("risk_level"), F.lit("delete").alias("action"))
    return last.where("action <> 'none'").unionByName(never)
