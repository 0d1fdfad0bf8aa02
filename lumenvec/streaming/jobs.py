"""Streaming jobs over detections (S7, K4, X1-X8, J16). Each reads a folder as a stream. Here rows come from a
Feed, slice after slice, and a job takes each slice as one batch; on a cluster the trigger is left out and the jobs
run on."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity import best_match
from ..sources.sinks import progress_sink, read_gallery, shared_dir, staged
from .status import run_job, statuses


class Feed:
    """df, written slice after slice to a folder that is read as a stream: iterating writes the next slice and gives
    its number. Slices are equal ranges of a column in which each key's frames ascend; a slice is written by as many
    tasks as hold its rows."""

    def __init__(self, df: DataFrame, name: str, by: str = "frame", slices: int = 4):
        spark: SparkSession = df.sparkSession
        self.rows, self.path = staged(df, f"{name}-rows"), shared_dir(spark, name)
        low, high = self.rows.agg(F.min(by), F.max(by)).first()
        self.slice = slice_of(F.col(by), low or 0, high or 0, slices)
        self.slices = slices
        self._write(0)
        self.stream = spark.readStream.schema(df.schema).parquet(self.path)

    def _write(self, k: int) -> None:
        self.rows.where(self.slice == k).write.mode("append").parquet(self.path)

    def whole(self) -> DataFrame:
        """All slices at once as a stream of one slice a batch."""
        path = shared_dir(self.rows.sparkSession, "slices")
        for k in range(self.slices):
            self.rows.where(self.slice == k).coalesce(1).write.mode("append").parquet(path)
        return self.rows.sparkSession.readStream.schema(self.rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def __iter__(self) -> Iterator[int]:
        for k in range(self.slices):
            if k:
                self._write(k)
            yield k


def slice_of(value: Column, low: int, high: int, slices: int) -> Column:
    """Which of the equal ranges from low to high a whole number lies in."""
    return F.floor((value - low) * slices / (high - low + 1)).cast("int")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", feed: Iterable[int] = (0,)) -> DataFrame:
    """Run a stream over all that is there, once for each slice of feed, into a parquet folder."""
    for _ in feed:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", feed: Iterable[int] = (0,)) -> None:
    for _ in feed:
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def match_batches(root: str, out: str, threshold: float, own: str | None = None) -> Callable[[DataFrame, int], None]:
    """Each batch of (probe, embedding) is matched with the gallery version published by then."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        best_match(kept, read_gallery(batch.sparkSession, root), threshold, own=own).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        kept.unpersist()

    return write


def running_counts(named: DataFrame, delay: str | None = None) -> DataFrame:
    """Session, name, n; with a watermark on ts if the state has to end."""
    rows = named.withWatermark("ts", delay) if delay else named
    return rows.groupBy("session", "name").agg(F.count(F.lit(1)).alias("n"))


def last_counts(feed: Feed) -> DataFrame:
    """X5 over a stream, in complete mode: the counts after the last batch."""
    stream, spark = feed.stream, feed.stream.sparkSession
    out = shared_dir(spark, "counts")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:06d}")

    drain_batches(running_counts(stream), write, shared_dir(spark, "state"), "complete", feed)
    every = spark.read.parquet(out)
    return every.join(every.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")


def progress(feed: Feed, job: str = "job") -> tuple[DataFrame, DataFrame]:
    """K4: (snapshots of counts, a folder a batch; the status rows that the stream's own events wrote)."""
    spark = feed.stream.sparkSession
    out, root = shared_dir(spark, "progress"), shared_dir(spark, "status")
    run_job(feed.whole(), progress_sink(out), shared_dir(spark, "state"), root, job, feed.rows.count())
    return spark.read.parquet(out), statuses(spark, root)


def snapshots(counts: DataFrame, status: DataFrame) -> DataFrame:
    """K4: each batch's counts with the status and percent that its job had then: the last row about the batch."""
    told = status.where("batch >= 0").groupBy("batch").agg(F.max_by(F.struct("status", "percent"), "seq").alias("s")).select("batch", "s.*")
    return counts.join(F.broadcast(told), "batch")  # a row for each batch


def job_status(jobs: DataFrame, groups: DataFrame) -> DataFrame:
    """movie_id, status: the one that its job's stream wrote, else completed if the movie has groups, else unknown.
    jobs: movie_id, status (null for movies without a job)."""
    have = groups.groupBy("movie_id").agg(F.count(F.lit(1)).alias("_n"))
    return jobs.join(have, "movie_id", "left").select("movie_id", F.coalesce("status", F.when(F.col("_n") > 0, "completed"), F.lit("unknown")).alias("status"))
