"""Status of streaming jobs from the streams themselves (K4, X8): a listener of Spark's query events writes running,
completed and error, with percent, as rows of a status table."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "job string, seq long, batch long, status string, percent double, rows long, message string"
#: Seconds to wait for the last event of a query that has ended.
PATIENCE_S = 60.0


class StatusListener(StreamingQueryListener):
    """Rows of SCHEMA for the queries of one job, by their name, appended below root: seq 0 when a query starts, one for
    each batch with rows (percent of total rows so far, 99 at most while it runs), and one for the end."""

    def __init__(self, spark: SparkSession, root: str, job: str, total: int):
        self.spark, self.root, self.job, self.total = spark, root, job, total
        self.name, self.ended = f"{job}-{uuid.uuid4().hex}", threading.Event()
        self.runs: set[str] = set()
        self.seq, self.rows, self.batch = 0, 0, -1

    def _write(self, status: str, percent: float, message: str | None = None) -> None:
        row = (self.job, self.seq, self.batch, status, percent, self.rows, message)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.root)
        self.seq += 1

    def _share(self) -> float:
        return 100.0 * self.rows / self.total if self.total else 0.0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.runs.add(str(event.runId))
            self._write("running", 0.0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if str(p.runId) in self.runs and p.numInputRows:
            self.rows, self.batch = self.rows + p.numInputRows, p.batchId
            self._write("running", min(99.0, self._share()))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) in self.runs:
            if event.exception is None:
                self._write("completed", 100.0)
            else:
                told = [x.strip() for x in event.exception.splitlines() if x.strip() and not x.lstrip().startswith(("at ", "..."))]
                self._write("error", min(99.0, self._share()), told[-1][:500] if told else None)
            self.ended.set()


@contextmanager
def watched(spark: SparkSession, root: str, job: str, total: int) -> Iterator[StatusListener]:
    """A listener for one query of the name it gives; the query's last event is waited for."""
    listener = StatusListener(spark, root, job, total)
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.ended.wait(PATIENCE_S)
    finally:
        spark.streams.removeListener(listener)


def run_job(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, root: str, job: str, total: int) -> bool:
    """Run a stream over all that is there, batch after batch, its status written below root; whether it completed."""
    with watched(stream.sparkSession, root, job, total) as listener:
        query = stream.writeStream.queryName(listener.name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            return False  # told by the status
    return True


def statuses(spark: SparkSession, root: str) -> DataFrame:
    """All rows written so far."""
    return spark.read.schema(SCHEMA).parquet(root)


def current(rows: DataFrame) -> DataFrame:
    """job, status, percent, batch, message: each job's latest row."""
    last = rows.groupBy("job").agg(F.max_by(F.struct("status", "percent", "batch", "message"), "seq").alias("s"))
    return last.select("job", "s.*")
