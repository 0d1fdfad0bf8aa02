"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic scores.

A document is a row of statistics of its whole text (FEATURES). They are standardised and mapped to
cos(W x + b) with W normal and b uniform, whose inner products approximate a Gaussian kernel. Tasks sum
Z'Z and Z'y over their rows; the sums, of a size that does not depend on the data, are added up by Spark
and solved for ridge weights. Raw scores are calibrated by isotonic regression on their histogram.

Labels are learnt from at most MAX_TRAIN rows, those of the smallest hashes of doc_id; that bound is what
lets their ids be broadcast to the scan, so no text is shuffled. Rows whose crc32(doc_id as text) mod 5 is 0
are never learnt from; of the others, remainder 1 fits the calibration and the rest the weights (if none has
remainder 1, the calibration is fitted on the rows of the weights). Labels, lang, source and doc_id are never
inputs of a score.

Defined cases: null, empty and wordless texts have all statistics 0 and are scored like any; a document
without a label or with a null doc_id is scored and never learnt from; repeated documents get a row each;
if no label, or only one, can be learnt, every score is the mean label (0.5 without any); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, fixed_lists, staged, table, text_slices, tune, words

FEATURES = ("log_words", "word_length", "word_length_sd", "upper", "digits", "punctuation", "marks", "pipes", "end_marks", "lines", "distinct", "distinct_lines", "top_word", "repeats", "non_ascii", "spaces", "short_words")
DIMENSIONS = 256
#: Kernel width in standard deviations, for all features together.
WIDTH = 3.0
RIDGE = 1e-3
MAX_TRAIN = 200_000
BINS = 500
THRESHOLD = 0.3


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    index, ends, dictionary = words(texts, SPACED)
    length = np.fromiter(map(len, dictionary.cast(pa.binary()).to_pylist()), np.float64, len(dictionary)) if len(dictionary) else np.zeros(0)
    sizes, out = length[index], np.zeros((len(texts), len(FEATURES)))
    for row, (text, x, y) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False)):
        n = y - x
        if not n:
            continue
        c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        total, one, w = len(text), sizes[x:y], index[x:y]
        letters = c[65:91].sum() + c[97:123].sum() + c[128:].sum() / 2
        marks = c[33] + c[35] + c[36] + c[37] + c[38] + c[42]  # ! # $ % & *
        _, times = np.unique(w, return_counts=True)
        lines = text.split(b"\n")
        out[row] = (
            np.log(n), one.mean(), one.std(), c[65:91].sum() / max(1, letters), c[48:58].sum() / total, (c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()) / total,
            marks / n, c[124] / n, (c[46] + c[63] + c[44]) / n, len(lines) / n, len(times) / n, len(set(lines)) / len(lines), times.max() / n,
            (w[1:] == w[:-1]).mean() if n > 1 else 0.0, c[128:].sum() / total, c[32] / total, (one <= 2).mean(),
        )
    return out


def with_statistics(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and x, the statistics of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                x = statistics(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), fixed_lists(x)], [*keep, "x"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "text").mapInArrow(run, f"{schema}, x array<double>")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    score: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)], axis=1)

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.score[0])
        return np.clip(np.interp(self.raw_scores(x), self.raw, self.score), 0, 1)


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres of the blocks and their non-decreasing means."""
    blocks: list[list[float]] = []
    for a, p, n in zip(x.tolist(), positives.tolist(), counts.tolist(), strict=True):
        blocks.append([a * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.01) / (b[2] + 0.02) for b in blocks])


def training_labels(labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """doc_id, y, fold of at most max_train labelled rows outside the held-out fold: those of the smallest
    hashes. Hashes over a cut that leaves some more than max_train rows are put aside before rows are ordered,
    so that what is ordered is bounded, too."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(fold != 0).select("doc_id", "y", fold.cast("int").alias("fold"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)).alias("h"))
    cells = known.groupBy(F.shiftright("h", 62 - 12).alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()  # 4,096 rows at most
    over = np.flatnonzero(cells["n"].cumsum().to_numpy() >= max_train)
    if len(over):
        known = known.where(F.shiftright("h", 62 - 12) <= int(cells["cell"][over[0]]))
    return known.orderBy("h", "doc_id").limit(max_train).select("doc_id", "y", "fold")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """What goes to the driver: moments, sums of dimensions ** 2 numbers and histograms, whatever the input."""
    known = staged(training_labels(labels, label, max_train), "labels")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most max_train rows of 20 bytes: a broadcast of proven size.
    rows = staged(with_statistics(text.join(F.broadcast(known), "doc_id"), ["doc_id", "y", "fold"]), "statistics")
    d = len(FEATURES)
    cells = [F.col("x")[k] for k in range(d)]
    found = rows.agg(F.count(F.lit(1)), F.avg("y"), F.min("y"), F.max("y"), *(f(c) for c in cells for f in (F.avg, F.stddev_pop))).first()
    if not found[0] or found[2] == found[3]:
        one = np.zeros(0)
        return Model(one, one, one, one, one, one, np.array([0.5 if not found[0] else found[1]]))
    moments = np.array(found[4:], np.float64).reshape(d, 2)
    rng = np.random.RandomState(seed)
    model = Model(moments[:, 0], np.where(moments[:, 1] > 1e-9, moments[:, 1], 1.0), rng.normal(size=(d, dimensions)) / WIDTH, rng.uniform(0, 2 * np.pi, dimensions), np.zeros(0), np.zeros(0), np.zeros(0))
    m = dimensions + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            z = model.features(_matrix(batch.column(0), d))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            a += z.T @ z
            b += z.T @ y
        both = np.concatenate([a, b[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), fixed_lists(both)], ["row", "v"])

    other = rows.where("fold <> 1")
    parts = other.select("x", "y").mapInArrow(sums, "row int, v array<double>").select("row", F.posexplode("v").alias("col", "v"))
    total = parts.groupBy("row", "col").agg(F.sum("v").alias("v")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "v"))).alias("v"))
    both = np.zeros((m, m + 1))
    for r in total.select("row", "v.v").toLocalIterator():
        both[r[0]] = r[1]
    a = both[:, :m]
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[0, 0]) / dimensions * np.eye(m), both[:, m])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw_scores(_matrix(batch.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.round((raw + 1) * BINS / 3), 0, BINS).astype(np.int32)), pa.array(raw), batch.column(1)], ["bin", "raw", "y"])

    held = rows.where("fold = 1")
    held = held if held.limit(1).count() else rows
    bins = held.select("x", "y").mapInArrow(histogram, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    model.raw, model.score = isotonic(bins["raw"].to_numpy(), bins["p"].to_numpy(), bins["n"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(statistics(texts)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all their columns, whose score reaches the threshold."""
    names = docs.columns
    keep = [f"_c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                yield part.select(keep).filter(pa.array(model.scores(statistics(texts)) >= threshold))

    wide = docs.toDF(*keep).withColumn("_text", F.col(keep[names.index("text")]).cast("string"))
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(keep, docs.schema, strict=True))
    return wide.mapInArrow(run, schema).toDF(*names)


def op2_fourier_ridge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
