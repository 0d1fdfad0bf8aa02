"""Shared plumbing: staged tables, shared folders, Arrow text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; texts may be long, so batches stay small.
ARROW_ROWS = 1000
ARROW_BYTES = "8m"
#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that Python workers keep a flat memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the folder that spark.checkpoint.dir names, which all executors must share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
        base = f"file://{tempfile.gettempdir()}/spark-checkpoint-{spark.sparkContext.applicationId}"  # one machine only
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Slots of a membership bitmap: 262,144 words of 64.
SLOTS = 1 << 24


def likely_in(df: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Rows of df that may have a key of members, by a bitmap of hashed keys, ahead of the join that decides. The
    bitmap has at most SLOTS / 64 rows of 16 bytes, whatever the input, so it is broadcast; the more keys, the
    fewer rows it saves from the join's shuffle."""
    word, bit, slot = (f"{x}_{uuid.uuid4().hex}" for x in ("word", "bit", "slot"))
    place = F.pmod(F.xxhash64(*key), F.lit(SLOTS))
    bits = members.select(place.alias(slot)).groupBy(F.shiftright(slot, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} % 64 as int))")).alias(bit))
    wide = df.withColumn(slot, place)
    held = wide.join(F.broadcast(bits), F.shiftright(F.col(slot), 6) == F.col(word)).where(F.expr(f"getbit({bit}, cast({slot} % 64 as int)) = 1"))
    return held.select(df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filled(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text column as one StringArray without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch so that each part holds about limit bytes of text (one row at least)."""
    texts = filled(batch.column(batch.schema.names.index(column)))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a StringArray without nulls and len + 1 offsets that begin at 0."""
    n = len(texts)
    raw = texts.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(raw[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def fixed_lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _table(keep) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for i in range(128):
        if not keep(int(t[i])):
            t[i] = 32
    return t


#: Lower-case A-Z; white space splits.
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13)
#: Lower-case A-Z; anything but digits, letters and non-ASCII splits.
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122)


def words(texts: pa.Array, bytes_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each text's words as indices into a dictionary: (indices, len + 1 offsets, dictionary)."""
    data, offsets = buffers(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(strings(bytes_table[data], offsets)))
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    filled_words = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not filled_words.all():  # an empty text is one empty word
        total = np.concatenate([[0], np.cumsum(filled_words)])
        flat, ends = flat.filter(pa.array(filled_words)), total[ends]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), ends, coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - firsts, lengths)
