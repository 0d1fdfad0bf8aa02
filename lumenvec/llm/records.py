"""Token ids as length-delimited binary records with a separate offset index.

A file `tokens-00007-002.rec` is a row of records, each one: length (unsigned 64-bit, little-endian),
masked CRC-32C of those eight bytes, the payload, masked CRC-32C of the payload. A payload is the
ids of one sequence, little-endian, two bytes each if the vocabulary allows it, else four. Beside
it lies `tokens-00007-002.idx`: one entry of three signed 64-bit numbers for each record, its offset,
payload length and doc_id (the least number: null). Shuffled readers take the indexes, order their entries,
and seek straight to each record (read_shuffled).

Shards follow doc_id: shard k holds smaller ids than shard k + 1, records ascend within a shard. There are
as many as shuffle partitions, or more where rows are many; a shard is cut into files of FILE_BYTES, so rows of
one doc_id, however many, are several files, written as a stream.

Defined cases: null text is an empty one (its record holds the end id alone); rows with a null
doc_id come first; repeated rows are records of their own, equal doc_ids in the order of their
bytes; an empty table writes no shard; other columns are ignored, whatever their names.
A task writes to a name of its own and renames when done, so a task that runs twice leaves the
same files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binaries, shared_dir, shuffle_partitions, staged, table, text_slices, tune
from .crc import CRC32C, masked
from .tokens import encoder, vocabulary_path

#: Bytes of records that are framed or read at once.
PART = 8 << 20
#: Bytes after which a shard goes on in another file, and rows that a shard holds where shuffle partitions are few.
FILE_BYTES = 128 << 20
SHARD_ROWS = 1_000_000
MOST_SHARDS = 20_000
NO_ID = -(1 << 63)
SHARDS = "shard int, piece int, path string, records long, tokens long, bytes long, width int"


def encode_column(df: DataFrame, tokenizer: str, end_id: int | None, width: int, cuts: list[int]) -> DataFrame:
    """doc_id, ids (binary) of every whole text, the end id appended, and shard: the cuts below doc_id."""
    dtype, bounds = f"<u{width}", np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                ids, offsets = enc.encode(texts)
                ids = ids.astype(dtype)
                if end_id is not None:
                    ids = np.insert(ids, offsets[1:], np.array(end_id, dtype))
                    offsets = offsets + np.arange(len(offsets))
                keys = pc.fill_null(part.column(0), NO_ID).to_numpy(zero_copy_only=False)
                shard = np.searchsorted(bounds, keys, side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), binaries(ids.view(np.uint8), offsets * width), pa.array(shard)], ["doc_id", "ids", "shard"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, shard int")


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Framed records, with offsets and payload lengths within them."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    head = sizes.astype("<u8").view(np.uint8)
    body = np.frombuffer(b"".join(payloads), np.uint8)
    at = np.cumsum(sizes) - sizes
    head_crc = masked(CRC32C.many(head, np.arange(len(sizes)) * 8, np.full(len(sizes), 8)))
    body_crc = masked(CRC32C.many(body, at, sizes))
    heads, lengths, tails = head_crc.astype("<u4").tobytes(), head.tobytes(), body_crc.astype("<u4").tobytes()
    out = b"".join(x for i, p in enumerate(payloads) for x in (lengths[8 * i : 8 * i + 8], heads[4 * i : 4 * i + 4], p, tails[4 * i : 4 * i + 4]))
    return out, np.cumsum(sizes + 16) - (sizes + 16), sizes


class _File:
    """An open file of a shard: appends framed records, then publishes file and index under their names."""

    def __init__(self, root: str, shard: int, piece: int, width: int):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(base, recursive=True)
        name = f"tokens-{shard:05d}-{piece:03d}"
        self.path, self.name, self.shard, self.piece, self.width = f"{base}/{name}", f"{root}/{name}", shard, piece, width
        ctx = TaskContext.get()
        self.own = f"{base}/.part-{shard:05d}-{piece:03d}-{ctx.taskAttemptId() if ctx else 0}"
        self.rec, self.idx = self.fs.open_output_stream(self.own + ".rec"), self.fs.open_output_stream(self.own + ".idx")
        self.waiting, self.names, self.size, self.records, self.tokens, self.bytes = [], [], 0, 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.waiting.append(ids)
        self.names.append(NO_ID if doc_id is None else doc_id)
        self.size += len(ids)
        if self.size >= PART:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            out, offsets, sizes = frame(self.waiting)
            self.rec.write(out)
            self.idx.write(np.stack([offsets + self.bytes, sizes, np.array(self.names, np.int64)], axis=1).astype("<i8").tobytes())
            self.records += len(sizes)
            self.tokens += int(sizes.sum()) // self.width
            self.bytes += len(out)
            self.waiting, self.names, self.size = [], [], 0

    def close(self) -> tuple:
        self.flush()
        for stream, end in ((self.rec, ".rec"), (self.idx, ".idx")):
            stream.close()
            self.fs.move(self.own + end, self.path + end)
        return self.shard, self.piece, self.name, self.records, self.tokens, self.bytes, self.width


def write_records(docs: DataFrame, root: str, tokenizer: str, end_id: int | None = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every text's ids below root (file://, hdfs:// or another store's address) and return one
    row for each file, itself a written table. The bounds of shards are quantiles of doc_id."""
    width = 2 if len(encoder(tokenizer).pieces) <= 1 << 16 else 4
    n = min(MOST_SHARDS, max(shuffle_partitions(docs.sparkSession), -(-docs.count() // SHARD_ROWS)))
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("c")).first()["c"] if n > 1 else None
    dealt = encode_column(docs, tokenizer, end_id, width, sorted(set(found or [])))
    dealt = dealt.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            numbers = batch.column(2).to_numpy(zero_copy_only=False)
            for number, row in zip(numbers.tolist(), range(len(numbers)), strict=True):
                if now is None or now.shard != number or now.bytes + now.size >= file_bytes:
                    if now is not None:
                        done.append(now.close())
                    now = _File(root, number, now.piece + 1 if now is not None and now.shard == number else 0, width)
                now.add(batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
        if now is not None:
            done.append(now.close())
        if done:
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], ["shard", "piece", "path", "records", "tokens", "bytes", "width"])

    return staged(dealt.mapInArrow(write, SHARDS), "record-files")


def _open(path: str):
    store, at = pafs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _index(file: dict) -> np.ndarray:
    """Offsets, payload lengths and doc_ids of a file's records."""
    with _open(file["path"] + ".idx") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
    if len(index) != file["records"]:
        raise ValueError(f"{file['path']}.idx: {len(index)} entries, {file['records']} records")
    return index


def _placed(files: DataFrame) -> DataFrame:
    """files with base, the ids of all files before, a file a partition as far as there are any."""
    order = Window.orderBy("shard", "piece")  # a row for each file
    placed = files.withColumn("base", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.row_number().over(order))
    parts = shuffle_partitions(files.sparkSession)
    return placed.repartitionById(parts, F.pmod(F.col("n") - 1, F.lit(parts)).cast("int"))


def _payload(raw: bytes, offset: int, size: int, width: int) -> bytes:
    ids = raw[offset + 12 : offset + 12 + size]
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def read_records(files: DataFrame) -> DataFrame:
    """Read files back through their indexes, checking lengths and both checksums of each record: shard, piece,
    record (its number in the file), doc_id, start (ids of all records before it, over all files), n_tokens, ids
    (binary). Raises ValueError at the first damaged record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                index, start, width, at = _index(file), file["base"], file["width"], 0
                with _open(file["path"] + ".rec") as f:
                    while at < len(index):
                        to = max(at + 1, int(np.searchsorted(index[:, 0] + index[:, 1], index[at, 0] + PART)))
                        first, last = int(index[at, 0]), int(index[to - 1, 0] + index[to - 1, 1] + 16)
                        f.seek(first)
                        data = np.frombuffer(f.read(last - first), np.uint8)
                        offset, size = index[at:to, 0] - first, index[at:to, 1]
                        _verify(file["path"], data, offset, size)
                        count = size // width
                        starts = start + np.cumsum(count) - count
                        start += int(count.sum())
                        raw = data.tobytes()
                        ids = [_payload(raw, o, s, width) for o, s in zip(offset.tolist(), size.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(to - at, file[c], np.int32)) for c in ("shard", "piece")), pa.array(np.arange(at, to)), pa.array(index[at:to, 2], mask=index[at:to, 2] == NO_ID), pa.array(starts), pa.array(count), pa.array(ids, pa.binary())], ["shard", "piece", "record", "doc_id", "start", "n_tokens", "ids"])
                        at = to

    return _placed(files).mapInArrow(read, "shard int, piece int, record long, doc_id long, start long, n_tokens long, ids binary")


def read_index(files: DataFrame) -> DataFrame:
    """path, width, shard, piece, record, doc_id, start, offset, size of every record, from the indexes alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                index = _index(file)
                n, count = len(index), index[:, 1] // file["width"]
                same = [pa.array([file["path"]] * n), *(pa.array(np.full(n, file[c], np.int32)) for c in ("width", "shard", "piece"))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n)), pa.array(index[:, 2], mask=index[:, 2] == NO_ID), pa.array(file["base"] + np.cumsum(count) - count), pa.array(index[:, 0]), pa.array(index[:, 1])], ["path", "width", "shard", "piece", "record", "doc_id", "start", "offset", "size"])

    return _placed(files).mapInArrow(read, "path string, width int, shard int, piece int, record long, doc_id long, start long, offset long, size long")


def read_shuffled(files: DataFrame, seed: int = 0) -> DataFrame:
    """Every record once, in an order that seed draws, over all files: place, shard, piece, record, doc_id, start,
    n_tokens, ids. Only index entries are sorted; each record is then read by a seek, and checked."""
    drawn = read_index(files).withColumn("place", F.xxhash64(F.lit(seed), "shard", "piece", "record")).orderBy("place", "shard", "piece", "record")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, ids = part.to_pylist(), [b""] * part.num_rows
                of: dict[str, list[int]] = {}
                for k, r in enumerate(rows):
                    of.setdefault(r["path"], []).append(k)
                for path, wanted in of.items():
                    with _open(path + ".rec") as f:
                        for k in sorted(wanted, key=lambda k: rows[k]["offset"]):
                            f.seek(rows[k]["offset"])
                            raw = f.read(rows[k]["size"] + 16)
                            _verify(path, np.frombuffer(raw, np.uint8), np.array([0]), np.array([rows[k]["size"]]))
                            ids[k] = _payload(raw, 0, rows[k]["size"], rows[k]["width"])
                keep = [part.column(c) for c in ("place", "shard", "piece", "record", "doc_id", "start")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["place", "shard", "piece", "record", "doc_id", "start", "n_tokens", "ids"])

    return drawn.mapInArrow(fetch, "place long, shard int, piece int, record long, doc_id long, start long, n_tokens long, ids binary")


def _verify(path: str, data: np.ndarray, offset: np.ndarray, size: np.ndarray) -> None:
    def four(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel()

    said = np.ascontiguousarray(data[offset[:, None] + np.arange(8)]).view("<u8").ravel().astype(np.int64)
    bad = said != size
    bad |= masked(CRC32C.many(data, offset, np.full(len(offset), 8))) != four(offset + 8)
    bad |= masked(CRC32C.many(data, offset + 12, size)) != four(offset + 12 + size)
    if bad.any():
        raise ValueError(f"{path}.rec: record at {int(offset[bad][0])} is damaged")


def op8_length_delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as records and read back."""
    tune(spark)
    files = write_records(table(spark, sf_dir, "documents"), shared_dir(spark, "records"), vocabulary_path("word_bpe_49k.json"))
    return read_records(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard", "piece", "record")
