"""Sinks (K1-K4), picture files (S6) and staged tables."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import tempfile
import time
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the folder that spark.checkpoint.dir names, which all executors must share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
        base = f"file://{tempfile.gettempdir()}/spark-checkpoint-{spark.sparkContext.applicationId}"  # one machine only
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: its lineage ends at files that all executors share."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(Exception):
    """Another version was published since the one that this one is based on."""


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(file system, path) of the cluster's store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _text(spark: SparkSession, path: str, text: str) -> None:
    store, at = _files(spark, path)
    out = store.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with text, whole or not at all; False if it is there already. The file is written under
    another name first. A local or mounted file gets its name by a hard link, in other stores by a rename, which
    fails where the name is taken (HDFS; stores that rename by copying need a lock of their own)."""
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    store, at = _files(spark, path)
    store.mkdirs(at.getParent())
    _text(spark, fresh, text)
    source = _files(spark, fresh)[1]
    try:
        if store.getScheme() == "file":
            try:
                os.link(source.toUri().getPath(), at.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return bool(store.rename(source, at)) and not store.exists(source)
    finally:
        store.delete(source, False)


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """K1: published versions of a gallery and the folders of their rows."""
    store, at = _files(spark, f"{root}/versions")
    if not store.exists(at):
        return {}
    names = [f.getPath().getName() for f in store.listStatus(at)]
    out = {}
    for name in sorted(n for n in names if n.isdigit()):
        held = store.open(_files(spark, f"{root}/versions/{name}")[1])
        try:
            out[int(name)] = bytes(held.readAllBytes()).decode()
        finally:
            held.close()
    return out


def current_version(spark: SparkSession, root: str) -> int | None:
    """The published version of a gallery, null before the first."""
    return max(versions(spark, root), default=None)


def publish_gallery(gallery: DataFrame, root: str, based_on: int | None = None, keep: int | None = None) -> int:
    """K1: write the rows to a folder of their own, then claim the next version's file for it, so two publishers
    never share a version: the later one takes the number after. With based_on, the version that gallery was made
    from, a version published since raises Conflict (make the gallery anew from it). Earlier versions are the backup;
    with keep, all but so many are taken out, their files before their rows."""
    spark = gallery.sparkSession
    rows = f"{root}/rows/{uuid.uuid4().hex}"
    gallery.write.parquet(rows)
    while True:
        now = current_version(spark, root) or 0
        if based_on is not None and now != based_on:
            raise Conflict(f"version {now} of {root} was published after {based_on}")
        if claim(spark, f"{root}/versions/{now + 1:09d}", rows):
            break
    if keep is not None:
        retire(spark, root, keep)
    return now + 1


def retire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """K1: take out all versions but the last keep; readers of a version that goes have to read anew."""
    held = versions(spark, root)
    gone = sorted(held)[: max(0, len(held) - max(1, keep))]
    for version in gone:
        for path in (f"{root}/versions/{version:09d}", held[version]):
            store, at = _files(spark, path)
            store.delete(at, True)
    return gone


def read_gallery(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The version asked for, else the current one."""
    held = versions(spark, root)
    return spark.read.parquet(held[max(held) if version is None else version])


#: Folders of a table of groups: a movie's rows lie in that of its hash.
BUCKETS = 32


def upsert_groups(stats: DataFrame, path: str) -> None:
    """K2: replace the rows of the movies in stats; other movies' stay. Movies lie in folders by their hash, so there are
    as many folders and files however many movies there are; those that stats has movies of are written anew, each by
    a task, and take the place of the old ones when the job commits."""
    spark = stats.sparkSession
    fresh = staged(stats.withColumn("bucket", F.pmod(F.xxhash64("movie_id"), F.lit(BUCKETS)).cast("int")), "upsert")
    store, at = _files(spark, path)
    rows = fresh
    if store.exists(at):
        buckets = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS rows at most
        held = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(buckets))
        movies = fresh.select(F.col("movie_id").alias("_movie")).distinct()
        kept = held.join(movies, F.col("movie_id").eqNullSafe(F.col("_movie")), "left_anti")
        rows = staged(fresh.unionByName(kept), "upserted")  # a folder is not written while it is read
    rows.repartition(F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_groups(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """K2: all movies' rows."""
    return spark.read.schema(StructType([*schema, StructField("bucket", IntegerType())])).parquet(path).drop("bucket")


def kept_report(spark: SparkSession, root: str, parameters: dict[str, object], make: Callable[[], dict[str, DataFrame]], age_s: float = 3600.0, now: Callable[[], float] = time.time) -> tuple[dict[str, DataFrame], bool]:
    """K3: (an evaluation's tables by name, whether they were kept). They are kept for age_s under the parameters that
    make them (the gallery's version is one of them, so a new version makes them anew); make is only called if there
    are none, or if they are too old. A report counts once its last file, which names its folder and time, is there;
    of two that are made at once, the later one is read."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:32]
    place = f"{root}/report-{key}"
    last = max(versions(spark, place).items(), default=None)
    if last and now() - json.loads(last[1])["made"] < age_s:
        told = json.loads(last[1])
        return {name: spark.read.parquet(f"{told['rows']}/{name}") for name in told["tables"]}, True
    rows, tables = f"{place}/rows/{uuid.uuid4().hex}", make()
    for name, df in tables.items():
        df.write.parquet(f"{rows}/{name}")
    told = json.dumps({"made": now(), "rows": rows, "tables": sorted(tables), "parameters": parameters}, default=str)
    while not claim(spark, f"{place}/versions/{(current_version(spark, place) or 0) + 1:09d}", told):
        pass
    return {name: spark.read.schema(df.schema).parquet(f"{rows}/{name}") for name, df in tables.items()}, False


def forget_reports(spark: SparkSession, root: str, age_s: float = 3600.0, now: Callable[[], float] = time.time) -> int:
    """K3: take out the reports that are too old to be read; how many."""
    store, at = _files(spark, root)
    gone = 0
    for one in store.listStatus(at) if store.exists(at) else []:
        place = one.getPath().toString()
        for version, text in versions(spark, place).items():
            told = json.loads(text)
            if now() - told["made"] >= age_s:
                for path in (f"{place}/versions/{version:09d}", told["rows"]):
                    store, old = _files(spark, path)
                    store.delete(old, True)
                gone += 1
    return gone


def write_images(pictures: DataFrame, root: str) -> DataFrame:
    """PNG files of pictures (name, height, width, nChannels 1 or 3, data: BGR bytes) below root, written by tasks
    through the store's own file system under names that are final once whole; returns name and path. Pictures
    without pixels get no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        folder = f"{base}/part-{TaskContext.get().partitionId():05d}"
        store.create_dir(folder)
        number = 0
        for batch in batches:
            done = []
            for name, h, w, c, data in zip(*(batch.column(x).to_pylist() for x in ("name", "height", "width", "nChannels", "data")), strict=True):
                if not h or not w:
                    continue
                final = f"{folder}/{number:08d}-{urllib.parse.quote(name or '', safe='')[:150]}.png"
                number += 1
                fresh = f"{final}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(fresh) as out:
                    out.write(png(data, h, w, c))
                store.move(fresh, final)
                done.append((name, final))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["name", "path"])

    return staged(pictures.select("name", "height", "width", "nChannels", "data").mapInArrow(run, "name string, path string"), "written-images")


def png(data: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG of grey or BGR pixels."""
    x = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels)[:, :, ::-1].reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), x], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def pixels(data: bytes) -> tuple[int, int, int, bytes]:
    """height, width, channels, BGR bytes of a PNG as png makes them; one that is damaged or of another make is an error."""
    at, body = 8, {}
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body[kind] = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body[kind]):
            raise ValueError("a damaged picture")
        at += n + 12
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body[b"IHDR"])
    channels = 1 if colour == 0 else 3
    lines = np.frombuffer(zlib.decompress(body[b"IDAT"]), np.uint8).reshape(height, 1 + width * channels)
    if depth != 8 or colour not in (0, 2) or any(rest) or lines[:, 0].any():
        raise ValueError("a picture of another make")
    return height, width, channels, lines[:, 1:].reshape(height, width, channels)[:, :, ::-1].tobytes()


#: Rows of a table of files that a task reads.
FILES = 2_000


def read_written_images(written: DataFrame, root: str) -> DataFrame:
    """Spark's image struct of the files that write_images told of (name, path), with the name. Tasks take shares of
    that table and open the files themselves: no folder is listed, and a task reads as many files at any size. (Spark's
    image source, read_images, lists every file on the driver, gives a task 32, and makes an encoder for each.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), []
                for path in part.column("path").to_pylist():
                    with store.open_input_stream(path) as held:
                        height, width, channels, data = pixels(held.read())
                    rows.append({"origin": path, "height": height, "width": width, "nChannels": channels, "mode": 0 if channels == 1 else 16, "data": data})
                yield pa.RecordBatch.from_arrays([part.column("name"), pa.array(rows, kind)], ["name", "image"])

    kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
    spark = written.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-written.count() // FILES))
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    return written.repartition(parts).mapInArrow(run, f"name string, image {image}")


def progress_sink(path: str) -> Callable[[DataFrame, int], None]:
    """K4: a foreachBatch function that writes each batch's counts, sorted, with the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("session", "name").agg(F.count(F.lit(1)).alias("n")).orderBy("session", F.desc("n"), "name")
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
