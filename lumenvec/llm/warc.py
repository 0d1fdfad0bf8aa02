"""WARC archives with revisit records for repeated payloads.

Headers alone (page, url, digest, size) are shuffled by payload digest: a partial minimum per digest names
the response, and the headers of the other pages of that digest, joined to it, become revisits. The scan of
the payloads makes each page's response record, a gzip member of its own as the format advises; members of
pages that revisit are taken out by an anti-join on (page_id, digest), so no task meets all copies of a
payload and what moves is compressed. Revisit records name their response by WARC-Refers-To and keep no
payload; every archive begins with a warcinfo record, and all headers are written anew, dated by the run.
Reading parses members back, recomputes the digests of stored payloads, compares them with the headers, and
joins revisits to the responses that they refer to.

Defined cases: null html is an empty payload; null url gives an empty WARC-Target-URI; pages with a null
page_id are records of their own (never a response that others refer to; responses all if no page of that
payload has an id); rows that repeat the smallest page_id of a payload are responses, too, under one record
id; one page_id with several payloads is resolved for each payload; an empty table gives no archive and no
rows; other columns are ignored. A task writes under a name of its own and renames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, staged, table, tune

#: Payloads below this are stored each time: a revisit record would be as long.
LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, size (of the payload) and html of every page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    return named.select("page_id", "url", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").cast("long").alias("size"), "html")


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, digest, refers_to, refers_to_url of the pages whose payload a smaller page_id holds."""
    large = headers(pages).drop("html").where(F.col("size") >= least_bytes)
    own = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = large.groupBy("digest").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    # A table of its own, so that the join's sides are plain exchanges and a hot digest's rows can be split.
    first = staged(first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_url")), "responses")
    again = large.select("page_id", "url", "digest").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return again.select("page_id", "url", "digest", "refers_to", "refers_to_url")


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _uri(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(kind: str, page_id: int | None, url: str, digest: str, date: str, block: bytes, more: tuple[str, ...] = ()) -> bytes:
    """One response or revisit record, uncompressed."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    return "\r\n".join([*head, *more]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str, date: str) -> bytes:
    block = b"software: Spark job\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(pages: DataFrame, date: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """member: the gzip member of every page's record, response or revisit."""
    again = staged(revisits(pages, least_bytes), "revisits")

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, digests, htmls = (batch.column(k).to_pylist() for k in range(4))
            made = [member(record("response", i, u, d, date, HTTP + h.encode())) for i, u, d, h in zip(ids, urls, digests, htmls, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["page_id", "digest", "member"])

    def referring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                more = (f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(r['refers_to'], r['digest'])}", f"WARC-Refers-To-Target-URI: {_uri(r['refers_to_url'])}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {r['refers_to']}")
                made.append(member(record("revisit", r["page_id"], r["url"], r["digest"], date, HTTP, more)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    every = headers(pages).select("page_id", "url", "digest", "html").mapInArrow(responses, "page_id long, digest string, member binary")
    gone = again.select(F.col("page_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    kept = every.join(gone, F.col("page_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left_anti")
    return kept.select("member").union(again.mapInArrow(referring, "member binary"))


def write_archives(pages: DataFrame, root: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page below root; a row for each archive (path, records, bytes), a written table."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        ctx, number, out = TaskContext.get(), 0, None
        part, attempt = (ctx.partitionId(), ctx.taskAttemptId()) if ctx else (0, 0)
        done, size, count = [], 0, 0

        def close() -> None:
            out.close()
            store.move(own, f"{base}/{name}")
            done.append((f"{root}/{name}", count, size))

        for batch in batches:
            for data in batch.column(0).to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, own = f"pages-{part:05d}-{number:03d}.warc.gz", f"{base}/.part-{part:05d}-{number:03d}-{attempt}"
                    out, info = store.open_output_stream(own, compression=None), member(warcinfo(name, date))
                    out.write(info)
                    size, count, number = len(info), 0, number + 1
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return staged(records(pages, date, least_bytes).mapInArrow(run, "path string, records long, bytes long"), "archives")


def members(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other, a part of the file at a time."""
    z, out = zlib.decompressobj(31), []
    while data := stream.read(read_bytes):
        while data:
            out.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: block of another length than said")
    return fields, rest[:size]


def read_archives(archives: DataFrame) -> DataFrame:
    """Every response and revisit: page_id, url, record_type, refers_to, digest (as the header says), payload
    (null for revisits). Raises ValueError where a payload has another digest than its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], ["page_id", "url", "record_type", "refers_to", "digest", "payload"])

        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = pafs.FileSystem.from_uri(path)
                found, size = [], 0
                with store.open_input_stream(at, compression=None) as f:
                    for data in members(f):
                        fields, block = parse(data)
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        payload, digest = block.partition(b"\r\n\r\n")[2], fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "revisit":
                            payload = None
                        elif hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{fields['warc-record-id']}: the payload fails its digest")
                        found.append((number(fields.get("x-page-id")), fields["warc-target-uri"], fields["warc-type"], number(fields.get("x-refers-to-page-id")), digest, payload))
                        size += len(data)
                        if size >= 4 * READ_BYTES:
                            yield rows(found)
                            found, size = [], 0
                yield rows(found)

    n = shuffle_partitions(archives.sparkSession)
    return archives.select("path").repartition(n).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, digest string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take the size from the response
    that they refer to (null if the archives hold none such)."""
    told = staged(records.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest")), "records")
    response, revisit = told.where("record_type = 'response'"), told.where("record_type = 'revisit'").drop("payload_bytes")
    target = response.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    asked = revisit.select("refers_to", "payload_digest").distinct()
    target = staged(target.join(asked, ["refers_to", "payload_digest"], "left_semi").distinct(), "targets")
    back = revisit.join(target, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select(columns).unionByName(back.select(columns))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    archives = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return resolved(read_archives(archives))


OP5_SQL = """
with p as (
  select page_id, coalesce(html, '') as h from pages
), d as (
  select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p
), f as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from d
)
select page_id, payload_bytes, payload_digest,
  case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id is null or first_id = page_id then null else first_id end as refers_to
from f
"""
