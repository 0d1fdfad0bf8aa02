"""Benchmark decontamination on a distributed positional inverted index.

The index is cut by documents: a segment is the documents of one batch of one task, their words one
after the other. It holds every term of the corpus: its rows are (segment, term, count, positions), the
positions as gaps in bytes of seven bits, so that a very common term has one row a segment and no list
that grows with the corpus; beside them lies a row for each document (its place in the segment and its
words). Both are written tables, and serve any benchmark.

Queries are windows: runs of a benchmark item's words. Each is looked up from its rarest terms: the
counts of the benchmark's terms over the whole index give an order, windows with an absent term go,
the others join the segments that hold their rarest term, and within a segment the position lists,
shifted by the terms' offsets, are intersected from the rarest to the commonest. A surviving start is
an exact phrase match. A proximity match is a place from which all of a window's terms stand within SPAN
times its length of words, in any order, in one document; both come from the same lists in one pass.

Words: A-Z lower-cased, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].

Windows that the same items hold share a name (set), which is what segments give back; items are joined
to it afterwards, so a window that all items share is no list in each segment.

Defined cases: null or empty texts, and texts without words, have no words and no hits; an item with
fewer words than a window, but not none, is one window; repeated documents are rows of their own,
repeated items count by item_id once (null item_ids are left out); empty tables give no rows (an empty
benchmark: no hits); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, binaries, buffers, ragged, staged, table, text_slices, tune, words

#: Bytes of text in a segment, about; one long document may exceed it.
SEGMENT_BYTES = 4 << 20
WINDOW = 10
#: Words of a proximity match, in lengths of its window.
SPAN = 2
#: Places left free after each document, so that no span reaches into the next.
GAP = 256


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, seven bits each and the lowest first, and how many bytes each takes."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 6))
    at, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        live = size > k
        out[at[live] + k] = ((values[live] >> 7 * k) & 127) | ((size[live] > k + 1).astype(np.int64) << 7)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.concatenate([first, [len(data)]])))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(postings: segment, term, count, positions; documents: segment, doc, doc_id, start, n_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        segment = (ctx.partitionId() if ctx else 0) << 32
        for batch in batches:
            for part, texts in text_slices(batch, "text", segment_bytes):
                index, ends, dictionary = words(texts, ALNUM)
                n, m = len(texts), len(dictionary)
                start = ends[:-1] + np.arange(n) * GAP
                place = ragged(start, np.diff(ends))[np.argsort(index, kind="stable")]  # by term, ascending in each
                count = np.bincount(index, minlength=m)
                first = np.cumsum(count) - count
                gaps = np.diff(place, prepend=0)
                gaps[first] = place[first]
                data, size = pack(gaps)
                offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([first, [len(gaps)]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, segment)), pa.array(["doc"] * n), pa.array(np.arange(n, dtype=np.int32)), part.column(0), pa.array(start), pa.array(np.diff(ends)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names,
                )
                for at in range(0, m, 20_000):
                    k = min(20_000, m - at)
                    lists = binaries(data[offsets[at] : offsets[at + k]], offsets[at : at + k + 1] - offsets[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, segment)), pa.array(["term"] * k), pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.int64())] * 3, dictionary.slice(at, k), pa.array(count[at : at + k].astype(np.int32)), lists],
                        names,
                    )
                segment += 1

    names = ["segment", "kind", "doc", "doc_id", "start", "n_words", "term", "count", "positions"]
    schema = "segment long, kind string, doc int, doc_id long, start long, n_words long, term string, count int, positions binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    index = staged(rows, "index", partition_by="kind")
    return index.where("kind = 'term'").select("segment", "term", "count", "positions"), index.where("kind = 'doc'").select("segment", "doc", "doc_id", "start", "n_words")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, terms: each item's runs of size words (shorter items: all their words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                index, ends, dictionary = words(texts, ALNUM)
                count = np.diff(ends)
                windows = np.where(count == 0, 0, np.maximum(1, count - size + 1))
                starts = ragged(ends[:-1], windows)
                length = np.repeat(np.minimum(count, size), windows)
                flat = dictionary.take(pa.array(index[ragged(starts, length)]))
                terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(count)), windows))), terms], ["item_id", "terms"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, terms array<string>").distinct()


def plans(postings: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrase, set, plan: each window's terms with offsets, the rarest in the corpus first; set, item_id: whose
    windows they are). Windows with a term that does not occur are left out."""
    named = windows.select("item_id", F.concat_ws(" ", "terms").alias("phrase"), "terms")
    whose = named.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "item_id")).alias(f"x{k}") for k in (0, 1)))
    whose = staged(whose.select("phrase", F.concat_ws(":", "n", "x0", "x1").alias("set")), "sets")
    members = named.select("phrase", "item_id").join(whose, "phrase").select("set", "item_id").distinct()
    vocabulary = staged(windows.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = staged(postings.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("count").alias("count")), "counts")
    placed = named.select("phrase", "terms").distinct().select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    planned = placed.groupBy("phrase", "length").agg(F.sort_array(F.collect_list(F.struct("count", "term", "offset"))).alias("plan")).where(F.size("plan") == F.col("length"))
    return staged(planned.join(whose, "phrase").select("phrase", "set", "plan"), "plans"), members


def matches(postings: DataFrame, planned: DataFrame, span: int | None = SPAN) -> DataFrame:
    """segment, set, length, starts (where a window's words stand one after the other), near (where its terms
    begin to stand within span lengths; null without span). The segments that hold a window's rarest term meet
    their own lists, once; a list is not copied for each window."""
    vocabulary = staged(planned.select(F.explode("plan.term").alias("term")).distinct(), "vocabulary")
    lists = postings.join(vocabulary, "term", "left_semi")
    by_rarest = planned.select("phrase", "set", F.col("plan.offset").alias("order"), F.col("plan")[0]["term"].alias("term"))
    candidates = postings.select("segment", "term").join(by_rarest, "term").select("segment", "phrase", "set", "order")

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        segment = asked.column("segment")[0].as_py() if asked.num_rows else 0
        of = _lists_of(held)
        out: list[tuple] = []
        for phrase, name, order in zip(*(asked.column(c).to_pylist() for c in ("phrase", "set", "order")), strict=True):
            terms = phrase.split(" ")
            ranked = [of.get(terms[o]) for o in order]
            if any(one is None for one in ranked):
                continue
            width = None if span is None else span * len(terms)
            if width is not None and width > GAP:
                raise ValueError(f"a span of {width} words is longer than the {GAP} places between documents")
            around = ranked[0] if width is None else _around(ranked, width)
            starts = around - order[0]
            for o, one in zip(order[1:], ranked[1:], strict=True):
                if not len(starts):
                    break
                at = np.searchsorted(one, starts + o)
                starts = starts[one[np.minimum(at, len(one) - 1)] == starts + o]
            near = None if width is None else _begins(ranked, around, width)
            if len(starts) or (near is not None and len(near)):
                out.append((segment, name, len(terms), starts, near))
        types = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["segment", "set", "length", "starts", "near"])

    return _together(lists, candidates).applyInArrow(run, "segment long, set string, length int, starts array<long>, near array<long>")


def _around(ranked: list[np.ndarray], width: int) -> np.ndarray:
    """Places of the rarest term that have every other term closer than width on some side."""
    at = ranked[0]
    for one in ranked[1:]:
        if not len(at):
            break
        k = np.searchsorted(one, at - width, side="right")
        at = at[(k < len(one)) & (one[np.minimum(k, len(one) - 1)] < at + width)]
    return at


def _begins(ranked: list[np.ndarray], around: np.ndarray, width: int) -> np.ndarray:
    """Places of terms, less than width before one of around, from which all terms stand within width."""
    if not len(around):
        return around
    spans = []
    for one in ranked:
        low = np.searchsorted(one, around - width, side="right")
        spans.append(one[ragged(low, np.searchsorted(one, around, side="right") - low)])
    begins = np.unique(np.concatenate(spans))
    last = begins.copy()
    for one in ranked:
        k = np.searchsorted(one, begins)
        last = np.maximum(last, np.where(k < len(one), one[np.minimum(k, len(one) - 1)], np.iinfo(np.int64).max))
    return begins[last - begins < width]


def _together(left: DataFrame, right: DataFrame):
    """Rows of both by segment; columns are named anew, as both may come from one index."""
    return left.groupBy("segment").cogroup(right.select(*(F.col(c).alias(c) for c in right.columns)).groupBy("segment"))


def _lists_of(held: pa.Table) -> dict[str, np.ndarray]:
    """Positions by term of one segment's rows."""
    out: dict[str, np.ndarray] = {}
    for batch in held.to_batches():
        if batch.num_rows:
            data, _ = buffers(batch.column(batch.schema.names.index("positions")))
            ends = np.cumsum(batch.column(batch.schema.names.index("count")).to_numpy())
            places = np.cumsum(unpack(data))  # runs on over the lists, each of which begins anew
            for term, x, y in zip(batch.column(batch.schema.names.index("term")).to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                out[term] = places[x:y] - (places[x - 1] if x else 0)
    return out


def document_hits(documents: DataFrame, found: DataFrame) -> DataFrame:
    """segment, doc, doc_id, n_words, n_hit (words inside any exact match), n_near (windows with a proximity
    match), sets (of the exact matches), for every document."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = docs.sort_by("doc")
        start, count = (docs.column(c).to_numpy().astype(np.int64) for c in ("start", "n_words"))
        if not len(start):
            return empty
        doc_of = lambda at: np.unique(np.searchsorted(start, at, side="right") - 1)
        edge, sets, near = np.zeros(int(start[-1] + count[-1]) + 2, np.int64), [set() for _ in range(len(start))], np.zeros(len(start), np.int64)
        for row in found.to_pylist():
            at = np.array(row["starts"], np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + row["length"], -1)
            for d in doc_of(at).tolist():
                sets[d].add(row["set"])
            if row["near"]:
                near[doc_of(np.array(row["near"], np.int64))] += 1
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        return pa.table([*(docs.column(c) for c in names[:4]), pa.array(hit[start + count] - hit[start]), pa.array(near), pa.array([sorted(x) for x in sets], pa.list_(pa.string()))], names)

    names = ["segment", "doc", "doc_id", "n_words", "n_hit", "n_near", "sets"]
    empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.string()))], names)
    return _together(documents, found).applyInArrow(run, "segment long, doc int, doc_id long, n_words long, n_hit long, n_near long, sets array<string>")


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, span: int | None = SPAN) -> tuple[DataFrame, DataFrame]:
    """(document_hits of docs against every window of benchmark; the windows' sets and items)."""
    windows = staged(windows_of(benchmark, size), "windows")
    postings, documents = build_index(docs)
    planned, members = plans(postings, windows)
    return document_hits(documents, matches(postings, planned, span)), members


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, span: int | None = SPAN) -> DataFrame:
    """doc_id, n_words, n_hit, n_near, item_ids (those with an exact match, ascending) of every document."""
    hits, members = search(docs, benchmark, size, span)
    hits = staged(hits, "hits")
    items = hits.select("segment", "doc", F.explode("sets").alias("set")).join(members, "set").groupBy("segment", "doc").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return hits.join(items, ["segment", "doc"], "left").select("doc_id", "n_words", "n_hit", "n_near", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs, with all their columns, without those that hold a window. A verdict depends on the text
    alone, so rows are told apart by a hash of doc_id and text."""
    key, name = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))), f"hit_{uuid.uuid4().hex}"
    hits, _ = search(docs.select(key.alias("doc_id"), "text"), benchmark, size, span=None)
    hit = hits.where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, key == F.col(name), "left_anti")


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    hits = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.concat_ws(",", F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


OP7_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null
), x as (
  select distinct item_id, list_slice(w, i, i + 9) as g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
), n as (
  select distinct len(g) as n from x
), p as (
  select rid, i, n, list_slice(w, i, i + n - 1) as g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, n where len(w) >= n)
), m as (
  select p.rid, p.i, p.n, x.item_id from p join x using (g)
), h as (
  select rid, count(distinct place) as n_hit from (select rid, unnest(range(i, i + n)) as place from m) group by 1
), t as (
  select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(item_id::varchar))), ',') as items from m group by 1
), dw as (
  select rid, w[i] as term, i from (select rid, w, unnest(range(1, len(w) + 1)) as i from d)
), tc as (
  select term, count(*) as c from dw group by 1
), gt as (
  select g, unnest(list_distinct(g)) as term from (select distinct g from x)
), pv as (
  select g, arg_min(term, c) as term from gt join tc using (term) group by g having count(*) = len(list_distinct(g))
), sp as (
  select distinct dw.rid, g, unnest(range(greatest(1, i - 2 * len(g) + 1), i + 1)) as b from pv join dw using (term)
), nr as (
  select rid, count(distinct g) as n_near from sp join d using (rid) where list_has_all(list_slice(w, b, b + 2 * len(g) - 1), g) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join h using (rid) left join t using (rid) left join nr using (rid)
"""
