"""BPE encoding by tree concatenation, and decoding.

A long text is cut into halves until the pieces (leaves) are short, at any place that no
composition of characters and no special token spans, in the middle of a word if need be. Leaves
are rows, so one long text is encoded by many tasks. Then neighbours are joined up the tree. Near
a join the halves' tokens may be wrong: a window around the join is encoded anew and grows until it
agrees with the left half on a token before the join and with the right half on a token after it.
The left half's tokens up to that agreement, the window's between and the right half's after it
are then the encoding of the whole: every two neighbouring tokens stand beside each other in a
valid encoding, and a BPE encoding is valid if each two neighbours are. A window that reaches an
end of the text needs no agreement there; one that reaches both is the text's own encoding.

Defined cases: null text is an empty one (no ids, decoded ''); repeated rows each give a row; an
empty table gives none; a text without a safe cut stays one leaf; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, shuffle_partitions, table, text_slices, tune
from .tokens import Encoder, encoder, vocabulary_path

#: Characters of a leaf at most, unless no safe place to cut lies within.
LEAF_CHARS = 16_384
#: Characters of the first window on each side of a join; it doubles.
WINDOW = 32


@dataclass
class Node:
    """Tokens of text[start:end] with their character spans in the whole text."""

    start: int
    end: int
    ids: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def clean(self) -> np.ndarray:
        """For each k, whether the tokens before k and from k on share no character: a boundary."""
        n = len(self.ids)
        before = np.concatenate([[self.start], np.maximum.accumulate(self.last)]) if n else np.array([self.start])
        after = np.concatenate([np.minimum.accumulate(self.first[::-1])[::-1], [self.end]]) if n else np.array([self.end])
        return before <= after


def safe(text: str, at: int, specials: list[str]) -> bool:
    """Whether text may be cut before at: the character there composes with none before it, and no
    special token's string spans the place."""
    if at <= 0 or at >= len(text):
        return True
    c = text[at]
    if c >= "̀" and (unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ"):
        return False
    return not any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in specials)


def leaf_cuts(text: str, specials: list[str], leaf: int = LEAF_CHARS) -> list[int]:
    """Where halving cuts: the middle of each piece longer than a leaf, or the first safe place after."""
    cuts: list[int] = []

    def halve(start: int, end: int) -> None:
        if end - start <= leaf:
            return
        at = (start + end) // 2
        while at < end and not safe(text, at, specials):
            at += 1
        if at < end:
            halve(start, at)
            cuts.append(at)
            halve(at, end)

    halve(0, len(text))
    return cuts


def encode_span(enc: Encoder, text: str, start: int, end: int) -> Node:
    e = enc.tok.encode(text[start:end], add_special_tokens=False)
    spans = np.array(e.offsets, np.int64).reshape(-1, 2) + start
    return Node(start, end, np.array(e.ids, np.uint32), spans[:, 0], spans[:, 1])


def pack_spans(first: np.ndarray, last: np.ndarray) -> bytes:
    """Character spans in a byte each where gaps and lengths are small, else as they are."""
    gap = first - np.concatenate([[0], last[:-1]]) + 1 if len(first) else first
    length = last - first
    if len(first) and min(gap.min(), length.min()) >= 0 and max(gap.max(), length.max()) < 16:
        return b"\1" + (gap * 16 + length).astype(np.uint8).tobytes()
    return b"\0" + np.stack([first, last]).astype("<i4").tobytes()


def unpack_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data[:1] == b"\0":
        first, last = np.frombuffer(data, "<i4", offset=1).reshape(2, -1).astype(np.int64)
        return first, last
    both = np.frombuffer(data, np.uint8, offset=1).astype(np.int64)
    gap, length = both // 16 - 1, both % 16
    last = np.cumsum(gap + length)
    return last - length, last


def join(enc: Encoder, text: str, left: Node, right: Node, window: int = WINDOW) -> Node:
    """The encoding of left's and right's characters together."""
    at, specials = left.end, enc.specials
    while True:
        a = max(left.start, at - window)
        while a > left.start and not safe(text, a, specials):
            a -= 1
        b = min(right.end, at + window)
        while b < right.end and not safe(text, b, specials):
            b += 1
        w = encode_span(enc, text, a, b)
        head = 0 if a == left.start else _agree(left, w, lambda p: p <= at, -1)
        tail = len(w.ids) if b == right.end else _agree(right, w, lambda p: p >= at, 0)
        if head is not None and tail is not None and (a == left.start or b == right.end or head <= tail):
            keep_l = 0 if a == left.start else _place(left, w, head, -1)
            keep_r = len(right.ids) if b == right.end else _place(right, w, tail, 0)
            pick = lambda k: np.concatenate([getattr(left, k)[:keep_l], getattr(w, k)[head:tail], getattr(right, k)[keep_r:]])
            return Node(left.start, right.end, pick("ids"), pick("first"), pick("last"))
        window *= 2


def _common(side: Node, w: Node) -> tuple[np.ndarray, np.ndarray]:
    """Indices of equal tokens (id and span) in side and in w."""
    lo, hi = np.searchsorted(side.first, w.start), np.searchsorted(side.first, w.end)
    key = lambda n, x, y: (n.first[x:y] << 40) ^ (n.last[x:y] << 18) ^ n.ids[x:y].astype(np.int64)
    _, i, j = np.intersect1d(key(side, lo, hi), key(w, 0, len(w.ids)), return_indices=True)
    same = (side.first[i + lo] == w.first[j]) & (side.last[i + lo] == w.last[j]) & (side.ids[i + lo] == w.ids[j])
    return i[same] + lo, j[same]


def _agree(side: Node, w: Node, within, step: int) -> int | None:
    """Where to change between side and w, as a token index of w: next to a token that both have on
    the far side of the change (step -1: before it, 0: after it), at a boundary of both."""
    i, j = _common(side, w)
    ks, kw = i - step, j - step  # step -1: the boundary follows the token; 0: it precedes it
    good = side.clean()[ks] & w.clean()[kw]
    edge = w.last[j] if step else w.first[j]
    good &= np.array([within(p) for p in edge], bool) if len(edge) else good
    if step == 0:
        good &= kw > 0
    chosen = kw[good]
    return None if not len(chosen) else int(chosen.max() if step else chosen.min())


def _place(side: Node, w: Node, k: int, step: int) -> int:
    i, j = _common(side, w)
    return int((i - step)[(j - step) == k][0])


def concatenate(enc: Encoder, text: str, leaves: list[Node], window: int = WINDOW) -> np.ndarray:
    """Join neighbours level by level."""
    while len(leaves) > 1:
        leaves = [join(enc, text, *leaves[k : k + 2], window) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0].ids if leaves else np.zeros(0, np.uint32)


def encode_documents(docs: DataFrame, tokenizer: str, leaf: int = LEAF_CHARS, window: int = WINDOW) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers), decoded (the library's decode of them) and
    leaves, for every whole text. Texts of one leaf are encoded where they are read; only longer ones
    are dealt out, a leaf a row, and met again by text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    long = F.length("text") > leaf

    def rows(enc: Encoder, ids_list: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, pa.Array]:
        ids, offsets = ids_list
        ids = ids.astype("<u4")
        decoded = [enc.decode(ids[x:y]) for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        return binaries(ids.view(np.uint8), offsets * 4), pa.array(decoded, pa.binary()).cast(pa.string())

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part, texts in text_slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), *rows(enc, enc.encode(texts)), pa.array(np.ones(len(texts), np.int32))], ["doc_id", "ids", "decoded", "leaves"])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = encoder(tokenizer).specials
        for batch in batches:
            for row in range(batch.num_rows):
                key, doc_id, t = (batch.column(k)[row].as_py() for k in range(3))
                ends = [0, *leaf_cuts(t, specials, leaf), len(t)]
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ends[:-1], pa.int64()), pa.array([t[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.string())], ["key", "doc_id", "leaf", "start", "piece"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for row in range(batch.num_rows):
                piece = batch.column(4)[row].as_py()
                n = encode_span(enc, piece, 0, len(piece))
                small = n.ids.astype("<u2" if len(enc.pieces) <= 1 << 16 else "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, 1) for k in range(5)), pa.array([small], pa.binary()), pa.array([pack_spans(n.first, n.last)], pa.binary())], ["key", "doc_id", "leaf", "start", "piece", "ids", "spans"])

    def tree(group: pa.Table) -> pa.Table:
        """One long text's leaves, joined."""
        enc = encoder(tokenizer)
        parts = sorted(group.to_pylist(), key=lambda r: r["leaf"])
        whole, nodes = "".join(p["piece"] for p in parts), []
        for p in parts:
            first, last = unpack_spans(p["spans"])
            own = np.frombuffer(p["ids"], "<u2" if len(enc.pieces) <= 1 << 16 else "<u4").astype(np.uint32)
            nodes.append(Node(p["start"], p["start"] + len(p["piece"]), own, first + p["start"], last + p["start"]))
        ids = concatenate(enc, whole, nodes, window)
        return pa.table([pa.array([parts[0]["doc_id"]], pa.int64()), *rows(enc, (ids, np.array([0, len(ids)]))), pa.array([len(parts)], pa.int32())], ["doc_id", "ids", "decoded", "leaves"])

    n = shuffle_partitions(docs.sparkSession)
    keyed = base.where(long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    dealt = keyed.mapInArrow(halves, "key long, doc_id long, leaf int, start long, piece string").repartition(n, "key", "leaf")
    dealt = dealt.mapInArrow(leaves, "key long, doc_id long, leaf int, start long, piece string, ids binary, spans binary")
    joined = dealt.groupBy("key").applyInArrow(tree, "doc_id long, ids binary, decoded string, leaves int")
    return base.where(~long).mapInArrow(short, "doc_id long, ids binary, decoded string, leaves int").unionByName(joined)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and decoded for a table of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [enc.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        "leaves",
        *more,
    )


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return digests(encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json")))
