"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows, empty tables
and extra columns."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenvec.llm import decontaminate, flac, licenses, near_dup, quality, records, tree_bpe
from lumenvec.llm.common import shared_dir, table
from lumenvec.llm.crc import CRC8, CRC16, CRC32C
from lumenvec.llm.tokens import encoder, vocabulary_path

ROOT = Path(__file__).resolve().parent.parent.parent
VOCABULARY = vocabulary_path("word_bpe_49k.json")
ODD = ["", None, " \n\t ", "a", "Ünïcode ÉCOLE naïve 中文字 😀 e\u0301", "x" * 40_000, "word " * 9_000, "a<|endoftext|>b", "same text here", "same text here", "\x00\x01 control \x85\xa0", "MIT license 'll we've"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """doc_id is null once and repeated once; further columns clash with names used inside."""
    rows = [(i if i != 3 else None, t, "x", 1, "c") for i, t in enumerate(ODD)] + [(5, ODD[5], "x", 1, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, rep long, component string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- tokens


def test_encoder_is_the_library():
    e, r = encoder(VOCABULARY), random.Random(2)
    alphabet = [chr(i) for i in range(256)] + list("'strevemdl") * 6 + list("éΣσς中文😀 \u0301\u00ad") * 3
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(4000)] + [a + b for a in map(chr, range(256)) for b in "a'! 9\xe9²"] + [t or "" for t in ODD]
    ids, at = e.encode(pa.array(texts))
    assert [ids[x:y].tolist() for x, y in itertools.pairwise(at)] == e.whole(texts)


def test_small_cache_changes_nothing(monkeypatch):
    from lumenvec.llm import tokens

    monkeypatch.setattr(tokens, "KEEP", 3)
    e = tokens.Encoder(VOCABULARY)
    texts = ["one two three four", "five six one", "two 中 two"]
    ids, at = e.encode(pa.array(texts))
    assert [ids[x:y].tolist() for x, y in itertools.pairwise(at)] == e.whole(texts)


def test_tree_joins_are_exact():
    e, r, bad = encoder(VOCABULARY), random.Random(5), []
    pools = ["abcdefghij", "the ", "aeiou", "a!'", "'s tre", "é´ẹ́x", "中文字", "0123 a", "😀🎉x", "<|endoftext|>ab"]
    for _ in range(500):
        pool = r.choice(pools)
        t = "".join(r.choice(pool) for _ in range(r.randint(1, 300)))
        cuts = [0, *tree_bpe.leaf_cuts(t, e.specials, r.choice([3, 7, 20, 50])), len(t)]
        leaves = [tree_bpe.encode_span(e, t, x, y) for x, y in itertools.pairwise(cuts)]
        if tree_bpe.concatenate(e, t, leaves, r.choice([1, 4, 16])).tolist() != e._whole(t):
            bad.append(t)
    assert not bad


def test_spans_pack():
    for first, last in (([0, 3, 3, 9], [3, 4, 4, 12]), ([0, 50], [40, 60]), ([], [])):
        a, b = tree_bpe.unpack_spans(tree_bpe.pack_spans(np.array(first, np.int64), np.array(last, np.int64)))
        assert a.tolist() == first and b.tolist() == last


def test_op3_rows(odd, none):
    e = encoder(VOCABULARY)
    got = tree_bpe.digests(tree_bpe.encode_documents(odd, VOCABULARY, leaf=1000)).collect()
    want = sorted((str(i), len(ids := e._whole(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(e.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, t in texts_of(odd))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert max(r.leaves for r in got) > 30
    assert tree_bpe.encode_documents(none, VOCABULARY).count() == 0


def test_op3_decodes(odd):
    encoded = tree_bpe.encode_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), VOCABULARY).persist()
    again = tree_bpe.decode_documents(encoded, VOCABULARY).withColumnRenamed("decoded", "d")
    assert encoded.join(again, "doc_id").where("d <> decoded").count() == 0


def test_op8_records(spark, odd, none):
    e = encoder(VOCABULARY)
    shards = records.write_records(odd, shared_dir(spark, "rec"), VOCABULARY)
    got = records.read_records(shards).orderBy("start").collect()
    want = sorted(((-1 if i is None else i, np.array([*e._whole(t), 1], "<u4").tobytes()) for i, t in texts_of(odd)), key=lambda x: x[0])
    assert [(-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *(len(w) // 4 for _, w in want)])[:-1].tolist()
    assert records.read_records(records.write_records(none, shared_dir(spark, "rec"), VOCABULARY)).count() == 0


def test_op8_shuffled_reads_and_files(spark, odd):
    """Files are cut by bytes, also among rows of one doc_id; any order reads the same records."""
    many = odd.unionByName(spark.createDataFrame([(5, "one of many rows " * (k % 4 + 1), "x", 1, "c") for k in range(40)], odd.schema))
    files = records.write_records(many, shared_dir(spark, "rec"), VOCABULARY, file_bytes=400)
    told = files.collect()
    assert max(f.piece for f in told) > 3 and len(told) == files.count()
    row = lambda r: (r.start, r.shard, r.piece, r.record, str(r.doc_id), r.n_tokens, bytes(r.ids))
    whole = sorted(row(r) for r in records.read_records(files).collect())
    assert [w[0] for w in whole] == np.cumsum([0, *(w[5] for w in whole)])[:-1].tolist() and len(whole) == many.count()
    orders = [[row(r) for r in records.read_shuffled(files, seed).collect()] for seed in (1, 2)]
    assert sorted(orders[0]) == sorted(orders[1]) == whole and orders[0] != orders[1] and orders[0] != whole
    assert records.read_shuffled(records.write_records(odd.limit(0), shared_dir(spark, "rec"), VOCABULARY)).count() == 0


def test_op8_finds_damage(spark, odd):
    from urllib.parse import urlparse

    shards = records.write_records(odd, shared_dir(spark, "rec"), VOCABULARY)
    path = urlparse(max(shards.collect(), key=lambda r: r.bytes).path).path + ".rec"
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(path, "wb").write(raw)
    for read in (records.read_records, records.read_shuffled):
        with pytest.raises(Exception, match="damaged"):
            read(shards).count()


def test_checksums():
    data = np.frombuffer(b"123456789", np.uint8)
    one = lambda c: int(c.many(data, np.array([0]), np.array([9]))[0])
    assert (one(CRC32C), one(CRC16), one(CRC8)) == (0xE3069283, 0xFEE8, 0xF4)
    r = np.random.RandomState(0)
    x, size = r.randint(0, 256, 9000).astype(np.uint8), np.array([0, 1, 255, 256, 257, 3000])
    at = np.cumsum(size) - size
    for n, a, got in zip(size, at, CRC32C.many(x, at, size), strict=True):
        c = 0xFFFFFFFF
        for b in x[a : a + n].tolist():
            c = (c >> 8) ^ int(CRC32C.one[(c ^ b) & 255])
        assert int(got) == c ^ 0xFFFFFFFF


# ---- FLAC


class Writer:
    """Bits of a frame, one field after the other."""

    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += f"{v & ((1 << n) - 1):0{n}b}" if n else ""

    def rice(self, v, k):
        u = 2 * v if v >= 0 else -2 * v - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)


def frame(samples, kind, number=0, order=0, coef=(), shift=0, method=0, partition=0, escape=(), wasted=0, variable=False):
    """A frame by the format's text, a sample at a time."""
    w, n = Writer(), len(samples)
    for v, b in ((0x7FFC, 15), (int(variable), 1), (7, 4), (0, 4), (0, 4), (1, 3), (0, 1), (number, 8), (n - 1, 16)):
        w.put(v, b)
    head = bytes(int(w.bits[i : i + 8], 2) for i in range(0, len(w.bits), 8))
    w.put(int(CRC8.many(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]))[0]), 8)
    w.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind], 7)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.put(1, wasted)
    x, deep = [s >> wasted for s in samples], 8 - wasted
    if kind == "constant":
        w.put(x[0], deep)
    elif kind == "verbatim":
        for s in x:
            w.put(s, deep)
    else:
        for s in x[:order]:
            w.put(s, deep)
        if kind == "lpc":
            w.put(11, 4)
            w.put(shift, 5)
            for c in coef:
                w.put(c, 12)
            res = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coef)) >> shift) for i in range(order, n)]
        else:
            res = np.diff(np.array(x), n=order).tolist()
        w.put(method, 2)
        w.put(partition, 4)
        four, at = 5 if method else 4, 0
        for p in range(1 << partition):
            size = (n >> partition) - (order if p == 0 else 0)
            part, at = res[at : at + size], at + size
            if p in escape:
                w.put((1 << four) - 1, four)
                w.put(12, 5)
                for v in part:
                    w.put(v, 12)
            else:
                k = p % 5
                w.put(k, four)
                for v in part:
                    w.rice(v, k)
    w.bits += "0" * (-len(w.bits) % 8)
    raw = bytes(int(w.bits[i : i + 8], 2) for i in range(0, len(w.bits), 8))
    return raw + int(CRC16.many(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")


def test_flac_decodes_what_the_format_allows():
    r = np.random.RandomState(1)
    x = np.clip(np.cumsum(r.randint(-3, 4, 64)), -100, 100).tolist()
    frames = [
        frame([7] * 64, "constant"), frame(x, "verbatim"), *(frame(x, "fixed", order=o) for o in range(5)), frame(x, "fixed", order=2, partition=3, method=1),
        frame(x, "fixed", order=1, partition=2, escape=(1, 3)), frame(x, "lpc", order=2, coef=(1800, -800), shift=10, partition=1), frame(x, "lpc", order=9, coef=(3, -2, 1, 0, 1, -1, 2, 0, 5), shift=3),
        frame([4 * s for s in (1, -2, 3, 5) * 8], "fixed", order=1, wasted=2), frame([9, -9, 100, -128] * 4, "fixed", order=4, partition=2), frame(x, "verbatim", number=5, variable=True),
    ]
    want = [[7] * 64, x, *[x] * 5, x, x, x, x, [4 * s for s in (1, -2, 3, 5) * 8], [9, -9, 100, -128] * 4, x]
    at = np.cumsum([0, *map(len, frames)])
    got, size, _, end = flac.decode_frames(np.frombuffer(b"".join(frames), np.uint8), at[:-1])
    assert [g[:n].tolist() for g, n in zip(got, size, strict=True)] == want and end.tolist() == at[1:].tolist()


def test_flac_checks_and_serial_reading():
    r = np.random.RandomState(3)
    pay = [b"\0" * 64, b"hello world " * 400, r.randint(0, 256, 5000).astype(np.uint8).tobytes(), (128 + 100 * np.sin(np.arange(9000) / 9)).astype(np.uint8).tobytes(), b"a" * 3000]
    streams = flac.encode_streams(np.frombuffer(b"".join(pay), np.uint8), np.cumsum([0, *map(len, pay)]))
    assert flac.decode_streams(streams)[0] == pay and len(streams[3]) < 0.5 * len(pay[3])
    alone = flac.encode_streams(np.frombuffer(pay[3], np.uint8), np.array([0, len(pay[3])]))
    assert alone == [streams[3]]
    bare = [s[:4] + b"\x80" + s[5:42] + s[flac._open(s)[0] :] for s in streams]  # without seek points
    assert flac.decode_streams(bare)[0] == pay
    for at in (60, len(streams[1]) - 9, 30):
        broken = bytearray(streams[1])
        broken[at if at != 60 else flac._open(streams[1])[0] + 2] ^= 4
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(broken)])


def test_op1_rows(odd, none):
    media = flac.encode_column(odd)
    got = flac.decode_column(media).collect()
    for r, t in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(texts_of(odd), key=lambda x: (str(x[0]), len(x[1].encode()))), strict=True):
        raw = t[1].encode()
        assert bytes(r.payload) == raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw)) and r.n_bytes == len(raw)
    last = [r for r in got if r.doc_id == 6][0]
    assert [b.first_sample for b in last.blocks] == list(range(0, len(last.payload), flac.BLOCK)) and sum(b.n_samples for b in last.blocks) == len(last.payload)
    assert flac.decode_column(flac.encode_column(none)).count() == 0


def test_op1_blocks_are_seekable(spark, odd, tmp_path):
    media = flac.encode_column(odd.where("doc_id in (4, 6)"))
    blocks = flac.write_blocks(flac.decode_column(media), f"{tmp_path}/blocks")
    raw = {i: t.encode() for i, t in texts_of(odd) if i in (4, 6)}
    assert blocks.where("doc_id = 6").count() == -(-45_056 // flac.BLOCK)
    for first, n in ((0, 5), (2000, 100), (40_000, 9000), (flac.BLOCK, flac.BLOCK)):
        got = flac.read_samples(blocks, first, n).where("doc_id = 6").orderBy("first_sample").collect()
        assert b"".join(bytes(r.pcm) for r in got) == (raw[6] + b"\0" * 56)[first : first + n]
        stream = bytes(media.where("doc_id = 6").first().flac)
        assert flac.samples_at(stream, first, n) == (raw[6] + b"\0" * 56)[first : first + n]


def test_op1_long_texts_take_bounded_memory():
    """One text of 12 MB, both ways, in a process of its own."""
    code = """
import resource, numpy as np
from lumenvec.llm import flac
def peak(): return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
words = np.random.RandomState(0).randint(97, 110, 3 << 20).astype(np.uint8)
x, small = np.tile(words, 4), words[: 1 << 16]
flac.decode_streams(flac.encode_streams(small, np.array([0, len(small)])))
before = peak()
s = flac.encode_streams(x, np.array([0, len(x)]))
assert flac.decode_streams(s)[0] == [x.tobytes()]
print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert int(out.stdout) < 700, out.stderr


# ---- near-duplicates


def components(docs, size, percent):
    sets, root = {}, {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def mutated(n, seed=4):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [r.choice(vocabulary) for _ in range(90)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return out + [" ".join(r.choice(vocabulary) for _ in range(80)) for _ in range(20)] + ["a b", "A B", "a b c", "", "x"]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_op4_against_all_pairs(spark, monkeypatch, size, percent):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "TILE", 10)
    docs = list(enumerate(mutated(150)))
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(docs, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op4_odd_rows(odd, none):
    got = near_dup.near_duplicates(odd, 3, 85).collect()
    assert len(got) == len(ODD) + 1
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[(9, 1)].component_id == 8 and not by[(9, 1)].kept and by[(0, 0)].kept and by[(2, 0)].component_id == 2
    assert [r for r in got if r.doc_id is None][0].component_id is None
    kept = near_dup.one_of_each(odd, 3, 85)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [0, 1, 2, None, 4, 5, 5, 6, 7, 8, 10, 11])
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.one_of_each(none).count() == 0


def test_odd_sketches_estimate():
    r = np.random.RandomState(0)
    n, error = near_dup.ROWS * near_dup.BANDS, []
    for shared in (950, 850, 700):
        a = np.unique(r.randint(0, 2**63, 1000).astype(np.uint64))
        other = np.concatenate([a[:shared], r.randint(0, 2**63, 1000 - shared).astype(np.uint64)])
        s = near_dup.odd_sketches(near_dup.minima([a, other], n)).view(np.uint64)
        error.append(near_dup.estimated(np.bitwise_count(s[0] ^ s[1]).sum(), n) - shared / (2000 - shared))
    assert max(map(abs, error)) < near_dup.MARGIN


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in near_dup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert near_dup.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- decontamination


def hits(docs, items, size, span=2):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - size + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w = word(t)
        mark, found, near = [0] * len(w), set(), 0
        for win, ids in windows.items():
            near += any(set(win) <= set(w[k : k + span * len(win)]) for k in range(len(w)))
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    found |= ids
                    mark[k : k + len(win)] = [1] * len(win)
        out.append((str(i), len(w), sum(mark), near, sorted(found)))
    return sorted(out)


def test_op7_against_all_windows(spark, odd):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 60)))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD[:5] + ODD[7:])]
    items = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 9)))) for i in range(15)] + [(50, None), (51, "..."), (52, "Same, TEXT here"), (53, "a b a"), (53, "b b"), (54, "a b a"), (55, "absent word"), (56, docs[5][1]), (57, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("segment", F.lit(1)).withColumn("set", F.lit("x"))
    got = decontaminate.decontaminate(d, b, 5).collect()
    want = hits(docs, items, 5)
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_near, x.item_ids) for x in got) == want and any(h[3] > len(h[4]) for h in want)
    clean = decontaminate.clean_documents(d, b, 5)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(int(x[0]) for x in want if not x[2])
    assert decontaminate.decontaminate(d, b.limit(0)).where("n_hit > 0 or n_near > 0 or size(item_ids) > 0").count() == 0
    assert decontaminate.decontaminate(odd.limit(0), b).count() == 0
    assert decontaminate.clean_documents(odd, b.limit(0)).columns == odd.columns


def test_op7_long_texts_and_segments(spark, monkeypatch):
    """Documents over many segments, one longer than a segment, and a window that all items share."""
    monkeypatch.setattr(decontaminate.build_index, "__defaults__", (300,))
    shared = "these ten words stand in each of the items here"
    items = [(i, f"item {i} begins {shared} and ends") for i in range(30)]
    docs = [(i, "filler text " * (i % 7)) for i in range(40)] + [(90, "word " * 5000 + shared + " tail " * 5000), (91, shared), (92, shared.replace("stand", "now stand")), (93, items[7][1].upper())]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_near, x.item_ids) for x in got) == hits(docs, items, 10)
    by = {x.doc_id: x for x in got}
    assert by[90].item_ids == list(range(30)) and by[92].n_hit == 0 and by[92].n_near == 1 and by[93].n_hit == 15


def test_op7_index_holds_every_term(spark):
    d = spark.createDataFrame([(1, "x one y one z"), (2, "one"), (None, None)], "doc_id long, text string")
    postings, documents = decontaminate.build_index(d.coalesce(1))
    assert {r.term: r["count"] for r in postings.groupBy("term").agg(F.sum("count").alias("count")).collect()} == {"x": 1, "one": 3, "y": 1, "z": 1}
    assert sorted(str(r.doc_id) for r in documents.collect()) == ["1", "2", "None"]
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, 1 << 28, 1 << 36, 5])
    assert decontaminate.unpack(decontaminate.pack(values)[0]).tolist() == values.tolist() and decontaminate.unpack(np.zeros(0, np.uint8)).tolist() == []


# ---- quality


def test_op2_held_out(spark, sf):
    docs, labels = table(spark, sf.replace("0.001", "0.01"), "documents"), table(spark, sf.replace("0.001", "0.01"), "labels")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, turned)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.score, again.score)


def test_op2_odd_rows(spark, sf, odd, none):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score(none, model).count() == 0 and quality.accepted(odd, model).columns == odd.columns
    for few, mean in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0)):
        one = quality.fit(docs, few)
        assert {r.score for r in quality.score(odd, one).collect()} == {mean}
    assert quality.fit(none, labels).score.tolist() == [0.5]


def test_op2_against_dense_algebra(spark, sf):
    """Weights and scores by plain formulas over all training rows at once, and how well held-out rows rank."""
    docs, labels = (table(spark, sf.replace("0.001", "0.01"), t).toPandas() for t in ("documents", "labels"))
    both = docs.merge(labels, on="doc_id").sort_values("doc_id")
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in both["doc_id"]])
    x, y = quality.statistics(pa.array(both["text"].fillna(""))), both["quality"].to_numpy(float)
    train = fold != 0
    mean, std = x[train].mean(axis=0), x[train].std(axis=0)
    model = quality.fit(table(spark, sf.replace("0.001", "0.01"), "documents"), table(spark, sf.replace("0.001", "0.01"), "labels"))
    z = np.clip((x - mean) / np.where(std > 1e-9, std, 1), -8, 8)
    phi = np.hstack([np.ones((len(z), 1)), np.sqrt(2 / quality.DIMENSIONS) * np.cos(z @ model.w + model.b)])
    of = fold > 1
    ridge = quality.RIDGE * of.sum() / quality.DIMENSIONS
    w = np.linalg.solve(phi[of].T @ phi[of] + ridge * np.eye(phi.shape[1]), phi[of].T @ y[of])
    assert np.allclose(phi @ w, model.raw_scores(x), atol=1e-6)
    kernel = np.exp(-((z[:40, None] - z[None, :40]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(phi[:40, 1:] @ phi[:40, 1:].T - kernel).mean() < 0.1
    held = fold == 0
    s = model.scores(x)[held]
    wins = (s[y[held] == 1][:, None] > s[y[held] == 0][None, :]).mean() + 0.5 * (s[y[held] == 1][:, None] == s[y[held] == 0][None, :]).mean()
    assert wins > 0.95


def test_op2_training_rows_are_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)] + [(7, 1), (None, 1), (9000, None)], "doc_id long, quality int")
    every = {r.doc_id: r for r in quality.training_labels(labels, "quality", 10**6).collect()}
    assert set(every) == {i for i in range(5000) if zlib.crc32(str(i).encode()) % 5} and all(r.fold == zlib.crc32(str(i).encode()) % 5 for i, r in every.items())
    few = [r.doc_id for r in quality.training_labels(labels, "quality", 300).collect()]
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in every], "doc_id long").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))).collect()]
    assert few == order[:300]


def test_isotonic():
    x, y = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 8, 2, 10]), np.array([10, 10, 10, 10]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y[1] == pytest.approx(0.5, abs=0.01)


# ---- licences


def test_op6_base_places(odd, none):
    got = {(str(r.doc_id), r.n_words): r for r in licenses.scan(odd).collect()}
    for i, t in texts_of(odd):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        r = got[(str(i), len(w))]
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            assert (r.base[label] if r.base else []) == [k for k in range(len(w)) if w[k : k + len(p)] == p]
    assert licenses.scan(none).count() == 0


def test_op6_rules_and_suppression(spark):
    text = "Licensed under the GNU Lesser General Public License, version 2.1. SPDX-License-Identifier: Apache-2.0\nMIT license; cc by-sa 4.0. \x01BSD 3-Clause License"
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    assert {(d.label, d.priority) for d in found} == {("lgpl-2.1", 2), ("apache-2.0", 1), ("mit", 3), ("cc-by-sa-4.0", 3), ("bsd-3-clause", 3)}
    for d in found:
        assert not any(e.start <= d.start and e.end >= d.end and e != d for e in found)
    low = text.lower()
    assert {low[d.start : d.end] for d in found if d.label == "mit"} == {"mit license"}


def test_op6_rules_match_their_own_names():
    rules = licenses.rules()
    assert len(rules) > 400 and len(licenses.LICENSES) + len(licenses.NOTICES) + len(licenses.SIGNATURES) > 230 and all(r["rank"] == i for i, r in enumerate(rules))
    for r in rules:
        re.compile(r["regex"])
        if r["priority"] == 1:
            assert re.search(r["regex"], f"spdx-license-identifier: {r['label']}")


def test_op6_against_python_rules(spark, sf):
    """The same rules by Python's regular expressions, whole table."""
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    got = {r.doc_id: sorted((d.rank, d.start, d.end) for d in (r.found or [])) for r in licenses.scan(docs).collect()}
    rules, n = licenses.rules(), 0
    for r in docs.collect():
        t = (r.text or "").lower()
        gated = re.search(licenses.GATE, r.text or "")
        every = [(x["priority"], m.start() - m.end(), x["rank"], m.start(), m.end()) for x in rules if gated and x["keyword"] in t for m in re.finditer(x["regex"], t)]
        keep = sorted(e[2:] for e in every if not any(o[3] <= e[3] and o[4] >= e[4] and o[:3] < e[:3] for o in every))
        n += len(keep)
        assert got[r.doc_id] == keep
    assert n > 20


def forms(tree) -> list[str]:
    """Strings that an expression matches: every branch, optional parts left out and taken, blanks as a line break."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            parts = [chr(arg)]
        elif op == "IN":
            kind, x = arg[0]
            parts = [{"CATEGORY_SPACE": "\n", "CATEGORY_NOT_SPACE": "u"}.get(str(x), "a") if str(kind) == "CATEGORY" else chr(x[0] if str(kind) == "RANGE" else x)]
        elif op in ("NOT_LITERAL", "ANY"):
            parts = ["x"]
        elif op == "BRANCH":
            parts = [f for b in arg[1] for f in forms(b)]
        elif op == "SUBPATTERN":
            parts = forms(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            parts = [f * k for k in {arg[0], max(arg[0], 1)} for f in forms(arg[2])]
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
            continue
        out = [a + b for a in out for b in parts]
    return out


def test_op6_filters_drop_no_form_of_a_rule():
    for r in licenses.rules():
        grant = r["regex"].startswith(licenses.GRANT)
        for f in forms(re._parser.parse(r["regex"].removeprefix(licenses.GRANT))):
            f = "released under " + f if grant else f
            assert re.search(r["regex"], f), (r, f)
            assert r["keyword"] in f and re.search(licenses.GATE, f), (r, f)


def test_op6_without_filters(spark):
    """Names and grants without the word licence, wrapped names and other forms, against all rules run on every text."""
    texts = ["Released under the 3-clause BSD", "released under the simplified BSD.", "Distributed under Apache 2.0", "available under Apache-2.0", "Published under CeCILL 2.1", "MIT No Attribution", "MIT\x01No Attribution", "GNU General\nPublic\n License,\n version 2", "Business\n Source License", "PSF license", "beer-ware license", "Creative Commons Attribution 4.0", "into the public\n domain", "into the public\x02domain", " * Redistributions of source code\n * must retain the above\n * copyright notice", "# Permission to use, copy, modify, and distribute this software\n# for any purpose with or without fee is hereby granted, provided", "you may not use this file except\n// in compliance with the License.", "nothing at all", "copyleft GNU General Public License v3 " * 40]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        t = texts[r.doc_id].lower().translate({1: " ", 2: " "})
        every = [(x["priority"], m.start() - m.end(), x["rank"], m.start(), m.end()) for x in licenses.rules() for m in re.finditer(x["regex"], t)]
        want = sorted(e[2:] for e in every if not any(o[3] <= e[3] and o[4] >= e[4] and o[:3] < e[:3] for o in every))
        assert bool(want) == (t != "nothing at all")
        assert sorted((d.rank, d.start, d.end) for d in (r.found or [])) == want, texts[r.doc_id]


def test_op6_very_many_detections(spark):
    """A long text of detections only: their number and places, and a time that does not grow with its square."""
    n = 4000
    text = "copyleft spdx-license-identifier: MIT " * n
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    assert len(found) == 2 * n
    assert [d.start for d in found if d.label == "copyleft"] == [38 * k for k in range(n)] and [(d.start, d.end) for d in found if d.label == "mit"] == [(38 * k + 9, 38 * k + 37) for k in range(n)]
