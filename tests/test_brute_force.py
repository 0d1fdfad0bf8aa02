"""Whole queries that SQL cannot express, against plain Python over the same tables (read with DuckDB)."""

from __future__ import annotations

import datetime
import itertools
import math
import os
import struct

import duckdb
import numpy as np
import pytest
import xxhash

from lumenvec.plans import catalog, streams
from lumenvec.plans.scalars import REASON
from lumenvec.plans.tables import DETECTION, GALLERY, HASHES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.fixture(scope="module")
def faces(con):
    """Gated faces as dictionaries, in frame order."""
    got = con.execute(f"with {DETECTION} select session, frame, det_id, bbox, vec_id, ts::timestamp as ts, e.embedding::double[] as v from detection join embeddings e using (vec_id) where {REASON} = 'passed' order by session, frame, det_id")
    names = [d[0] for d in got.description]
    return [dict(zip(names, r, strict=True)) | {"v": np.array(r[-1])} for r in got.fetchall()]


@pytest.fixture(scope="module")
def vectors(con):
    return [(i, p, np.array(v), k) for i, p, v, k in con.execute(f"with {GALLERY} select identity, pos, embedding, vec_id from gallery order by identity, pos").fetchall()]


def rows(spark, sf, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, sf).collect())


def near(got, want, at):
    """Equal rows, but for values at some columns, which may differ a little."""
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, abs=2e-6) if k in at else x == y for k, (x, y) in enumerate(zip(g, w, strict=True))), (g, w)


def by_session(faces):
    return [(s, list(f)) for s, f in itertools.groupby(faces, key=lambda f: f["session"])]


def grouped(faces, least, duplicate):
    out = []
    for session, every in by_session(faces):
        means, last = [], []
        for f in every:
            sims = [float(np.dot(m, f["v"])) for m in means]
            best = max(range(len(sims)), key=lambda k: (sims[k], -k), default=None)
            if best is None or sims[best] <= 0 or sims[best] < least:
                means.append(f["v"])
                last.append(f["v"])
                out.append((session, f["det_id"], len(means) - 1, 1.0, True))
            elif float(np.dot(last[best], f["v"])) >= duplicate:
                out.append((session, f["det_id"], best, sims[best], False))
            else:
                means[best], last[best] = 0.9 * means[best] + 0.1 * f["v"], f["v"]
                out.append((session, f["det_id"], best, sims[best], True))
    return sorted(out)


@pytest.mark.parametrize("name", ["x1_online_grouping", "x1_online_grouping_stream"])
def test_grouping(spark, sf, faces, name):
    near(rows(spark, sf, name, "session", "det_id", "group_index", "sim", "kept"), grouped(faces, *streams._GROUPING), {3})


def intersection(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    every = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / every if every > 0 else 0.0


def blend(vs):
    w = [math.exp(-3 + 3 * i / (len(vs) - 1)) if len(vs) > 1 else 1.0 for i in range(len(vs))]
    v = sum(x * y for x, y in zip(w, vs, strict=True))
    return v / np.sqrt((v * v).sum())


class Tracks:
    def __init__(self):
        self.held, self.count = [], 0

    def take(self, f):
        """(track, score, smoothed vector)"""
        self.held = [t for t in self.held if f["frame"] - t["frame"] <= 60]
        best = None
        for t in sorted(self.held, key=lambda t: t["n"]):
            if f["frame"] - t["frame"] > 30:
                continue
            iou, like = intersection(f["bbox"], t["box"]), float(blend(t["vs"]) @ f["v"])
            score = 0.6 * iou + 0.4 * like
            if iou >= 0.1 and like >= 0.3 and (best is None or score > best[0]):
                best = (score, t)
        if best is None or best[0] <= 0.3:
            best = (0.0, {"n": self.count, "vs": []})
            self.count += 1
            self.held.append(best[1])
        t = best[1]
        t.update(frame=f["frame"], box=f["bbox"], vs=(t["vs"] + [f["v"]])[-20:])
        return t["n"], best[0], blend(t["vs"])


def tracked(faces):
    return [(s, f["det_id"], *t.take(f)) for s, every in by_session(faces) for t in [Tracks()] for f in every]


@pytest.mark.parametrize("name", ["x2_tracking", "x2_tracking_stream"])
def test_tracks(spark, sf, faces, name):
    want = sorted(w[:4] for w in tracked(faces))
    near(rows(spark, sf, name, "session", "det_id", "track", "score"), want, {3})


def test_smoothed_tracks(spark, sf, faces):
    want = sorted((s, d, t, float(v[0]), float(v.sum())) for s, d, t, _, v in tracked(faces))
    near(rows(spark, sf, "x3_smoothed_tracks", "session", "det_id", "track", "first_value", "total"), want, {3, 4})


def test_expired_tracks(spark, sf, faces):
    """Slice after slice of time; then sessions idle for longer than the limit start anew."""
    ms = lambda f: round((f["ts"] - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    low, high = min(map(ms, faces)), max(map(ms, faces))
    state, last, latest, want, again = {}, {}, 0, [], 0
    for k in range(4):
        part = [f for f in faces if (ms(f) - low) * 4 // (high - low + 1) == k]
        for f in part:
            t = state.setdefault(f["session"], Tracks())
            want.append((f["session"], f["det_id"], t.take(f)[0]))
        for f in part:
            last[f["session"]] = max(last.get(f["session"], 0), ms(f))
        latest = max([latest, *map(ms, part)])
        for s in [s for s in state if last[s] + streams.IDLE_MS < latest]:
            again += any(f["session"] == s and (ms(f) - low) * 4 // (high - low + 1) > k for f in faces)
            del state[s]
    assert rows(spark, sf, "x6_expired_tracks", "session", "det_id", "track") == sorted(want)
    assert again  # some session came back


def test_names_and_guests(spark, sf, faces, vectors):
    want = []
    for session, every in by_session(faces):
        guests = []
        for f in every:
            sim, name = max(((float(v @ f["v"]), i) for i, _, v, k in vectors if k != f["vec_id"]), key=lambda x: x[0])
            best = max(range(len(guests)), key=lambda g: float(guests[g] @ f["v"]), default=None)
            if sim >= 0.35:
                want.append((session, f["det_id"], name, sim))
            elif best is not None and float(guests[best] @ f["v"]) > 0.65:
                want.append((session, f["det_id"], f"Misafir-{best + 1}", float(guests[best] @ f["v"])))
                moved = 0.9 * guests[best] + 0.1 * f["v"]
                guests[best] = moved / np.linalg.norm(moved)
            else:
                guests.append(f["v"])
                want.append((session, f["det_id"], f"Misafir-{len(guests)}", 0.0))
    assert len({w[2][:3] for w in want}) > 1
    near(rows(spark, sf, "x4_names_and_guests", "session", "det_id", "name", "score"), sorted(want), {3})


def test_repeats(spark, sf, con):
    got = con.execute(f"with {DETECTION} select session, event_type, frame, det_id, embedding::double[] from detection join embeddings using (vec_id) order by session, event_type, frame, det_id").fetchall()
    want = []
    for _, group in itertools.groupby(got, key=lambda r: r[:2]):
        last = None
        for *_, det, v in group:
            keep = last is None or float(np.dot(v, last)) < 0.1
            last = v if keep else last
            want.append((det, keep))
    assert rows(spark, sf, "w3_drop_repeats", "det_id", "kept") == sorted(want)


def test_greedy_dedupe(spark, sf, con):
    pairs = con.execute(f"with {HASHES}, {GALLERY} select doc_id, identity, phash, embedding from hashes join gallery on vec_id = doc_id % 1000000000 order by doc_id").fetchall()
    first, kept = [], []
    for i, name, h, v in pairs:
        if all(bin(int(h, 16) ^ int(o, 16)).count("1") >= 5 for _, _, o, _ in first):
            first.append((i, name, h, v))
    for i, name, _, v in first:
        if not any(name == n and float(np.dot(v, o)) > 0.2 for _, n, o in kept):
            kept.append((i, name, v))
    assert any(int(h, 16) ^ int(o, 16) for i, _, h, _ in pairs for j, _, o, _ in pairs if j == i - 1_000_000_000)  # near hashes decide
    assert rows(spark, sf, "w4_greedy_dedupe", "id") == [(i,) for i, _, _ in kept]


def uniform(name, pos, draw):
    """The number that a row draws: a hash of group, place and draw."""
    h = 42
    for part in (name.encode(), struct.pack("<q", pos), struct.pack("<i", draw)):
        h = xxhash.xxh64_intdigest(part, seed=h)
    return (h % (1 << 53) + 1) / (1 << 53)


def spherical(name, places, x):
    """Clusters by size as A18 says: seeds drawn by squared distance, then means, as unit vectors."""
    k = min(len(x), 1 if len(x) < 3 else 2 if len(x) < 8 else 3)
    starts = []
    while len(starts) < k:
        weight = [min(((1 - float(v @ x[s])) ** 2 for s in starts), default=1.0) for v in x]
        starts.append(min(range(len(x)), key=lambda i: (-math.log(uniform(name, places[i], len(starts))) / weight[i] if weight[i] > 0 else math.inf, places[i])))
    c = [x[s] for s in starts]
    for _ in range(100):
        sims = [[float(v @ m) for m in c] for v in x]
        now = [max(range(k), key=lambda j: (r[j], -j)) for r in sims]
        fresh = []
        for j in range(k):
            own = [v for v, n in zip(x, now, strict=True) if n == j]
            v = sum(own) if own else x[min(range(len(x)), key=lambda i: max(sims[i]))]
            fresh.append(v / np.linalg.norm(v))
        still = max(np.abs(a - b).max() for a, b in zip(fresh, c, strict=True)) < 1e-4
        c = fresh
        if still:
            break
    return [(j, now.count(j), float(c[j][0]), float(c[j].sum())) for j in range(k)]


@pytest.mark.parametrize("name", ["a18_templates", "a19_stored_template"])
def test_templates(spark, sf, vectors, name):
    want = []
    for identity, group in itertools.groupby(vectors, key=lambda r: r[0]):
        kept = [(p, v) for _, p, v, k in group if name == "a18_templates" or k % 11]
        want += [(identity, *t) for t in spherical(identity, [p for p, _ in kept], [v for _, v in kept]) if name == "a18_templates" or t[0] == 0]
    near(rows(spark, sf, name, "identity", "template", "n", "first_value", "total"), sorted(want), {3, 4})


def picture(text):
    raw = (text or "").encode()
    return np.frombuffer(raw + b"\0" * (-len(raw) % 32), np.uint8).reshape(-1, 32).astype(float)


def shrunk(x, n):
    """Each pixel repeated n times both ways, then means of equal blocks."""
    h, w = x.shape
    tall = np.repeat(x, n, axis=0).reshape(n, h, w).mean(axis=1)
    return np.repeat(tall, n, axis=1).reshape(n, n, w).mean(axis=2)


def features(x):
    if not x.size:
        return None, None, ""
    h, w = x.shape
    at = lambda i, n: abs(i) if i < n else 2 * n - 2 - i
    if min(h, w) > 1:
        rows, columns = ([at(i + d, n) for i in range(n)] for n, d in ((h, -1), (w, -1)))
        below, right = [at(i + 1, h) for i in range(h)], [at(i + 1, w) for i in range(w)]
        lap = x[rows] + x[below] + x[:, columns] + x[:, right] - 4 * x
    else:
        p = np.pad(x, 1, mode="edge")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x
    small, low = shrunk(x, 32), np.zeros((8, 8))
    c = lambda k: np.array([math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)]) * math.sqrt((1 if k == 0 else 2) / 32)
    for u in range(8):
        for v in range(8):
            low[u, v] = c(u) @ small @ c(v)
    flat = low.round(6).astype(np.float32).ravel()
    bits = "".join("1" if b else "0" for b in flat > np.median(flat[1:]))
    return float(x.mean()), float(lap.var()), f"{int(bits, 2):016x}"


@pytest.fixture(scope="module")
def pictures(con):
    return [(str(i), s, picture(t)) for i, t, s in con.execute("select doc_id, text, source from documents").fetchall()]


def test_image_features(spark, sf, pictures):
    want = sorted((o, *features(x)) for o, _, x in pictures)
    got = {r[0]: r for r in rows(spark, sf, "i1_image_features", "origin", "brightness", "blur_var")}
    near([got[w[0]] for w in want], [w[:3] for w in want], {1, 2})
    hashes = dict(rows(spark, sf, "i2_image_hash", "origin", "phash"))
    unlike = [w[0] for w in want if bin(int(w[3] or "0", 16) ^ int(hashes[w[0]] or "0", 16)).count("1") > 1]
    assert not unlike and set(hashes) == {w[0] for w in want}  # a bit may sit on the median


def test_image_audit(spark, sf):
    hashes = dict(rows(spark, sf, "i2_image_hash", "origin", "phash"))
    bright = {r[0]: r for r in rows(spark, sf, "i1_image_features", "origin", "brightness", "blur_var")}
    got = {r[0]: r for r in rows(spark, sf, "i3_audit", "origin", "phash", "blur_score", "brightness_score", "repeats")}
    assert set(got) == set(hashes)
    stays, goes = [], set()
    for o in sorted(hashes):
        if hashes[o] and any(bin(int(hashes[o], 16) ^ int(hashes[p], 16)).count("1") < 5 for p in stays):
            goes.add(o)
        elif hashes[o]:
            stays.append(o)
    for o, (_, h, blur, light, repeats) in got.items():
        _, mean, var = bright[o]
        assert h == hashes[o] and blur == pytest.approx(0 if var is None else min(max((var - 50) / 450, 0), 1), abs=1e-6)
        m = mean or 0
        assert light == pytest.approx(0 if mean is None else m / 80 * 0.7 if m < 80 else (255 - m) / 75 * 0.7 if m > 180 else 1 - abs(m - 130) / 50 * 0.3, abs=1e-6)
        assert repeats == (o in goes)
    assert 0 < len(goes) < len(got)


def test_similar_images(spark, sf, pictures):
    last, want = {}, []
    for origin, source, x in sorted(pictures, key=lambda p: p[0]):
        if not x.size:
            want.append((origin, True))
            continue
        v = shrunk(x, 64)
        v = v - v.mean()
        v = v / (np.sqrt((v * v).sum()) or 1)
        keep = source not in last or float((v * last[source]).sum()) <= 0.92
        last[source] = v if keep else last[source]
        want.append((origin, keep))
    assert rows(spark, sf, "w7_similar_images", "origin", "kept") == want
