"""The conversation trie, whitening and class-based scoring against brute force and planted cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenvec.llm import class_lm, prefix_trie, queries, whitening
from lumenvec.llm.common import staged, tune


def brute_trie(rows):
    """(conv_id, turn, role, text) to the set of a node's contract columns."""
    source = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            source.setdefault(c, []).append(((turn is not None, turn or 0, said), role, text))
    for turns in source.values():
        turns.sort(key=lambda x: x[0])
    whole = {}
    for c, turns in source.items():
        h, base = zlib.crc32(str(c).encode()) % 9, int(math.fmod(c, 5))
        whole[c] = tuple(x[1:] for x in [*source.get(c - base, [])[:h], *turns[h:]])
    nodes = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == k))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], ends(k, m)) for k, m in nodes.items())


def trie_rows(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=lambda r: (r[0], r[1]))


ODD_TURNS = [
    (0, None, "user", "null turn is first"), (0, 0, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 1, "a", "tie"), (1, 5, "user", "é" * 30_000), (1, 6, "b", "c"),
    (2, 0, "user", "x"), (None, 0, "user", "no conversation"), (7, 1, None, "base is absent"), (7, 2, "user", "so this"), (-7, 0, "u", "negative"), (-3, 0, "u", "negative too"), (3, None, None, None),
]


def family(rows=60):
    """Conversations that share turns in every way, one of them long."""
    out = [(c, t, "user" if t % 2 == 0 else "bot", f"{(c // 20) * (t > 2)} {t}") for c in range(rows) for t in range(c % 7)]
    return out + [(35, t, "user", f"long {t}") for t in range(7, 400)] + [(c, 0, "user", "same") for c in range(1000, 1040)]


@pytest.mark.parametrize(("rows", "rest"), [(1 << 19, 1 << 15), (60, 8)])
def test_trie(spark, rows, rest):
    """Also with small ranges, so that one conversation and one node's children fill several, and with splicing rounds."""
    tune(spark)
    turns = [*family(), *ODD_TURNS]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as rank", "'x' as said", "2 as part", "3 as one", "4 as base", "5 as key")
    assert trie_rows(prefix_trie.prefix_trie(df, rows, rest)) == [tuple(r) for r in sorted(brute_trie(turns), key=lambda r: (r[0], r[1]))]


def test_trie_tour(spark, sf):
    """Arcs have places 0 to 2 n - 1, children lie within their parents, and equal a plain list ranking."""
    rows = queries.QUERIES["op11_euler_tour_trie"](spark, sf).collect()
    assert sorted(x for r in rows for x in (r.enter_at, r.exit_at)) == list(range(2 * len(rows)))
    at = {(r.conv_id, r.depth): r for r in rows}
    for r in rows:
        if r.depth:
            up = at[r.parent_conv_id, r.depth - 1]
            assert up.enter_at < r.enter_at < r.exit_at < up.exit_at
        assert (r.exit_at == r.enter_at + 1) == (r.n_children == 0)


def test_trie_edges(spark):
    tune(spark)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0
    nulls = spark.createDataFrame([(None, 0, "a", "b")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(nulls).count() == 0


def test_trie_long_end_lists(spark):
    """A node where more members end than a chunk holds."""
    tune(spark)
    members = staged(spark.range(9000).selectExpr("cast('k' as binary) as key", "id * 7 as conv_id").union(spark.sql("select cast('j' as binary), 5L")), "members")
    got = {bytes(r.key): r.ends_sha256 for r in prefix_trie.ends(members, 1000).collect()}
    assert got == {b"k": hashlib.sha256(",".join(str(7 * i) for i in range(9000)).encode()).hexdigest(), b"j": hashlib.sha256(b"5").hexdigest()}


def test_list_ranking(spark):
    """Random lists, spliced down to one segment."""
    n, order = 200, np.random.RandomState(3).permutation(200)
    follows = {int(a): int(b) for a, b in zip(order, order[1:], strict=False)}
    rows = [(i, i % 3, follows.get(i), follows[i] % 3 if i in follows else None, 1, i, i * i) for i in range(n)]
    df = staged(spark.createDataFrame(rows, "conv long, code long, next_conv long, next_code long, arcs long, leaves long, saved long"), "list")
    got = {r.conv: (r.arcs, r.leaves, r.saved) for r in prefix_trie.list_ranked(df, rest=1).collect()}
    before = np.concatenate([[[0, 0, 0]], np.cumsum([[1, i, i * i] for i in order.tolist()], axis=0)])
    assert got == {int(i): tuple(before[k].tolist()) for k, i in enumerate(order)}


# Whitening


def brute_whitening(rows, components=16):
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in kept], np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    y = n * x - s
    return [i for i, _ in kept], n, (y.astype(object) ** 2).sum(axis=1), y / n @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def against_brute(df, rows):
    ids, n, deviation, white, explained = brute_whitening(rows)
    k = white.shape[1]
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
    assert sorted(got, key=str) == sorted(set(ids), key=str)
    signs = None
    for i, d, w in zip(ids, deviation, white, strict=True):
        mine = sorted(got[i], key=lambda r: r.component)
        mine = mine[:: len(mine) // k]
        assert [r.component for r in mine] == list(range(1, k + 1)) and all(r.n == n and r.deviation == d for r in mine)
        v = np.array([r.whitened for r in mine])
        signs = np.where(np.abs(v) > 1e-6, np.sign(v * w), 1) if signs is None else signs
        assert np.allclose(v * signs, w, atol=1e-8)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9) and max(r.identity_error for r in mine) < 1e-9


def test_op12(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    against_brute(queries.QUERIES["op12_cholesky_jacobi_whitening"](spark, sf), rows)


def whitening_of(spark, rows):
    tune(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as n", "'c' as component")
    ints = whitening.integers(df)
    return whitening.projected(ints, whitening.fit(ints))


def test_op12_odd_rows(spark):
    rng = np.random.RandomState(0)
    rows = [(i, [float(a) for a in rng.normal(size=5) * (3, 1, 0.2, 2, 0)]) for i in range(40)]  # the last dimension is constant
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, None), (102, []), (103, [1.0, None, 2.0, 3.0, 4.0]), (104, [float("nan")] * 5), (105, [float("inf")] * 5)]
    against_brute(whitening_of(spark, [*rows, (106, [1.0, 2.0])]), rows)
    null_id = whitening_of(spark, [*rows, (None, [0.0] * 5)])
    assert null_id.where("vec_id is null").count() == 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_op12_without_spread(spark, rows):
    assert whitening_of(spark, rows).count() == 0


def test_op12_large_entries(spark):
    """Deviations over 64 bits are null, the others exact."""
    out = whitening_of(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])]).collect()
    assert {r.vec_id for r in out if r.deviation is None} == {1, 2} and all(math.isfinite(r.whitened) for r in out)


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_jacobi(d):
    a = np.random.RandomState(d).normal(size=(200, d)) * np.logspace(0, -4, d)
    g = a.T @ a
    lower, order = whitening.pivoted_cholesky(g)
    assert np.allclose(lower @ lower.T, g[np.ix_(order, order)]) and np.allclose(lower, np.tril(lower))
    values, vectors = whitening.decomposed(g, 1)
    want = np.linalg.eigvalsh(g)[::-1]
    assert np.allclose(values, want, rtol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-10) and np.allclose(g @ vectors, vectors * values)


def test_cholesky_finds_rank():
    a = np.random.RandomState(1).normal(size=(50, 3)) @ np.random.RandomState(2).normal(size=(3, 8))
    values, vectors = whitening.decomposed(a.T @ a, 1)
    assert vectors.shape == (8, 3) and np.allclose(vectors * values @ vectors.T, a.T @ a)


# Class-based scoring


def words_of(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", low) + [None]


def base_of(rows):
    """doc_id and (n_tokens, n_known, base_score) of each row, train_tokens, by the contract."""
    count = Counter()
    for i, text in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            count.update(words_of(text))
    n, v = sum(count.values()), len(count)
    out = [(i, (len(t), sum(1 for w in t if count[w]), sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))) for i, t in ((i, words_of(x)) for i, x in rows)]
    return out, n


def test_op13_base_and_gain(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found, n = base_of(rows)
    want = dict(found)
    got = queries.QUERIES["op13_brown_class_lm"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0
    for held in (False, True):
        some = [r for r in got if r.held_out == held]
        assert sum(r.score for r in some) > sum(r.base_score for r in some) + 0.2 * sum(r.n_tokens for r in some)


def brute_score(rows, classes, tail_class, k, head_words, known):
    """Scores by the definition, word by word, from given classes of head and other words."""
    train = [words_of(x) for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in t)
    at = {w: ("head", classes[j]) for j, w in enumerate(head_words)} | {w: ("tail", c) for w, c in tail_class.items()}
    transitions, sizes, types = Counter(), Counter(), Counter()

    def steps(t):
        g = 0
        for w in t:
            yield g, w
            if w in at and at[w][0] == "head":
                g = at[w][1]

    for t in train:
        for g, w in steps(t):
            transitions[g, at[w]] += 1
            sizes[at[w]] += 1
    for w in count:
        types[at[w]] += 1
    history, n, d = Counter(), sum(count.values()), known.discount
    for (g, _), c in transitions.items():
        history[g] += c
    p = lambda g, c: (transitions[g, c] + class_lm.PRIOR * sizes[c] / n) / (history[g] + class_lm.PRIOR)
    unseen = {g: sum(p(g, c) * d * types[c] / sizes[c] for c in sizes) for g in range(k)}
    for g in range(k):  # a distribution over the vocabulary and one unseen word
        assert sum(p(g, at[w]) * (c - d) / sizes[at[w]] for w, c in count.items()) + unseen[g] == pytest.approx(1)
    return {i: sum(math.log10(p(g, at[w]) * (count[w] - d) / sizes[at[w]] if count[w] else unseen[g]) for g, w in steps(words_of(x))) for i, x in rows}


def test_op13_whole_model(spark, sf):
    """Every score, from the operator's own classes; tail words and several classes, so that all parts count."""
    tune(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    head, k, rounds = 1e-3, 6, 3
    texts = class_lm._documents(docs)
    known = class_lm.vocabulary(texts, head)
    pairs = staged(class_lm.head_pairs(texts, known), "pairs")
    classes, m, seen = class_lm.exchanged(pairs, len(known.head), k, rounds)
    assert all(a <= b for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0]
    read = class_lm.read_documents(texts, known, classes, m)
    tails = class_lm.tail_classes(read.where("not held_out").selectExpr("inline(tail)").select("word", "g", "n"), m).collect()
    assert len(tails) > 100
    encoded = lambda w: None if w == class_lm.END else w.encode()
    want = brute_score(rows, classes, {encoded(r.word): r.k for r in tails}, k, [encoded(w) for w in known.head.to_pylist()], known)
    for r in class_lm.scored(docs, head, k, rounds).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)


def test_op13_exchange_gain(spark):
    """The gain that gains() promises for one move is what the likelihood really gains."""
    rng = np.random.RandomState(5)
    n = rng.poisson(2.0, size=(12, 12))
    pairs = staged(spark.createDataFrame([(int(v), int(w), int(n[v, w])) for v in range(12) for w in range(12) if n[v, w]], "v int, w int, n long"), "pairs")
    classes = np.array([0, 1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2])
    near = class_lm.neighbours(pairs)
    m = class_lm.class_counts(near, classes, 4)[:, :4]
    plain = np.zeros((4, 4), np.int64)
    np.add.at(plain, (classes[:, None], classes[None, :]), n)
    assert (m == plain).all()
    for word in range(1, 12):
        left, right = np.bincount(classes, n[:, word], 4), np.bincount(classes, n[word], 4)
        g = class_lm.gains(m, int(classes[word]), left, right, int(n[word, word]))
        for b in range(1, 4):
            moved = classes.copy()
            moved[word] = b
            after = np.zeros((4, 4), np.int64)
            np.add.at(after, (moved[:, None], moved[None, :]), n)
            assert g[b] - g[classes[word]] == pytest.approx(class_lm.likelihood(after) - class_lm.likelihood(m), abs=1e-8)
    words, to, gain = class_lm.moves(near, classes, m, 0, 256, 4)
    assert len(words) and gain > 0 and 0 not in words and 0 not in to


def test_op13_odd_rows(spark):
    tune(spark)
    rows = [(1, None), (2, ""), (None, "a b A"), (3, " \t\n"), (4, "b " * 50_000), (4, "b c"), (5, "x" * 100_000), (6, "É é ÀB\x00c end"), (10, "never seen"), (7, "a b c d " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word", "2 as key", "false as held_out", "3 as k")
    want, n = base_of(rows)
    got = class_lm.scored(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.n_tokens, r.n_known) for r in got) == sorted(w[:2] for _, w in want)
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(w[2] for _, w in want)) and {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) for r in got)
    assert class_lm.scored(docs.limit(0)).count() == 0


def test_op13_nothing_to_learn_from(spark):
    tune(spark)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = class_lm.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.score == r.base_score == 0.0
