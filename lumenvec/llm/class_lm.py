"""LM scoring by Brown class-based n-grams.

A text's tokens are its words and one end; P(token) = P(class | class before) * P(token | its class), where the class
before is that of the latest head word (the text's start counts as an end). Head words are those that make up a
share of HEAD or more of all training tokens, so there are at most 1 / HEAD of them at any size of the corpus; only
they, of all that grows with the corpus, are broadcast. Other words get classes too, but are passed over as history.

Exchange clustering: head words start in CLASSES classes, dealt by falling count (the end has a class of its own).
In each round, every word of a share that a hash draws (half of them at first) moves to the class that raises the
likelihood of the class bigrams most, given the counts before the round: tasks find the moves from the counts of
the words' neighbours (lists of at most 1 / HEAD neighbours a side), and the class counts are summed anew. Words
that move at once may miss what each was promised: where the likelihood rises much less than the sum of the single
gains, the share is halved, and a round that lowers it is taken back, so it never falls. Counts are integers, so
the classes do not depend on how rows are dealt out. A word that is no head word then goes to the tail class whose
transitions suit its own history classes best, by the same criterion, and transitions are counted over all tokens.

Smoothing: transitions by PRIOR pseudo-counts of the classes' own shares; emissions by an absolute discount, n1 /
(n1 + 2 n2) of the words seen once and twice, whose mass in each class goes to unseen words. So for every history
the probabilities of the vocabulary and of one unseen word sum to 1.

Training takes the rows whose crc32(doc_id as text) mod 10 is not 0. Per-token figures (score / n_tokens, or the
perplexity 10 ** -(score / n_tokens)) are comparable between texts.

Defined cases: null and empty texts have the end as their only token; a null doc_id is held in training, since it
has no remainder; repeated rows are scored each, and learnt from as often; without training rows nothing is known
and score is base_score; words over 32 bytes are counted by their SHA-256; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, staged, table, text_slices, tune, words

#: Share of all training tokens from which a word is a head word.
HEAD = 5e-6
CLASSES = 64
ROUNDS = 12
#: Shares of the words that a round draws, in 256ths: at first, and at least.
DRAWN, LEAST_DRAWN = 128, 16
#: Part of the promised gain below which the share is halved.
KEPT_PROMISE = 0.7
#: Rounds end when fewer than this share of the words move.
SETTLED = 0.004
PRIOR = 10.0
#: Base model: what is added to each count.
ADDED = 0.1
#: No word begins with a blank.
END = " end"
LONG = 32
#: (word, n) rows that a task holds before it sums them up.
HELD = 1 << 18
SLICE = 2 << 20


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens as indices into a dictionary whose last entry is the end, len + 1 offsets, dictionary."""
    index, ends, dictionary = words(texts, SPACED)
    long = np.flatnonzero(pc.binary_length(dictionary).to_numpy(zero_copy_only=False) > LONG)
    if len(long):
        names = dictionary.to_pylist()
        for i in long.tolist():
            names[i] = f" {hashlib.sha256(names[i].encode()).hexdigest()}"
        dictionary = pa.array(names, pa.string())
    n = len(texts)
    tokens = np.empty(len(index) + n, np.int64)
    tokens[np.arange(len(index)) + np.repeat(np.arange(n), np.diff(ends))] = index
    tokens[ends[1:] + np.arange(n)] = len(dictionary)
    return tokens, ends + np.arange(n + 1), pa.concat_arrays([dictionary.cast(pa.string()), pa.array([END])])


def _documents(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of docs (doc_id, held_out, text) that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for _, texts in text_slices(batch, "text", SLICE):
                tokens, _, dictionary = coded(texts)
                held.append(pa.table({"word": dictionary, "n": np.bincount(tokens, minlength=len(dictionary))}))
                if sum(map(len, held)) > HELD:
                    held = [summed(held)]
                    if len(held[0]) > HELD // 2:
                        yield from held.pop().to_batches(8192)
        if held:
            yield from summed(held).to_batches(8192)

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).select(["word", "n"])

    return docs.where("not held_out").select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """What all tasks get: head words (the end first), their counts, totals of the training tokens."""

    head: pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    discount: float

    def ids(self, dictionary: pa.Array) -> np.ndarray:
        """Numbers of head words, -1 for others."""
        return pc.fill_null(pc.index_in(dictionary, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADDED) / (self.total + ADDED * (self.distinct + 1)))


def vocabulary(docs: DataFrame, head: float = HEAD) -> Words:
    counts = staged(word_counts(docs), "vocabulary")
    total, distinct, once, twice = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first())
    rows = counts.where((F.col("n") >= head * total) | (F.col("word") == END)).toPandas()  # 1 / head rows at most, and the end
    rows = rows.sort_values(["n", "word"], ascending=[False, True])
    names, numbers = rows["word"].tolist(), dict(zip(rows["word"], rows["n"].tolist(), strict=True))
    order = [END, *(w for w in names if w != END)]
    discount = once / (once + 2 * twice) if once and twice else 0.5
    return Words(pa.array(order, pa.string()), np.array([numbers.get(w, 0) for w in order], np.int64), total, distinct, discount)


def histories(ids: np.ndarray) -> np.ndarray:
    """The latest head word before each token; texts end with an end, so none reaches into the next."""
    latest = np.maximum.accumulate(np.where(ids >= 0, np.arange(len(ids)), -1)) if len(ids) else ids
    before = np.concatenate([[-1], latest[:-1]]) if len(ids) else ids
    return np.where(before >= 0, ids[before], 0)


def _pairs_counted(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique(a * width + b, return_counts=True)
    return key // width, key % width, n


def head_pairs(docs: DataFrame, known: Words) -> DataFrame:
    """v, w, n: how often head word w (-1: any other word) has the history v."""
    width = len(known.head) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "text", SLICE):
                tokens, _, dictionary = coded(texts)
                ids = known.ids(dictionary)[tokens]
                v, w, n = _pairs_counted(histories(ids), ids + 1, width)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array((w - 1).astype(np.int32)), pa.array(n)], ["v", "w", "n"])

    return docs.where("not held_out").select("text").mapInArrow(run, "v int, w int, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """word, its neighbours before and after as packed numbers (ids of 32 bits, counts of 64) and others, how often a
    word that is no head word follows. A head word has at most as many neighbours a side as there are head words, so a
    row is bounded. Packed rows are read in every round; they cost a copy, not a conversion of each neighbour."""
    both = F.inline(F.array(F.struct(F.col("w").alias("word"), F.lit(0).alias("side"), F.col("v").alias("other"), "n"), F.struct(F.col("v").alias("word"), F.lit(1).alias("side"), F.col("w").alias("other"), "n")))
    lists = pairs.select(both).where("word >= 0").groupBy("word").agg(F.collect_list(F.struct("side", "other", "n")).alias("near"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column(1)
            ends, flat = near.offsets.to_numpy(), near.values
            side, other, n = (flat.field(i).to_numpy() for i in range(3))
            out: list[list] = [[], [], [], [], []]
            for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                o, c, before = other[a:b], n[a:b], side[a:b] == 0
                after = ~before & (o >= 0)
                for x, v in zip(out, (o[before].tobytes(), c[before].tobytes(), o[after].tobytes(), c[after].tobytes(), int(c[~before & (o < 0)].sum())), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in out[:4]), pa.array(out[4], pa.int64())], ["word", "before", "before_n", "after", "after_n", "others"])

    return lists.mapInArrow(pack, "word int, before binary, before_n binary, after binary, after_n binary, others long")


def _unpacked(ids: bytes, counts: bytes, classes: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(classes[np.frombuffer(ids, np.int32)], np.frombuffer(counts, np.int64), k)


def class_counts(near: DataFrame, classes: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """Counts of class pairs, and in column k those of words that are no head words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1), np.int64)
        for batch in batches:
            for word, ids, counts, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[classes[word], :k] += _unpacked(ids, counts, classes, k).astype(np.int64)
                total[classes[word], k] += others
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["cell", "n"])

    out = np.zeros(k * (k + 1), np.int64)
    for r in near.select("word", "after", "after_n", "others").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # k * (k + 1) rows at most
        out[r[0]] = r[1]
    return out.reshape(k, k + 1)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))  # counts: 0 or 1 at least


def gains(m: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, twin: int) -> np.ndarray:
    """Log likelihood of the class bigrams with a word in each class, less what does not depend on its class. m: counts
    of class pairs; left, right: the word's counts with the classes before and after it; twin: with itself."""
    all_left, all_right = left.sum(), right.sum()
    left, right = left.copy(), right.copy()
    left[own] -= twin
    right[own] -= twin
    rest = m.astype(np.float64)
    rest[:, own] -= left
    rest[own, :] -= right
    rest[own, own] -= twin
    at, cell = _xlogx(rest), np.diag(rest)
    pairs = (_xlogx(rest + left[:, None]) - at).sum(axis=0) + (_xlogx(rest + right[None, :]) - at).sum(axis=1)
    pairs += _xlogx(cell + left + right + twin) - _xlogx(cell + left) - _xlogx(cell + right) + _xlogx(cell)
    rows, columns = m.sum(axis=1).astype(np.float64), m.sum(axis=0).astype(np.float64)
    rows[own] -= all_right
    columns[own] -= all_left
    return pairs - (_xlogx(rows + all_right) - _xlogx(rows)) - (_xlogx(columns + all_left) - _xlogx(columns))


def _drawn(word: int, turn: int, share: int) -> bool:
    return hashlib.blake2b(f"{turn}:{word}".encode(), digest_size=1).digest()[0] < share


def moves(near: DataFrame, classes: np.ndarray, m: np.ndarray, turn: int, share: int = 256, k: int = CLASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """(words, classes, sum of single gains) of the drawn words that leave their class. The end stays alone in class 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for word, before, before_n, after, after_n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if word == 0 or not _drawn(word, turn, share):
                    continue
                own = int(classes[word])
                twin = np.frombuffer(before_n, np.int64)[np.frombuffer(before, np.int32) == word].sum()
                g = gains(m, own, _unpacked(before, before_n, classes, k), _unpacked(after, after_n, classes, k), int(twin))
                best = 1 + int(np.argmax(g[1:]))
                if g[best] > g[own] + 1e-6:
                    found.append((word, best, float(g[best] - g[own])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["word", "class", "gain"])

    rows = near.select("word", "before", "before_n", "after", "after_n").mapInArrow(run, "word int, class int, gain double").toPandas()  # 1 / HEAD rows at most
    return rows["word"].to_numpy(), rows["class"].to_numpy(), float(rows["gain"].sum())


def likelihood(m: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what classes do not change."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def exchanged(pairs: DataFrame, heads: int, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each head word, counts of class pairs, likelihood at the start and after each round)."""
    classes = np.where(np.arange(heads) == 0, 0, 1 + (np.arange(heads) - 1) % (k - 1))
    near = staged(neighbours(pairs), "neighbours")
    m, share = class_counts(near, classes, k), DRAWN
    seen = [likelihood(m[:, :k])]
    for turn in range(rounds):
        words_, to, promised = moves(near, classes, m[:, :k], turn, share, k)
        if not len(words_):
            break
        moved = classes.copy()
        moved[words_] = to
        after = class_counts(near, moved, k)
        gained = likelihood(after[:, :k]) - seen[-1]
        settled = len(words_) * 256 < SETTLED * heads * share
        if gained < KEPT_PROMISE * promised:
            share = max(share // 2, LEAST_DRAWN)
        if gained > 0:
            classes, m = moved, after
        seen.append(seen[-1] + max(gained, 0.0))
        if settled:
            break
    return classes, m, seen


def smoothed(counts: np.ndarray, history: np.ndarray, total: int) -> np.ndarray:
    """log10 of the transition probabilities to some classes, from their counts and those of all transitions."""
    with np.errstate(divide="ignore"):
        return np.log10((counts + PRIOR * counts.sum(axis=0) / max(total, 1)) / (history[:, None] + PRIOR))


def read_documents(docs: DataFrame, known: Words, classes: np.ndarray, m: np.ndarray) -> DataFrame:
    """A row for each document: key, doc_id, held_out, n_tokens, figures of its head words (known, base, score) and
    its other words as tail, an array of (word, g: class before, n)."""
    k = len(m)
    to = smoothed(m[:, :k], m.sum(axis=1), known.total)
    size = np.maximum(np.bincount(classes, known.counts, k), 1)
    with np.errstate(divide="ignore"):
        emit = np.log10(np.maximum(known.counts - known.discount, 0) / size[classes])
    base = known.base(known.counts)
    tail = pa.list_(pa.struct([("word", pa.string()), ("g", pa.int32()), ("n", pa.int64())]))
    end_known = bool(known.counts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE):
                tokens, ends, dictionary = coded(texts)
                of, rows = known.ids(dictionary), len(texts)
                ids = of[tokens]
                g, doc = classes[histories(ids)], np.repeat(np.arange(rows), np.diff(ends))
                head = (ids > 0) | ((ids == 0) & end_known)
                h, gh, dh = ids[head], g[head], doc[head]
                sums = [np.bincount(dh, x, rows) for x in (np.ones(len(h)), base[h], to[gh, classes[h]] + emit[h])]
                other = ~head
                cell, n = np.unique((doc[other] * len(dictionary) + tokens[other]) * k + g[other], return_counts=True)
                word = dictionary.take(pa.array(cell // k % len(dictionary)))
                offsets = np.searchsorted(cell // k // len(dictionary), np.arange(rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([word, pa.array((cell % k).astype(np.int32)), pa.array(n)], fields=list(tail.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(rows)), part.column(0), part.column(1), pa.array(np.diff(ends)), *(pa.array(x.astype(t)) for x, t in zip(sums, (np.int64, np.float64, np.float64), strict=True)), lists],
                    ["key", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score", "tail"],
                )
                key += rows

    return docs.mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_score double, tail array<struct<word: string, g: int, n: long>>")


def tail_classes(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """word, c, k (its class) and seen, an array of (g, n), of the training rows' other words (word, g, n)."""
    k = len(m)
    inner = m[:, :k].astype(np.float64)
    inner[:, 0] = 0  # the end's own class
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.log(np.where(inner > 0, inner, 1e-3) / np.maximum(inner.sum(axis=0), 1e-3))
    fit[:, 0] = -np.inf if k > 1 else 0.0
    seen = rows.groupBy("word", "g").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("c"), F.collect_list(F.struct("g", "n")).alias("seen"))  # a word meets at most CLASSES classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            starts, flat = lists.offsets.to_numpy()[:-1], lists.values
            score = np.add.reduceat(fit[flat.field(0).to_numpy()] * flat.field(1).to_numpy()[:, None], starts, axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score.argmax(axis=1).astype(np.int32)), lists], ["word", "c", "k", "seen"])

    return seen.mapInArrow(run, "word string, c long, k int, seen array<struct<g: int, n: long>>")


def scored(docs: DataFrame, head: float = HEAD, k: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark, texts = docs.sparkSession, _documents(docs)
    # Lists of neighbours are gathered in order of words, a few words at a time, instead of 128 at once.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4")
    known = vocabulary(texts, head)
    classes, m, _ = exchanged(head_pairs(texts, known), len(known.head), k, rounds)
    read = staged(read_documents(texts, known, classes, m), "read")
    others = read.select("key", "held_out", F.inline("tail"))
    tails = staged(tail_classes(others.where("not held_out").select("word", "g", "n"), m), "tail_classes")
    # Sums of class pairs: k * k rows at most, here and below.
    t = np.zeros((k, k))
    for r in tails.select("k", F.inline("seen")).groupBy("g", "k").agg(F.sum("n").alias("n")).collect():
        t[r["g"], r["k"]] = r["n"]
    types = np.zeros((2, k))
    types[0] = np.bincount(classes, known.counts > 0, k)
    for r in tails.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():
        types[1, r["k"]] = r["n"]
    sizes = np.maximum(np.array([m[:, :k].sum(axis=0), t.sum(axis=0)]), 1)
    history = m.sum(axis=1)
    to_head, to_tail = smoothed(m[:, :k], history, known.total), smoothed(t, history, known.total)
    if known.total:
        with np.errstate(divide="ignore"):
            unseen = np.log10(10**to_head @ (known.discount * types[0] / sizes[0]) + 10**to_tail @ (known.discount * types[1] / sizes[1]))
    else:
        unseen = np.full(k, float(known.base(np.zeros(1))[0]))
    cells = [(g, c, float(to_tail[g, c] - np.log10(sizes[1, c]))) for g in range(k) for c in range(k) if np.isfinite(to_tail[g, c])] + [(g, -1, float(unseen[g])) for g in range(k)]
    model = spark.createDataFrame(cells, "g int, k int, lp double")
    met = others.join(tails.select("word", "c", "k"), "word", "left").withColumn("k", F.coalesce("k", F.lit(-1))).join(F.broadcast(model), ["g", "k"])
    weight = F.col("lp") + F.when(F.col("c").isNotNull(), F.log10(F.col("c") - known.discount)).otherwise(F.lit(0.0))
    base = F.log10((F.coalesce("c", F.lit(0)) + ADDED) / F.lit(known.total + ADDED * (known.distinct + 1)))
    sums = met.groupBy("key").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known"), F.sum(F.col("n") * base).alias("base"), F.sum(F.col("n") * weight).alias("score"))
    rows = read.drop("tail").join(sums, "key", "left")
    whole = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return rows.select("doc_id", "held_out", "n_tokens", whole("head_known", "known").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), F.round(whole("head_base", "base"), 9).alias("base_score"), F.round(whole("head_score", "score"), 9).alias("score"))


def op13_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return scored(table(spark, sf_dir, "documents"))
