"""Near-duplicate documents: MinHash bands for candidates, odd sketches to weigh them, full sets to confirm.

A document is its set of word shingles. Documents with equal sets are one node from the start. Each
node has MinHash samples (the least value of each of bands * rows hash functions over its shingles),
folded into a parity bitmap (odd sketch): a sample that differs flips two bits, so the population count of
two sketches' XOR gives the similarity with a small error.

Nodes that share all samples of a band are a bucket; buckets of the same nodes are one. Sketches are
compared inside buckets, before any text moves: a bucket of two is an expression, larger ones are cut into
blocks of TILE nodes (80 bytes each), each two blocks are one tile, and a tile returns the components of
the pairs whose sketches agree to within MARGIN below the threshold, never all pairs. The connected
components of these are the groups that may hold links, and only their texts are read.

Within a group, cut into blocks of bounded rows and bytes, links are confirmed on the full shingle sets:
first inside each block, which is all for most groups; then among one document of each component found so
far; and only in groups that are still apart, between each two blocks. Pairs already connected are not
confirmed again, and a tile returns what its components merge into, so fewer rows than it has documents; a
group of near copies, however large, is read about once.

A link of similarity s is missed if no band agrees, (1 - s**rows) ** bands: 1e-9 at 0.85, 4e-7 at
0.8, or if the sketch errs by more than MARGIN, over five standard deviations.

A bucket of m nodes takes (m / TILE)**2 / 2 tiles of sketches, a group of m that falls into parts which no
two representatives link takes (m / BLOCK)**2 / 2 tiles of texts: the price of losing no link between
different texts. Exact copies, however many, cost nothing here.

Defined cases: null, empty or wordless texts have an empty set and are linked with nothing; fewer
words than a shingle make one shingle; rows with a null doc_id are linked with nothing (component
null, kept); rows of one doc_id count as one document, whatever their texts; an empty table gives
none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, fixed_lists, likely_in, shuffle_partitions, staged, table, text_slices, tune, words

ROWS, BANDS = 4, 28
SKETCH_BITS = 512
#: Estimated similarities this much below the threshold are still confirmed.
MARGIN = 0.2
#: Nodes of a block of sketches; a tile holds two.
TILE = 1024
#: Documents and bytes of text of a block; a tile holds two.
BLOCK, BLOCK_BYTES = 512, 4 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a public 64-bit mixing generator."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    index, ends, dictionary = words(texts, SPACED)
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in dictionary.cast(pa.binary()).to_pylist()), _U, len(dictionary))
    flat, factors = of[index], _numbers(size, 7) | _U(1)
    n = len(flat)
    run = np.zeros(n, _U)
    for k in range(min(size, n)):
        run[: n - k] += flat[k:] * factors[k]
    run, out = _mix(run), []
    for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if y - x >= size:
            out.append(np.unique(run[x : y - size + 1]))
        elif y > x:
            short = (flat[x:y] * factors[: y - x]).sum(dtype=_U) + _U(y - x)
            out.append(_mix(np.array([short], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash samples: n for each set (empty sets: the largest value)."""
    mul, add = _numbers(n, 11) | _U(1), _numbers(n, 13)
    out = np.full((len(sets), n), np.iinfo(_U).max, _U)
    for row, s in enumerate(sets):
        for at in range(0, len(s), 4096):
            out[row] = np.minimum(out[row], (np.multiply.outer(s[at : at + 4096], mul) + add).min(axis=0))
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: bit h is whether an odd number of them falls on it."""
    rows, n = samples.shape
    bit = _mix(samples + _numbers(n, 17)) % _U(SKETCH_BITS)
    at = bit.astype(np.int64) + np.arange(rows)[:, None] * SKETCH_BITS
    odd = np.bincount(at.ravel(), minlength=rows * SKETCH_BITS).reshape(rows, SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def estimated(flips: np.ndarray, n: int) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR, n samples each."""
    odd = np.minimum(flips / SKETCH_BITS * 2, 1 - 1e-9)
    return 1 - np.log1p(-odd) / np.log1p(-2 / SKETCH_BITS) / 2 / n


def signatures(docs: DataFrame, shingle: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, k1, k2 (name of the set), bands, sketch, bytes."""
    n = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, salt = _numbers(rows, 19) | _U(1), _numbers(bands, 23)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                sets = shingle_sets(texts, shingle)
                samples = minima(sets, n)
                keys = _mix((samples.reshape(len(sets), bands, rows) * fold).sum(axis=2, dtype=_U) + salt).view(np.int64)
                names = np.array([[xxhash.xxh3_64_intdigest(s.tobytes(), seed=k) for k in (1, 2)] for s in sets], _U).view(np.int64)
                band = fixed_lists(keys)
                sketch = fixed_lists(odd_sketches(samples).view(np.int64))
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                length = [len(t) for t in texts.cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(names[:, 0]), pa.array(names[:, 1]), band, sketch, pa.array(length, pa.int64())], ["doc_id", "digest", "n_shingles", "k1", "k2", "bands", "sketch", "bytes"])

    return _keyed(docs).mapInArrow(run, "doc_id long, digest long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>, bytes long")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge a - b, by alternating
    large and small stars until all are stars; each round is a written table, and a hub's edges are never one group:
    they meet partial minima, and their join has one row on the other side, which Spark's skew join may repeat."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").limit(1).count()

    while not stars(now):
        both = now.union(now.select("v", "u")).toDF("n", "m")
        # A table of its own, so that both sides of the join are shuffled for it and a hub's rows can be split.
        least = staged(both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo")), "least")
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("lo").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = large.join(least, "u").where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        now = staged(small.union(least.select("u", F.col("lo").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def most_flips(percent: int, n: int) -> int:
    """The largest population count at which two sketches of n samples may still reach the threshold."""
    flips = np.arange(SKETCH_BITS + 1)
    return int(flips[estimated(flips, n) >= percent / 100 - MARGIN].max())


def _alike(size: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes can be as similar as that."""
    return 100 * F.least(size, other) >= percent * F.greatest(size, other)


def parts_of(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of flags, the first row that it is connected with."""
    out, rest = np.arange(len(near)), np.ones(len(near), bool)
    for first in range(len(near)):
        if not rest[first]:
            continue
        rest[first], queue = False, [first]
        while queue:
            new = np.flatnonzero(near[queue.pop()] & rest)
            rest[new], out[new] = False, first
            queue += new.tolist()
    return out


def _sketch_tiles(percent: int, n: int):
    """Each tile's likely pairs as stars, each node with the smallest it is connected with; rows come sorted by tile."""
    most = most_flips(percent, n)

    def likely(rows: list[dict]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: r["rep"])
        x = np.array([r["sketch"] for r in rows], np.int64).view(_U)
        size, low = np.array([r["n_shingles"] for r in rows]), np.array([r["block"] == r["lo"] for r in rows])
        near = np.zeros((len(rows), len(rows)), bool)
        for i in range(len(rows)):
            near[i] = (np.bitwise_count(x[i] ^ x).sum(axis=1) <= most) & (100 * np.minimum(size[i], size) >= percent * np.maximum(size[i], size))
        if rows[0]["lo"] != rows[0]["hi"]:
            near &= low[:, None] != low[None, :]
        return [(rows[i]["rep"], r["rep"]) for i, r in zip(parts_of(near).tolist(), rows, strict=True) if rows[i]["rep"] != r["rep"]]

    return _by_tile(("key", "lo", "hi"), likely)


def _by_tile(key: tuple[str, ...], pairs):
    """A mapInArrow function that gives pairs() of each run of rows with one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (now := tuple(r[k] for k in key)) != last:
                    out += pairs(held) if held else []
                    held, last = [], now
                held.append(r)
            yield told(out)
        if held:
            yield told(pairs(held))

    def told(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _text_tiles(percent: int, shingle: int, n: int):
    """Of each tile, the components that confirmed links merge, each with the smallest; rows come sorted by tile."""
    most = most_flips(percent, n)

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        rows = list({(r["rep"], r["digest"]): r for r in rows}.values())
        sets = shingle_sets(pa.array([r["text"] for r in rows], pa.string()), shingle)
        sketch = np.array([r["sketch"] for r in rows], np.int64).view(_U)
        size, low = np.fromiter(map(len, sets), np.int64, len(sets)), np.array([r["block"] == r["lo"] for r in rows])
        left = np.flatnonzero(low)
        right = left if rows[0]["lo"] == rows[0]["hi"] else np.flatnonzero(~low)
        flips, first, second = [], [], []
        for i in left.tolist():
            js = right[right > i] if right is left else right
            f = np.bitwise_count(sketch[i] ^ sketch[js]).sum(axis=1)
            near = (f <= most) & (100 * np.minimum(size[i], size[js]) >= percent * np.maximum(size[i], size[js]))
            flips.append(f[near])
            first.append(np.full(int(near.sum()), i))
            second.append(js[near])
        order = np.argsort(np.concatenate(flips), kind="stable") if flips else []
        names = sorted({r["component"] for r in rows})
        node = {c: k for k, c in enumerate(names)}
        of, root, apart = [node[r["component"]] for r in rows], list(range(len(names))), len(names)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in zip(np.concatenate(first)[order].tolist(), np.concatenate(second)[order].tolist(), strict=True) if len(order) else ():
            if apart == 1:
                break
            if (x := find(of[i])) != (y := find(of[j])):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    root[max(x, y)], apart = min(x, y), apart - 1
        return [(names[x], names[k]) for k in range(len(names)) if (x := find(k)) != k]

    return _by_tile(("group", "lo", "hi"), links)


def likely_pairs(nodes: DataFrame, percent: int, n: int) -> DataFrame:
    """a, b: pairs of nodes that connect all nodes which share a bucket and whose sketches agree."""
    parts = shuffle_partitions(nodes.sparkSession)
    band = nodes.select(F.explode("bands").alias("key"), "rep")
    # Tables of their own, so that the joins' sides are plain exchanges and a large bucket's rows can be split.
    shared = staged(band.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key"), "shared")
    held = staged(band.join(shared, "key"), "held")
    name = [F.count(F.lit(1)).alias("n"), F.min("rep").alias("a"), F.max("rep").alias("z"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(1 << 31))).alias("s")]
    buckets = staged(held.groupBy("key").agg(*name).groupBy("n", "a", "z", "x", "s").agg(F.min("key").alias("key")), "buckets")
    side = nodes.select("rep", "sketch", "n_shingles")
    two = buckets.where("n = 2").select("a", "z").distinct()
    both = two.join(side.toDF("a", "sa", "na"), "a").join(side.toDF("z", "sz", "nz"), "z")
    flips = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sz")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    pairs = both.where((flips <= most_flips(percent, n)) & _alike(F.col("na"), F.col("nz"), percent)).select("a", F.col("z").alias("b"))
    blocks = buckets.where("n > 2").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    placed = held.join(blocks, "key").distinct().join(side, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "sketch", "n_shingles")
    dealt = tiled.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return pairs.unionByName(dealt.mapInArrow(_sketch_tiles(percent, n), "a long, b long"))


def confirmed(texts: DataFrame, percent: int, shingle: int, n: int, tiles: str) -> DataFrame:
    """a, b: component b and a larger one, a, which links of texts (group, rep, digest, bytes, sketch, component,
    text) merge with it, by tiles of each block of a group with itself (tiles own), with each other (cross), or
    both (all)."""
    parts = shuffle_partitions(texts.sparkSession)
    blocks = texts.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = texts.join(staged(blocks, "blocks"), "group").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.array("block") if tiles == "own" else F.sequence(F.lit(0), F.col("blocks") - 1)
    tiled = placed.withColumn("other", F.explode(others)).where(F.lit(tiles != "cross") | (F.col("block") != F.col("other")))
    tiled = tiled.select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "digest", "sketch", "component", "text")
    dealt = tiled.repartition(parts, "group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
    found = staged(dealt.mapInArrow(_text_tiles(percent, shingle, n), "b long, a long"), "links")
    if tiles == "own":
        return found.select("a", "b")  # a component is in one tile
    return connected(found).where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def components(docs: DataFrame, nodes: DataFrame, percent: int, shingle: int, n: int) -> DataFrame:
    """rep, component: the smallest node that links lead to, for every node that may have one."""
    groups = staged(connected(likely_pairs(nodes, percent, n)).select(F.col("node").alias("rep"), F.col("component").alias("group")), "groups")
    member = staged(nodes.select("rep", "digest", "bytes", "sketch").join(groups, "rep"), "members")
    text = likely_in(_keyed(docs).withColumnRenamed("doc_id", "rep"), member, ["rep", "digest"])
    texts = staged(text.join(member, ["rep", "digest"]), "texts")
    label = groups.select("rep", "group", F.col("rep").alias("component"))
    size = member.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))
    large = staged(size.where((F.col("m") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("group"), "large")

    def merged(label: DataFrame, found: DataFrame) -> DataFrame:
        """label by what its components merge into."""
        to = found.select(F.col("a").alias("component"), F.col("b").alias("to"))
        return staged(label.join(to, "component", "left").select("rep", "group", F.coalesce("to", "component").alias("component")), "labels")

    label = merged(label, confirmed(texts.withColumn("component", F.col("rep")), percent, shingle, n, "own"))
    for tiles in ("all", "cross"):
        apart = label.join(large, "group", "left_semi").groupBy("group").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a < z")
        large = staged(apart.select("group"), "large")
        if not large.limit(1).count():
            break
        of = label.join(large, "group", "left_semi").where(F.lit(tiles == "cross") | (F.col("rep") == F.col("component")))
        label = merged(label, confirmed(texts.join(of.select("rep", "component"), "rep"), percent, shingle, n, tiles))
    return label.select("rep", "component")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, digest, n_shingles, component_id, kept: one row for each row of docs."""
    sig = staged(signatures(docs, shingle, rows, bands), "signatures")
    sets = sig.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    sets = staged(sets, "sets")
    nodes = staged(sig.join(sets, ["k1", "k2"]).where("doc_id = rep").select("rep", "digest", "n_shingles", "bands", "sketch", "bytes"), "nodes")
    named = sets.join(components(docs, nodes, percent, shingle, rows * bands), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    # A table of its own: the rows of a set with very many copies can be split in the join.
    out = sig.select("doc_id", "digest", "n_shingles", "k1", "k2").join(staged(named, "named"), ["k1", "k2"], "left")
    alone = F.col("n_shingles") == 0
    component_id = F.when(F.col("doc_id").isNull(), None).when(alone, F.col("doc_id")).otherwise(F.col("c"))
    return out.select("doc_id", "digest", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near-duplicates of a smaller doc_id. Repeated rows of one doc_id are one document
    and stay together."""
    name = f"gone_{uuid.uuid4().hex}"
    gone = near_duplicates(docs, shingle, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name), F.col("digest").alias(f"{name}_digest")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(gone, (F.col("doc_id") == F.col(name)) & (F.xxhash64(text) == F.col(f"{name}_digest")), "left_anti")


def op4_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, list_slice(w, i, i + 2) as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by 1
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)
), e as (
  select a, b from l union select b, a from l
), r as (
  select a as doc_id, a as z from e
  union
  select r.doc_id, e.b from r join e on e.a = r.z
), c as (
  select doc_id, min(z) as c from r group by 1
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, doc_id) as component_id, doc_id = coalesce(c, doc_id) as kept from d left join n using (doc_id) left join c using (doc_id)
"""
