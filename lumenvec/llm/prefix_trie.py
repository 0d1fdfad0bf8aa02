"""Conversation prefix trie by the Euler-tour technique.

Conversations are rebuilt from the turns that they share, and each distinct sequence of first turns (role, text)
is a node. A node's name is its smallest member and its depth; its identity is a digest of sums, over the turns of
the sequence, of hashes of (place, role, text), so that prefixes of one long conversation are running sums over
ranges of turns instead of one task's work.

Every node has an enter and an exit arc. Enter leads to the first child's enter, or to the node's own exit; exit
leads to the next sibling's enter, or to the parent's exit. Siblings are ordered by name over ranges, so that a
node with any number of children is no one task's work either. The tour is list-ranked: (1) ranges of arcs follow
their own links and are left with segments, (2) segments are spliced into those before them in rounds, by coins
that are hashes, until at most rest of them are left (a bound, not a share), which one task ranks, (3) what was
spliced gets its place back in reverse. A rank carries three prefix sums (arcs, leaves, savings), and what lies
between a node's two arcs is its subtree's.

Digests of the members that end at a node are those of long strings: ranges of ids are joined to chunks by their
tasks, and a chunk is all that a node's one hash is fed at a time.

Defined cases: turns are ordered by turn (null first), those of one turn by a digest of role and text; equal rows
are turns of their own; null role or text is empty; rows with a null conv_id belong to no conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, table, tune
from .scan import ROWS, parts, ranged, running

#: Segments that one task ranks.
REST = 1 << 15
#: Ids of a chunk.
CHUNK = 4096
#: Fixed values of the task: conversations of one base, and the most turns that are taken from it and one more.
FAMILY, SHARED = 5, 9
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, said (digest of role and text), bytes of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id is not null")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of the rebuilt conversations; their turns as conv_id, place, said, bytes, last."""
    own = staged(turns(conversations), "turns").withColumn("one", F.lit(1).cast("long"))
    ranks = running(ranged(own, ["conv_id", "turn", "said"], "ordered"), "conv_id", ["turn", "said"], ["one"])
    ranks = staged(ranks.select("conv_id", F.col("total_one").alias("rank"), "said", "bytes"), "ranks")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = staged(ranks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    taken = sizes.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED})
    taken = taken.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    first = F.least("h", F.coalesce("base_size", F.lit(0)))
    lengths = staged(taken.select("conv_id", "base", "h", first.alias("first"), (first + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    after = ranks.join(lengths, "conv_id").where("rank > h").select("conv_id", (F.col("first") + F.col("rank") - F.col("h")).alias("place"), "said", "bytes", "length")
    given = ranks.where(F.col("rank") < SHARED).withColumnRenamed("conv_id", "base").join(lengths.where("first > 0"), "base").where("rank <= first").select("conv_id", F.col("rank").alias("place"), "said", "bytes", "length")
    return lengths.select("conv_id", "length"), staged(after.union(given).withColumn("last", F.col("place") == F.col("length")).drop("length"), "rebuilt")


def _key(place: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", place, *sums), 256), 1, 32))


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent (keys of the node of the first depth turns, and of one less), bytes, last."""
    hashed = F.sha2(F.concat(F.col("place").cast("string").cast("binary"), F.lit(":").cast("binary"), "said"), 256)
    names = [f"s{i}" for i in range(4)]
    pieces = {c: F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long") for i, c in enumerate(names)}  # 32 bits each: sums stay far below 64
    terms = ranged(rows.withColumns(pieces).drop("said"), ["conv_id", "place"], "terms")
    summed = running(terms, "conv_id", ["place"], names)
    key = _key(F.col("place"), [F.col(f"total_{c}") for c in names])
    parent = _key(F.col("place") - 1, [F.col(f"total_{c}") - F.col(c) for c in names])
    return staged(summed.select("conv_id", F.col("place").alias("depth"), key.alias("key"), parent.alias("parent"), "bytes", "last"), "paths")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) as key, first id and the ids of a run joined by commas, at most CHUNK to a row."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, at = [], 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and to - at < CHUNK and keys[to] == keys[at]:
                to += 1
            out.append((keys[at], ids[at], ",".join(map(str, ids[at:to])).encode()))
            at = to
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to one digest a key; only a hash is kept from one chunk to the next."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done])], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def ends(members: DataFrame, rows: int = ROWS) -> DataFrame:
    """key, ends_sha256 from key, conv_id (a written table)."""
    chunks = members.repartitionByRange(parts(members, rows), "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_joined_ids, "key binary, first long, ids binary")
    return staged(chunks, "chunks").repartition(shuffle_partitions(members.sparkSession), "key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed_ids, "key binary, ends_sha256 string")


def nodes(lengths: DataFrame, steps: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, first_child, saved (of the node itself), ends_sha256."""
    root_key = F.lit(b"")
    root = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    found = steps.groupBy("key", "parent", "depth", "bytes").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    found = staged(found, "nodes")
    above = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    first = root.first()
    # A table of its own: the children of one node can be split in the join.
    linked = staged(found.where("depth > 1").join(above, "parent").select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "bytes"), "linked")
    top = found.where("depth = 1").select("key", "conv_id", "depth", F.lit(first["conv_id"] if first else None).cast("long").alias("parent_conv_id"), "n_convs", "bytes")
    whole = linked.union(top).union(root.select(root_key, "conv_id", F.lit(0).cast("long"), F.lit(None).cast("long"), "n_convs", F.lit(0).cast("long")))
    members = staged(steps.where("last").select("key", "conv_id").union(lengths.where("length = 0").select(root_key, "conv_id")), "members")
    children = linked.union(top).groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child"))
    told = whole.join(ends(members), "key", "left").join(children, ["conv_id", "depth"], "left")
    return staged(told.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")), "trie")


def with_siblings(trie: DataFrame, rows: int = ROWS) -> DataFrame:
    """trie with sibling, the next child of the same parent by conv_id, or null."""
    here = ranged(trie, ["parent_conv_id", "depth", "conv_id"], "siblings", rows)
    one = F.struct("parent_conv_id", "depth", "conv_id")
    firsts = here.groupBy("part").agg(F.min(one).alias("first"))  # a row for each range
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("follows"))
    after = F.coalesce(F.lead(one).over(Window.partitionBy("part").orderBy("parent_conv_id", "depth", "conv_id")), F.col("follows"))
    wide = here.join(F.broadcast(firsts), "part").withColumn("after", after)
    same = (F.col("after.parent_conv_id") == F.col("parent_conv_id")) & (F.col("after.depth") == F.col("depth"))
    return wide.select(*trie.columns, F.when(same, F.col("after.conv_id")).alias("sibling"))


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256")
_LINK = ("enter_conv", "enter_code", "enter_arcs", "enter_leaves", "enter_saved", "exit_conv", "exit_code", "exit_arcs", "exit_leaves", "exit_saved")
_CONTRACTED = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, ends_sha256 string, " + ", ".join(f"{c} long" for c in _LINK)
SUMS = ("arcs", "leaves", "saved")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of nodes in order of (conv_id, depth), its links followed as far as they stay inside: a row for each
    node (segment and offsets of both arcs), and one for each segment (no conv_id; enter_: its first arc and its
    sums; exit_conv, exit_code: the arc that follows it). An arc is a conv_id and 2 * depth, 1 more for exits."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    n = rows.num_rows
    number = lambda c: pc.fill_null(rows.column(c), 0).to_numpy()
    held = lambda c: pc.is_valid(rows.column(c)).to_numpy(zero_copy_only=False)
    conv, depth, up, down, aside = (number(c) for c in ("conv_id", "depth", "parent_conv_id", "first_child", "sibling"))
    leaf, has_next, has_up = ~held("first_child"), held("sibling"), held("parent_conv_id")
    next_conv = np.concatenate([np.where(leaf, conv, down), np.where(has_next, aside, up)])
    next_code = np.concatenate([np.where(leaf, 2 * depth + 1, 2 * depth + 2), np.where(has_next, 2 * depth, 2 * depth - 1)])
    ended = np.concatenate([np.zeros(n, bool), ~has_next & ~has_up])
    names, starts = np.unique(conv, return_index=True)  # depths of one conversation's own nodes follow each other
    at = np.minimum(np.searchsorted(names, next_conv), len(names) - 1)
    row = starts[at] + next_code // 2 - depth[starts[at]]
    inside = (names[at] == next_conv) & (row >= starts[at]) & (row < np.append(starts[1:], n)[at]) & ~ended
    target = np.where(inside, row + n * (next_code % 2), -1)
    before = np.arange(2 * n)
    before[target[inside]] = np.flatnonzero(inside)
    weight = np.zeros((2 * n, 3), np.int64)
    weight[:, 0], weight[:n, 1], weight[:n, 2] = 1, leaf, number("saved")
    total = np.where((before != np.arange(2 * n))[:, None], weight[before], 0)
    while not np.array_equal(before, before[before]):
        total, before = total + total[before], before[before]
    arc_conv, arc_code = np.tile(conv, 2), np.concatenate([2 * depth, 2 * depth + 1])
    node = [rows.column(c).combine_chunks() for c in NODE] + [pa.array(x) for i in (slice(n), slice(n, None)) for x in (arc_conv[before[i]], arc_code[before[i]], *total[i].T)]
    schema = pa.schema([(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in (*NODE, *_LINK)])
    yield from pa.Table.from_arrays(node, schema=schema).to_batches(8192)
    tail = np.flatnonzero(target < 0)
    none = pa.nulls(len(tail), pa.int64())
    whole = (total + weight)[tail]
    last = pa.array(ended[tail])
    segment = [none] * 5 + [pa.nulls(len(tail), pa.string())] + [pa.array(x) for x in (arc_conv[before[tail]], arc_code[before[tail]], *whole.T)] + [pc.if_else(last, None, pa.array(x)) for x in (next_conv[tail], next_code[tail])] + [none] * 3
    yield from pa.Table.from_arrays(segment, schema=schema).to_batches(8192)


def _ranked_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All segments that are left, with the sums of those before them."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    rows = pa.Table.from_batches(got).to_pydict()
    at = {k: i for i, k in enumerate(zip(rows["conv"], rows["code"], strict=True))}
    follows = [at.get(k) for k in zip(rows["next_conv"], rows["next_code"], strict=True)]
    i = next(iter(set(range(len(follows))) - set(follows)))
    out, sums = [], [0, 0, 0]
    while i is not None:
        out.append((rows["conv"][i], rows["code"][i], *sums))
        sums = [s + rows[c][i] for s, c in zip(sums, SUMS, strict=True)]
        i = follows[i]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["conv", "code", *SUMS])


def list_ranked(segments: DataFrame, rest: int = REST) -> DataFrame:
    """conv, code and the sums of all segments before, from conv, code, next_conv, next_code, sums (a written table).
    In a round, a segment whose coin is heads takes in the one after it whose coin is tails: a quarter goes."""
    spliced, level = [], 0
    while segments.count() > rest:
        heads = F.pmod(F.xxhash64("conv", "code", F.lit(level)), F.lit(2)) == 0
        tails = segments.where(~heads).select(*(F.col(c).alias(f"t_{c}") for c in segments.columns))
        met = staged(segments.where(heads).join(tails, (F.col("next_conv") == F.col("t_conv")) & (F.col("next_code") == F.col("t_code")), "left"), "splices")
        hit = F.col("t_conv").isNotNull()
        longer = met.select("conv", "code", *(F.when(hit, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in ("next_conv", "next_code")), *((F.col(c) + F.coalesce(f"t_{c}", F.lit(0))).alias(c) for c in SUMS))
        spliced.append(met.where(hit).select(F.col("t_conv").alias("conv"), F.col("t_code").alias("code"), F.col("conv").alias("into_conv"), F.col("code").alias("into_code"), *(F.col(c).alias(f"off_{c}") for c in SUMS)))
        segments = staged(longer.union(segments.where(~heads).join(spliced[-1].select("conv", "code"), ["conv", "code"], "left_anti").select(longer.columns)), "segments")
        level += 1
    ranks = staged(segments.coalesce(1).mapInArrow(_ranked_here, "conv long, code long, arcs long, leaves long, saved long"), "ranks")
    for gone in reversed(spliced):
        into = ranks.select(F.col("conv").alias("into_conv"), F.col("code").alias("into_code"), *SUMS)
        back = gone.join(into, ["into_conv", "into_code"]).select("conv", "code", *((F.col(c) + F.col(f"off_{c}")).alias(c) for c in SUMS))
        ranks = staged(ranks.union(back), "ranks")
    return ranks


def toured(trie: DataFrame, rows: int = ROWS, rest: int = REST) -> DataFrame:
    """trie's nodes with n_leaves, saved_tokens and the places of both arcs in the tour."""
    linked = staged(with_siblings(trie, rows), "linked")
    arcs = linked.repartitionByRange(parts(linked, rows), "conv_id", "depth").sortWithinPartitions("conv_id", "depth").mapInArrow(_contracted, _CONTRACTED)
    arcs = staged(arcs, "arcs")
    kept = {"enter_conv": "conv", "enter_code": "code", "exit_conv": "next_conv", "exit_code": "next_code", "enter_arcs": "arcs", "enter_leaves": "leaves", "enter_saved": "saved"}
    ranks = list_ranked(arcs.where("conv_id is null").select(*(F.col(c).alias(a) for c, a in kept.items())), rest)
    out = arcs.where("conv_id is not null")
    for side in ("enter", "exit"):
        out = out.join(ranks.select(F.col("conv").alias(f"{side}_conv"), F.col("code").alias(f"{side}_code"), *(F.col(c).alias(f"{side}_base_{c}") for c in SUMS)), [f"{side}_conv", f"{side}_code"])
    at = {f"{side}_{c}": F.col(f"{side}_base_{c}") + F.col(f"{side}_{c}") for side in ("enter", "exit") for c in SUMS}
    between = lambda c: at[f"exit_{c}"] - at[f"enter_{c}"]
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", between("leaves").alias("n_leaves"), between("saved").alias("saved_tokens"), "ends_sha256", at["enter_arcs"].alias("enter_at"), at["exit_arcs"].alias("exit_at"))


def prefix_trie(conversations: DataFrame, rows: int = ROWS, rest: int = REST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at, exit_at."""
    lengths, turns_ = rebuilt(conversations)
    return toured(nodes(lengths, paths(turns_)), rows, rest)


def op11_euler_tour_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
with t as (
  select conv_id, octet_length(encode(coalesce(text, ''))) as bytes, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as said,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as rank
  from conversations where conv_id is not null
), z as (
  select conv_id, conv_id - conv_id % 5 as base, count(*) as size, xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda d, i: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end)))) % 9 as h
  from t group by conv_id
), l as (
  select z.conv_id, z.base, z.h, least(z.h, coalesce(b.size, 0)) as first, least(z.h, coalesce(b.size, 0)) + greatest(z.size - z.h, 0) as length
  from z left join z b on b.conv_id = z.base
), r as (
  select t.conv_id, l.first + t.rank - l.h as place, said, bytes from t join l using (conv_id) where rank > h
  union all
  select l.conv_id, t.rank, said, bytes from t join l on t.conv_id = l.base where rank <= first
), p as (
  select conv_id, place as depth, bytes, md5(array_to_string(list(said) over (partition by conv_id order by place), ',')) as key from r
  union all
  select conv_id, 0, 0, '' from l
), n as (
  select key, depth, max(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs from p group by key, depth
), c as (
  select n.*, u.key as up, u.conv_id as parent_conv_id from n left join p on p.conv_id = n.conv_id and p.depth = n.depth - 1 left join n u on u.key = p.key and u.depth = p.depth
), k as (
  select c.*, coalesce(x.n_children, 0) as n_children from c left join (select up, depth - 1 as depth, count(*) as n_children from c where depth > 0 group by all) x on x.up = c.key and x.depth = c.depth
), s as (
  select p.key, p.depth, sum((k.n_children = 0)::bigint) as n_leaves, sum((k.n_convs - 1) * k.bytes) as saved_tokens
  from k join p on p.conv_id = k.conv_id and p.depth <= k.depth group by all
), e as (
  select p.key, p.depth, string_agg(l.conv_id::varchar, ',' order by l.conv_id) as ids from l join p on p.conv_id = l.conv_id and p.depth = l.length group by all
), w as (
  select k.conv_id, k.depth, k.key, row_number() over (order by path) as place from k join (
    select c.conv_id, c.depth, list(u.conv_id order by u.depth) as path from c join p on p.conv_id = c.conv_id and p.depth <= c.depth join n u on u.key = p.key and u.depth = p.depth group by all
  ) using (conv_id, depth)
), d as (
  select w.conv_id, w.depth, w.place, count(*) as within from w join p on p.key = w.key and p.depth = w.depth join k v on v.conv_id = p.conv_id and v.depth >= w.depth group by all
)
select k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256,
  (2 * (d.place - 1) - k.depth)::bigint as enter_at, (2 * (d.place - 1) - k.depth + 2 * d.within - 1)::bigint as exit_at
from k join s on s.key = k.key and s.depth = k.depth left join e on e.key = k.key and e.depth = k.depth join d on d.conv_id = k.conv_id and d.depth = k.depth
"""
