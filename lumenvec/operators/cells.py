"""Exact nearest vectors by cells (J8, J9): the gallery lies in cells around pivots, and a cell that cannot hold a
probe's k best is left out for it.

Pivots are gallery vectors (those of the smallest hashes, about the square root of their number, at most PIVOTS).
Every vector goes to its nearest pivot p, and a cell keeps its radius R, the largest distance to p. For a probe q and
any v of the cell, q.v = q.p + q.(v - p) lies within |q| R of q.p, for vectors of any length. The k best reach at
least the k-th best of the pivots themselves, and the lower ends of cells that hold k vectors together; cells whose
upper ends lie below that hold none of them. The rest are tiles of bounded rows, as in similarity.nearest, whose rows
these are; no recall is given up. What is saved depends on the data:
tight clusters leave most cells out, vectors without structure none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import staged
from .similarity import BLOCK, best_of_tile, matrix, ranked, sides

PIVOTS = 1024
#: Rows that are held against all pivots at once; a row may be asked of every cell.
SLICE = 128
#: Share of |q| times the longest vector by which rounding may move a product.
ROUNDING = 1e-9

_FOUND = "probe long, identity string, pos long, sim double"


@dataclass
class Search:
    #: probe, identity, pos, sim, rank
    found: DataFrame
    #: probe, products (vectors it was multiplied with, pivots not counted)
    asked: DataFrame
    #: vectors of the gallery
    size: int


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most: some matrices of rows by pivots are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def nearest_in_cells(probes: DataFrame, gallery: DataFrame, k: int, per_vector: bool = True, own: str | None = None, pivots: int = PIVOTS) -> Search:
    """As similarity.nearest."""
    left, right = sides(probes, gallery, own)
    right = staged(right, "gallery")
    n = right.count()
    most = min(pivots, max(1, math.ceil(math.sqrt(n))))
    chosen = right.orderBy(F.xxhash64("identity", "pos"), "identity", "pos").limit(most).toPandas()  # PIVOTS vectors at most
    p = np.array(chosen["embedding"].tolist(), np.float64) if len(chosen) else np.zeros((0, 0))
    names, own_of = chosen["identity"].to_numpy(object), chosen["own"].to_numpy(np.float64, na_value=np.nan)
    squares = (p * p).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if batch.num_rows:
                x = matrix(pa.chunked_array([batch.column("embedding")]))
                cell = (squares[None, :] - 2 * x @ p.T).argmin(axis=1)
                radius = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(np.sqrt((x * x).sum(axis=1)))], [*batch.schema.names, "cell", "radius", "length"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in right.schema)
    dealt = staged(right.mapInArrow(assign, f"{kinds}, cell int, radius double, length double"), "cells")
    by_name = dealt.groupBy("cell", "identity").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius"), F.max("length").alias("length"))
    sizes = by_name.groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("names"), F.max("radius").alias("radius"), F.max("length").alias("length"))
    sizes = staged(sizes, "sizes")
    told = sizes.toPandas()  # a row for each pivot at most
    held, reach, various = np.zeros(len(p), np.int64), np.full(len(p), -np.inf), np.zeros(len(p), np.int64)
    held[told["cell"]], reach[told["cell"]], various[told["cell"]] = told["n"], told["radius"], told["names"]
    enough = k + (own is not None)  # the probe's own vector may be among them
    longest = float(told["length"].max()) if len(told) else 0.0

    def bound(s: np.ndarray) -> np.ndarray:
        """The k-th best of each row, of different names if names count; -inf where there are fewer."""
        out = np.full(len(s), -np.inf)
        if per_vector:
            if s.shape[1] >= k:
                out = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
            return out
        for i, row in enumerate(s):
            best: dict[str, float] = {}
            for name, x in zip(names, row, strict=True):
                best[name] = max(best.get(name, -np.inf), x)
            if len(best) >= k:
                out[i] = sorted(best.values())[-k]
        return out

    def floor(low: np.ndarray) -> np.ndarray:
        """What k vectors (or names) reach, from the lower ends of the cells: of the best cells that hold enough
        together, or, for names, of the best one that holds enough of them itself."""
        if not per_vector:
            return np.where(various >= enough, low, -np.inf).max(axis=1, initial=-np.inf)
        order = np.argsort(-low, axis=1)
        total = np.cumsum(held[order], axis=1)
        at = np.minimum((total < enough).sum(axis=1), low.shape[1] - 1)
        reached = np.take_along_axis(low, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
        return np.where(total[:, -1] >= enough, reached, -np.inf)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if not batch.num_rows or not len(p):
                continue
            q = matrix(pa.chunked_array([batch.column("embedding")]))
            s, length = q @ p.T, np.sqrt((q * q).sum(axis=1))
            mine = batch.column("own").to_numpy(zero_copy_only=False).astype(np.float64)
            others = np.where(mine[:, None] == own_of[None, :], -np.inf, s)
            span = length[:, None] * np.maximum(reach, 0)[None, :]
            least = np.maximum(bound(others), floor(np.where(held > 0, s - span, -np.inf))) - ROUNDING * length * longest
            row, cell = np.nonzero((s + span >= least[:, None]) & (held > 0)[None, :])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema)
    asked = staged(left.mapInArrow(choose, f"{kinds}, cell int"), "asked")
    counts = sizes.select("cell", F.col("n").alias("vectors"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int").alias("_bj"))
    tiles = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asks")).join(counts, "cell").withColumn("_bi", F.ceil(F.col("asks") / BLOCK).cast("int"))
    tiles = F.broadcast(staged(tiles, "tiles"))  # a row for each pivot at most
    cut = lambda names, blocks: F.pmod(F.xxhash64(*names), F.col(blocks)).cast("int")
    one = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    a = asked.join(tiles, "cell").withColumn("_i", cut(["probe"], "_bi")).withColumn("_j", one("_bj")).select("cell", "_i", "_j", *left.columns)
    b = dealt.join(tiles, "cell").withColumn("_j", cut(["identity", "pos"], "_bj")).withColumn("_i", one("_bi")).select("cell", "_i", "_j", *right.columns)
    found = a.groupBy("cell", "_i", "_j").cogroup(b.groupBy("cell", "_i", "_j")).applyInArrow(best_of_tile(k, per_vector, own is not None), _FOUND)
    products = asked.join(tiles, "cell").groupBy("probe").agg(F.sum("vectors").alias("products"))
    return Search(ranked(found, k, per_vector), products, n)


def best_match_in_cells(probes: DataFrame, gallery: DataFrame, threshold: float, own: str | None = None) -> DataFrame:
    """As similarity.best_match."""
    found = nearest_in_cells(probes, gallery, 1, own=own).found
    return found.select("probe", F.when(F.col("sim") >= threshold, F.col("identity")).otherwise("Unknown").alias("name"), "sim")
