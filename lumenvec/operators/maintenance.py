"""Table maintenance: dedupe, merge, append, delete, label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.sinks import staged
from .similarity import alike_rows, hamming_join, matrix, most_similar

#: Vectors of an identity that one task decides in order at most, and the bits of a range's rows by which they are counted.
SEGMENT, RANGE_BITS = 8192, 10


def drop_repeats(faces: DataFrame, key: list[str], threshold: float = 0.95) -> DataFrame:
    """det_id, kept: a face at least threshold like the last kept one of its group goes. A group's rows come to
    one task sorted and are read as they come; all that is held is a batch and the last kept vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for batch in batches:
            kept = []
            for now, v in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), matrix(pa.chunked_array([batch.column("embedding")])), strict=True):
                if now != group:
                    group, last = now, None
                kept.append(last is None or float(v @ last) < threshold)
                last = v if kept[-1] else last
            yield pa.RecordBatch.from_arrays([batch.column("det_id"), pa.array(kept, pa.bool_())], ["det_id", "kept"])

    ordered = faces.select(*key, "frame", "det_id", "embedding").repartition(*key).sortWithinPartitions(*key, "frame", "det_id")
    return ordered.mapInArrow(run, "det_id long, kept boolean")


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that a greedy pass in order of id keeps: an id goes if a kept smaller one is joined to it by edges
    (a < b). Rounds decide all ids whose smaller neighbours are decided; each is a written table. Joins are by sort: files of ids are so small against their rows that Spark would
    take tables of millions of ids for ones to broadcast through the driver, anew in each round."""
    state = staged(nodes.select("id", F.lit(None).cast("boolean").alias("kept")), "greedy")
    e = staged(edges.select("a", "b").distinct(), "greedy-edges")
    while state.where("kept is null").limit(1).count():
        told = e.join(state.select(F.col("id").alias("a"), "kept").hint("merge"), "a").groupBy(F.col("b").alias("id")).agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("_hit"), F.bool_or(F.col("kept").isNull()).alias("_open"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("_hit", F.lit(False)), False).when(F.coalesce("_open", F.lit(False)), None).otherwise(True)
        state = staged(state.join(told.hint("merge"), "id", "left").select("id", now.alias("kept")), "greedy")
    return state.where("kept").select("id")


def keep_apart(rows: DataFrame, alike: float) -> DataFrame:
    """Ids of rows (identity, id, embedding) that a greedy pass in order of id keeps: a row goes if its product with a
    kept smaller one of its identity is over alike. No pair is stored: identities are cut into segments in order of id;
    of two halves, the first is decided, what is like a kept row of it goes from the second by tiles, and what is left
    is decided in turn. A segment, or what is left of many, is decided by one task for each identity. Rows without
    identity or vector stay."""
    ordered = rows.select("identity", "id", "embedding").orderBy("identity", "id")
    every = staged(ordered.withColumn("_range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)), "ordered")  # numbers in order
    pairable = F.col("identity").isNotNull() & F.col("embedding").isNotNull()
    held = every.where(pairable)
    before = F.sum("n").over(Window.partitionBy("identity").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = held.groupBy("identity", "_range").agg(F.count(F.lit(1)).alias("n"))
    place = F.floor(F.coalesce(before, F.lit(0)) / (SEGMENT - (1 << RANGE_BITS)))
    segments = staged(sizes.select("identity", "_range", place.alias("_part")), "segments")
    parts = (segments.agg(F.max("_part")).first()[0] or 0) + 1

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x, kept = matrix(t.column("embedding")), np.zeros(0, int)
        for low in range(0, len(x), 256):
            some = x[low : low + 256]
            free, near = ~(some @ x[kept].T > alike).any(axis=1), some @ some.T > alike
            for i in range(len(some)):
                if free[i]:
                    free[i + 1 :] &= ~near[i, i + 1 :]
            kept = np.append(kept, low + np.flatnonzero(free))
        return t.take(pa.array(kept))

    def decide(left: DataFrame, low: int, high: int, known: bool) -> DataFrame:
        """Kept rows of the segments low to high, none of which is like a row kept of those before."""
        largest = None if known or high - low == 1 else left.groupBy("identity").count().agg(F.max("count")).first()[0] or 0
        if high - low == 1 or (largest is not None and largest <= SEGMENT):
            return staged(left.groupBy("identity").applyInArrow(first, left.schema), "kept")
        middle = (low + high) // 2
        kept = decide(left.where(F.col("_part") < middle), low, middle, known)
        rest = left.where(F.col("_part") >= middle)
        gone = alike_rows(rest, kept, "identity", "id", alike).withColumn("_gone", F.lit(True)).hint("merge")
        # Marked and filtered: an anti join would be moved below the join with segments and shuffle the first half, too.
        stays = rest.join(gone, ["identity", "id"], "left").where("_gone is null").drop("_gone")
        return kept.union(decide(staged(stays, "left"), middle, high, False))

    kept = decide(held.join(segments, ["identity", "_range"]).drop("_range"), 0, parts, True)
    return kept.select("id").union(every.where(~pairable).select("id"))


def dedupe(rows: DataFrame, most_bits: int = 5, alike: float = 0.85) -> DataFrame:
    """Ids kept of rows (id, identity, phash, embedding): by hash first, then, of what is left, by vectors
    within an identity; the earlier one stays."""
    first = staged(rows.groupBy(F.lower("phash").alias("phash")).agg(F.min("id").alias("id")), "first")
    by_hash = greedy_keep(first, hamming_join(first, most_bits).where("distance > 0"))
    return keep_apart(rows.join(by_hash.hint("merge"), "id", "left_semi"), alike)


def merge_galleries(target: DataFrame, source: DataFrame, same: float = 0.9999) -> DataFrame:
    """Identity, embedding, added: the target and those source vectors that no vector of their identity,
    earlier added ones included, equals by more than same. New identities come whole. What the target holds is found
    by tiles; of what is left, equal copies are one, and rows are decided in order (keep_apart)."""
    t = target.select("identity", "embedding")
    names = t.select("identity").distinct()
    s = staged(source.select("identity", "pos", "embedding").orderBy("identity", "pos").withColumn("id", F.monotonically_increasing_id()), "source")  # numbers in order
    fresh = s.join(names, "identity", "left_anti")
    asked = s.join(names, "identity", "left_semi")
    known = most_similar(asked, t, "identity", "id").where(F.col("max_sim") > same)
    left = staged(asked.join(known.select("id"), "id", "left_anti"), "unknown")
    itself = dot(F.col("embedding"), F.col("embedding")) > same
    first = F.row_number().over(Window.partitionBy("identity", "embedding").orderBy("id"))
    nodes = staged(left.withColumn("_n", first).where((F.col("_n") == 1) | ~itself).drop("_n"), "nodes")
    added = fresh.unionByName(nodes.join(keep_apart(nodes, same), "id", "left_semi").select(fresh.columns))
    return t.withColumn("added", F.lit(False)).unionByName(added.select("identity", "embedding").withColumn("added", F.lit(True)))


def delete_actors(actors: DataFrame, cast: DataFrame, gallery: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1: the three tables without the actors of gone (id, name)."""
    ids = gone.select("id")
    return actors.join(ids, "id", "left_anti"), cast.join(ids.withColumnRenamed("id", "actor_id"), "actor_id", "left_anti"), gallery.join(gone.select(F.col("name").alias("identity")), "identity", "left_anti")


def delete_movies(movies: DataFrame, cast: DataFrame, groups: DataFrame, detections: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """M2: movies, cast and groups without those of gone (id); their detections keep a null group."""
    ids = gone.select(F.col("id").alias("movie_id"))
    marked = detections.join(ids.withColumn("_gone", F.lit(True)), "movie_id", "left")
    loose = marked.withColumn("group_id", F.when(F.col("_gone").isNull(), F.col("group_id"))).drop("_gone")
    return movies.join(gone.select("id"), "id", "left_anti"), cast.join(ids, "movie_id", "left_anti"), groups.join(ids, "movie_id", "left_anti"), loose


def remove_rows(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """M3, M6: rows without those keys."""
    return rows.join(gone.select(*key), key, "left_anti")


def set_where(rows: DataFrame, selected: DataFrame, key: list[str], values: dict) -> DataFrame:
    """M4: rows with values set where the key is selected."""
    marked = rows.join(selected.select(*key).distinct().withColumn("_s", F.lit(True)), key, "left")
    return marked.withColumns({c: F.when(F.col("_s"), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).drop("_s")


def label_groups(faces: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """M5: faces of labelled groups go to the actor: owner, file with the film before it, is_labeled."""
    named = faces.join(labels.select(*key, F.col("name").alias("_name")), key, "left")
    has = F.col("_name").isNotNull()
    file = F.when(has, F.concat_ws("_", F.col("movie_id").cast("string"), "group_id", "file")).otherwise(F.col("file"))
    return named.withColumns({"file": file, "owner": F.coalesce("_name", "owner"), "is_labeled": has}).drop("_name")


def append_vectors(gallery: DataFrame, rows: DataFrame, duplicate: float = 0.99, on_duplicate: str = "skip") -> DataFrame:
    """M7: gallery with rows (identity, file, embedding) appended; with skip, those more than duplicate like a
    vector of their identity are left out unless their file is new and named."""
    listed = gallery.select("identity", "file").distinct().withColumn("_listed", F.lit(True))
    sims = most_similar(rows.where("file is not null"), gallery, "identity", "file").withColumnRenamed("max_sim", "_sim")
    told = rows.select("identity", "file").distinct().join(sims, ["identity", "file"], "left").join(listed, ["identity", "file"], "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    drop = (F.col("_sim") > duplicate) & (F.col("_listed") | F.coalesce(F.col("file") == "", F.lit(True)))
    kept = told.where(~F.coalesce(drop, F.lit(False))) if on_duplicate == "skip" else told
    added = rows.join(kept.select("identity", "file"), ["identity", "file"], "left_semi")
    return gallery.select("identity", "file", "embedding").unionByName(added.select("identity", "file", "embedding"))


def toggle_files(gallery: DataFrame, files: DataFrame) -> DataFrame:
    """M8: the first position of each named file (identity, file) is removed."""
    first = gallery.join(files.select("identity", "file"), ["identity", "file"], "left_semi").groupBy("identity", "file").agg(F.min("pos").alias("pos"))
    return gallery.join(first.select("identity", "pos"), ["identity", "pos"], "left_anti")


def promote_guests(guests: DataFrame, names: DataFrame, gallery: DataFrame, cast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9: guests (session, name, file, embedding) named in names (session, name, identity, actor_id, movie_id)
    join the gallery and the cast."""
    chosen = guests.join(names, ["session", "name"])
    grown = append_vectors(gallery, chosen.select("identity", "file", "embedding"))
    links = cast.unionByName(chosen.select("movie_id", "actor_id")).distinct()
    return grown, links
