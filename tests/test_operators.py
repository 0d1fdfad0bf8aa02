"""Planted cases: boundaries, ties, order and edge values."""

from __future__ import annotations

import math
import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.functions import scores, text, vectors
from lumenvec.operators import catalogue, cells, gates, images, maintenance, similarity, templates, trigrams
from lumenvec.sources import readers, sinks
from lumenvec.streaming import folds, inventory, jobs, status, tracks


def clusters(n: int = 12, dim: int = 16, noise: float = 0.12, seed: int = 7) -> list[np.ndarray]:
    r = np.random.RandomState(seed)
    out = []
    for k in range(5):
        x = np.eye(dim)[k] + r.normal(scale=noise, size=(n, dim))
        out.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    return out


def gallery_of(spark, parts):
    rows = [(f"id_{k}", i, f"f{k}_{i}", v.tolist()) for k, p in enumerate(parts) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "identity string, pos long, file string, embedding array<double>")


def value(spark, column, **row):
    """An expression's value for one row."""
    schema = ", ".join(f"{k} {t}" for k, (t, _) in row.items())
    return spark.createDataFrame([tuple(v for _, v in row.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [("0" * 16, "0" * 16, 0), ("0" * 16, "0" * 15 + "1", 1), ("", "0" * 16, 64), (None, "0" * 16, 64), ("zz" * 8, "0" * 16, 64), ("f" * 16, "0" * 16, 64), ("F" * 16, "f" * 16, 0)])
def test_hamming(spark, a, b, want):
    assert value(spark, vectors.hamming(F.col("a"), F.col("b")), a=("string", a), b=("string", b)) == want


@pytest.mark.parametrize(("s", "want"), [(0.98, "redundant"), (0.85, "same_person"), (0.70, "same_person"), (0.5, "different_person")])
def test_band(spark, s, want):
    assert value(spark, vectors.band(F.col("s")), s=("double", s)) == want


@pytest.mark.parametrize(("u", "v", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), (None, [1.0, 1.0], 0.0)])
def test_dot(spark, u, v, want):
    assert value(spark, vectors.dot(F.col("u"), F.col("v")), u=("array<double>", u), v=("array<double>", v)) == want


def test_unit_of_zero_is_null(spark):
    assert value(spark, vectors.unit(F.col("v")), v=("array<double>", [0.0, 0.0])) is None
    assert value(spark, vectors.validate_norm(F.col("v")), v=("array<double>", [3.0, 4.0])) == [0.6, 0.8]


@pytest.mark.parametrize(("mean", "low", "high"), [(128.0, 0.95, 1.0), (20.0, 0.0, 0.3), (240.0, 0.0, 0.3), (80.0, 0.69, 0.71), (180.0, 0.69, 0.71)])
def test_brightness(spark, mean, low, high):
    assert low <= value(spark, scores.brightness_score(F.col("m")), m=("double", mean)) <= high


@pytest.mark.parametrize(("points", "want"), [([[30.0, 40.0], [70.0, 40.0], [50.0, 80.0], [0.0, 0.0], [0.0, 0.0]], 1.0), (None, 0.5), ([[1.0, 1.0], [2.0, 2.0]], 0.5), ([[5.0, 5.0], [5.0, 5.0], [6.0, 6.0], [0.0, 0.0], [0.0, 0.0]], 0.0)])
def test_pose_score(spark, points, want):
    assert value(spark, scores.pose_score(F.col("p")), p=("array<array<double>>", points)) == pytest.approx(want)


def test_pose_labels(spark):
    of = lambda p: value(spark, scores.pose_label(F.col("p")), p=("array<array<double>>", p))
    assert of(None) == "Unknown"
    assert of([[0.0, 0.0], [2.0, 0.0], [1.0, 1.0]]) == "Frontal"
    assert of([[0.0, 0.0], [2.0, 0.0], [0.0, 0.0]]) == "Unknown"
    assert of([[0.0, 0.0], [10.0, 0.0], [1.0, 0.0]]) == "Profile"


def test_combined_quality_weights(spark):
    args = {k: ("double", v) for k, v in (("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 7.0))}
    assert value(spark, scores.combined_quality(*map(F.col, "abcd")), **args) == pytest.approx(0.55)
    none = {k: ("double", None) for k in "abcd"}
    assert value(spark, scores.combined_quality(*map(F.col, "abcd")), **none) == pytest.approx(0.5)


def test_names(spark):
    of = lambda f, s: value(spark, f(F.col("n")), n=("string", s))
    assert of(text.normalize_name, "Robert De Niro Jr.") == "robert de niro jr"
    assert of(text.safe_name, "Şener Şen ") == "Şener_Şen"
    assert of(text.safe_name, "a--b !") == "a--b"
    assert of(text.identity_key, " !! ") is None
    assert of(text.owner_of_path, "media/labeled_faces/anna/x.jpg") == "anna"
    assert of(text.owner_of_path, "media/other/anna/x.jpg") is None
    assert of(text.source_of_file, "film_1_2.jpg") == "film"


def test_rates(spark):
    args = lambda a, b: {"a": ("long", a), "b": ("long", b)}
    assert value(spark, text.identification_rate(F.col("a"), F.col("b")), **args(0, 0)) == 0
    assert value(spark, text.quality_rate(F.col("a"), F.col("b")), **args(0, 0)) == 100
    assert value(spark, text.identification_rate(F.col("a"), F.col("b")), **args(2, 1)) == 66


def test_gallery_layouts(spark):
    v = [[float(i)] * 2 for i in range(25)]
    rows = [("a", v[:2], v, v[0], None), ("b", [], v, v[0], None), ("c", None, None, v[3], None), ("d", None, None, None, v[:3])]
    raw = spark.createDataFrame(rows, "identity string, templates array<array<double>>, all_embeddings array<array<double>>, embedding array<double>, bare array<array<double>>")
    count = lambda mode: {r[0]: r[1] for r in readers.explode_gallery(raw, mode).groupBy("identity").count().collect()}
    assert count("recognise") == {"a": 2, "b": 10, "c": 1, "d": 3}
    assert count("merge") == {"a": 2, "b": 25, "c": 1, "d": 3}
    assert count("evaluate") == {"a": 25, "b": 25, "c": 1}


def test_files_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("name\nRobert De Niro Jr.\n\n robert de niro jr \n")
    assert [r[0] for r in readers.read_actor_list(spark, str(tmp_path / "a.txt")).collect()] == ["robert de niro jr"]
    (tmp_path / "c.csv").write_text('t,x,names\nF1,0,"a, b"\nshort,1\nF1,0,"c , d,"\n')
    assert sorted(tuple(r) for r in readers.read_cast_csv(spark, str(tmp_path / "c.csv")).collect()) == [("F1", "c"), ("F1", "d")]
    for p in ("labeled_faces/anna/film_1.JPG", "labeled_faces/anna/g/x.png", "profiles/bob/p.txt"):
        (tmp_path / "m" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / p).write_bytes(b"x")
    got = readers.read_inventory(spark, f"file:{tmp_path}/m")
    assert {(r.owner, r.group_id, r.file) for r in got.collect()} == {("anna", None, "film_1.JPG"), ("anna", "g", "x.png")}


def test_tables_by_jdbc(spark):
    """In parts and whole, from a database in memory."""
    url = "jdbc:derby:memory:catalogue;create=true"
    spark.range(100).selectExpr("cast(id as int) as id", "concat('Film ', id) as title").write.jdbc(url, "movie", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    whole, cut = readers.read_table(spark, "movie", url, **options), readers.read_table(spark, "movie", url, ("id", 0, 100, 4), **options)
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) and cut.count() == 100
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,90)]" in cut.where("id > 90")._jdf.queryExecution().toString().replace("`", "") or cut.where("id > 90").count() == 9
    spark.range(3).createOrReplaceTempView("held")
    assert readers.read_table(spark, "held").count() == 3


def test_pages(spark):
    rows = spark.range(41).toDF("id")
    for asked, page, n in ((1, 1, 20), (3, 3, 1), (9, 3, 1), (-1, 3, 1), ("x", 1, 20)):
        shown, told = catalogue.page(rows, ["id"], asked, 20)
        assert (told["page"], shown.count(), told["pages"]) == (page, n, 3)
    shown, told = catalogue.page(rows.limit(0), ["id"], 1, 20)
    assert (told["pages"], shown.count(), told["has_next"]) == (1, 0, False)


def test_sync(spark):
    row = lambda ids: spark.createDataFrame([(i, "g", i) for i in ids], "movie_id long, group_id string, face_count long")
    got = {r.movie_id: r.action for r in catalogue.sync(row([1, 2, 4]), row([1, 3]), ["movie_id", "group_id"]).collect()}
    assert got == {1: "keep", 2: "insert", 3: "delete", 4: "insert"}


def test_sync_reads_new_files_only(spark):
    """A second run takes what was added since, repeats nothing if it runs again, and ends as the full join does."""
    key, schema = ["owner", "group_id"], "owner string, group_id string"
    path, state, actions, checkpoint = (sinks.shared_dir(spark, x) for x in ("feed", "counts", "actions", "state"))
    rows = spark.createDataFrame([("a", "g1", 3), ("b", "g1", 1), ("c", "g9", 4)], f"{schema}, face_count long")
    feed = lambda changes: spark.createDataFrame(changes, "path string, removed boolean").coalesce(1).write.mode("append").parquet(path)
    seen, work = [], inventory.sync_batches(lambda: rows, key, schema, state, actions)

    def watched(batch, number):
        seen.append((number, batch.count()))
        work(batch, number)
        work(batch, number)  # as after a failure between the write and the commit

    def run():
        stream = spark.readStream.schema("path string, removed boolean").parquet(path)
        jobs.drain_batches(stream, watched, checkpoint)
        return {(r.owner, r.group_id): (r.action, r.face_count) for r in inventory.current_actions(spark, actions, rows, key).collect()}

    feed([("k/a/g1/1.jpg", None), ("k/a/g1/2.JPG", False), ("k/a/g2/1.jpg", False), ("k/b/g1/1.jpg", False), ("k/b/g1/1.txt", False), ("k/b/no.jpg", False)])
    assert run() == {("a", "g1"): ("keep", 2), ("a", "g2"): ("insert", 1), ("b", "g1"): ("keep", 1), ("c", "g9"): ("delete", 4)}
    feed([("k/a/g1/3.png", False), ("k/a/g2/1.jpg", True), ("k/b/g1/1.jpg", True), ("k/d/g1/1.jpg", False)])
    assert run() == {("a", "g1"): ("keep", 3), ("b", "g1"): ("delete", 1), ("c", "g9"): ("delete", 4), ("d", "g1"): ("insert", 1)}
    assert seen == [(0, 6), (1, 4)]
    folders = inventory.counts(spark, state, key, schema).where("face_count > 0")
    full = {(r.owner, r.group_id): (r.action, r.face_count) for r in catalogue.sync(folders, rows, key).collect()}
    assert run() == full and len(seen) == 2


def test_sync_reads_a_batch_and_its_rows_once(spark):
    """Changes are added up in one pass; a batch's actions take one read of the rows."""
    path, state, actions = (sinks.shared_dir(spark, x) for x in ("feed", "counts", "actions"))
    spark.createDataFrame([("k/a/g/1.jpg", None), ("k/a/g/2.jpg", True), ("k/b/g/1.jpg", False), ("k/c/g/1.jpg", True)], "path string, removed boolean").write.parquet(path)
    feed, asked = spark.read.parquet(path), []
    assert inventory.grouped_changes(feed, ["owner", "group_id"])._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(n):
        reads.add(1)
        return n

    table = spark.createDataFrame([("a", "g", 5), ("b", "g", 6), ("c", "g", 7)], "owner string, group_id string, face_count long").withColumn("face_count", counted("face_count"))
    inventory.sync_batches(lambda: asked.append(1) or table, ["owner", "group_id"], "owner string, group_id string", state, actions)(feed, 0)
    got = {r.owner: (r.action, r.face_count, r.risk_level) for r in spark.read.parquet(actions).collect()}
    assert got == {"a": ("delete", 5, None), "b": ("keep", 1, None), "c": ("delete", 7, None)}
    assert len(asked) == 1 and reads.value == 3


def test_search(spark):
    rows = spark.createDataFrame([("henry_fonda",), ("Jane Fonda",), ("x",)], "name string")
    assert [r[0] for r in gates.search(rows, "name", "Y F", 5).collect()] == ["henry_fonda"]
    assert gates.search(rows, "name", "f", shortest=2).count() == 0


def test_search_by_trigrams(spark):
    """The plain search's rows for needles of all kinds; under three letters all rows are searched."""
    names = ["henry_fonda", "Jane Fonda", "x", None, "fon", "FONDA fonda", "İstanbul", "a_b c", "nda jan", ""] + [f"actor {i}_{i * 7}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    index = trigrams.build(rows, "id", "name")
    for needle in ("Fonda", "y f", "FON", "fo", "", " ", "r 1", "actor 1", "7_49", "zzz", "a b", "ndafon", "nda j", "stanbul", "b c"):
        want = [(r.id, r.name) for r in gates.search(rows, "name", needle).collect()]
        assert sorted((r.id, r.name) for r in trigrams.search_indexed(index, rows, needle).collect()) == sorted(want), needle
    assert trigrams.candidates(index, "fo") is None and trigrams.search_indexed(index, rows, "f", shortest=2).count() == 0
    assert [r.id for r in trigrams.search_indexed(index, rows, "actor", 3).collect()] == [r.id for r in gates.search(rows, "name", "actor", 3).collect()]
    plan = trigrams.candidates(index, "fonda")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1][:80]


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    g = gallery_of(spark, clusters())
    x = np.concatenate(clusters())
    probes = g.select((F.xxhash64("identity", "pos")).alias("probe"), "embedding", "identity", "pos")
    got = similarity.nearest(probes.select("probe", "embedding"), g, 3, per_vector=False).join(probes.select("probe", F.col("identity").alias("own")), "probe").where("rank = 1").collect()
    assert len(got) == len(x)
    assert all(r.identity == r.own and r.sim == pytest.approx(1.0) for r in got)
    found = similarity.nearest(g.select(F.xxhash64("identity", "pos").alias("probe"), "embedding", F.xxhash64("identity", "pos").alias("own")), g.withColumn("own", F.xxhash64("identity", "pos")), 2, own="own")
    assert found.where("sim > 0.999999").join(g.select(F.xxhash64("identity", "pos").alias("probe"), "identity", "pos"), ["probe", "identity", "pos"]).count() == 0 and found.select("probe").distinct().count() == len(x)
    told = similarity.within_pairs(g, 0.85)
    assert told.where("i >= j").count() == 0 and told.distinct().count() == told.count()
    pairs = told.count()
    assert pairs == sum(int((np.triu(p @ p.T, 1) >= 0.85).sum()) for p in clusters())


@pytest.mark.parametrize("per_vector", [True, False])
@pytest.mark.parametrize("kind", ["clusters", "spread", "equal"])
def test_cells_lose_nothing(spark, monkeypatch, kind, per_vector):
    """The same rows as all products give, ties included; far clusters are left out. Blocks of 16, vectors of any length."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(cells, "BLOCK", 16)
    r = np.random.RandomState(8)
    if kind == "clusters":
        x = np.concatenate([7 * np.eye(8)[k] + r.normal(scale=0.05, size=(60, 8)) for k in range(5)])
    else:
        x = r.normal(size=(300, 8)) if kind == "spread" else np.ones((300, 8))
    rows = [(f"id_{i % 40}", i // 40, i, [float(y) for y in v]) for i, v in enumerate(x)]
    g = spark.createDataFrame(rows, "identity string, pos long, vec_id long, embedding array<double>")
    probes = g.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding", "vec_id")
    got = cells.nearest_in_cells(probes, g, 4, per_vector, own="vec_id")
    plain = lambda df: sorted((q.probe, q.rank, q.identity, q.pos, round(q.sim, 9)) for q in df.collect())
    assert plain(got.found) == plain(similarity.nearest(probes, g, 4, per_vector, own="vec_id")) != []
    assert got.size == 300
    products = {q.probe: q.products for q in got.asked.collect()}
    assert len(products) == 15 and all(4 <= n <= 300 for n in products.values())
    if kind == "clusters" and per_vector:
        assert sum(products.values()) < 0.4 * 15 * 300
    none = cells.nearest_in_cells(probes, g.limit(0), 4, per_vector, own="vec_id")
    assert none.found.count() == 0 and cells.nearest_in_cells(probes.limit(0), g, 4, per_vector).found.count() == 0


def test_evaluation_of_separated_clusters(spark):
    counts = similarity.similarity_counts(gallery_of(spark, clusters())).persist()
    curve = similarity.roc(counts, full=True)
    assert similarity.area_under_curve(curve).first()["auc"] > 0.99
    assert similarity.equal_error_rate(curve).first()["eer"] < 0.01
    stats = {r.same: r for r in similarity.similarity_stats(counts).collect()}
    assert stats[True].pairs == 5 * 66 and stats[False].pairs == 10 * 144 and stats[True].mean > 0.8
    assert similarity.histogram(counts).count() == 100


def test_thresholds_at_their_edges(spark):
    """Similarities of exactly 1, 0.5, 0 and below 0."""
    u = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [("a", 0, "f", [1.0, 0.0]), ("a", 1, "g", [1.0, 0.0]), ("b", 0, "h", [0.5, float(np.sqrt(0.75))]), ("c", 0, "i", [-1.0, 0.0]), ("c", 1, "j", u(np.pi))]
    counts = similarity.similarity_counts(spark.createDataFrame(rows, "identity string, pos long, file string, embedding array<double>"))
    curve = {round(r.threshold, 2): r for r in similarity.roc(counts).collect()}
    assert curve[1.0].tpr == pytest.approx(1.0) and curve[0.5].far > curve[0.51].far and curve[0.0].far < 1
    top = {(r.same, r.bin): r.n for r in similarity.histogram(counts).where("n > 0").collect()}
    assert top[(True, 49)] == 2 and (False, 25) in top


def test_leave_one_out_smallest_groups(spark):
    p = clusters()
    g = gallery_of(spark, [np.concatenate([p[0][:7], p[1][:1]]), p[2][:2], p[3][:1]])
    got = {(r.identity, r.pos): r.kept for r in similarity.leave_one_out(g, 0.4).collect()}
    assert not got[("id_0", 7)] and sum(not k for k in got.values()) == 1


def test_templates_repeat(spark):
    g = gallery_of(spark, clusters())
    a, b = (templates.templates(x, "identity").orderBy("identity", "template").collect() for x in (g, g.repartition(7)))
    assert a == b and len(a) == 15 and all(np.linalg.norm(r.centroid) == pytest.approx(1) for r in a)
    assert {r.n for r in templates.templates(gallery_of(spark, [clusters()[0][:2]]), "identity").collect()} == {2}
    assert templates.templates(g.limit(0), "identity").count() == 0


def test_templates_of_groups_cut_over_tasks(spark):
    """Groups over largest, of all sizes, one with equal vectors only: the same as by one task each."""
    r = np.random.RandomState(9)
    parts = [*clusters(noise=0.4), clusters()[0][:1], clusters()[1][:2], clusters()[2][:5], np.tile([[0.6, 0.8]], (9, 8)) / np.sqrt(8), r.normal(size=(60, 16))]
    parts[-1] /= np.linalg.norm(parts[-1], axis=1, keepdims=True)
    g = gallery_of(spark, parts)
    one = templates.templates(g, "identity").orderBy("identity", "template").collect()
    for largest in (0, 10):
        many = templates.templates(g, "identity", largest=largest).orderBy("identity", "template").collect()
        assert [(x.identity, x.template, x.n) for x in many] == [(x.identity, x.template, x.n) for x in one]
        assert all(np.allclose(x.centroid, y.centroid, atol=1e-9) for x, y in zip(many, one, strict=True))


def test_running_mean_is_not_rescaled(spark):
    v = [[float(np.cos(a)), float(np.sin(a))] for a in np.radians(np.arange(0, 120, 2))]
    want = np.array(v[0])
    for x in v[1:]:
        want = 0.9 * want + 0.1 * np.array(x)
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", 0, v[3])], "k string, pos long, embedding array<double>")
    means = {r.k: r["mean"] for r in similarity.running_means(rows, "k").collect()}
    got = means["a"]
    assert means["b"] == v[3]
    assert np.allclose(got, want) and np.linalg.norm(got) < 0.99


def test_repeats_are_held_against_the_last_kept(spark):
    a, b, c = [1.0, 0.0], [0.97, float(np.sqrt(1 - 0.97**2))], [0.9, float(np.sqrt(1 - 0.81))]
    rows = [(1, 0, 0, a), (1, 1, 1, b), (1, 2, 2, c), (1, 3, 3, a)]
    faces = spark.createDataFrame(rows, "session long, frame long, det_id long, embedding array<double>")
    got = {r.det_id: r.kept for r in maintenance.drop_repeats(faces, ["session"], 0.95).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_greedy_keeps_what_a_removed_one_would_remove(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(r.id for r in maintenance.greedy_keep(nodes, edges).collect()) == [0, 2, 4, 5]


def test_dedupe_by_hash_then_vector(spark):
    h = "00000000000000ff"
    rows = [(0, "a", h, [1.0, 0.0]), (1, "a", h, [0.0, 1.0]), (2, "a", "ffffffffffffffff", [1.0, 0.0]), (3, "a", "0f0f0f0f0f0f0f0f", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, identity string, phash string, embedding array<double>")
    assert sorted(r.id for r in maintenance.dedupe(df).collect()) == [0, 3]


def test_hamming_join_finds_all(spark):
    r = np.random.RandomState(1)
    base = [int(x) for x in r.randint(0, 2**62, size=20)]
    every = base + [b ^ sum(1 << int(k) for k in r.choice(64, size=i % 6, replace=False)) for i, b in enumerate(base)]
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(every)], "id long, phash string")
    first = {}
    for i, v in enumerate(every):
        first.setdefault(v, i)
    want = {(first[u], first[v]) for u in first for v in first if first[u] < first[v] and bin(u ^ v).count("1") < 5}
    assert {(r.a, r.b) for r in similarity.hamming_join(df).where("distance > 0").collect()} == want


def test_merge_grows_as_it_goes(spark):
    g = lambda rows: spark.createDataFrame(rows, "identity string, pos long, embedding array<double>")
    target = g([("a", 0, [1.0, 0.0])])
    source = g([("a", 0, [0.0, 1.0]), ("a", 1, [0.0, 1.0]), ("a", 2, [1.0, 0.0]), ("n", 0, [1.0, 0.0]), ("n", 1, [1.0, 0.0])])
    got = maintenance.merge_galleries(target, source).groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.count_if("added").alias("a")).collect()
    assert {r.identity: (r.n, r.a) for r in got} == {"a": (2, 1), "n": (2, 2)}


def test_merge_in_order_and_blocks(spark, monkeypatch):
    """Against the plain pass: near copies, equal copies, vectors of all lengths, identities in many blocks."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    r = np.random.RandomState(12)
    rows = []
    for name in "abc":
        base = r.normal(size=(8, 6))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        for i in range(30):
            v = base[r.randint(8)] + r.choice([0, 0, 0.004, 0.02]) * r.normal(size=6)
            v = v / np.linalg.norm(v) * r.choice([1.0, 1.0, 0.5])
            rows.append((name, i, v.tolist()))
    rows += [("new", i, rows[0][2]) for i in range(3)]
    target, source = [x for x in rows if x[1] % 5 == 0 and x[0] != "new"], [x for x in rows if x[1] % 5 or x[0] == "new"]
    want = [(n, v, False) for n, _, v in target]
    held = {n: [np.array(v) for m, _, v in target if m == n] for n in "abc"}
    for n, _, v in sorted(source, key=lambda x: x[:2]):
        if n == "new" or not any(float(np.dot(v, o)) > 0.9999 for o in held[n]):
            want.append((n, v, True))
            held.setdefault(n, []).append(np.array(v))
    df = lambda x: spark.createDataFrame(x, "identity string, pos long, embedding array<double>")
    got = [(x.identity, x.embedding, x.added) for x in maintenance.merge_galleries(df(target), df(source)).collect()]
    assert sorted(got) == sorted(want) and 20 < sum(x[2] for x in got) < len(source)


def test_most_similar_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    r = np.random.RandomState(13)
    x = [(f"g{i % 3}", i, r.normal(size=4).tolist()) for i in range(40)] + [("alone", 99, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(x, "group_id string, candidate long, embedding array<double>")
    got = {q.candidate: (q.redundant, q.max_sim) for q in similarity.redundancy(df.where("candidate % 4 = 0 or candidate = 99"), df.where("candidate % 4 <> 0 and candidate < 99"), 0.85).collect()}
    want = {}
    for g, i, v in x:
        if i % 4 == 0 or i == 99:
            best = max((float(np.dot(v, w)) for h, j, w in x if h == g and j % 4 and j != 99), default=0.0)
            want[i] = (best > 0.85, pytest.approx(best))
    assert got == want


def test_drawn_pairs_tell_what_all_pairs_tell(spark):
    g = gallery_of(spark, clusters(noise=0.3))
    every, drawn = (similarity.roc(c).orderBy("threshold").collect() for c in (similarity.similarity_counts(g), similarity.sampled_counts(g, 20_000)))
    assert all(a.tpr == pytest.approx(b.tpr) and a.far == pytest.approx(b.far, abs=0.02) for a, b in zip(every, drawn, strict=True))
    one, two = (similarity.cross_sample(x, 500).orderBy("draw").collect() for x in (g, g.repartition(5)))
    assert one == two and len(one) == 500 and all(x.a != x.b for x in one)


def test_append_policy(spark):
    g = spark.createDataFrame([("a", "f1", [1.0, 0.0])], "identity string, file string, embedding array<double>")
    rows = spark.createDataFrame([("a", "f1", [1.0, 0.0]), ("a", "", [1.0, 0.0]), ("a", "f2", [1.0, 0.0]), ("b", "f1", [1.0, 0.0])], g.schema)
    assert sorted((r.identity, r.file) for r in maintenance.append_vectors(g, rows).collect()) == [("a", "f1"), ("a", "f2"), ("b", "f1")]
    assert maintenance.append_vectors(g, rows, on_duplicate="append").count() == 5


def test_versions(spark, tmp_path):
    root = f"file:{tmp_path}/g"
    assert sinks.current_version(spark, root) is None
    for n in (3, 5):
        sinks.publish_gallery(spark.range(n), root)
    assert sinks.current_version(spark, root) == 2 and sinks.read_gallery(spark, root).count() == 5
    assert sinks.read_gallery(spark, root, 1).count() == 3
    with pytest.raises(sinks.Conflict):
        sinks.publish_gallery(spark.range(9), root, based_on=1)
    assert sinks.publish_gallery(spark.range(7), root, based_on=2, keep=2) == 3
    assert sorted(sinks.versions(spark, root)) == [2, 3] and sinks.read_gallery(spark, root).count() == 7
    assert sinks.retire(spark, root, 2) == []


def test_publishers_at_once_lose_no_version(spark, tmp_path):
    root = f"file:{tmp_path}/g"
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: (sinks.publish_gallery(spark.range(n), root), n), range(1, 9)))
    assert sorted(v for v, _ in got) == list(range(1, 9))
    assert all(sinks.read_gallery(spark, root, v).count() == n for v, n in got)


def test_one_of_two_claims_holds(spark, tmp_path):
    path = f"file:{tmp_path}/one"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda n: sinks.claim(spark, path, str(n)), range(16))) == 1
    assert not list(tmp_path.glob("*.tmp"))


def test_reports_are_kept_for_an_hour(spark, tmp_path):
    root, made, clock = f"file:{tmp_path}/r", [], [1000.0]

    def report(**parameters):
        def make():
            made.append(parameters)
            return {"a": spark.range(len(made)), "b": spark.range(0)}

        tables, kept = sinks.kept_report(spark, root, parameters, make, now=lambda: clock[0])
        return tables["a"].count(), tables["b"].count(), kept

    assert report(least=4, version=1) == (1, 0, False)
    assert report(version=1, least=4) == (1, 0, True)
    assert report(least=4, version=2) == (2, 0, False)
    clock[0] += 3599
    assert report(least=4, version=1) == (1, 0, True)
    clock[0] += 1
    assert report(least=4, version=1) == (3, 0, False) and report(least=4, version=1) == (3, 0, True)
    assert len(made) == 3
    assert sinks.forget_reports(spark, root, now=lambda: clock[0]) == 2
    assert report(least=4, version=1) == (3, 0, True) and report(least=4, version=2) == (4, 0, False)


def test_image_files(spark, tmp_path):
    """Grey and coloured pictures, one of one pixel, equal and odd names, and one without pixels."""
    r = np.random.RandomState(2)
    rows = [("a/b", 5, 7, 1), ("a/b", 5, 7, 1), (None, 1, 1, 1), ("colour", 4, 3, 3), ("none", 0, 32, 1), ("x" * 300, 2, 2, 3)]
    data = [(n, h, w, c, r.randint(0, 256, h * w * c).astype(np.uint8).tobytes()) for n, h, w, c in rows]
    df = spark.createDataFrame(data, "name string, height int, width int, nChannels int, data binary")
    written = sinks.write_images(df.repartition(2), f"file:{tmp_path}/images")
    assert written.count() == 5
    (tmp_path / "images" / "broken.png").write_bytes(b"no picture")
    got = [(x.height, x.width, x.nChannels, bytes(x.data)) for x in readers.read_images(spark, f"file:{tmp_path}/images").select("image.*").collect()]
    assert sorted(got) == sorted(x[1:] for x in data if x[1])


def test_written_images_are_read_by_shares(spark, tmp_path):
    """What Spark's own reader gives, but by shares of the table of files; a changed byte is an error."""
    r = np.random.RandomState(3)
    rows = [(str(i), h, w, c, r.randint(0, 256, h * w * c).astype(np.uint8).tobytes()) for i, (h, w, c) in enumerate([(5, 7, 1), (1, 1, 3), (4, 3, 3)] + [(1, 2, 1)] * 300)]
    df = spark.createDataFrame(rows, "name string, height int, width int, nChannels int, data binary")
    root = f"file:{tmp_path}/images"
    written = sinks.write_images(df.repartition(3), root)
    got = sinks.read_written_images(written, root)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < readers.read_images(spark, root).rdd.getNumPartitions()
    assert sorted((x.name, x.image.height, x.image.width, x.image.nChannels, bytes(x.image.data)) for x in got.collect()) == sorted(rows)
    plain = lambda df: sorted((x.height, x.width, x.nChannels, x.mode, bytes(x.data)) for x in df.select("image.*").collect())
    assert plain(got) == plain(readers.read_images(spark, root))
    whole = sinks.png(rows[0][4], 5, 7, 1)
    assert sinks.pixels(whole) == (5, 7, 1, rows[0][4])
    with pytest.raises(ValueError, match="damaged"):
        sinks.pixels(whole[:45] + bytes([whole[45] ^ 1]) + whole[46:])


def faces_of(spark, rows):
    return spark.createDataFrame([(1, f, i, b, v) for i, (f, b, v) in enumerate(rows)], "session long, frame long, det_id long, bbox array<double>, embedding array<double>")


BOX = [0.0, 0.0, 10.0, 10.0]


def test_tracks_end_after_the_gap(spark):
    x = [1.0, 0.0]
    for gap, tracks in ((29, 1), (30, 1), (31, 2)):
        got = folds.fold_batch(faces_of(spark, [(0, BOX, x), (gap, BOX, x)]), "session", folds.Tracking)
        assert got.select("track").distinct().count() == tracks


def test_tracks_need_overlap_and_likeness(spark):
    rows = [(0, BOX, [1.0, 0.0]), (1, [9.0, 9.0, 19.0, 19.0], [1.0, 0.0]), (2, BOX, [0.0, 1.0])]
    got = folds.fold_batch(faces_of(spark, rows), "session", folds.Tracking)
    assert got.select("track").distinct().count() == 3


def test_guests(spark):
    a, near, edge = [1.0, 0.0], [0.8, 0.6], [0.65, float(np.sqrt(1 - 0.65**2))]
    rows = [(0, a, 0.2, "x"), (1, edge, 0.1, "x"), (2, near, 0.35, "known"), (3, a, 0.0, "x")]
    df = spark.createDataFrame([(1, f, f, v, s, n) for f, v, s, n in rows], "session long, frame long, det_id long, embedding array<double>, sim double, name string")
    got = {r.frame: (r.name, r.score) for r in folds.fold_batch(df, "session", folds.Naming).collect()}
    assert got[0] == ("Misafir-1", 0.0) and got[1][0] == "Misafir-2" and got[2] == ("known", 0.35) and got[3] == ("Misafir-1", 1.0)


@pytest.mark.parametrize("make", [folds.Grouping, folds.Tracking])
def test_stream_equals_batch(spark, make):
    r = np.random.RandomState(3)
    x = np.concatenate(clusters())[r.permutation(60)]
    df = faces_of(spark, [(i, [float(k) for k in (i, i, i + 20, i + 20)], v.tolist()) for i, v in enumerate(x)]).withColumn("session", F.col("det_id") % 3)
    want = folds.fold_batch(df, "session", make).orderBy("det_id").collect()
    feed = jobs.Feed(df, "cuts", slices=3)
    got = jobs.drain(folds.fold_stream(feed.stream, "session", make), sinks.shared_dir(spark, "out"), sinks.shared_dir(spark, "state"), feed=feed).drop("late").orderBy("det_id").collect()
    assert got == want


def test_stream_state_is_shared_by_keys(spark):
    """200 keys, one of them null, in 4 states at most, with the rows of the batch form; idle keys end for themselves."""
    r = np.random.RandomState(5)
    v = r.randn(400, 3)
    rows = [(None if i % 200 == 7 else i % 200, i // 200 + (i >= 200) * 3, i, BOX, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]
    df = spark.createDataFrame(rows, "session long, frame long, det_id long, bbox array<double>, embedding array<double>")
    want = folds.fold_batch(df, "session", folds.Grouping).orderBy("det_id").collect()
    feed = jobs.Feed(df, "cuts", slices=2)
    stream, state = folds.fold_stream(feed.stream, "session", folds.Grouping, buckets=3), sinks.shared_dir(spark, "state")
    assert jobs.drain(stream, sinks.shared_dir(spark, "out"), state, feed=feed).drop("late").orderBy("det_id").collect() == want
    held = spark.read.format("statestore").load(state)
    assert held.count() <= 4

    path = sinks.shared_dir(spark, "idle")
    for k, (session, minute) in enumerate([(1, 0), (2, 0), (2, 50), (2, 120), (2, 121), (1, 122)]):
        faces_of(spark, [(k, BOX, [1.0, 0.0])]).withColumns({"session": F.lit(session).cast("long"), "det_id": F.lit(k).cast("long"), "ts": F.timestamp_seconds(F.lit(60 * minute + 1))}).coalesce(1).write.mode("append").parquet(path)
    timed = spark.readStream.schema("session long, frame long, det_id long, bbox array<double>, embedding array<double>, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.drain(folds.fold_stream(timed, "session", folds.Tracking, idle_ms=3_600_000, buckets=1), sinks.shared_dir(spark, "out"), sinks.shared_dir(spark, "state"))
    assert {x.det_id: x.score > 0 for x in got.collect()} == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False}


def test_late_rows_are_counted(spark):
    df = faces_of(spark, [(0, BOX, [1.0, 0.0]), (5, BOX, [1.0, 0.0])])
    late = faces_of(spark, [(3, BOX, [1.0, 0.0]), (9, BOX, [1.0, 0.0])]).withColumn("det_id", F.col("det_id") + 10)
    path = sinks.shared_dir(spark, "late")
    for part in (df, late):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.drain(folds.fold_stream(stream, "session", folds.Tracking), sinks.shared_dir(spark, "out"), sinks.shared_dir(spark, "state")).collect()
    assert sorted((r.det_id, r.late) for r in got) == [(0, 0), (1, 0), (11, 1)]


def test_status_comes_from_the_stream(spark):
    root = sinks.shared_dir(spark, "status")
    df = spark.range(100).withColumnRenamed("id", "frame")
    seen = []
    feed = jobs.Feed(df, "rows", slices=4)
    assert status.run_job(feed.whole(), lambda batch, n: seen.append(batch.count()), sinks.shared_dir(spark, "state"), root, "good", 100)
    assert seen == [25, 25, 25, 25]

    def fails(batch, n):
        batch.count()  # rows that are not read are not counted
        if n == 2:
            raise ValueError("third batch")

    assert not status.run_job(feed.whole(), fails, sinks.shared_dir(spark, "state"), root, "bad", 100)
    empty = jobs.Feed(df.limit(0), "rows", slices=1)
    assert status.run_job(empty.whole(), lambda batch, n: None, sinks.shared_dir(spark, "state"), root, "empty", 0)
    told = {}
    for r in status.statuses(spark, root).orderBy("job", "seq").collect():
        told.setdefault(r.job, []).append((r.status, r.percent))
    assert told["good"] == [("running", 0.0), ("running", 25.0), ("running", 50.0), ("running", 75.0), ("running", 99.0), ("completed", 100.0)]
    assert told["bad"][-1] == ("error", 50.0) and {s for s, _ in told["bad"][:-1]} == {"running"}
    assert told["empty"] == [("running", 0.0), ("completed", 100.0)]
    last = {r.job: r for r in status.current(status.statuses(spark, root)).collect()}
    assert {j: r.status for j, r in last.items()} == {"good": "completed", "bad": "error", "empty": "completed"} and "third batch" in last["bad"].message


def streamed_tracks(spark, parts, **limits):
    """(rows, late rows) of a stream that takes each of parts as one batch."""
    path, out, late = (sinks.shared_dir(spark, x) for x in ("in", "out", "late"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    with tracks.state_of_keys(spark):
        stream = tracks.tracked(spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path), "session", **limits)
        jobs.drain_batches(stream, tracks.split_late(stream, out, late), sinks.shared_dir(spark, "state"))
    return spark.read.parquet(out), spark.read.parquet(late)


def test_tracks_in_state_equal_the_fold(spark):
    """Over batches cut anywhere, with a ring of vectors that wraps and tracks that idle; late rows go elsewhere."""
    r = np.random.RandomState(6)
    x = np.concatenate(clusters(n=20))[r.permutation(100)]
    rows = [(i % 2, i * (1 if i < 60 else 3), i, [float(k) for k in (i % 7, i % 5, i % 7 + 20, i % 5 + 20)], v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "session long, frame long, det_id long, bbox array<double>, embedding array<double>")
    want = folds.fold_batch(df, "session", lambda: folds.Tracking(buffer=4)).orderBy("det_id").collect()
    assert 2 < len({(w.session, w.track) for w in want}) < 100
    old = df.where("frame in (10, 11)").withColumn("det_id", F.col("det_id") + 1000)
    got, late = streamed_tracks(spark, [df.where("det_id < 33"), df.where("det_id between 33 and 70").union(old), df.where("det_id > 70")], buffer=4)
    names = ["session", "det_id", "frame", "track", "score", "smoothed"]
    assert [tuple(r[c] for c in names) for r in got.orderBy("det_id").collect()] == [tuple(w[c] for c in names) for w in want]
    assert sorted((r.session, r.det_id) for r in late.collect()) == [(0, 1010), (1, 1011)]


def test_idle_sessions_end_by_timer(spark):
    """A session's state goes once the others' time is an hour ahead, though it has no row itself."""
    def faces_at(session, det, minute):
        one = spark.createDataFrame([(session, det, det, BOX, [1.0, 0.0])], "session long, frame long, det_id long, bbox array<double>, embedding array<double>")
        return one.withColumn("ts", F.timestamp_seconds(F.lit(60 * minute + 1)))

    parts = [faces_at(1, 0, 0).union(faces_at(2, 1, 0)), faces_at(1, 2, 1), faces_at(2, 3, 50), faces_at(2, 4, 120), faces_at(1, 5, 121), faces_at(2, 6, 122)]
    got, late = streamed_tracks(spark, parts, idle_ms=3_600_000, gap=30, idle=60)
    assert late.count() == 0
    assert {r.det_id: r.track for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    again = got.where("det_id = 5").first()  # a new track 0 of one vector, where the old one would have joined with a score
    assert again.score == 0.0 and got.where("det_id = 2").first().score > 0.3 and got.where("det_id = 6").first().score > 0.3


def test_sessions_share_calls(spark):
    """150 sessions, one of them null, in two buckets and that of null: the fold's rows, idle sessions ending for
    themselves, and state that keeps tracks apart."""
    r = np.random.RandomState(7)
    v = r.randn(600, 3)
    rows = [(None if i % 150 == 3 else i % 150, i // 150 * 25, i, BOX, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]
    df = spark.createDataFrame(rows, "session long, frame long, det_id long, bbox array<double>, embedding array<double>")
    want = folds.fold_batch(df, "session", lambda: folds.Tracking(buffer=2)).orderBy("det_id").collect()
    got, late = streamed_tracks(spark, [df.where("frame < 50"), df.where("frame >= 50")], buffer=2, buckets=2)
    names = ["session", "det_id", "frame", "track", "score", "smoothed"]
    assert [tuple(r[c] for c in names) for r in got.orderBy("det_id").collect()] == [tuple(w[c] for c in names) for w in want] and not late.count()

    at = lambda k, session, minute: (session, k, k, BOX, [1.0, 0.0], minute * 60 + 1)
    timed = [[at(0, 1, 0), at(1, 2, 0)], [at(2, 2, 50)], [at(3, 2, 120)], [at(4, 1, 121), at(5, 2, 121)]]
    schema = "session long, frame long, det_id long, bbox array<double>, embedding array<double>, ts long"
    got, _ = streamed_tracks(spark, [spark.createDataFrame(x, schema).withColumn("ts", F.timestamp_seconds("ts")) for x in timed], idle_ms=3_600_000, buckets=1)
    assert {x.det_id: x.score > 0 for x in got.collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True}


def png(path, x: np.ndarray) -> None:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in x)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    flat, checker = np.full((100, 100), 128), np.indices((64, 64)).sum(axis=0) % 4 // 2 * 255
    left, right = np.zeros((64, 64)), np.zeros((64, 64))
    left[:32, :32], right[32:, 32:] = 255, 255
    for name, x in (("flat", flat), ("checker", checker), ("left", left), ("right", right), ("right2", right)):
        png(tmp_path / f"{name}.png", x)
    df = readers.read_images(spark, f"file:{tmp_path}")
    got = {r.origin.rsplit("/", 1)[1]: r for r in images.audit(df).collect()}
    assert got["flat.png"].brightness == 128 and got["flat.png"].blur_var == 0 and got["flat.png"].brightness_score > 0.95
    assert got["checker.png"].blur_score > 0.5 and all(len(r.phash) == 16 for r in got.values())
    assert got["left.png"].phash != got["right.png"].phash and got["right.png"].phash == got["right2.png"].phash
    assert not got["right.png"].repeats and got["right2.png"].repeats
    kept = {r.origin.rsplit("/", 1)[1]: r.kept for r in images.drop_similar_images(df.withColumn("g", F.lit(1)), "g").collect()}
    assert kept["right.png"] and not kept["right2.png"] and kept["left.png"]


def test_audit_keeps_the_first(spark):
    """Of equal images all but the first by origin repeat; one that is near a repeat only stays."""
    r = np.random.RandomState(4)
    x = r.randint(0, 256, (40, 40)).astype(np.uint8)
    images_of = lambda kept: spark.createDataFrame([((o, *y.shape, 1, 0, y.tobytes()),) for o, y in kept], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    rows = [(o, x) for o in ("13", "10", "12", "11")] + [("0", np.zeros((0, 32), np.uint8)), ("1", np.zeros((0, 32), np.uint8)), ("2", 255 - x)]
    got = {a.origin: a.repeats for a in images.audit(images_of(rows)).collect()}
    assert got == {"0": False, "1": False, "2": False, "10": False, "11": True, "12": True, "13": True}
    assert images.audit(images_of(rows).limit(0)).count() == 0


def test_similar_images_are_a_stream(spark):
    """Groups of many batches and of large pictures, one of them null, against the chain in plain Python; no group is one frame."""
    r = np.random.RandomState(1)
    rows = []
    for i in range(120):
        base = r.randint(0, 256, (8, 8)) if i % 3 == 0 else base
        side = 200 if i % 5 == 0 else 24
        x = np.kron(base, np.ones((side // 8, side // 8))).astype(np.uint8)
        rows.append((None if i % 40 < 9 else f"g{i // 60}", (f"{i:03}", side, side, 1, 0, x.tobytes())))
    df = spark.createDataFrame(rows, "g string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>").repartition(5)
    last, want = {}, {}
    for g, (origin, h, w, c, _, data) in rows:
        x = images.area_mean(images.grey(data, h, w, c), 64)
        x = (x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).sum())
        want[origin] = g not in last or float((x * last[g]).sum()) <= 0.92
        last[g] = x if want[origin] else last[g]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = images.drop_similar_images(df, "g")
        assert {x.origin: x.kept for x in got.collect()} == want and 0 < sum(want.values()) < 120
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hash_bears_noise():
    r = np.random.RandomState(0)
    x = r.randint(0, 256, (100, 100)).astype(float)
    y = np.clip(x + r.randint(-5, 6, x.shape), 0, 255)
    assert bin(int(images.dct_hash(x), 16) ^ int(images.dct_hash(y), 16)).count("1") < 15


def test_upserts_take_the_same_folders_for_any_movies(spark, tmp_path):
    """rows replaced, added and kept over three upserts; files by buckets, not by movies."""
    path = f"file:{tmp_path}/groups"
    df = lambda rows: spark.createDataFrame(rows, "movie_id long, group_id string, face_count long")
    sinks.upsert_groups(df([(i, g, 1) for i in range(300) for g in "ab"] + [(None, "a", 1)]), path)
    sinks.upsert_groups(df([(i, "c", 2) for i in range(0, 400, 2)] + [(None, "b", 2)]), path)
    sinks.upsert_groups(df([(7, "d", 3)]), path)
    sinks.upsert_groups(df([]), path)
    want = [(i, "c", 2) for i in range(0, 400, 2)] + [(i, g, 1) for i in range(1, 300, 2) if i != 7 for g in "ab"] + [(7, "d", 3), (None, "b", 2)]
    got = [tuple(r) for r in sinks.read_groups(spark, path, df([]).schema).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(list((tmp_path / "groups").rglob("*.parquet"))) <= sinks.BUCKETS


def test_group_means_are_added_up_in_order(spark, tmp_path):
    """a group's mean is that of one pass over its rows, also if other tasks read them in another order."""
    from lumenvec.plans.tables import face_group

    r = np.random.RandomState(4)
    ids = np.arange(4000)
    total, n = {}, {}
    for e in ids.tolist():
        total[e % 40] = total.get(e % 40, 0.0) + (e * 37 % 101) / 100.0
        n[e % 40] = n.get(e % 40, 0) + 1
    rows = [(e, float(e), e % 40, "view") for e in r.permutation(ids).tolist()]
    spark.createDataFrame(rows, "event_id long, ts double, user_id long, event_type string").repartition(7).write.parquet(f"file:{tmp_path}/events.parquet")
    spark.createDataFrame([(0, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"file:{tmp_path}/embeddings.parquet")
    got = {x.movie_id: x.avg_confidence for x in face_group(spark, f"file:{tmp_path}").collect()}
    assert got == {k: total[k] / n[k] for k in total}


@pytest.mark.parametrize("kind", ["few", "many"])
def test_counts_are_those_of_all_pairs(spark, monkeypatch, kind):
    """identities of equal and different sizes, in one block and in grown ones, vectors longer than 1."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "SPREAD", 3)
    monkeypatch.setattr(similarity, "WIDE", 5)
    monkeypatch.setattr(similarity, "PIECE", (7, 11))
    r = np.random.RandomState(5)
    names = [f"p{int(q) % 90 if kind == 'many' else int(q) % 4}" for q in r.randint(0, 1000, 400)]
    x = r.normal(size=(400, 5)) * 0.5
    g = spark.createDataFrame([(n, i, v.tolist()) for i, (n, v) in enumerate(zip(names, x, strict=True))], "identity string, pos long, embedding array<double>")
    want, size = {}, {n: names.count(n) for n in names}
    for i in range(400):
        for j in range(i + 1, 400):
            s, same = float(x[i] @ x[j]), names[i] == names[j]
            w, m = 1.0 if same else 1.0 / (size[names[i]] * size[names[j]]), math.floor(s * 1e6 + 0.5)
            at = want.setdefault((same, max(-101, min(101, m // 10000))), np.zeros(5))
            at += [1, w, w * s, w * s * s, m > 1_000_000]
    got = {(c.same, c.cell): [c.n, c.w, c.s1, c.s2, c.over] for c in similarity.similarity_counts(g).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    within = {(c.same, c.cell): [c.n, c.w, c.s1, c.s2, c.over] for c in similarity.within_counts(g).collect()}
    assert within.keys() == {k for k in want if k[0]} and all(np.allclose(within[k], want[k], atol=1e-9) for k in within)


def test_large_sides_are_moved_to_few_tasks():
    """tables of any size are cut into few blocks until blocks are large."""
    assert [similarity.count_blocks(n) for n in (0, 1, 2048, 2049, 40_000, 600_000, 10**6)] == [1, 1, 1, 2, 20, 24, 31]


def test_own_row_is_no_member(spark, monkeypatch):
    """every vector is a candidate; its own row does not count, a copy of it does, and one alone has no member."""
    monkeypatch.setattr(similarity, "BLOCK", 3)
    x = [("a", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 3, [1.0, 0.0]), *(("c", 10 + i, [float(i), 1.0]) for i in range(9))]
    df = spark.createDataFrame(x, "group_id string, candidate long, embedding array<double>").withColumn("own", F.col("candidate"))
    got = {q.candidate: q.max_sim for q in similarity.redundancy(df, df, 0.85, own="own").collect()}
    assert {k: got[k] for k in range(4)} == {0: 1.0, 1: 1.0, 2: 0.0, 3: 0.0} and got[18] == 57.0 and got[17] == 57.0 and got[10] == 1.0


def test_equal_probes_are_asked_once(spark):
    """the same rows as nearest gives, fewer probes; equal vectors of other own values are asked for themselves."""
    r = np.random.RandomState(6)
    x = r.normal(size=(12, 4))
    g = spark.createDataFrame([(f"n{i % 5}", i // 5, i, v.tolist()) for i, v in enumerate(x)], "identity string, pos long, own long, embedding array<double>")
    probes = spark.createDataFrame([(i, x[i % 3].tolist(), i % 6 if i % 7 else None) for i in range(40)], "probe long, embedding array<double>, own long")
    plain = lambda df: sorted((q.probe, q.rank, q.identity, q.pos, round(q.sim, 9)) for q in df.collect())
    assert plain(similarity.nearest_once(probes, g, 2, "own")) == plain(similarity.nearest(probes, g, 2, own="own")) != []
    assert plain(similarity.nearest_once(probes, g, 1)) == plain(similarity.nearest(probes, g, 1))


@pytest.mark.parametrize("n", [100, 5_000_000, 100_000_000, 10**10])
def test_hash_tables_by_size(spark, n):
    """64 bits in pieces; as many tables as are needed, and all pairs under 5 bits meet in them; one shuffle."""
    pieces = similarity.hash_pieces(n, 5)
    assert len(pieces) == {100: 5, 5_000_000: 6, 100_000_000: 7, 10**10: 8}[n] and sum(pieces) == (1 << 64) - 1
    r = np.random.RandomState(7)
    base = [int(v) for v in r.randint(0, 2**62, size=10)]
    every = base + [b ^ sum(1 << int(k) for k in r.choice(64, size=c, replace=False)) for b in base for c in (1, 4, 5)]
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(every)], "id long, phash string")
    found = similarity.hamming_join(df, 5, pieces)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # the tables never pass the driver
    assert {(q.a, q.b, q.distance) for q in found.collect()} == {(i, j, bin(u ^ v).count("1")) for i, u in enumerate(every) for j, v in enumerate(every) if i < j and bin(u ^ v).count("1") < 5}


def test_smoothing_across_ranges(spark):
    """ranges of a key give what one window over it gives."""
    r = np.random.RandomState(8)
    rows = [("a", i, i, r.normal(size=3).tolist()) for i in range(130)] + [("b", 0, 900, [0.0, 0.0, 0.0]), ("c", 0, 901, [3.0, 4.0, 0.0])]
    got = {q.id: q.smoothed for q in similarity.smoothed_rows(spark.createDataFrame(rows, "k string, pos long, id long, embedding array<double>"), "k", "id", ranges=32).collect()}
    for _, pos, i, _ in rows[:130]:
        v = np.array([x[3] for x in rows[max(0, pos - 19) : pos + 1]])
        y = (v * np.exp(np.linspace(-3, 0, len(v)) if len(v) > 1 else np.array([-3.0]))[:, None]).sum(axis=0)
        assert np.allclose(got[i], y / np.linalg.norm(y))
    assert got[900] is None and np.allclose(got[901], [0.6, 0.8, 0.0]) and len(got) == len(rows)


def test_rows_against_pivots_come_in_slices():
    """whatever a batch holds, few rows are held against all pivots at once."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([[float(i)] * 2 for i in range(1000)])], ["id", "v"])
    parts = list(cells._slices(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= cells.SLICE and [i for p in parts for i in p.column("id").to_pylist()] == list(range(1000))
    assert np.concatenate([similarity.matrix(pa.chunked_array([p.column("v")])) for p in parts])[:, 0].tolist() == list(range(1000))


def test_decided_ids_are_not_broadcast(spark):
    """rounds of a greedy pass join by sort, also where files look small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans = []
    real = maintenance.staged
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        maintenance.staged = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name)
        nodes, edges = spark.createDataFrame([(i,) for i in range(4)], "id long"), spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
        assert sorted(r.id for r in maintenance.greedy_keep(nodes, edges).collect()) == [0, 2, 3]
    finally:
        maintenance.staged = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize("alike", [0.2, 0.999])
def test_greedy_pass_over_segments(spark, monkeypatch, alike):
    """whatever segments an identity is cut into, rows kept are those of one pass in order of id."""
    monkeypatch.setattr(maintenance, "SEGMENT", 24)
    monkeypatch.setattr(maintenance, "RANGE_BITS", 3)
    r = np.random.RandomState(9)
    x = r.normal(size=(260, 6))
    x[130:200] = x[:70] + r.normal(size=(70, 6)) * 0.02  # near copies far behind
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i * 3 % 260, None if i == 5 else "a" if i % 4 else f"n{i % 3}", None if i == 6 else v.tolist()) for i, v in enumerate(x)]
    kept = []
    for i, name, v in sorted(rows, key=lambda q: q[0]):
        if name is None or v is None or not any(name == n and w is not None and float(np.dot(v, w)) > alike for _, n, w in kept):
            kept.append((i, name, v))
    got = maintenance.keep_apart(spark.createDataFrame(rows, "id long, identity string, embedding array<double>"), alike)
    assert sorted(q.id for q in got.collect()) == [i for i, _, _ in kept] and len(kept) < 260


def test_greedy_pass_stores_no_pairs(spark, monkeypatch):
    """400 vectors that are all alike are 79,800 pairs; no table that is written, and no tile, holds more rows than there are vectors."""
    from lumenvec.operators import similarity as s

    counts, real, tiles = [], maintenance.staged, s._key_tiles
    monkeypatch.setattr(maintenance, "SEGMENT", 64)
    monkeypatch.setattr(maintenance, "RANGE_BITS", 4)

    def staged(df, name):
        out = real(df, name)
        counts.append(out.count())
        return out

    def counted(*a):
        out = tiles(*a)
        counts.append(out.count())
        return out

    monkeypatch.setattr(maintenance, "staged", staged)
    monkeypatch.setattr(s, "_key_tiles", counted)
    v = np.ones(4) / 2 + np.random.RandomState(10).normal(size=(400, 4)) * 1e-3
    rows = [(i, "a", f"{(i * 0x9E3779B97F4A7C15) % (1 << 64):016x}", x.tolist()) for i, x in enumerate(v)]
    got = maintenance.dedupe(spark.createDataFrame(rows, "id long, identity string, phash string, embedding array<double>"))
    assert [q.id for q in got.collect()] == [0] and max(counts) <= 400
