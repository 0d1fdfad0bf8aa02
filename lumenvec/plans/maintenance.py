"""Queries of dedupe, merge, append, delete, labels and stored galleries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..operators import similarity
from ..sources import sinks
from .evaluation import CURVE
from .registry import query
from .tables import CATALOGUE, DETECTION, FACE_GROUP, GALLERY, actor, dealt, detection, face_group, gallery, hashes, movie, movie_cast, table, with_vectors


@query("w3_drop_repeats")
def w3(spark: SparkSession, d: str) -> DataFrame:
    faces = with_vectors(detection(spark, d), spark, d)
    return m.drop_repeats(faces, ["session", "event_type"], 0.1)


@query("w4_greedy_dedupe")
def w4(spark: SparkSession, d: str) -> DataFrame:
    """Texts and their copies with one bit flipped, with the vector of the text's number."""
    h = hashes(spark, d).select(F.col("doc_id").alias("id"), "phash", (F.col("doc_id") % 1_000_000_000).alias("vec_id"))
    return m.dedupe(h.join(gallery(spark, d).select("vec_id", "identity", "embedding"), "vec_id"), alike=0.2)


@query("u2_merge_galleries", f"with {GALLERY} select identity, vec_id % 20 = 0 as added, round(embedding[1], 6) as first_value, round(list_sum(embedding), 6) as total from gallery")
def u2(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    merged = m.merge_galleries(g.where("vec_id % 20 <> 0"), g.where("vec_id % 20 = 0 or vec_id % 3 = 0"))
    return merged.select("identity", "added", F.round(F.col("embedding")[0], 6).alias("first_value"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _keys(rows: DataFrame, name: str, *key: str) -> DataFrame:
    """One table's rows, by name and key."""
    return rows.select(F.lit(name).alias("name"), F.concat_ws(":", *(F.col(k).cast("string") for k in key)).alias("key"))


@query("m1_delete_actors", f"""with {CATALOGUE}, {GALLERY} select 'actor' as name, id::varchar as key from actor where id % 9 <> 0 union all select 'cast', movie_id || ':' || actor_id from movie_cast where actor_id % 9 <> 0
union all select 'gallery', identity || ':' || pos from gallery where identity not in ('id_0', 'id_9')""")
def m1(spark: SparkSession, d: str) -> DataFrame:
    gone = actor(spark, d).where("id % 9 = 0").select("id", F.concat(F.lit("id_"), (F.col("id") % 2 * 9).cast("string")).alias("name"))
    a, c, g = m.delete_actors(actor(spark, d), movie_cast(spark, d), gallery(spark, d), gone)
    return _keys(a, "actor", "id").union(_keys(c, "cast", "movie_id", "actor_id")).union(_keys(g, "gallery", "identity", "pos"))


@query("m2_delete_movies", f"""with {CATALOGUE}, {DETECTION}, {FACE_GROUP} select 'movie' as name, id::varchar as key from movie where id % 4 <> 0 union all select 'cast', movie_id || ':' || actor_id from movie_cast where movie_id % 4 <> 0
union all select 'group', movie_id || ':' || group_id from face_group where movie_id % 4 <> 0 or movie_id not in (select id from movie)
union all select case when session % 4 = 0 and session in (select id from movie) then 'loose' else 'held' end, det_id::varchar from detection""")
def m2(spark: SparkSession, d: str) -> DataFrame:
    faces = detection(spark, d).select(F.col("session").alias("movie_id"), F.col("event_type").alias("group_id"), "det_id")
    movies = dealt(movie(spark, d), table(spark, d, "orders"), "id")
    a, c, g, f = m.delete_movies(movies, movie_cast(spark, d), face_group(spark, d), faces, movie(spark, d).where("id % 4 = 0"))
    loose = f.select(F.when(F.col("group_id").isNull(), "loose").otherwise("held").alias("name"), F.col("det_id").cast("string").alias("key"))
    return _keys(a, "movie", "id").union(_keys(c, "cast", "movie_id", "actor_id")).union(_keys(g, "group", "movie_id", "group_id")).union(loose)


@query("m3_remove_links", f"with {CATALOGUE} select movie_id, actor_id from movie_cast where (movie_id + actor_id) % 7 <> 0")
def m3(spark: SparkSession, d: str) -> DataFrame:
    c = movie_cast(spark, d)
    return m.remove_rows(c, c.where("(movie_id + actor_id) % 7 = 0"), ["movie_id", "actor_id"])


@query("m4_bulk_update", f"with {DETECTION}, {FACE_GROUP} select movie_id, group_id, case when movie_id % 5 = 0 then 'LOW' else 'HIGH' end as risk_level, movie_id % 5 <> 0 as is_labeled from face_group")
def m4(spark: SparkSession, d: str) -> DataFrame:
    g = face_group(spark, d).select("movie_id", "group_id", F.lit("HIGH").alias("risk_level"), F.lit(True).alias("is_labeled"))
    return m.set_where(g, g.where("movie_id % 5 = 0"), ["movie_id", "group_id"], {"risk_level": "LOW", "is_labeled": False})


@query("m5_label_groups", f"""with {DETECTION} select det_id, case when session % 3 = 0 then 'id_' || (session % 10) else 'none' end as owner, session % 3 = 0 as is_labeled,
case when session % 3 = 0 then session || '_' || event_type || '_f' || det_id else 'f' || det_id end as file from detection""")
def m5(spark: SparkSession, d: str) -> DataFrame:
    x = detection(spark, d)
    faces = x.select("det_id", F.col("session").alias("movie_id"), F.col("event_type").alias("group_id"), F.concat(F.lit("f"), F.col("det_id").cast("string")).alias("file"), F.lit("none").alias("owner"))
    labels = x.where("session % 3 = 0").select(F.col("session").alias("movie_id"), F.col("event_type").alias("group_id"), F.concat(F.lit("id_"), (F.col("session") % 10).cast("string")).alias("name")).distinct()
    return m.label_groups(faces, labels, ["movie_id", "group_id"]).select("det_id", "owner", "is_labeled", "file")


@query("m6_discard_groups", f"with {DETECTION}, {FACE_GROUP} select movie_id, group_id from face_group where movie_id % 6 <> 0")
def m6(spark: SparkSession, d: str) -> DataFrame:
    g = face_group(spark, d)
    return m.remove_rows(g, g.where("movie_id % 6 = 0").select("movie_id").distinct(), ["movie_id"]).select("movie_id", "group_id")


@query("m7_append_vectors", f"with {GALLERY} select identity, file from gallery union all select identity, file || '_b' from gallery where vec_id % 10 = 0")
def m7(spark: SparkSession, d: str) -> DataFrame:
    """New vectors come in; of those that repeat one, listed files are left out, other file names come in."""
    g = gallery(spark, d)
    again = g.where("vec_id % 10 = 0").withColumn("file", F.concat("file", F.lit("_b")))
    rows = g.where("vec_id % 20 = 0 or vec_id % 3 = 0").unionByName(again).select("identity", "file", "embedding")
    return m.append_vectors(g.where("vec_id % 20 <> 0"), rows).select("identity", "file")


@query("m8_toggle_files", f"with {GALLERY} select identity, pos, file from gallery where vec_id % 4 <> 0")
def m8(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    return m.toggle_files(g, g.where("vec_id % 4 = 0")).select("identity", "pos", "file")


@query("m9_promote_guests", f"""with {CATALOGUE}, {GALLERY} select 'gallery' as name, identity || ':' || file as key from gallery
union all select 'gallery', identity || ':' || file || '_g' from gallery where vec_id % 2 = 1
union all (select 'cast', movie_id || ':' || actor_id from movie_cast union select 'cast', vec_id || ':1' from gallery)""")
def m9(spark: SparkSession, d: str) -> DataFrame:
    """Every vector is a guest against the whole gallery: those of even ids come with a listed file, others with a new one."""
    g = gallery(spark, d)
    file = F.when(F.col("vec_id") % 2 == 1, F.concat("file", F.lit("_g"))).otherwise(F.col("file"))
    guests = g.select(F.col("vec_id").alias("session"), F.lit("Misafir-1").alias("name"), file.alias("file"), "embedding", "identity")
    names = guests.select("session", "name", "identity", F.lit(1).cast("long").alias("actor_id"), F.col("session").alias("movie_id"))
    grown, links = m.promote_guests(guests.drop("identity"), names, g, movie_cast(spark, d))
    return _keys(grown, "gallery", "identity", "file").union(_keys(links, "cast", "movie_id", "actor_id"))


@query("k1_versioned_gallery", f"with {GALLERY} select identity, pos, 2 as version, true as refused from gallery where vec_id % 2 = 0")
def k1(spark: SparkSession, d: str) -> DataFrame:
    """Two versions; a third one that is based on the first is refused."""
    g, root, refused = gallery(spark, d), sinks.shared_dir(spark, "gallery"), False
    first = sinks.publish_gallery(g, root)
    sinks.publish_gallery(g.where("vec_id % 2 = 0"), root, based_on=first)
    try:
        sinks.publish_gallery(g.where("vec_id % 2 = 1"), root, based_on=first)
    except sinks.Conflict:
        refused = True
    return sinks.read_gallery(spark, root).select("identity", "pos", F.lit(sinks.current_version(spark, root)).alias("version"), F.lit(refused).alias("refused"))


@query("k2_upsert_groups", f"with {DETECTION}, {FACE_GROUP} select movie_id, group_id, case when movie_id % 2 = 0 then face_count + 1000 else face_count end as face_count from face_group")
def k2(spark: SparkSession, d: str) -> DataFrame:
    g, path = face_group(spark, d).select("movie_id", "group_id", "face_count"), sinks.shared_dir(spark, "groups")
    sinks.upsert_groups(g, path)
    sinks.upsert_groups(g.where("movie_id % 2 = 0").withColumn("face_count", F.col("face_count") + 1000), path)
    return sinks.read_groups(spark, path, g.schema).select("movie_id", "group_id", "face_count")


@query("k3_kept_report", f"with {CURVE} select threshold, round(tpr, 6) as tpr, round(far, 6) as far, true as kept from curve")
def k3(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of a gallery's version, made once and read the second time."""
    root, g = sinks.shared_dir(spark, "reports"), gallery(spark, d)
    make = lambda: {"roc": similarity.roc(similarity.similarity_counts(g))}
    parameters = {"report": "roc", "version": 1}
    sinks.kept_report(spark, root, parameters, make)
    tables, kept = sinks.kept_report(spark, root, parameters, make)
    return tables["roc"].select("threshold", F.round("tpr", 6).alias("tpr"), F.round("far", 6).alias("far"), F.lit(kept).alias("kept"))
