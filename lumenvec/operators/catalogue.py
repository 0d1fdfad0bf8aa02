"""Joins, aggregates and windows on the catalogue and its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import risk_level
from ..functions.text import safe_name, source_of_file


def movie_actors(movies: DataFrame, cast: DataFrame, actors: DataFrame) -> DataFrame:
    """Title, name of every cast link."""
    m, a = movies.select(F.col("id").alias("movie_id"), "title"), actors.select(F.col("id").alias("actor_id"), "name")
    return cast.join(m, "movie_id").join(a, "actor_id").select("movie_id", "title", "actor_id", "name")


def resolve_names(names: DataFrame, actors: DataFrame) -> DataFrame:
    """Names with the actor's id, null where there is none."""
    return names.join(actors.select("name", F.col("id").alias("actor_id")), "name", "left")


def only_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not exist yet."""
    return rows.join(existing.select(key), key, "left_anti")


def insert_ignore(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Existing and, once each, the rows of new keys."""
    return existing.unionByName(rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti"))


def find_movies(wanted: DataFrame, movies: DataFrame) -> DataFrame:
    """Title, movie_id, how: by exact title, else by equal safe name (the smallest id), else to be created."""
    exact = movies.groupBy("title").agg(F.min("id").alias("exact_id"))
    safe = movies.groupBy(safe_name(F.col("title")).alias("_safe")).agg(F.min("id").alias("safe_id"))
    joined = wanted.join(exact, "title", "left").withColumn("_safe", safe_name(F.col("title"))).join(safe, "_safe", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("safe_id").isNotNull(), "safe").otherwise("create")
    return joined.select("title", F.coalesce("exact_id", "safe_id").alias("movie_id"), how.alias("how"))


def sync(folders: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Key, face_count, risk_level, action: folders without a row are inserted (risk HIGH), rows without
    a folder deleted, others kept. folders has face_count."""
    f = folders.select(*key, F.col("face_count").alias("folder_count"), F.lit(True).alias("_f"))
    r = rows.select(*key, F.col("face_count").alias("row_count"), F.lit(True).alias("_r"))
    action = F.when(F.col("_r").isNull(), "insert").when(F.col("_f").isNull(), "delete").otherwise("keep")
    return f.join(r, key, "full_outer").select(*key, F.coalesce("folder_count", "row_count").alias("face_count"), F.when(action == "insert", "HIGH").alias("risk_level"), action.alias("action"))


def with_defaults(page: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """Page rows with stats, HIGH risk and 0 where missing."""
    return page.join(stats, key, "left").withColumns({"risk_level": F.coalesce("risk_level", F.lit("HIGH")), "face_count": F.coalesce("face_count", F.lit(0).cast("long"))})


def pictures(owners: DataFrame, inventory: DataFrame) -> DataFrame:
    """Owner, picture: the first profile picture, else the first labelled one, else null."""
    first = lambda kind, name: inventory.where(F.col("kind") == kind).groupBy("owner").agg(F.min("file").alias(name))
    return owners.join(first("profiles", "_p"), "owner", "left").join(first("labeled_faces", "_l"), "owner", "left").select("owner", F.coalesce("_p", "_l").alias("picture"))


def embedded_flag(photos: DataFrame, gallery: DataFrame) -> DataFrame:
    """Photos (identity, file) with embedded."""
    have = gallery.select("identity", "file").distinct().withColumn("_e", F.lit(True))
    return photos.join(have, ["identity", "file"], "left").select("identity", "file", F.col("_e").isNotNull().alias("embedded"))


def link_counts(keys: DataFrame, links: DataFrame, key: str, link_key: str) -> DataFrame:
    """A1: key, n links, 0 kept."""
    n = links.groupBy(F.col(link_key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return keys.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def owner_summary(inventory: DataFrame) -> DataFrame:
    """A2: owner, photos, films, film_list."""
    film = source_of_file(F.coalesce("group_id", "file"))
    return inventory.groupBy("owner").agg(F.count(F.lit(1)).alias("photos"), F.countDistinct(film).alias("films"), F.sort_array(F.collect_set(film)).alias("film_list"))


def appearance_counts(names: DataFrame, top: int | None = None) -> DataFrame:
    """A4: name, n, the most frequent first."""
    n = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")
    return n.limit(top) if top else n


def group_stats(faces: DataFrame, key: list[str]) -> DataFrame:
    """Faces, mean similarity (the first face counts 1), mean quality, risk. faces: key, frame, sim, quality."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy("frame", "sim"))
    rated = faces.withColumn("_s", F.when(first == 1, 1.0).otherwise(F.col("sim")))
    out = rated.groupBy(*key).agg(F.count(F.lit(1)).alias("face_count"), F.avg("_s").alias("avg_sim"), F.avg("quality").alias("avg_quality"))
    return out.withColumn("risk_level", risk_level(F.round(F.coalesce("avg_sim", F.lit(1.0)), 9)))


def pose_pivot(rows: DataFrame, key: str) -> DataFrame:
    """Key and a count of each pose."""
    return rows.groupBy(key).pivot("pose", ["Frontal", "Tilted", "Profile", "Unknown"]).agg(F.count(F.lit(1))).na.fill(0)


def representative(faces: DataFrame, key: list[str], value: str) -> DataFrame:
    """Value of each group's best face: frontal first, then the sharpest, then the earliest."""
    order = F.struct((F.col("pose") == "Frontal").alias("a"), F.col("blur_var").alias("b"), (-F.col("frame")).alias("c"))
    return faces.groupBy(*key).agg(F.max_by(value, order).alias(value))


def largest_box(faces: DataFrame, key: list[str], value: str) -> DataFrame:
    """Value of each image's largest box, the smallest value of equals."""
    area = (F.col("bbox")[2] - F.col("bbox")[0]) * (F.col("bbox")[3] - F.col("bbox")[1])
    return faces.groupBy(*key).agg(F.max(F.struct(area.alias("a"), (-F.col(value)).alias("v"))).alias("m")).select(*key, (-F.col("m.v")).alias(value))


def first_of_each(rows: DataFrame, key: str, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def page(rows: DataFrame, order: list[str], number: int | str, size: int) -> tuple[DataFrame, dict]:
    """The rows of a page, and its counts. Beyond the last page: the last; no number: the first."""
    total = rows.count()
    pages = max(1, -(-total // size))
    try:
        asked = int(number)
    except ValueError:
        asked = 1
    at = pages if asked < 1 or asked > pages else asked
    shown = rows.orderBy(*order).offset((at - 1) * size).limit(size)
    return shown, {"page": at, "pages": pages, "total": total, "has_next": at < pages, "has_previous": at > 1}


def cast_order(counts: DataFrame) -> DataFrame:
    """Known names first, guests after them, Unknown last; frequent ones first within each."""
    return counts.orderBy(F.col("name") == "Unknown", F.startswith("name", F.lit("Misafir")), F.desc("n"), "name")
