"""Canonical tables derived from the driver's, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1920.0, 1080.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of two or three numbers that a task is to hold at most.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, held: DataFrame, *key: str) -> DataFrame:
    """rows by key in as many parts as held, the table that they are of, has TASK_ROWS. Rows of a few numbers take so
    little room in a shuffle that Spark would join its parts to one for each core, whose tasks grow with the table. As
    many rows as the cores have TASK_ROWS are left as they are. held is counted by its files' footers."""
    parts = -(-held.count() // TASK_ROWS)
    return rows.repartition(parts, *key) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity, pos, file, embedding, vec_id."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("id_"), F.col("label").cast("string")).alias("identity"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("file"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        "vec_id",
    )


GALLERY = """gallery as (
  select 'id_' || label as identity, row_number() over (partition by label order by vec_id) - 1 as pos,
    'f' || vec_id as file, embedding::double[] as embedding, vec_id from embeddings
)"""


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One face in one frame of a session: box, landmarks, scores and the vector's number."""
    n = table(spark, sf_dir, "embeddings").count()
    e = F.col("event_id")
    x1, y1 = (e * 13 % 1800).cast("double"), (e * 29 % 960).cast("double")
    w, h = (30 + e * 7 % 140).cast("double"), (30 + e * 11 % 150).cast("double")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = table(spark, sf_dir, "events")
    base = dealt(events, events, "user_id").select(
        e.alias("det_id"), F.col("user_id").alias("session"), "ts", "event_type", frame.cast("long").alias("frame"), (e % n).alias("vec_id"),
        ((e * 37 % 101) / F.lit(100.0)).alias("det_score"), x1.alias("x1"), y1.alias("y1"), w.alias("w"), h.alias("h"),
        (e * 53 % 600).cast("double").alias("blur_var"), (e * 31 % 256).cast("double").alias("brightness"), (e % 5).alias("m5"), (e % 9).alias("m9"), (e % 7).alias("m7"),
    )
    point = lambda x, y: F.array(x, y)
    left = point(F.col("x1") + 0.3 * F.col("w"), F.col("y1") + 0.4 * F.col("h"))
    right = point(F.col("x1") + (0.45 + 0.15 * F.col("m5")) * F.col("w"), F.col("y1") + 0.4 * F.col("h"))
    nose = point(F.col("x1") + (0.3 + 0.05 * F.col("m9")) * F.col("w"), F.col("y1") + (0.5 + 0.05 * F.col("m7")) * F.col("h"))
    mouth = [point(F.col("x1") + f * F.col("w"), F.col("y1") + 0.8 * F.col("h")) for f in (0.35, 0.65)]
    return base.select(
        "det_id", "session", "ts", "event_type", "frame", "vec_id", "det_score", "blur_var", "brightness",
        F.array("x1", "y1", F.col("x1") + F.col("w"), F.col("y1") + F.col("h")).alias("bbox"),
        F.array(left, right, nose, *mouth).alias("landmarks"),
    )


DETECTION = """detection as (
  select det_id, session, ts, event_type, frame, vec_id, det_score, blur_var, brightness, [x1, y1, x1 + w, y1 + h] as bbox,
    [[x1 + 0.3 * w, y1 + 0.4 * h], [x1 + (0.45 + 0.15 * m5) * w, y1 + 0.4 * h], [x1 + (0.3 + 0.05 * m9) * w, y1 + (0.5 + 0.05 * m7) * h],
     [x1 + 0.35 * w, y1 + 0.8 * h], [x1 + 0.65 * w, y1 + 0.8 * h]] as landmarks
  from (
    select event_id as det_id, user_id as session, ts, event_type, row_number() over (partition by user_id order by ts, event_id) as frame,
      event_id % (select count(*) from embeddings) as vec_id, (event_id * 37 % 101)::double / 100.0::double as det_score,
      (event_id * 13 % 1800)::double as x1, (event_id * 29 % 960)::double as y1, (30 + event_id * 7 % 140)::double as w,
      (30 + event_id * 11 % 150)::double as h, (event_id * 53 % 600)::double as blur_var, (event_id * 31 % 256)::double as brightness,
      (event_id % 5)::double as m5, (event_id % 9)::double as m9, (event_id % 7)::double as m7
    from events
  )
)"""


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Film "), F.col("o_orderkey").cast("string")).alias("title"))


def actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))


def movie_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as they are, once each. They are dealt by film before repeats go, as a file's part has almost none, and
    tables of all rows of a part would be made to find it out."""
    line = table(spark, sf_dir, "lineitem")
    return dealt(line.select(F.col("l_orderkey").alias("movie_id"), F.col("l_partkey").alias("actor_id")), line, "movie_id").distinct()


CATALOGUE = """movie as (select o_orderkey as id, 'Film ' || o_orderkey as title from orders),
actor as (select p_partkey as id, p_name || '_' || p_partkey as name from part),
movie_cast as (select distinct l_orderkey as movie_id, l_partkey as actor_id from lineitem)"""


def face_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of faces: session x event type stand for movie x group. Scores are added up in the order of faces, so a
    mean has the same last digit whatever tasks read its rows."""
    d = detection(spark, sf_dir)
    scores = F.transform(F.sort_array(F.collect_list(F.when(F.col("det_score").isNotNull(), F.struct("det_id", "det_score")))), lambda s: s["det_score"])
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    return d.groupBy(F.col("session").alias("movie_id"), F.concat(F.lit("group_"), F.col("event_type")).alias("group_id")).agg(
        F.count(F.lit(1)).alias("face_count"), mean.alias("avg_confidence")
    )


FACE_GROUP = """face_group as (
  select session as movie_id, 'group_' || event_type as group_id, count(*) as face_count, avg(det_score) as avg_confidence
  from detection group by 1, 2
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of actors as paths: labelled ones from lineitem, profile pictures for every seventh part."""
    labeled = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("labeled_faces/p"), F.col("l_partkey").cast("string"), F.lit("/film"), (F.col("l_orderkey") % 50).cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("path")
    )
    profile = table(spark, sf_dir, "part").select(F.concat(F.lit("profiles/p"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".txt").otherwise(".PNG")).alias("path")).where(F.col("path").isNotNull())
    return labeled.union(profile)


FILES = """files as (
  select 'labeled_faces/p' || l_partkey || '/film' || (l_orderkey % 50) || '_' || l_linenumber || '_' || l_orderkey || '.jpg' as path from lineitem
  union all
  select 'profiles/p' || p_partkey || '/' || p_size || case when p_partkey % 3 = 0 then '.txt' else '.PNG' end from part
)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, phash: 16 digits of each text's MD5, and for every text a copy (doc_id + 1e9) with one bit flipped."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 16).alias("phash")).where(F.col("phash").isNotNull())
    digit = F.substring("phash", 16, 1)
    flipped = F.translate(digit, "0123456789abcdef", "1032547698badcfe")
    return own.union(own.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.concat(F.substring("phash", 1, 15), flipped).alias("phash")))


HASHES = """hashes as (
  select doc_id, substring(md5(text), 1, 16) as phash from documents where text is not null
  union all
  select doc_id + 1000000000, substring(md5(text), 1, 15) || translate(substring(md5(text), 16, 1), '0123456789abcdef', '1032547698badcfe')
  from documents where text is not null
)"""


def with_vectors(d: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return d.join(vectors, "vec_id")
