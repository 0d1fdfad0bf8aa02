"""Queries of sources, joins, aggregates and windows on the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.text import identification_rate, quality_rate
from ..operators import catalogue as c
from ..operators import gates, trigrams
from ..sources import readers
from .registry import query
from .scalars import _NAMES, _POSE, REASON, named
from .tables import CATALOGUE, DETECTION, FACE_GROUP, FILES, GALLERY, HEIGHT, WIDTH, actor, detection, face_group, files, gallery, movie, movie_cast, table


@query("s1_actor_list", "select distinct lower(replace(trim(' ' || p_brand || '. '), '.', '')) as name from part")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return readers.actor_names(table(spark, d, "part").select(F.concat(F.lit(" "), "p_brand", F.lit(". ")).alias("name")))


_CAST_ROWS = "select p_partkey as n, p_brand as title, case when p_size % 10 > 0 then p_name || ', ' || p_type || ' , ' end as names from part"


@query("s2_cast_lists", f"""with r as ({_CAST_ROWS}), l as (select title, arg_max(names, n) as names from r where names is not null group by 1)
select title, trim(x) as name from (select title, unnest(string_split(names, ',')) as x from l) where trim(x) <> ''""")
def s2(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("p_size") % 10 > 0, F.concat("p_name", F.lit(", "), "p_type", F.lit(" , ")))
    return readers.cast_lists(table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("title"), names.alias("names")))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """The gallery in its stored layouts: by label, some fields are missing."""
    g = gallery(spark, d).groupBy("identity").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "embedding"))), lambda s: s["embedding"]).alias("v"))
    k = F.substring("identity", 4, 9).cast("int")
    return g.select("identity", F.when(k % 3 == 0, F.slice("v", 1, 2)).alias("templates"), F.when(k % 2 == 0, F.col("v")).alias("all_embeddings"), F.when(k % 4 == 1, F.col("v")[0]).alias("embedding"), F.when(k % 4 == 3, F.slice("v", 1, 3)).alias("bare"))


@query("s3_gallery_layouts", f"""with {GALLERY}, g as (select identity, substring(identity, 4)::int as k, count(*) as n from gallery group by 1), c as (
  select identity, 'recognise' as mode, case when k % 3 = 0 then least(n, 2) when k % 2 = 0 then least(10, ceil(n / greatest(1, n // 10))) when k % 4 = 1 then 1 else least(n, 3) end as vectors from g
  union all select identity, 'merge', case when k % 3 = 0 then least(n, 2) when k % 2 = 0 then n when k % 4 = 1 then 1 else least(n, 3) end from g
  union all select identity, 'evaluate', case when k % 2 = 0 then n when k % 4 = 1 then 1 when k % 3 = 0 then least(n, 2) else 0 end from g
) select identity, mode, vectors::bigint as vectors from c where vectors > 0""")
def s3(spark: SparkSession, d: str) -> DataFrame:
    raw, out = _raw(spark, d), None
    for mode in readers.MODES:
        one = readers.explode_gallery(raw, mode).groupBy("identity").agg(F.count(F.lit(1)).alias("vectors")).select("identity", F.lit(mode).alias("mode"), "vectors")
        out = one if out is None else out.union(one)
    return out


_INVENTORY = f"""{FILES}, inventory as (
  select p[1] as kind, p[2] as owner, case when len(p) > 3 then p[3] end as group_id, p[-1] as file
  from (select string_split(path, '/') as p, path from files) where regexp_matches(path, '(?i)\\.(jpg|jpeg|png)$') and len(p) >= 3
)"""


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return readers.inventory(files(spark, d))


@query("s4_catalogue_table", "select o_orderkey as id, 'Film ' || o_orderkey as title from orders where o_orderkey > 100")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """A table of the session's catalogue by its name, as one by JDBC is read."""
    movie(spark, d).createOrReplaceTempView("lumenvec_movie")
    return readers.read_table(spark, "lumenvec_movie").where("id > 100")


@query("s5_inventory", f"with {_INVENTORY} select kind, owner, count(*) as n, min(file) as first_file, max(file) as last_file from inventory group by all")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return _inventory(spark, d).groupBy("kind", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


_GROUPS = f"{CATALOGUE}, {DETECTION}, {FACE_GROUP}"


@query("s8_group_metadata", f"with {_GROUPS} select movie_id, title, group_id, face_count from face_group join movie on movie.id = movie_id")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return readers.group_metadata(face_group(spark, d), movie(spark, d)).select("movie_id", "title", "group_id", "face_count")


@query("f5_cast_gallery", f"with {GALLERY} select identity, count(*) as n from gallery where identity in (select 'id_' || (n_nationkey % 4) from nation) group by 1")
def f5(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.concat(F.lit("id_"), (F.col("n_nationkey") % 4).cast("string")).alias("identity")).distinct()
    return gates.cast_only(gallery(spark, d), names).groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


@query("f6_size_window", f"with {GALLERY}, n as (select identity, count(*) as n from gallery group by 1) select identity, n as vectors from n where n between 4 and 50")
def f6(spark: SparkSession, d: str) -> DataFrame:
    dim = 64
    return gates.size_window(gallery(spark, d), 4, 50, dim).groupBy("identity").agg(F.count(F.lit(1)).alias("vectors"))


@query("f7_search", f"with {CATALOGUE} select id, name from actor where contains(lower(name), '_12') order by name limit 20")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return gates.search(actor(spark, d), "name", " 12", 20)


@query("f7_search_indexed", f"with {CATALOGUE} select id, name from actor where contains(lower(name), '_12') order by name limit 20")
def f7_indexed(spark: SparkSession, d: str) -> DataFrame:
    rows = actor(spark, d)
    return trigrams.search_indexed(trigrams.build(rows, "id", "name"), rows, " 12", 20)


_MOVIES = f"with {CATALOGUE} select id, title from movie where contains(lower(title), 'm 12') order by title limit 10"


@query("t4_movie_search_indexed", _MOVIES)
def t4_indexed(spark: SparkSession, d: str) -> DataFrame:
    rows = movie(spark, d)
    return trigrams.search_indexed(trigrams.build(rows, "id", "title"), rows, "M 12", 10, shortest=2)


@query("t4_movie_search", _MOVIES)
def t4(spark: SparkSession, d: str) -> DataFrame:
    return gates.search(movie(spark, d), "title", "M 12", 10, shortest=2)


@query("f8_usable", f"with {DETECTION} select det_id from detection where det_id % 5 <> 0 and det_id % 11 <> 0")
def f8(spark: SparkSession, d: str) -> DataFrame:
    flagged = detection(spark, d).withColumns({"is_valid": F.col("det_id") % 5 != 0, "is_outlier": F.col("det_id") % 11 == 0})
    return gates.usable(flagged).select("det_id")


@query("f9_small_groups", f"with {DETECTION}, {FACE_GROUP} select movie_id, group_id, face_count, (select count(*) from face_group where face_count < 20) as dropped from face_group where face_count >= 20")
def f9(spark: SparkSession, d: str) -> DataFrame:
    kept, dropped = gates.drop_small(face_group(spark, d), 20)
    return kept.select("movie_id", "group_id", "face_count").withColumn("dropped", F.lit(dropped.first()[0]))


@query("f10_admin_filters", f"with {_GROUPS} select movie_id, group_id, title from face_group join movie on movie.id = movie_id where avg_confidence <= 0.5::double and title like 'Film 1%'")
def f10(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.group_metadata(face_group(spark, d), movie(spark, d))
    return rows.where((F.col("avg_confidence") <= 0.5) & F.startswith("title", F.lit("Film 1"))).select("movie_id", "group_id", "title")


_J1 = f"with {CATALOGUE} select movie_id, title, actor_id, name from movie_cast join movie on movie.id = movie_id join actor on actor.id = actor_id"


@query("j1_movie_actors", _J1)
def j1(spark: SparkSession, d: str) -> DataFrame:
    return c.movie_actors(movie(spark, d), movie_cast(spark, d), actor(spark, d))


@query("j2_resolve_names", f"with {CATALOGUE}, w as (select p_partkey, case when p_partkey % 4 = 0 then p_name || '_x' else p_name || '_' || p_partkey end as name from part) select w.name, actor.id as actor_id from w left join actor using (name)")
def j2(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("_x"))).otherwise(F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")))
    return c.resolve_names(p.select(name.alias("name")), actor(spark, d)).select("name", "actor_id")


@query("j3_only_new", f"with {CATALOGUE} select 'Film ' || (c_custkey * 97) as title from customer where 'Film ' || (c_custkey * 97) not in (select title from movie)")
def j3(spark: SparkSession, d: str) -> DataFrame:
    """Some of the titles are films' already."""
    rows = table(spark, d, "customer").select(F.concat(F.lit("Film "), (F.col("c_custkey") * 97).cast("string")).alias("title"))
    return c.only_new(rows, movie(spark, d), "title")


@query("j4_insert_ignore", f"with {CATALOGUE} select title, min(src) as src from (select title, 0 as src from movie union all select 'Film ' || c_custkey, 1 from customer) group by 1")
def j4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat(F.lit("Film "), F.col("c_custkey").cast("string")).alias("title"), F.lit(1).alias("src"))
    return c.insert_ignore(movie(spark, d).select("title", F.lit(0).alias("src")), rows.union(rows), ["title"])


@query("j5_find_movies", f"""with {CATALOGUE}, w as (select case c_custkey % 3 when 0 then 'Film ' || c_custkey when 1 then 'Film_' || c_custkey else 'New ' || c_custkey end as title from customer),
e as (select title, min(id) as exact_id from movie group by 1), s as (select replace(title, ' ', '_') as safe, min(id) as safe_id from movie group by 1)
select w.title, coalesce(exact_id, safe_id) as movie_id, case when exact_id is not null then 'exact' when safe_id is not null then 'safe' else 'create' end as how
from w left join e using (title) left join s on s.safe = replace(w.title, ' ', '_')""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    title = F.when(k == 0, F.concat(F.lit("Film "), s)).when(k == 1, F.concat(F.lit("Film_"), s)).otherwise(F.concat(F.lit("New "), s))
    return c.find_movies(table(spark, d, "customer").select(title.alias("title")), movie(spark, d))


_SYNC = f"""with {DETECTION}, {FACE_GROUP}, f as (select * from face_group where movie_id % 3 <> 0), r as (select * from face_group where movie_id % 4 <> 0)
select coalesce(f.movie_id, r.movie_id) as movie_id, coalesce(f.group_id, r.group_id) as group_id, coalesce(f.face_count, r.face_count) as face_count,
  case when r.movie_id is null then 'HIGH' end as risk_level, case when r.movie_id is null then 'insert' when f.movie_id is null then 'delete' else 'keep' end as action
from f full outer join r on f.movie_id = r.movie_id and f.group_id = r.group_id"""


@query("j6_sync", _SYNC)
def j6(spark: SparkSession, d: str) -> DataFrame:
    g = face_group(spark, d)
    return c.sync(g.where("movie_id % 3 <> 0"), g.where("movie_id % 4 <> 0"), ["movie_id", "group_id"])


@query("u1_key_differences", f"with {DETECTION}, {FACE_GROUP} select movie_id, group_id, case when movie_id % 4 = 0 then 'insert' else 'delete' end as action from face_group where (movie_id % 3 <> 0) <> (movie_id % 4 <> 0)")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return j6(spark, d).where("action <> 'keep'").select("movie_id", "group_id", "action")


@query("j11_page_defaults", f"with {DETECTION}, {FACE_GROUP} select movie_id, group_id, case when movie_id % 2 = 0 then face_count else 0 end as face_count, case when movie_id % 2 = 0 then 'LOW' else 'HIGH' end as risk_level from face_group")
def j11(spark: SparkSession, d: str) -> DataFrame:
    g = face_group(spark, d)
    stats = g.where("movie_id % 2 = 0").select("movie_id", "group_id", "face_count", F.lit("LOW").alias("risk_level"))
    return c.with_defaults(g.select("movie_id", "group_id"), stats, ["movie_id", "group_id"])


@query("j12_pictures", f"""with {_INVENTORY} select o.owner, coalesce(p.f, l.f) as picture from (select 'p' || p_partkey as owner from part) o
left join (select owner, min(file) as f from inventory where kind = 'profiles' group by 1) p using (owner) left join (select owner, min(file) as f from inventory where kind = 'labeled_faces' group by 1) l using (owner)""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("owner"))
    return c.pictures(owners, _inventory(spark, d))


@query("j13_embedded_flag", f"with {GALLERY} select identity, file, vec_id % 2 = 0 as embedded from gallery")
def j13(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    return c.embedded_flag(g.select("identity", "file"), g.where("vec_id % 2 = 0"))


@query("a1_link_counts", f"with {CATALOGUE} select 'movie' as kind, m.id, count(x.actor_id) as n from movie m left join movie_cast x on x.movie_id = m.id group by all union all select 'actor', a.id, count(x.movie_id) from actor a left join movie_cast x on x.actor_id = a.id group by all")
def a1(spark: SparkSession, d: str) -> DataFrame:
    links = movie_cast(spark, d)
    m = c.link_counts(movie(spark, d), links, "id", "movie_id").select(F.lit("movie").alias("kind"), "id", "n")
    return m.union(c.link_counts(actor(spark, d), links, "id", "actor_id").select(F.lit("actor").alias("kind"), "id", "n"))


@query("a2_owner_summary", f"with {_INVENTORY}, s as (select owner, split_part(coalesce(group_id, file), '_', 1) as film from inventory) select owner, count(*) as photos, count(distinct film) as films, array_to_string(list_sort(list_distinct(list(film))), ',') as film_list from s group by 1")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return c.owner_summary(_inventory(spark, d)).withColumn("film_list", F.array_join("film_list", ","))


@query("a3_dashboard", f"""with {CATALOGUE}, {_INVENTORY}, t as (select (select count(*) from actor) as actors, (select count(*) from movie) as movies, (select count(*) from inventory where kind = 'labeled_faces') as labeled, (select count(*) from inventory where kind = 'profiles') as pending)
select actors, movies, labeled, pending, floor(100 * labeled / (labeled + pending))::int as identified, (case when pending = 0 then 100 else greatest(0, 100 - floor(100 * pending / (labeled + pending + 1))) end)::int as quality from t""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    faces = _inventory(spark, d).agg(F.count_if(F.col("kind") == "labeled_faces").alias("labeled"), F.count_if(F.col("kind") == "profiles").alias("pending"))
    totals = faces.crossJoin(actor(spark, d).agg(F.count(F.lit(1)).alias("actors"))).crossJoin(movie(spark, d).agg(F.count(F.lit(1)).alias("movies")))  # one row each
    return totals.select("actors", "movies", "labeled", "pending", identification_rate(F.col("labeled"), F.col("pending")).alias("identified"), quality_rate(F.col("labeled"), F.col("pending")).alias("quality"))


@query("a4_appearances", f"with {DETECTION} select {_NAMES} as name, count(*) as n from detection group by 1 order by n desc, name limit 15")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return c.appearance_counts(named(spark, d), 15)


@query("a5_groups_per_movie", f"with {DETECTION}, {FACE_GROUP} select movie_id, count(*) as n from face_group where face_count >= 20 group by 1 having count(*) > 0")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return face_group(spark, d).where("face_count >= 20").groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))


@query("a6_group_stats", f"""with {_POSE}, s as (select session as movie_id, event_type as group_id, case when row_number() over (partition by session, event_type order by frame, det_score) = 1 then 1.0::double else det_score end as s, pose_score as q from pose),
g as (select movie_id, group_id, count(*) as face_count, avg(s) as a, avg(q) as q from s group by all)
select movie_id, group_id, face_count, round(a, 6) as avg_sim, round(q, 6) as avg_quality, case when round(a, 9) > 0.70::double then 'LOW' when round(a, 9) > 0.55::double then 'MEDIUM' else 'HIGH' end as risk_level from g""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    faces = detection(spark, d).select(F.col("session").alias("movie_id"), F.col("event_type").alias("group_id"), "frame", F.col("det_score").alias("sim"), scores.pose_score(F.col("landmarks")).alias("quality"))
    return c.group_stats(faces, ["movie_id", "group_id"]).withColumns({"avg_sim": F.round("avg_sim", 6), "avg_quality": F.round("avg_quality", 6)})


@query("a7_reject_counts", f"with {DETECTION} select {REASON} as reason, count(*) as n from detection group by 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).groupBy(gates.reject_reason(WIDTH, HEIGHT).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a7_pose_pivot", f"""with {_POSE} select session, count(*) filter (pose = 'Frontal') as "Frontal", count(*) filter (pose = 'Tilted') as "Tilted", count(*) filter (pose = 'Profile') as "Profile", count(*) filter (pose = 'Unknown') as "Unknown" from pose group by 1""")
def a7_pivot(spark: SparkSession, d: str) -> DataFrame:
    return c.pose_pivot(detection(spark, d).select("session", scores.pose_label(F.col("landmarks")).alias("pose")), "session")


@query("a21_representative", f"with {_POSE} select session, event_type, arg_max(det_id, (case when pose = 'Frontal' then 1e12::double else 0 end) + blur_var * 1e6::double - frame) as det_id from pose group by all")
def a21(spark: SparkSession, d: str) -> DataFrame:
    faces = detection(spark, d).select("session", "event_type", "det_id", "frame", "blur_var", scores.pose_label(F.col("landmarks")).alias("pose"))
    return c.representative(faces, ["session", "event_type"], "det_id")


@query("a22_distinct_films", f"with {_INVENTORY} select count(distinct split_part(coalesce(group_id, file), '_', 1)) as films, ceil(count(*) / 20.0)::bigint as pages from inventory")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return _inventory(spark, d).agg(F.countDistinct(text.source_of_file(F.coalesce("group_id", "file"))).alias("films"), F.ceil(F.count(F.lit(1)) / 20).alias("pages"))


@query("a23_largest_box", f"with {DETECTION} select session, arg_max(det_id, (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) * 1e9::double - det_id) as det_id from detection group by 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return c.largest_box(detection(spark, d), ["session"], "det_id")


@query("k5_guest_snapshot", f"with {DETECTION} select session, {_NAMES} as name, arg_min(vec_id, frame) as vec_id from detection where starts_with({_NAMES}, 'Misafir') group by all")
def k5(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).where(text.is_guest(F.col("name"))).groupBy("session", "name").agg(F.min_by("vec_id", "frame").alias("vec_id"))


@query("w1_first_pictured", f"with {_INVENTORY}, {CATALOGUE}, x as (select movie_id, actor_id, row_number() over (partition by movie_id order by actor_id) as n from movie_cast where 'p' || actor_id in (select owner from inventory)) select movie_id, actor_id from x where n <= 4")
def w1(spark: SparkSession, d: str) -> DataFrame:
    have = _inventory(spark, d).select("owner").distinct()
    cast = movie_cast(spark, d).withColumn("owner", F.concat(F.lit("p"), F.col("actor_id").cast("string"))).join(have, "owner", "left_semi")
    return c.first_of_each(cast.select("movie_id", "actor_id"), "movie_id", ["actor_id"], 4)


@query("w2_first_photos", f"with {_INVENTORY}, x as (select owner, file, row_number() over (partition by owner order by file) as n from inventory) select owner, file from x where n <= 5")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return c.first_of_each(_inventory(spark, d).select("owner", "file"), "owner", ["file"], 5)


@query("w6_page", f"with {DETECTION}, {FACE_GROUP} select movie_id, group_id, ceil((select count(*) from face_group) / 20.0)::int as pages from face_group order by movie_id, group_id limit 20 offset 40")
def w6(spark: SparkSession, d: str) -> DataFrame:
    shown, told = c.page(face_group(spark, d).select("movie_id", "group_id"), ["movie_id", "group_id"], 3, 20)
    return shown.withColumn("pages", F.lit(told["pages"]))


@query("t1_cast_order", f"with {DETECTION}, n as (select {_NAMES} as name, count(*) as n from detection group by 1) select name, n, row_number() over (order by name = 'Unknown', starts_with(name, 'Misafir'), n desc, name) as place from n")
def t1(spark: SparkSession, d: str) -> DataFrame:
    counts = c.appearance_counts(named(spark, d))
    place = Window.orderBy(F.col("name") == "Unknown", text.is_guest(F.col("name")), F.desc("n"), "name")  # a row for each name
    return c.cast_order(counts.select("name", "n", F.row_number().over(place).alias("place")))


@query("t2_default_order", f"with {_GROUPS} select movie_id, group_id from face_group order by movie_id, group_id")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return face_group(spark, d).select("movie_id", "group_id").orderBy("movie_id", "group_id")


@query("u3_distinct_names", "select distinct lower(replace(p_type, '.', '')) as name from part")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(text.normalize_name(F.col("p_type")).alias("name")).distinct()
