"""Queries of similarity joins, centroids, outliers and the gallery's evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, templates
from ..operators import similarity as s
from .registry import query
from .tables import GALLERY, HASHES, gallery, hashes

_PAIRS = f"""{GALLERY}, sized as (select *, count(*) over (partition by identity) as n from gallery),
pairs as (
  select a.identity = b.identity as same, list_dot_product(a.embedding, b.embedding) as s, case when a.identity = b.identity then 1.0::double else 1.0::double / (a.n * b.n) end as w
  from sized a join sized b on (a.identity = b.identity and a.pos < b.pos) or a.identity < b.identity
), millionths as (select same, s, w, floor(s * 1e6 + 0.5)::bigint as m from pairs)"""
CURVE = f"""{_PAIRS}, curve as (
  select t / 100.0::double as threshold, coalesce(sum(w) filter (same and m >= t * 10000), 0) / sum(w) filter (same) as tpr, coalesce(sum(w) filter (not same and m >= t * 10000), 0) / sum(w) filter (not same) as far
  from millionths, (select unnest(range(101)) as t) group by t
)"""


@query("j7_within_pairs", f"with {GALLERY} select a.identity, a.pos as i, b.pos as j, round(list_dot_product(a.embedding, b.embedding), 6) as sim from gallery a join gallery b on a.identity = b.identity and a.pos < b.pos where list_dot_product(a.embedding, b.embedding) >= 0.15::double")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return s.within_pairs(gallery(spark, d), 0.15).withColumn("sim", F.round("sim", 6))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every vector whose id is divisible by 20, and the whole gallery; a probe's own row is left out by vec_id."""
    g = gallery(spark, d)
    return g.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding", "vec_id"), g


_RANKED = f"""with {GALLERY}, r as (
  select p.vec_id as probe, g.identity, g.pos, list_dot_product(p.embedding, g.embedding) as sim,
    row_number() over (partition by p.vec_id order by list_dot_product(p.embedding, g.embedding) desc, g.identity, g.pos) as rank
  from gallery p, gallery g where p.vec_id % 20 = 0 and g.vec_id <> p.vec_id
)"""


_MATCH = f"{_RANKED} select probe, case when sim >= 0.35::double then identity else 'Unknown' end as name, round(sim, 6) as sim from r where rank = 1"
_NEAREST = f"{_RANKED}, k as (select *, row_number() over (partition by probe, identity order by rank) as again from r where rank <= 5) select probe, identity, pos, round(sim, 6) as sim, rank from k where again = 1"
_NAMES = f"{_RANKED}, k as (select *, row_number() over (partition by probe, identity order by rank) as again from r), n as (select *, row_number() over (partition by probe order by rank) as place from k where again = 1) select probe, identity, pos, round(sim, 6) as sim, place as rank from n where place <= 3"


@query("j8_best_match", _MATCH)
def j8(spark: SparkSession, d: str) -> DataFrame:
    return s.best_match(*_sides(spark, d), 0.35, own="vec_id").withColumn("sim", F.round("sim", 6))


@query("j9_nearest", _NEAREST)
def j9(spark: SparkSession, d: str) -> DataFrame:
    return s.nearest(*_sides(spark, d), 5, own="vec_id").withColumn("sim", F.round("sim", 6))


@query("j9_nearest_names", _NAMES)
def j9_names(spark: SparkSession, d: str) -> DataFrame:
    return s.nearest(*_sides(spark, d), 3, per_vector=False, own="vec_id").withColumn("sim", F.round("sim", 6))


@query("j8_match_in_cells", _MATCH)
def j8_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells.best_match_in_cells(*_sides(spark, d), 0.35, own="vec_id").withColumn("sim", F.round("sim", 6))


@query("j9_nearest_in_cells", _NEAREST)
def j9_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells.nearest_in_cells(*_sides(spark, d), 5, own="vec_id").found.withColumn("sim", F.round("sim", 6))


@query("j9_names_in_cells", _NAMES)
def j9_cell_names(spark: SparkSession, d: str) -> DataFrame:
    return cells.nearest_in_cells(*_sides(spark, d), 3, per_vector=False, own="vec_id").found.withColumn("sim", F.round("sim", 6))


@query("j10_cross_means", f"with {GALLERY} select a.identity as a, b.identity as b, count(*) as pairs, round(avg(list_dot_product(a.embedding, b.embedding)), 6) as mean from gallery a join gallery b on a.identity < b.identity group by all")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return s.cross_means(gallery(spark, d)).withColumn("mean", F.round("mean", 6))


@query("j10_cross_sample")
def j10_sample(spark: SparkSession, d: str) -> DataFrame:
    return s.cross_sample(gallery(spark, d))


@query("j14_hamming_join", f"""with {HASHES}, u as (select phash, min(doc_id) as id, ('0x' || phash)::ubigint as v from hashes group by 1), c as (select doc_id as a, lead(doc_id) over (partition by phash order by doc_id) as b from hashes)
select a.id as a, b.id as b, bit_count(xor(a.v, b.v))::int as distance from u a join u b on a.id < b.id where bit_count(xor(a.v, b.v)) < 5 union all select a, b, 0 from c where b is not null""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    return s.hamming_join(hashes(spark, d).withColumnRenamed("doc_id", "id"))


@query("j15_redundancy", f"with {GALLERY} select c.vec_id as candidate, coalesce(max(list_dot_product(c.embedding, g.embedding)) > 0.2::double, false) as redundant, round(coalesce(max(list_dot_product(c.embedding, g.embedding)), 0), 6) as max_sim from gallery c left join gallery g on g.identity = c.identity and g.vec_id <> c.vec_id group by 1")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against all others of its identity."""
    g = gallery(spark, d).withColumnRenamed("identity", "group_id")
    found = s.redundancy(g.withColumn("candidate", F.col("vec_id")), g, 0.2, own="vec_id")
    return found.withColumn("max_sim", F.round("max_sim", 6))


_CENTROID = f"""{GALLERY}, dims as (select identity, k, avg(embedding[k]) as x, count(*) as n, sum(embedding[k]) as t from gallery, (select unnest(range(1, 65)) as k) group by all),
c as (select identity, max(n) as n, list(x order by k) as v, list(t order by k) as s from dims group by 1)"""


@query("a8_centroids", f"with {_CENTROID} select identity, n, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first_value, round(list_sum(v) / sqrt(list_dot_product(v, v)), 6) as total from c")
def a8(spark: SparkSession, d: str) -> DataFrame:
    v = s.centroids(gallery(spark, d), "identity")
    return v.select("identity", "n", F.round(F.col("centroid")[0], 6).alias("first_value"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("a9_similarity_stats", f"with {_PAIRS} select same, count(*) as pairs, round(sum(w * s) / sum(w), 6) as mean, round(sqrt(sum(w * s * s) / sum(w) - (sum(w * s) / sum(w)) ** 2), 6) as std from pairs group by 1")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return s.similarity_stats(s.similarity_counts(gallery(spark, d))).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("a10_histogram", f"""with {_PAIRS}, b as (select same, least(m // 20000, 49) as bin, count(*) as n from millionths where m between 0 and 1000000 group by all), g as (select same, bin from (select unnest([true, false]) as same), (select unnest(range(50)) as bin))
select g.same, g.bin, coalesce(n, 0) as n, round(coalesce(n, 0) / (sum(coalesce(n, 0)) over (partition by g.same) * 0.02::double), 6) as density from g left join b on b.same = g.same and b.bin = g.bin""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return s.histogram(s.similarity_counts(gallery(spark, d))).withColumn("density", F.round("density", 6))


@query("a11_roc", f"with {CURVE} select threshold, round(tpr, 6) as tpr, round(far, 6) as far from curve")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return s.roc(s.similarity_counts(gallery(spark, d))).withColumns({"tpr": F.round("tpr", 6), "far": F.round("far", 6)})


@query("a11_roc_drawn")
def a11_drawn(spark: SparkSession, d: str) -> DataFrame:
    """From all pairs within identities and 50,000 drawn pairs of two."""
    return s.roc(s.sampled_counts(gallery(spark, d))).withColumns({"tpr": F.round("tpr", 6), "far": F.round("far", 6)})


@query("a12_equal_error_rate", f"with {CURVE} select threshold, round((far + 1 - tpr) / 2, 6) as eer from curve order by round(abs(far - (1 - tpr)), 9), threshold limit 1")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return s.equal_error_rate(s.roc(s.similarity_counts(gallery(spark, d)))).withColumn("eer", F.round("eer", 6))


@query("a13_area_under_curve", f"with {CURVE}, p as (select far, tpr, lag(far) over (order by far, tpr) as f, lag(tpr) over (order by far, tpr) as t from curve) select round(sum((far - f) * (tpr + t) / 2), 6) as auc from p")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return s.area_under_curve(s.roc(s.similarity_counts(gallery(spark, d)))).withColumn("auc", F.round("auc", 6))


_LOO = f"{GALLERY}, loo as (select a.identity, a.pos, avg(list_dot_product(a.embedding, b.embedding)) as m from gallery a join gallery b on a.identity = b.identity and a.pos <> b.pos group by all)"


@query("a14_leave_one_out", f"with {_LOO} select identity, pos, round(m, 6) as mean_sim, round(m, 9) >= 0.0 as kept from loo")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return s.leave_one_out(gallery(spark, d), 0.0).select("identity", "pos", F.round("mean_sim", 6).alias("mean_sim"), "kept")


@query("a15_outlier_report", f"with {_LOO}, f as (select identity, min(pos) as pos, arg_min(m, pos) as m from loo where round(m, 9) < 0.0 group by 1) select identity, pos, round(m, 6) as mean_sim from f order by m, identity limit 20")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return s.outlier_report(gallery(spark, d), 0.0).withColumn("mean_sim", F.round("mean_sim", 6)).select("identity", "pos", "mean_sim")


@query("a16_mean_outliers", f"with {_CENTROID}, x as (select vec_id, list_dot_product(embedding, v) / sqrt(list_dot_product(v, v)) as sim from gallery join c using (identity) where n >= 3) select vec_id, round(sim, 6) as sim, round(sim, 9) < 0.12::double as is_outlier from x")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return s.mean_outliers(gallery(spark, d), "identity", 0.12).select("vec_id", F.round("sim", 6).alias("sim"), "is_outlier")


@query("a17_gallery_summary", f"with {GALLERY} select identity, case when identity = 'id_3' then 0 else count(*) end as vectors, case when identity <> 'id_3' then 64 end as dim, identity = 'id_3' as empty from gallery group by 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    raw = gallery(spark, d).groupBy("identity").agg(F.collect_list(F.when(F.col("identity") != "id_3", F.col("embedding"))).alias("vectors"))
    return s.gallery_summary(raw)


def _values(t: DataFrame) -> DataFrame:
    return t.select("identity", "template", "n", F.round(F.col("centroid")[0], 6).alias("first_value"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("a18_templates")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return _values(templates.templates(gallery(spark, d), "identity"))


@query("a19_stored_template")
def a19(spark: SparkSession, d: str) -> DataFrame:
    """The first template of each group's usable faces, as it is stored."""
    usable = gallery(spark, d).where("vec_id % 11 <> 0")
    return _values(templates.templates(usable, "identity").where("template = 0"))


@query("a20_running_mean", f"""with {GALLERY}, n as (select identity, count(*) as n from gallery group by 1),
d as (select identity, k, sum(embedding[k] * case when pos = 0 then 0.9::double ** (n - 1) else 0.1 * 0.9::double ** (n - 1 - pos) end) as x from gallery join n using (identity), (select unnest(range(1, 65)) as k) group by all)
select identity, round(sum(x) filter (k = 1), 6) as first_value, round(sum(x), 6) as total from d group by 1""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    r = s.running_means(gallery(spark, d), "identity")
    return r.select("identity", F.round(F.col("mean")[0], 6).alias("first_value"), F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("w5_smoothed", f"""with {GALLERY}, l as (select vec_id, list(embedding) over (partition by identity order by pos rows between 19 preceding and current row) as l from gallery),
x as (select vec_id, k, list_sum(list_transform(range(1, len(l) + 1), lambda i: exp(case when len(l) > 1 then -3 + 3 * (i - 1) / (len(l) - 1)::double else -3.0::double end) * l[i][k])) as y from l, (select unnest(range(1, 65)) as k))
select vec_id, round(sum(y) / sqrt(sum(y * y)), 6) as total, round(sum(y) filter (k = 1) / sqrt(sum(y * y)), 6) as first_value from x group by 1""")
def w5(spark: SparkSession, d: str) -> DataFrame:
    v = s.smoothed_rows(gallery(spark, d).select("identity", "pos", "vec_id", "embedding"), "identity", "vec_id").withColumnRenamed("smoothed", "v")
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("v")[0], 6).alias("first_value"))
