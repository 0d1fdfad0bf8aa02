"""Queries of scalar expressions and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text, vectors
from ..operators import gates
from .registry import query
from .tables import CATALOGUE, DETECTION, FILES, GALLERY, HASHES, HEIGHT, WIDTH, actor, detection, files, gallery, hashes, table

_X = "bbox[1]"


@query("p1_normalize_name", f"with {CATALOGUE} select id, lower(replace('Jr. ' || name, '.', '')) as norm from actor")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return actor(spark, d).select("id", text.normalize_name(F.concat(F.lit("Jr. "), "name")).alias("norm"))


@query("p2_safe_name", "select c_custkey as id, replace(rtrim(regexp_replace(c_name || ' (' || c_mktsegment || '#) ', '[^\\p{L}\\p{Nd} _-]', '', 'g')), ' ', '_') as safe from customer")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.safe_name(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit("#) "))).alias("safe"))


@query("p3_display_name", """with x as (select n_nationkey as id, string_split(lower(replace('new_' || n_name || '_o''NEIL 3D-a', '_', ' ')), '') as l from nation)
select id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: case when i = 1 or not regexp_matches(l[i - 1], '[a-z]') then upper(l[i]) else l[i] end), '') as shown from x""")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), text.display_name(F.concat(F.lit("new_"), "n_name", F.lit("_o'NEIL 3D-a"))).alias("shown"))


@query("p4_identity_key", "select p_partkey as id, nullif(replace(rtrim(regexp_replace(lower(trim('  ' || case when p_partkey % 10 = 0 then '##' else p_name end || ' ')), '[^\\p{L}\\p{Nd} _-]', '', 'g')), ' ', '_'), '') as key from part")
def p4(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("  "), F.when(F.col("p_partkey") % 10 == 0, "##").otherwise(F.col("p_name")), F.lit(" "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.identity_key(name).alias("key"))


@query("p5_source_of_file", f"with {FILES} select source, count(*) as n from (select split_part(split_part(path, '/', 3), '_', 1) as source from files) group by 1")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select(text.source_of_file(F.get(F.split("path", "/"), F.lit(2))).alias("source")).withColumn("source", F.coalesce("source", F.lit(""))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("p6_owner_of_path", f"with {FILES} select owner, count(*) as n from (select nullif(regexp_extract(path, '(?:^|/)labeled_faces/([^/]+)', 1), '') as owner from files) group by 1")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(text.owner_of_path(F.col("path")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_unit_vectors", f"with {GALLERY}, s as (select vec_id, list_transform(embedding, lambda x: x * (vec_id % 3)) as v from gallery) select vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) as total, round(sqrt(list_dot_product(v, v)), 6) as length from s where list_dot_product(v, v) > 0")
def p7(spark: SparkSession, d: str) -> DataFrame:
    v = gallery(spark, d).select("vec_id", F.transform("embedding", lambda x: x * (F.col("vec_id") % 3)).alias("v"))
    u = v.select("vec_id", "v", vectors.unit(F.col("v")).alias("u")).where("u is not null")
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(vectors.norm(F.col("v")), 6).alias("length"))


@query("p8_blob_codec", "select vec_id, 4 * len(embedding) as bytes, true as same from embeddings")
def p8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", vectors.encode_blob("embedding").alias("blob"), F.col("embedding").cast("array<float>").alias("embedding"))
    return e.select("vec_id", F.octet_length("blob").alias("bytes"), (vectors.decode_blob("blob") == F.col("embedding")).alias("same"))


_PAIR = "select a.vec_id as a, b.vec_id as b, a.embedding as u, b.embedding as v from gallery a join gallery b on b.vec_id = a.vec_id + 1"


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    return g.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("embedding").alias("u")).join(g.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v")), "b")


@query("p9_dot", f"with {GALLERY}, p as ({_PAIR}) select a, b, round(list_dot_product(u, v), 6) as sim from p")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("a", "b", F.round(vectors.dot(F.col("u"), F.col("v")), 6).alias("sim"))


@query("p10_cosine", f"with {GALLERY}, p as ({_PAIR}) select a, b, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) + 1e-8), 6) as sim from p")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("a", "b", F.round(vectors.cosine(F.col("u"), F.col("v")), 6).alias("sim"))


@query("p11_band", f"with {DETECTION} select band, count(*) as n from (select case when det_score > 0.85::double then 'redundant' when det_score >= 0.70::double then 'same_person' else 'different_person' end as band from detection) group by 1")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).groupBy(vectors.band(F.col("det_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("p12_risk_level", f"with {DETECTION} select risk, count(*) as n from (select case when det_score > 0.70::double then 'LOW' when det_score > 0.55::double then 'MEDIUM' else 'HIGH' end as risk from detection) group by 1")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).groupBy(scores.risk_level(F.col("det_score")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("p13_quality_label", f"with {DETECTION} select label, count(*) as n from (select case when det_score >= 0.8::double then 'Excellent' when det_score >= 0.6::double then 'Good' when det_score >= 0.4::double then 'Fair' when det_score >= 0.2::double then 'Poor' else 'Rejected' end as label from detection) group by 1")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).groupBy(scores.quality_label(F.col("det_score")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_detection_status", f"with {DETECTION} select status, count(*) as n from (select case when det_id % 11 = 0 then 'outlier' when det_id % 5 = 0 then 'invalid' else 'valid' end as status from detection) group by 1")
def p14(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).groupBy(scores.detection_status(F.col("det_id") % 11 == 0, F.col("det_id") % 5 != 0).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_POSE = f"""{DETECTION}, eyes as (
  select *, sqrt((landmarks[1][1] - landmarks[3][1]) ** 2 + (landmarks[1][2] - landmarks[3][2]) ** 2) as el,
    sqrt((landmarks[2][1] - landmarks[3][1]) ** 2 + (landmarks[2][2] - landmarks[3][2]) ** 2) as er,
    sqrt((landmarks[1][1] - landmarks[2][1]) ** 2 + (landmarks[1][2] - landmarks[2][2]) ** 2) as ee from detection
), pose as (
  select *, case when least(el, er) <= 0 then 0.0::double else greatest(el, er) / least(el, er) end as ratio,
    0.6 * greatest(0.0::double, 1 - 2 * abs(landmarks[3][1] - (landmarks[1][1] + landmarks[2][1]) / 2) / ee)
      + 0.4 * (case when (landmarks[3][2] - (landmarks[1][2] + landmarks[2][2]) / 2) / ee between 0.4::double and 1.0::double then 1.0::double
        else greatest(0.0::double, 1 - abs((landmarks[3][2] - (landmarks[1][2] + landmarks[2][2]) / 2) / ee - 0.7)) end) as pose_score,
    case when least(el, er) <= 0 then 'Unknown' when greatest(el, er) / least(el, er) < 1.4::double then 'Frontal' when greatest(el, er) / least(el, er) < 2.0::double then 'Tilted' else 'Profile' end as pose
  from eyes
)"""


@query("p15_pose_label", f"with {_POSE} select det_id, pose, round(ratio, 6) as ratio from pose")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", scores.pose_label(F.col("landmarks")).alias("pose"), F.round(scores.pose_ratio(F.col("landmarks")), 6).alias("ratio"))


@query("p16_pose_score", f"with {_POSE} select det_id, round(pose_score, 6) as pose_score from pose")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", F.round(scores.pose_score(F.col("landmarks")), 6).alias("pose_score"))


_BLUR = "least(greatest((blur_var - 50) / 450, 0.0), 1.0)"
_BRIGHT = "case when brightness < 80 then greatest(0.0::double, brightness / 80) * 0.7 when brightness > 180 then greatest(0.0::double, (255 - brightness) / 75) * 0.7 else 1 - abs(brightness - 130) / 50 * 0.3 end"


@query("p17_blur_score", f"with {DETECTION} select det_id, round({_BLUR}, 6) as score from detection")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", F.round(scores.blur_score(F.col("blur_var")), 6).alias("score"))


@query("p18_brightness_score", f"with {DETECTION} select det_id, round({_BRIGHT}, 6) as score from detection")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", F.round(scores.brightness_score(F.col("brightness")), 6).alias("score"))


def quality(live: bool = False):
    """P19 of a detection; the live scorer has no blur and no brightness."""
    blur = F.lit(None).cast("double") if live else scores.blur_score(F.col("blur_var"))
    bright = F.lit(None).cast("double") if live else scores.brightness_score(F.col("brightness"))
    return scores.combined_quality(blur, bright, scores.pose_score(F.col("landmarks")), F.col("det_score"))


@query("p19_combined_quality", f"with {_POSE} select det_id, round(0.30 * {_BLUR} + 0.20 * ({_BRIGHT}) + 0.25 * pose_score + 0.25 * det_score, 6) as quality, round(0.15 + 0.10 + 0.25 * pose_score + 0.25 * det_score, 6) as live from pose")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", F.round(quality(), 6).alias("quality"), F.round(quality(live=True), 6).alias("live"))


_NEXT = "select a.det_id, a.bbox as p, b.bbox as q from detection a join detection b on b.session = a.session and b.frame = a.frame + 1"


@query("p20_iou", f"""with {DETECTION}, n as ({_NEXT}), i as (
  select det_id, greatest(0.0, least(p[3], q[3]) - greatest(p[1], q[1])) * greatest(0.0, least(p[4], q[4]) - greatest(p[2], q[2])) as inter,
    (p[3] - p[1]) * (p[4] - p[2]) + (q[3] - q[1]) * (q[4] - q[2]) as sum from n
) select det_id, round(case when sum - inter > 0 then inter / (sum - inter) else 0.0 end, 6) as iou from i""")
def p20(spark: SparkSession, d: str) -> DataFrame:
    x = detection(spark, d).select("det_id", "session", "frame", "bbox")
    y = x.select("session", (F.col("frame") - 1).alias("frame"), F.col("bbox").alias("q"))
    return x.join(y, ["session", "frame"]).select("det_id", F.round(vectors.iou(F.col("bbox"), F.col("q")), 6).alias("iou"))


@query("p21_box_ratio", f"with {DETECTION} select det_id, round((bbox[3] - bbox[1]) / (bbox[4] - bbox[2]), 6) as ratio from detection")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", F.round(vectors.box_ratio(F.col("bbox")), 6).alias("ratio"))


@query("p22_eye_ratio", f"with {_POSE} select det_id, round(ee / (bbox[3] - bbox[1]), 6) as ratio from pose")
def p22(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", F.round(scores.eye_ratio(F.col("landmarks"), F.col("bbox")), 6).alias("ratio"))


_HEX = "('0x' || {})::ubigint"
_HAMMING = f"with {HASHES}, n as (select a.doc_id, a.phash, b.phash as other from hashes a left join hashes b on b.doc_id = a.doc_id + 1)"


@query("p23_hamming", f"{_HAMMING} select doc_id, coalesce(bit_count(xor({_HEX.format('phash')}, {_HEX.format('other')})), 64)::int as distance from n")
def p23(spark: SparkSession, d: str) -> DataFrame:
    return _next_hash(spark, d).select("doc_id", vectors.hamming(F.col("phash"), F.col("other")).alias("distance"))


@query("p24_near_duplicate", f"{_HAMMING} select doc_id, coalesce(bit_count(xor({_HEX.format('phash')}, {_HEX.format('other')})), 64) < 5 as near from n")
def p24(spark: SparkSession, d: str) -> DataFrame:
    return _next_hash(spark, d).select("doc_id", vectors.near_duplicate(F.col("phash"), F.col("other")).alias("near"))


def _next_hash(spark: SparkSession, d: str) -> DataFrame:
    h = hashes(spark, d)
    return h.join(h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("phash").alias("other")), "doc_id", "left")


@query("p25_score_formats", f"with {DETECTION} select det_id, trunc(det_score * 100)::int as whole, round(det_score * 100, 1) as one from detection")
def p25(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", text.percent(F.col("det_score")).alias("whole"), text.percent_one(F.col("det_score")).alias("one"))


@query("p26_template_count", f"with {GALLERY} select identity, case when count(*) < 3 then 1 when count(*) < 8 then 2 else 3 end as k from gallery group by 1")
def p26(spark: SparkSession, d: str) -> DataFrame:
    return gallery(spark, d).groupBy("identity").agg(scores.template_count(F.count(F.lit(1))).alias("k"))


@query("p27_screen_time", f"with {DETECTION} select session, round(count(*) * 3 / 25.0::double, 6) as seconds from detection group by 1")
def p27(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).groupBy("session").agg(F.round(scores.screen_time(F.count(F.lit(1)), 3, 25.0), 6).alias("seconds"))


_NAMES = "case when det_id % 7 = 0 then 'Unknown' when det_id % 3 = 0 then 'Misafir-' || (det_id % 10) else 'id_' || (det_id % 10) end"


def named(spark: SparkSession, d: str) -> DataFrame:
    """Detections with a recognised name."""
    e = F.col("det_id")
    last = (e % 10).cast("string")
    name = F.when(e % 7 == 0, "Unknown").when(e % 3 == 0, F.concat(F.lit("Misafir-"), last)).otherwise(F.concat(F.lit("id_"), last))
    return detection(spark, d).withColumn("name", name)


@query("p28_guest_flags", f"with {DETECTION} select det_id, starts_with({_NAMES}, 'Misafir') as guest, starts_with({_NAMES}, 'Unknown') as unknown from detection")
def p28(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).select("det_id", text.is_guest(F.col("name")).alias("guest"), text.is_unknown(F.col("name")).alias("unknown"))


@query("p29_rates", f"""with {DETECTION}, c as (select session, count(*) filter (event_type = 'view' or event_type = 'click') as l, count(*) filter (not (event_type = 'view' or event_type = 'click')) as p from detection group by 1)
select session, floor(100 * l / (l + p))::int as identified, (case when p = 0 then 100 else greatest(0, 100 - floor(100 * p / (l + p + 1))) end)::int as quality from c""")
def p29(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("event_type").isin("view", "click")
    c = detection(spark, d).groupBy("session").agg(F.count_if(known).alias("l"), F.count_if(~known).alias("p"))
    return c.select("session", text.identification_rate(F.col("l"), F.col("p")).alias("identified"), text.quality_rate(F.col("l"), F.col("p")).alias("quality"))


@query("p30_upload_names", f"with {DETECTION} select det_id, 'Upload_' || strftime(ts, '%Y%m%d_%H%M') as title, (epoch_us(ts) // 1000) || '_g' || (det_id % 4) || '.jpg' as file from detection")
def p30(spark: SparkSession, d: str) -> DataFrame:
    guest = F.concat(F.lit("g"), (F.col("det_id") % 4).cast("string"))
    ts = F.col("ts").cast("timestamp")
    return detection(spark, d).select("det_id", text.upload_title(ts).alias("title"), text.enrolled_file(ts, guest).alias("file"))


@query("p31_box_json", f"with {DETECTION} select det_id, bbox[1] as x1, bbox[2] as y1, bbox[3] as x2, bbox[4] as y2, 4 as n from detection")
def p31(spark: SparkSession, d: str) -> DataFrame:
    back = text.parse_box(text.box_json(F.col("bbox")))
    return detection(spark, d).select("det_id", back.alias("b")).select("det_id", *(F.col("b")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), F.size("b").alias("n"))


@query("p32_clipped_box", f"with {DETECTION} select det_id, least(greatest(bbox[3], 0.0), 1800.0) as x2, least(greatest(bbox[4], 0.0), 1000.0) as y2, trunc(bbox[3] - bbox[1])::int || 'x' || trunc(bbox[4] - bbox[2])::int as size from detection")
def p32(spark: SparkSession, d: str) -> DataFrame:
    c = text.clip_box(F.col("bbox"), F.lit(1800.0), F.lit(1000.0))
    return detection(spark, d).select("det_id", c[2].alias("x2"), c[3].alias("y2"), text.size_text(F.col("bbox")).alias("size"))


REASON = f"""case when bbox[1] < 10 or bbox[2] < 10 or bbox[3] > {WIDTH} - 10 or bbox[4] > {HEIGHT} - 10 then 'edge_face' when det_score < 0.65::double then 'low_det_score'
  when bbox[3] - bbox[1] < 50 or bbox[4] - bbox[2] < 50 then 'too_small' when blur_var < 80 then 'blur' when brightness < 30 then 'too_dark' when brightness > 230 then 'too_bright' else 'passed' end"""


@query("f1_quality_gate", f"with {DETECTION} select det_id, {REASON} as reason from detection")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", gates.reject_reason(WIDTH, HEIGHT).alias("reason"))


@query("f2_recognition_gate", f"with {_POSE} select det_id from pose where bbox[4] - bbox[2] >= 50 and round(ee / (bbox[3] - bbox[1]), 9) between 0.2::double and 0.7::double and blur_var >= 80 and round(0.15 + 0.10 + 0.25 * pose_score + 0.25 * det_score, 9) >= 0.3::double")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).where(gates.recognition_gate(quality(live=True), min_blur=80)).select("det_id")


@query("f3_upload_gate", f"with {DETECTION} select det_id, case when bbox[3] - bbox[1] < 50 or bbox[4] - bbox[2] < 50 then 'too_small' when blur_var < 80 then 'blur' else 'ok' end as reason from detection")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).select("det_id", gates.upload_reason().alias("reason"))


@query("f4_frame_stride", f"with {DETECTION} select session, frame from detection where frame % 3 = 0")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return detection(spark, d).where(gates.stride(3, 0)).select("session", "frame")
