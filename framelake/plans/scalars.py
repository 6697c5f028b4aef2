"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import geometry, samples, scores, text
from framelake.plans import bindings as B
from framelake.plans.registry import query

CUSTOMERS = f"c AS (SELECT c_custkey, c_name, c_acctbal, {B._sql_list(B.CATEGORIES)}[(c_custkey % 10 + 1)::INTEGER] AS category FROM customer)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "customer").withColumn("category", B._pick(B.CATEGORIES, F.col("c_custkey") % 10))


@query(
    """SELECT c_custkey, v::INTEGER AS binary_label FROM c JOIN (VALUES ('original', 1), ('Deepfakes', 0), ('Face2Face', 0), ('FaceShifter', 0), ('FaceSwap', 0), ('NeuralTextures', 0),
    ('Celeb-real', 1), ('YouTube-real', 1), ('Celeb-synthesis', 0)) m(name, v) ON name = category""",
    CUSTOMERS,
)
def p1_category_label(spark, sf_dir):
    labelled = customers(spark, sf_dir).withColumn("binary_label", text.category_label("category"))
    return labelled.filter("binary_label is not null").select("c_custkey", "binary_label")


NAMES = "n AS (SELECT c_custkey, ['Celeb-DF-v2/', 'x_C40/', 'y_c23_z/', 'raw/', 'celeb_c40/'][(c_custkey % 5 + 1)::INTEGER] || c_name AS name FROM customer)"


@query("SELECT c_custkey, CASE WHEN lower(name) LIKE '%celeb%' THEN 'celeb-dc' WHEN lower(name) LIKE '%c40%' THEN 'c40' WHEN lower(name) LIKE '%c23%' THEN 'c23' ELSE 'unknown' END AS compression FROM n", NAMES)
def p2_infer_compression(spark, sf_dir):
    prefix = B._pick(("Celeb-DF-v2/", "x_C40/", "y_c23_z/", "raw/", "celeb_c40/"), F.col("c_custkey") % 5)
    return B.table(spark, sf_dir, "customer").select("c_custkey", text.infer_compression(F.concat(prefix, F.col("c_name"))).alias("compression"))


IDS = f"i AS (SELECT o_orderkey, {B._sql_list(B.CATEGORIES)}[(o_orderkey % 10 + 1)::INTEGER] AS category, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || '__walk' WHEN 1 THEN o_custkey || '_' || o_orderkey ELSE o_custkey::VARCHAR END AS video_id FROM orders)"


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    video = F.when(key % 3 == 0, F.concat(cust, F.lit("__walk"))).when(key % 3 == 1, F.concat_ws("_", cust, key.cast("string"))).otherwise(cust)
    return B.table(spark, sf_dir, "orders").select("o_orderkey", B._pick(B.CATEGORIES, key % 10).alias("category"), video.alias("video_id"))


@query("SELECT o_orderkey, CASE WHEN category = 'DeepFakeDetection' THEN split_part(video_id, '__', 1) WHEN category = 'original' THEN video_id WHEN contains(video_id, '_') THEN video_id ELSE category || ':' || video_id END AS split_group FROM i", IDS)
def p3_split_group_key(spark, sf_dir):
    return ids(spark, sf_dir).select("o_orderkey", text.split_group_key("category", "video_id").alias("split_group"))


@query("SELECT o_orderkey, md5(video_id) AS order_key FROM i", IDS)
def p4_stable_hash(spark, sf_dir):
    return ids(spark, sf_dir).select("o_orderkey", text.stable_hash("video_id").alias("order_key"))


@query("SELECT video_id, lower(trim(split)) AS kept, CASE WHEN lower(trim(split)) IN ('train','val','test') THEN lower(trim(split)) ELSE 'missing' END AS or_missing FROM videos", B.VIDEOS)
def p5_normalize_split(spark, sf_dir):
    return B.videos(spark, sf_dir).select("video_id", text.normalize_split("split").alias("kept"), text.normalize_split("split", "missing").alias("or_missing"))


KEYED = B.FRAMES + ", keyed AS (SELECT event_id, category, CASE WHEN event_id % 2 = 0 THEN 'v\\' || video_id ELSE ' ' END AS video_name, CASE WHEN event_id % 3 = 0 THEN video_id END AS id, CASE WHEN event_id % 5 <> 0 THEN 'root/' || video_id || '_frame_' || frame_number || '.jpg' END AS frame_path, frame_number FROM frames)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return B.frames(spark, sf_dir).select(
        "event_id",
        "category",
        F.when(e % 2 == 0, F.concat(F.lit("v\\"), F.col("video_id"))).otherwise(" ").alias("video_name"),
        F.when(e % 3 == 0, F.col("video_id")).alias("id"),
        F.when(e % 5 != 0, F.concat(F.lit("root/"), F.col("video_id"), F.lit("_frame_"), F.col("frame_number"), F.lit(".jpg"))).alias("frame_path"),
        "frame_number",
    )


@query(
    r"""SELECT event_id, category || '/' || coalesce(nullif(trim(video_name), ''), id, regexp_extract(coalesce(frame_path, ''), '([^/]*?)([.][^./]*)?$', 1).nullif(''), 'unknown_video') AS group_key,
    replace(coalesce(id, CASE WHEN trim(video_name) <> '' THEN category || '/' || trim(video_name) END, 'unknown_video'), '\', '/') AS canonical_id, category || '|' || coalesce(id, '') || '|' || 'val' AS video_key FROM keyed""",
    KEYED,
)
def p6_keys(spark, sf_dir):
    return keyed(spark, sf_dir).select("event_id", text.group_key("category", "video_name", "id", "frame_path").alias("group_key"), text.canonical_video_id("category", "video_name", "id").alias("canonical_id"), text.video_key("category", "id", F.lit(" VAL ")).alias("video_key"))


@query(
    r"""SELECT event_id, replace(category || '/' || coalesce(nullif(trim(video_name), ''), 'unknownvideo') || '/' || CASE WHEN frame_path IS NOT NULL THEN regexp_extract(frame_path, '([^/]*?)([.][^./]*)?$', 1)
    ELSE coalesce(nullif(trim(video_name), ''), 'unknownvideo') || '_' || frame_number END, '\', '/') AS sample_key FROM keyed""",
    KEYED,
)
def p7_sample_key(spark, sf_dir):
    return keyed(spark, sf_dir).select("event_id", text.sample_key("category", "video_name", "frame_path", "frame_number").alias("sample_key"))


@query("SELECT event_id, video_id || '_frame_' || lpad(frame_number::VARCHAR, 5, '0') || '.jpg' AS file, video_id AS parsed_video, frame_number::BIGINT AS parsed_number FROM frames", B.FRAMES)
def p8_frame_filename(spark, sf_dir):
    named = B.frames(spark, sf_dir).select("event_id", text.frame_filename("video_id", "frame_number").alias("file"))
    return named.select("event_id", "file", text.parse_frame_filename(F.concat(F.lit("a_frame_x/"), F.col("file"))).alias("p")).select("event_id", "file", F.col("p.video_name").alias("parsed_video"), F.col("p.frame_number").alias("parsed_number"))


RAW = "raw AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN ' ' || c_custkey || '.75 ' WHEN 2 THEN '' WHEN 3 THEN 'n/a' ELSE '-' || c_custkey || '.5' END AS t FROM customer)"


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE 7 END::BIGINT AS whole, coalesce(trunc(try_cast(trim(t) AS DOUBLE))::BIGINT, 0) AS truncated, coalesce(try_cast(trim(t) AS DOUBLE), -1.0) AS number FROM raw", RAW)
def p9_coercions(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    t = F.when(k % 5 == 0, s).when(k % 5 == 1, F.concat(F.lit(" "), s, F.lit(".75 "))).when(k % 5 == 2, "").when(k % 5 == 3, "n/a").otherwise(F.concat(F.lit("-"), s, F.lit(".5")))
    return B.table(spark, sf_dir, "customer").select("c_custkey", text.safe_int(t, 7).alias("whole"), text.safe_int_trunc(t).alias("truncated"), text.safe_float(t, -1.0).alias("number"))


@query(
    """SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN CASE WHEN conv_id % 4 < 2 THEN (conv_id % 4)::INTEGER ELSE -1 END END, CASE WHEN turn % 3 = 1 AND conv_id % 3 < 2 THEN (conv_id % 3)::INTEGER END,
    CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END, -1)::INTEGER AS label,
    coalesce(1 - CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END, -1)::INTEGER AS inverted, coalesce(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END, -1)::INTEGER AS real_is_one,
    CASE WHEN role = 'user' THEN 0 WHEN role = 'assistant' THEN 1 ELSE -1 END::INTEGER AS of_crop,
    coalesce(CASE WHEN conv_id % 3 < 2 THEN (conv_id % 3)::INTEGER END, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END, -1)::INTEGER AS of_clip FROM conversations"""
)
def p10_resolve_label(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    name = F.when(F.col("role") == "user", " Real").when(F.col("role") == "assistant", "fake").otherwise(F.col("role"))
    cls = F.when(t % 3 == 0, F.concat(F.lit(" "), (c % 4).cast("string")))  # 2 and 3 are bad class parts, which no other field mends
    field = F.when(t % 3 == 1, (c % 3).cast("string"))
    none = F.lit(None).cast("string")
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.resolve_label(cls, field, name).alias("label"), text.resolve_label(none, none, name, invert=True).alias("inverted"), text.resolve_label(none, none, name, polarity="real").alias("real_is_one"), text.crop_label(name, (c % 3).cast("string")).alias("of_crop"), text.clip_label(F.concat((c % 3).cast("string"), F.lit(" ")), name).alias("of_clip"))


BOXES = B.FRAMES + ", b AS (SELECT event_id, k, floor(value)::INTEGER AS v FROM frames)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("k"), F.floor("value").cast("int")
    return B.frames(spark, sf_dir).select("event_id", "k", v.alias("v"), F.array(k, v % 60, k + v % 30, v % 60 + 25).alias("one"), F.array(F.lit(20), F.lit(10), F.lit(60), F.lit(50)).alias("two"))


@query(
    """SELECT event_id, (v % 30 * 25)::DOUBLE AS area, round(CASE WHEN iw * ih > 0 THEN iw * ih / (v % 30 * 25 + 1600.0 - iw * ih) ELSE 0 END, 6) AS iou,
    CASE WHEN least(k + v % 30, 79) > least(k, 79) AND least(v % 60 + 25, 59) > least(v % 60, 59) THEN [least(k, 79), least(v % 60, 59), least(k + v % 30, 79), least(v % 60 + 25, 59)] END::VARCHAR AS clipped
    FROM (SELECT *, greatest(0, least(k + v % 30, 60) - greatest(k, 20))::DOUBLE AS iw, greatest(0, least(v % 60 + 25, 50) - greatest(v % 60, 10))::DOUBLE AS ih FROM b)""",
    BOXES,
)
def p11_boxes(spark, sf_dir):
    one, two = F.col("one"), F.col("two")
    clipped = geometry.clip_bbox(one, F.lit(80), F.lit(60))
    shown = F.when(clipped.isNotNull(), F.concat(F.lit("["), F.concat_ws(", ", clipped.cast("array<string>")), F.lit("]")))
    return boxes(spark, sf_dir).select("event_id", geometry.bbox_area(one).alias("area"), F.round(geometry.bbox_iou(one, two), 6).alias("iou"), shown.alias("clipped"))


@query("SELECT event_id, round(least(1.0, 64.0 / greatest(k + 20, v % 300 + 1)), 6) AS scale, round_even(k / least(1.0, 64.0 / greatest(k + 20, v % 300 + 1)), 0)::INTEGER AS x1, round(v / least(1.0, 64.0 / greatest(k + 20, v % 300 + 1)), 6) AS nose FROM b", BOXES)
def p12_detection_scale(spark, sf_dir):
    scale = geometry.detection_scale(F.col("k") + 20, F.col("v") % 300 + 1, 64)
    return boxes(spark, sf_dir).select("event_id", F.round(scale, 6).alias("scale"), geometry.rescale_bbox(F.col("one"), scale)[0].alias("x1"), F.round(geometry.rescale_landmarks(F.create_map(F.lit("nose"), F.array(F.col("v").cast("double"))), scale)["nose"][0], 6).alias("nose"))


@query(
    """SELECT event_id, greatest(0, least(floor(l)::INTEGER, 119)) AS x1, greatest(0, least(floor(t)::INTEGER, 89)) AS y1,
    greatest(greatest(0, least(floor(l)::INTEGER, 119)) + 1, least(ceil(l + side)::INTEGER, 120)) AS x2, greatest(greatest(0, least(floor(t)::INTEGER, 89)) + 1, least(ceil(t + side)::INTEGER, 90)) AS y2
    FROM (SELECT *, least(greatest(0.0, (2 * k + v % 30)::DOUBLE / 2 - side / 2), greatest(0.0, 120.0 - side)) AS l, least(greatest(0.0, (2 * (v % 60) + 25)::DOUBLE / 2 - side / 2), greatest(0.0, 90.0 - side)) AS t
    FROM (SELECT *, least(greatest(v % 30, 25)::DOUBLE * 1.3::DOUBLE, 90.0::DOUBLE) AS side FROM b WHERE v % 30 > 0))""",
    BOXES,
)
def p13_square_crop_box(spark, sf_dir):
    crop = geometry.square_crop_box(F.col("one"), F.lit(90), F.lit(120), 1.3)
    return boxes(spark, sf_dir).select("event_id", crop.alias("c")).filter("c is not null").select("event_id", *[F.col("c")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT event_id, round_even((1 - t) * k + t * 20, 0)::INTEGER AS x1, round_even((1 - t) * (v % 60 + 25) + t * 50, 0)::INTEGER AS y2, round((1 - t) * k + t * v, 6) AS nose FROM (SELECT *, (v % 9)::DOUBLE / 8 AS t FROM b)", BOXES)
def p14_lerp(spark, sf_dir):
    t = (F.col("v") % 9).cast("double") / 8
    mark = lambda x: F.create_map(F.lit("nose"), F.array(x.cast("double"), F.lit(0.0)))
    box = geometry.lerp_bbox(F.col("one"), F.col("two"), t)
    nose = geometry.lerp_landmarks(mark(F.col("k")), mark(F.col("v")), t)["nose"][0]
    return boxes(spark, sf_dir).select("event_id", box[0].alias("x1"), box[3].alias("y2"), F.round(nose, 6).alias("nose"))


@query(
    """SELECT key, (prob_positive >= 0.4)::INTEGER AS pred, round(1 / (1 + exp(-(prob_positive - 0.5))), 6) AS sigmoid,
    round(ln(least(greatest(prob_positive, 1e-6), 1 - 1e-6) / (1 - least(greatest(prob_positive, 1e-6), 1 - 1e-6))), 6) AS logit, round(0.3 * prob_positive + 0.7 * weak, 6) AS fused FROM preds""",
    B.PREDS,
)
def p15_probabilities(spark, sf_dir):
    p = F.col("prob_positive")
    return B.preds(spark, sf_dir).select("key", scores.pred_at(p, 0.4).alias("pred"), F.round(scores.sigmoid(p - 0.5), 6).alias("sigmoid"), F.round(scores.logit(p), 6).alias("logit"), F.round(scores.fuse_prob(p, F.col("weak"), 0.3), 6).alias("fused"))


@query(
    """SELECT label, round(avg(2 * y * sm + (1 - y) * sp), 5) AS bce, round(avg((0.75 * y + 0.25 * (1 - y)) * (1 - (p * y + (1 - p) * (1 - y))) ** 2 * (y * sm + (1 - y) * sp)), 5) AS focal
    FROM (SELECT label, label * 0.9 + 0.05 AS y, 1 / (1 + exp(-x)) AS p, greatest(-x, 0) + ln(1 + exp(-abs(x))) AS sm, greatest(x, 0) + ln(1 + exp(-abs(x))) AS sp FROM (SELECT label, 4 * prob_positive - 2 AS x FROM preds)) GROUP BY label""",
    B.PREDS,
)
def p16_losses(spark, sf_dir):
    x = 4 * F.col("prob_positive") - 2
    return B.preds(spark, sf_dir).groupBy("label").agg(F.round(F.avg(scores.bce_loss(x, F.col("label"), 2.0)), 5).alias("bce"), F.round(F.avg(scores.focal_loss(x, F.col("label"))), 5).alias("focal"))


@query("SELECT event_id, key, k, round(value, 6) AS value, category FROM frames", B.FRAMES)
def p17_sample_json(spark, sf_dir):
    packed = B.frames(spark, sf_dir).select("event_id", F.to_json(F.struct("key", "k", "value", "category")).alias("doc"))
    parsed = packed.select("event_id", F.from_json("doc", "key string, k int, value double").alias("d"), F.get_json_object("doc", "$.category").alias("category"))
    return parsed.select("event_id", "d.key", "d.k", F.round("d.value", 6).alias("value"), "category")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'v' || video_id END, CASE WHEN event_id % 3 = 0 THEN category END) AS first_value, regexp_replace(key || ' é?', '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM frames", B.FRAMES)
def p18_first_meta(spark, sf_dir):
    e = F.col("event_id")
    meta = F.create_map(F.lit("video"), F.when(e % 2 == 0, F.concat(F.lit(" v"), F.col("video_id"))).otherwise("  "), F.lit("category"), F.when(e % 3 == 0, F.col("category")))
    return B.frames(spark, sf_dir).select("event_id", text.first_meta(meta, "absent", "video", "category").alias("first_value"), text.safe_name(F.concat(F.col("key"), F.lit(" é?"))).alias("safe"))


@query("SELECT event_id, CASE WHEN k % 4 = 0 THEN 0 ELSE [2, 3, 4, 5][(2 + 1)] END::INTEGER AS default_center, CASE WHEN k % 5 < 3 THEN 1 ELSE (k % 5) - 2 END::INTEGER AS n_valid FROM frames", B.FRAMES)
def p19_center_candidates(spark, sf_dir):
    own = F.when(F.col("k") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, scores.center_candidates(8))))
    # clip lengths 0..4 keep max(0, length - 2) of the candidates 2..5, or fall back to one
    valid = scores.valid_candidates(F.array(*map(F.lit, scores.center_candidates(8))), F.col("k") % 5, F.lit(0))
    return B.frames(spark, sf_dir).select("event_id", scores.default_center(own).alias("default_center"), F.size(valid).alias("n_valid"))


@query("SELECT run, epoch, least(1.0, (epoch + 1) / 5.0)::DOUBLE AS factor FROM history", B.HISTORY)
def p20_warmup_factor(spark, sf_dir):
    return B.history(spark, sf_dir).select("run", "epoch", scores.warmup_factor(F.col("epoch"), 5).alias("factor"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN frame_number WHEN event_id % 3 = 1 THEN event_id ELSE 1000000000000 END::BIGINT AS position FROM frames", B.FRAMES)
def l1_frame_position(spark, sf_dir):
    e = F.col("event_id")
    number = F.when(e % 3 == 0, F.col("frame_number").cast("string")).otherwise("")
    path = F.when(e % 3 == 1, F.concat(F.lit("a7/img_"), e.cast("string"), F.lit(".png"))).otherwise("a7/none.png")
    return B.frames(spark, sf_dir).select("event_id", text.frame_position(path, number).alias("position"))
