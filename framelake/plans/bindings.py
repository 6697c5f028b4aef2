"""The driver's tables as domain tables: each binding as a DataFrame, and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frame rates and categories that stand in by number; the last category has no label.
RATES = (23.976, 25.0, 29.97, 30.0, 4.0)
CATEGORIES = ("original", "Deepfakes", "Face2Face", "FaceShifter", "FaceSwap", "NeuralTextures", "Celeb-real", "YouTube-real", "Celeb-synthesis", "DeepFakeDetection")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in values) + "]"


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("video_id"),
        F.concat(F.col("o_orderpriority"), F.lit("/"), F.col("o_orderkey"), F.lit(".mp4")).alias("video_path"),
        F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("g"), F.col("o_custkey")).alias("split_group"),
        (F.col("o_orderkey") % 2).cast("int").alias("binary_label"),
        _pick(RATES, F.col("o_orderkey") % 5).alias("original_fps"),
        (F.floor("o_totalprice") % 900).alias("num_frames"),
        F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", " VAL ").otherwise("other").alias("split"),
    )


VIDEOS = f"""videos AS (SELECT o_orderkey::VARCHAR AS video_id, o_orderpriority || '/' || o_orderkey || '.mp4' AS video_path, o_orderpriority AS category,
 'g' || o_custkey AS split_group, (o_orderkey % 2)::INTEGER AS binary_label, {_sql_list(RATES)}[(o_orderkey % 5 + 1)::INTEGER] AS original_fps,
 floor(o_totalprice)::BIGINT % 900 AS num_frames, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN ' VAL ' ELSE 'other' END AS split FROM orders)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    numbered = e.withColumn("frame_number", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    category = F.concat(F.lit("cat"), F.col("user_id") % 5)
    return numbered.select(
        "event_id",
        "ts",
        category.alias("category"),
        F.col("user_id").cast("string").alias("video_id"),
        "frame_number",
        F.col("event_id").alias("original_frame_index"),
        F.concat_ws("/", category, F.col("user_id").cast("string"), F.col("frame_number").cast("string")).alias("key"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
        "event_type",
        (F.get_json_object("props", "$.k").cast("int") % 2).alias("binary_label"),
        F.col("frame_number").cast("double").alias("timestamp"),
    )


FRAMES = """frames AS (SELECT event_id, ts, 'cat' || (user_id % 5) AS category, user_id::VARCHAR AS video_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number, event_id AS original_frame_index,
 'cat' || (user_id % 5) || '/' || user_id || '/' || (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS key,
 regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k, value, event_type, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER % 2 AS binary_label,
 (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS timestamp FROM events)"""


def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).filter(F.col("event_type") != "error")


KEPT = FRAMES + ", kept AS (SELECT * FROM frames WHERE event_type <> 'error')"


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.operators.detections import with_position

    return with_position(frames(spark, sf_dir), ["category", "video_id"], ["frame_number"])


POSITIONED = FRAMES + """, positioned AS (SELECT *, row_number() OVER (PARTITION BY category, video_id ORDER BY frame_number) - 1 AS pos,
 count(*) OVER (PARTITION BY category, video_id) AS frames_in_video FROM frames)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes with status and box."""
    from framelake.operators.detections import keyframes

    k, v = F.col("k"), F.floor("value").cast("int")
    box = F.array(k, v % 300, k + 20 + k % 40, v % 300 + 20 + v % 50).cast("array<int>")
    ok = F.col("event_type") != "error"
    marks = F.create_map(F.lit("nose"), F.array(k.cast("double"), F.col("value")))
    return keyframes(positioned(spark, sf_dir)).select(
        "category", "video_id", "pos", "k", "value", F.when(ok, "ok").otherwise("no_face").alias("status"), F.when(ok, 1 + k % 3).alias("num_faces"), F.when(ok, F.col("value") / 500).alias("confidence"), F.when(ok, box).alias("bbox"), F.when(ok & (k % 7 != 0), marks).alias("landmarks")
    )


DETECTIONS = POSITIONED + """, detections AS (SELECT category, video_id, pos, k, value, CASE WHEN event_type <> 'error' THEN 'ok' ELSE 'no_face' END AS status,
 CASE WHEN event_type <> 'error' THEN 1 + k % 3 END AS num_faces, CASE WHEN event_type <> 'error' THEN value / 500 END AS confidence,
 CASE WHEN event_type <> 'error' THEN [k, floor(value)::INTEGER % 300, k + 20 + k % 40, floor(value)::INTEGER % 300 + 20 + floor(value)::INTEGER % 50] END AS bbox
 FROM positioned WHERE pos % 5 = 0 OR pos = frames_in_video - 1)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.select(F.col("event_id").cast("string").alias("key"), "video_id", "category", (F.col("k") >= 50).cast("int").alias("label"), (F.col("value") / 500).alias("prob_positive"), "k", ((F.col("event_id") * 37) % 101 / 100).alias("weak"))


PREDS = FRAMES + """, preds AS (SELECT event_id::VARCHAR AS key, video_id, category, (k >= 50)::INTEGER AS label, value / 500 AS prob_positive, k,
 ((event_id * 37) % 101) / 100 AS weak FROM frames)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of videos: every fourth one, complete or failed."""
    v = videos(spark, sf_dir).filter(F.col("video_id").cast("long") % 4 == 0)
    return v.select("category", "video_id", "split", F.when(F.col("binary_label") * 0 + F.col("video_id").cast("long") % 8 == 0, " Complete").otherwise("Failed").alias("status"))


AUDIT = VIDEOS + """, audit AS (SELECT category, video_id, split, CASE WHEN video_id::BIGINT % 8 = 0 THEN ' Complete' ELSE 'Failed' END AS status FROM videos WHERE video_id::BIGINT % 4 = 0)"""


def labels_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", F.col("quality").alias("label"), "toxic")


LABELS = "labelled AS (SELECT d.doc_id, d.source, l.quality AS label, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.select(F.col("video_id").alias("run"), (F.col("frame_number") + 1).alias("epoch"), F.when(F.col("k") != 0, F.col("value") / 500).otherwise(float("nan")).alias("metric"))


HISTORY = FRAMES + ", history AS (SELECT video_id AS run, frame_number + 1 AS epoch, CASE WHEN k <> 0 THEN value / 500 END AS metric FROM frames)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    grey = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5).cast("int"), F.lit(0)), F.lit(255)))
    return e.select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("frame_number"), F.concat_ws("/", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("key"), grey.alias("pixels"))


PIXELS = """pixels AS (SELECT label::VARCHAR AS video_id, vec_id AS frame_number, label || '/' || vec_id AS key,
 list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 127.5)::INTEGER, 0), 255)) AS pixels FROM embeddings)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels as images of 8 x 8 in three equal channels."""
    raw = F.unhex(F.array_join(F.transform("pixels", lambda p: F.repeat(F.lpad(F.hex(p), 2, "0"), 3)), ""))
    rows = pixels(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number")).cast("long") - 1)
    return rows.select("video_id", F.col("n").alias("frame_number"), F.col("frame_number").alias("original_frame_index"), "key", raw.alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"), (F.col("video_id").cast("int") % 2).alias("binary_label"), F.col("n").cast("double").alias("timestamp"))
