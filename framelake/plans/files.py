"""Queries that write derived tables as files, read them again, and call user code on derived images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import text
from framelake.operators import history, metrics, pixels, reports, user
from framelake.plans import bindings as B
from framelake.plans.registry import query
from framelake.plans.tables import PIXEL_CLIPS, _stacked
from framelake.sources import images, shards, tables
from framelake.sources.staging import scratch


@query("SELECT video_id, category, binary_label, lower(trim(split)) AS split, round(original_fps, 6) AS original_fps, num_frames::BIGINT AS num_frames FROM videos", B.VIDEOS)
def s4_manifest_files(spark, sf_dir):
    path = scratch(spark, "manifest")
    tables.write_manifest(B.videos(spark, sf_dir).withColumn("compression", text.infer_compression("video_path")), path)
    back = tables.read_manifest(spark, f"{path}/csv")
    return back.select("video_id", "category", "binary_label", "split", F.round("original_fps", 6).alias("original_fps"), "num_frames")


@query("SELECT event_id::VARCHAR || '.jpg' AS frame_path, video_id, frame_number::VARCHAR AS frame_number FROM frames WHERE k % 2 = 0 AND category = 'cat1'", B.FRAMES)
def s5_frame_metadata_files(spark, sf_dir):
    path = scratch(spark, "frames")
    named = B.frames(spark, sf_dir).select(F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("frame_path"), "video_id", "category", "frame_number", F.when(F.col("k") % 2 == 0, " Train").otherwise("val").alias("split"))
    named.write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return tables.read_frame_metadata(spark, path, split="TRAIN", category="cat1").select("frame_path", "video_id", "frame_number")


@query("SELECT frame_path, video_id FROM (SELECT event_id::VARCHAR || '.jpg' AS frame_path, video_id, k FROM frames ORDER BY 1 LIMIT 700) WHERE k % 2 = 0", B.FRAMES)
def s5_limited_frame_metadata(spark, sf_dir):
    """The first rows in order of the frame path, and of these one split."""
    path = scratch(spark, "frames")
    named = B.frames(spark, sf_dir).select(F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("frame_path"), "video_id", "category", F.when(F.col("k") % 2 == 0, "train").otherwise("val").alias("split"))
    named.write.csv(path, header=True)
    return tables.read_frame_metadata(spark, path, split="train", limit=700).select("frame_path", "video_id")


@query("SELECT video_id, event_id AS original_frame_index, CASE WHEN k % 2 = 0 THEN 'train' ELSE 'val' END AS split, category FROM frames", B.FRAMES)
def s6_frame_tables(spark, sf_dir):
    path = scratch(spark, "frames")
    rows = B.frames(spark, sf_dir).withColumn("split", F.when(F.col("k") % 2 == 0, "train").otherwise("val"))
    known = {"frame_path": "key", "video_id": "video_id", "category": "category", "split": "split", "frame_number": "frame_number", "original_frame_index": "original_frame_index"}
    tables.write_frame_metadata(rows.select(*[(F.col(known[c]) if c in known else F.lit(None).cast("string")).alias(c) for c in tables.FRAMES]), path)
    return spark.read.parquet(path).select("video_id", "original_frame_index", "split", "category")


@query("SELECT DISTINCT trim(category) || '|' || trim(video_id) || '|' || lower(trim(split)) AS video_key FROM audit WHERE lower(trim(status)) = 'complete'", B.AUDIT)
def s8_audit_files(spark, sf_dir):
    path = scratch(spark, "audit")
    audit = B.audit(spark, sf_dir).withColumn("split", text.normalize_split("split"))
    for part in (0, 1, 1):  # two appends, one of them run again
        tables.append_audit(audit.filter(F.pmod(F.xxhash64("video_id"), F.lit(2)) == part), path, write_id=f"part{part}")
    return tables.read_completed_videos(spark, path)


@query("SELECT category, video_id, status, count(*)::BIGINT AS n FROM audit GROUP BY ALL", B.AUDIT)
def s8_repeated_append(spark, sf_dir):
    """Every row of an audit is there once, though its appends were run twice."""
    path = scratch(spark, "audit")
    audit = B.audit(spark, sf_dir).withColumn("split", text.normalize_split("split"))
    for part in (0, 1, 0, 1):
        tables.append_audit(audit.filter(F.pmod(F.xxhash64("video_id"), F.lit(2)) == part), path, write_id=f"part{part}")
    return spark.read.parquet(path).groupBy("category", "video_id", "status").agg(F.count("*").alias("n"))


@query("SELECT key, label, round(prob_positive, 6) AS prob_positive FROM preds", B.PREDS)
def s14_prediction_files(spark, sf_dir):
    path = scratch(spark, "predictions")
    tables.write_predictions(B.preds(spark, sf_dir).withColumns({"label_name": F.lit("x"), "spatial_index": F.lit(2)}), path)
    return tables.read_predictions(spark, path).select("key", "label", F.round("prob_positive", 6).alias("prob_positive"))


@query("SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM (SELECT count(*) FILTER (WHERE NOT h AND label = 0)::BIGINT AS tn, count(*) FILTER (WHERE h AND label = 0)::BIGINT AS fp, count(*) FILTER (WHERE NOT h AND label = 1)::BIGINT AS fn, count(*) FILTER (WHERE h AND label = 1)::BIGINT AS tp FROM (SELECT *, prob_positive >= 0.5 AS h FROM preds))", B.PREDS)
def s15_metrics_document(spark, sf_dir):
    path = scratch(spark, "metrics")
    tables.write_metrics(metrics.binary_metrics(B.preds(spark, sf_dir)), path)
    return spark.read.json(path).select("confusion_matrix.*", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT run, 'val' AS stage, epoch::BIGINT AS epoch, round(metric, 6) AS auc FROM history", B.HISTORY)
def s16_history_files(spark, sf_dir):
    path = scratch(spark, "history")
    rows = B.history(spark, sf_dir).withColumn("auc", F.when(~F.isnan("metric"), F.col("metric")))
    documents = rows.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "auc"))), lambda e: F.struct(e["auc"].alias("auc"))).alias("val"))
    documents.write.json(path, ignoreNullFields=False)
    back = tables.read_history(spark, path, multi_line=False)
    return back.select("run", "stage", F.col("epoch").cast("long").alias("epoch"), F.round("auc", 6).alias("auc"))


RGB_HEX = "array_to_string(list_transform(range(1, 5), lambda t: repeat(array_to_string(list_transform(px[t], lambda p: lpad(printf('%X', p), 2, '0')), ''), 3)), '')"


@query(f"SELECT key, 2::BIGINT AS parts, md5({RGB_HEX}) AS rgb_md5, 4 AS length FROM st", PIXEL_CLIPS)
def s11_shard_files(spark, sf_dir):
    """Clips as tar shards in the shared folder, and read back; the same write once more adds nothing."""
    path = scratch(spark, "shards")
    stacked = _stacked(spark, sf_dir)
    parts = F.create_map(F.lit("rgb.npy"), F.col("rgb"), F.lit("json"), F.to_json(F.struct("key", "length")).cast("binary"))
    for _ in range(2):
        shards.write_shards(stacked.select(F.substring_index("key", "/", 1).alias("video"), "key", parts.alias("parts")), path, maxcount=50, write_id="clips")
    back = shards.read_shards(spark, f"{path}/shard-*.tar")
    length = F.get_json_object(F.col("parts")["json"].cast("string"), "$.length").cast("int")
    return back.select("key", F.size("parts").cast("long").alias("parts"), F.md5(F.hex(F.col("parts")["rgb.npy"])).alias("rgb_md5"), length.alias("length"))


def labelled_shards(spark: SparkSession, sf_dir: str) -> str:
    """Pattern of tars with pixels, JSON and, for every third clip, a class."""
    path = scratch(spark, "shards")
    n = F.substring("key", -6, 6).cast("int")
    document = F.to_json(F.struct((F.floor(n / 2) % 2).alias("binary_label"))).cast("binary")
    base = F.create_map(F.lit("rgb.npy"), F.col("rgb"), F.lit("json"), document)
    classed = F.map_concat(base, F.create_map(F.lit("cls"), (n % 2).cast("string").cast("binary")))
    parts = F.when(n % 3 == 0, classed).otherwise(base)
    shards.write_shards(_stacked(spark, sf_dir).select(F.substring_index("key", "/", 1).alias("video"), "key", parts.alias("parts")), path, maxcount=20)
    return f"{path}/shard-*.tar"


LABELLED = PIXEL_CLIPS + ", lb AS (SELECT key, right(key, 6)::INTEGER AS n FROM st)"


@query("SELECT 'all' AS split, count(*)::BIGINT AS clips FROM st", PIXEL_CLIPS)
def s10_count_shard_samples(spark, sf_dir):
    """Counted from the tars' indexes."""
    counted = reports.count_clips(shards.shard_members(shards.read_shard_index(spark, labelled_shards(spark, sf_dir)), "all"))
    return counted.filter("split is not null").select("split", "clips")


@query("SELECT part, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM (SELECT 'rgb.npy' AS part, 768 AS size FROM lb UNION ALL SELECT 'json', 18 FROM lb UNION ALL SELECT 'cls', 1 FROM lb WHERE n % 3 = 0) GROUP BY part", LABELLED)
def s10_shard_index(spark, sf_dir):
    """Members and their sizes, without their bytes."""
    return shards.read_shard_index(spark, labelled_shards(spark, sf_dir)).groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(
    "SELECT negative_count, positive_count, round(CASE WHEN negative_count > 0 AND positive_count > 0 THEN negative_count / positive_count END, 6) AS raw_pos_weight FROM (SELECT count(*) FILTER (WHERE label = 0)::BIGINT AS negative_count, count(*) FILTER (WHERE label = 1)::BIGINT AS positive_count FROM (SELECT CASE WHEN n % 3 = 0 THEN n % 2 ELSE (n // 2) % 2 END AS label FROM lb))",
    LABELLED,
)
def s10_class_balance(spark, sf_dir):
    """Class balance of tars of which only the label and JSON members are read."""
    out = reports.class_balance(shards.read_shard_labels(spark, labelled_shards(spark, sf_dir)))
    return out.select("negative_count", "positive_count", F.round("raw_pos_weight", 6).alias("raw_pos_weight"))


@query(f"SELECT key, md5({RGB_HEX}) AS rgb_md5 FROM st WHERE key LIKE '3/%' OR key = '7/clip_000001'", PIXEL_CLIPS)
def s10_pruned_samples(spark, sf_dir):
    """Samples of one video and one more, pixels only; the filters reach the tars."""
    pattern = labelled_shards(spark, sf_dir)
    read = lambda: shards.read_shards(spark, pattern, ["rgb.npy"], split_bytes=64 << 10)
    own = read().filter(F.col("key").startswith("3/")).unionByName(read().filter(F.col("key") == "7/clip_000001"))
    return own.select("key", F.md5(F.hex(F.col("parts")["rgb.npy"])).alias("rgb_md5"))


class BrightestPixel:
    """A stand-in detector: one box around the brightest pixel, none in dark images."""

    def detect_faces(self, image, threshold: float) -> dict:
        y, x = divmod(int(image[..., 0].argmax()), image.shape[1])
        return {"face": {"facial_area": [x, y, x + 1, y + 1], "score": float(image.max()) / 255}} if image.max() > 170 else {}


@query(
    "SELECT key, CASE WHEN list_max(pixels) > 170 THEN 'ok' ELSE 'no_face' END AS status, CASE WHEN list_max(pixels) > 170 THEN (list_position(pixels, list_max(pixels)) - 1) % 8 END::INTEGER AS x1, CASE WHEN list_max(pixels) > 170 THEN (list_position(pixels, list_max(pixels)) - 1) // 8 END::INTEGER AS y1 FROM pixels",
    B.PIXELS,
)
def u1_detect_faces(spark, sf_dir):
    out = user.detect_faces(B.images(spark, sf_dir), BrightestPixel)
    box = F.col("candidates")[0]["bbox"]
    return out.select("key", "status", F.when(F.size("candidates") > 0, box[0]).alias("x1"), F.when(F.size("candidates") > 0, box[1]).alias("y1"))


def mean_motion():
    """A stand-in model: the mean of a clip's differences."""
    import numpy as np

    return lambda spatial, temporal: [float(np.frombuffer(x, "<f4").mean()) for x in temporal]


@query("SELECT key, round(avg(abs(px[t + 1][i] - px[t][i])) / 255, 5) AS prob_positive FROM st, range(1, 4) a(t), range(1, 65) b(i) GROUP BY key", PIXEL_CLIPS)
def u2_score_clips(spark, sf_dir):
    ready = pixels.prepare_clips(_stacked(spark, sf_dir).withColumn("spatial_index", F.lit(2)))
    return user.score_clips(ready, mean_motion).withColumn("prob_positive", F.round("prob_positive", 5))


@query("SELECT run, epoch, CASE WHEN metric IS NULL THEN 'neg_val_loss' ELSE 'val_auc' END AS name, round(coalesce(metric, -0.5), 6) AS value FROM history", B.HISTORY)
def w10_selection_metric(spark, sf_dir):
    out = B.history(spark, sf_dir).select("run", "epoch", history.selection_metric(F.col("metric"), F.lit(0.5)).alias("m"))
    return out.select("run", "epoch", "m.name", F.round("m.value", 6).alias("value"))


PATHS = f"p AS (SELECT {B._sql_list(B.CATEGORIES)}[(c_custkey % 10 + 1)::INTEGER] AS category, 'v' || c_custkey AS video_id, ['mp4', 'AVI', 'txt', 'webm'][(c_custkey % 4 + 1)::INTEGER] AS ending, c_custkey % 7 = 0 AS deep FROM customer)"


@query("SELECT category, category || '/' || video_id || '.' || ending AS video_path, video_id FROM p WHERE category <> 'DeepFakeDetection' AND ending <> 'txt' AND NOT deep", PATHS)
def s1_known_videos(spark, sf_dir):
    """Of a file listing the videos directly under known category folders."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("v"), k.cast("string"), F.lit("."), B._pick(("mp4", "AVI", "txt", "webm"), k % 4))
    path = F.concat_ws("/", B._pick(B.CATEGORIES, k % 10), F.when(k % 7 == 0, "more"), name)
    return tables.known_videos(B.table(spark, sf_dir, "customer").select(path.alias("video_path")))


@query("SELECT DISTINCT category || '/' || o_custkey || '.mp4' AS video_path FROM (SELECT o_orderpriority AS category, o_custkey FROM orders WHERE o_orderkey % 5 <> 0)".replace("o_orderpriority AS category", "left(o_orderpriority, 1) AS category"))
def s3_official_test_list(spark, sf_dir):
    path = scratch(spark, "official")
    named = F.concat_ws("/", F.substring("o_orderpriority", 1, 1), F.concat(F.col("o_custkey").cast("string"), F.lit(".mp4")))
    line = F.when(F.col("o_orderkey") % 5 == 0, "1").otherwise(F.concat(F.lit(" 1 \t"), named, F.lit("  more")))
    B.table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return tables.read_official_test_list(spark, path)


@query("SELECT event_id::VARCHAR || '.jpg' AS frame_path, CASE event_id % 7 WHEN 0 THEN 'missing_file' WHEN 1 THEN 'read_fail' ELSE 'ok' END AS load_status, CASE WHEN event_id % 7 > 1 THEN 8 WHEN event_id % 7 = 1 THEN -1 END::INTEGER AS height FROM frames", B.FRAMES)
def s9_frame_images(spark, sf_dir):
    """Frames with what their files gave."""
    e = F.col("event_id")
    f = B.frames(spark, sf_dir).select(F.concat(e.cast("string"), F.lit(".jpg")).alias("frame_path"), "event_id")
    size = F.when(e % 7 == 1, -1).otherwise(8)
    loaded = f.filter(e % 7 != 0).select("frame_path", size.alias("height"), size.alias("width"), F.lit(b"").alias("image"))
    return images.with_images(f.select("frame_path"), loaded).select("frame_path", "load_status", "height")


@query("SELECT key, CASE WHEN k % 3 = 0 THEN 'test' WHEN k % 3 = 1 THEN 'val' ELSE 'train' END AS split, CASE WHEN k % 3 = 1 THEN 2 ELSE 1 END AS version FROM frames", B.FRAMES)
def s12_guarded_output(spark, sf_dir):
    """Output of three splits, one of which is replaced."""
    path = scratch(spark, "guarded")
    split = F.when(F.col("k") % 3 == 0, "test").when(F.col("k") % 3 == 1, "val").otherwise("train")
    rows = B.frames(spark, sf_dir).select("key", split.alias("split"), F.lit(1).alias("version"))
    tables.guarded_write(rows, path)
    tables.guarded_write(rows.filter("split = 'val'").withColumn("version", F.lit(2)), path, overwrite=True)
    return spark.read.parquet(path).select("key", "split", "version")


def grey_image(raw: bytes):
    """A stand-in decoder of grey maps: a line with height and width, and the pixels."""
    import numpy as np

    head, _, body = raw.partition(b"\n")
    height, width = map(int, head.split())
    return np.repeat(np.frombuffer(body, np.uint8).reshape(height, width, 1), 3, 2)


@query(
    """SELECT video_id, frame_number, CASE WHEN frame_number % 7 = 0 THEN 'missing_file' WHEN frame_number % 11 = 0 THEN 'read_fail' ELSE 'ok' END AS load_status, CASE WHEN frame_number % 7 <> 0 AND frame_number % 11 <> 0 THEN 8 END::INTEGER AS height,
    CASE WHEN frame_number % 7 <> 0 AND frame_number % 11 <> 0 THEN md5(array_to_string(list_transform(pixels, lambda p: repeat(lpad(printf('%X', p), 2, '0'), 3)), '')) END AS pixels_md5 FROM pixels""",
    B.PIXELS,
)
def s9_frame_files(spark, sf_dir):
    """Files of grey maps, some missing and some cut off, read by their frames."""
    root = scratch(spark, "images")
    path = F.format_string("%s/frame_%05d.grey", "video_id", "frame_number").alias("frame_path")
    own = B.pixels(spark, sf_dir).select("video_id", "frame_number", path, F.unhex(F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), "")).alias("body"))
    n = F.col("frame_number")
    body = F.when(n % 11 == 0, F.expr("substring(body, 1, 9)")).otherwise(F.col("body"))
    content = F.concat(F.lit(b"8 8\n"), body)
    images.write_frame_files(own.filter(n % 7 != 0).withColumn("content", content), root)
    out = images.read_frame_files(own.drop("body"), root, grey_image)
    return out.select("video_id", "frame_number", "load_status", "height", F.md5(F.hex("image")).alias("pixels_md5"))


@query("SELECT category, category || '/' || video_id || '.' || ending AS video_path, video_id FROM p WHERE category <> 'DeepFakeDetection' AND ending <> 'txt' AND NOT deep", PATHS)
def s1_listed_videos(spark, sf_dir):
    """The same of real files."""
    root = scratch(spark, "videos")
    k = F.col("c_custkey")
    name = F.concat(F.lit("v"), k.cast("string"), F.lit("."), B._pick(("mp4", "AVI", "txt", "webm"), k % 4))
    path = F.concat_ws("/", B._pick(B.CATEGORIES, k % 10), F.when(k % 7 == 0, "more"), name)
    images.write_frame_files(B.table(spark, sf_dir, "customer").select(path.alias("frame_path"), F.lit(b"0").alias("content")), root, tasks=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tables.list_videos(spark, root).select("category", "video_path", "video_id")
