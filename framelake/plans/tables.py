"""Queries of the joins, reports, metrics and sequence operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import samples, text
from framelake.operators import clips, detections, history, metrics, pixels, reports, resume, sampling, splits, stretches
from framelake.plans import bindings as B
from framelake.plans.registry import query

VKEY = "trim(category) || '|' || trim(video_id) || '|' || lower(trim(split))"


# joins


@query(f"SELECT category, video_id FROM videos WHERE {VKEY} NOT IN (SELECT {VKEY} FROM audit WHERE lower(trim(status)) = 'complete')", B.AUDIT)
def j1_pending_videos(spark, sf_dir):
    return resume.pending_videos(B.videos(spark, sf_dir), B.audit(spark, sf_dir)).select("category", "video_id")


@query(f"SELECT DISTINCT {VKEY} AS video_key FROM audit WHERE lower(trim(status)) = 'complete'", B.AUDIT)
def s7_completed_videos(spark, sf_dir):
    return resume.completed_videos(B.audit(spark, sf_dir))


@query("SELECT key FROM frames WHERE event_id % 3 <> 0 AND event_id % 7 <> 0", B.FRAMES)
def j2_pending_frames(spark, sf_dir):
    f = B.frames(spark, sf_dir)
    return resume.pending_frames(f, f.filter("event_id % 3 = 0"), f.filter("event_id % 7 = 0")).select("key")


GREEDY = B.VIDEOS + """, w AS (SELECT category, split_group, count(*) AS weight FROM videos GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, md5(split_group)) AS i, sum(weight) OVER (PARTITION BY category)::DOUBLE AS total FROM w),
 s AS (SELECT category, 0::BIGINT AS i, NULL::VARCHAR AS split_group, NULL::VARCHAR AS split, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, any_value(total) AS total FROM r GROUP BY category
 UNION ALL SELECT category, i, split_group, split, a + CASE WHEN split = 'train' THEN weight ELSE 0 END, b + CASE WHEN split = 'val' THEN weight ELSE 0 END, c + CASE WHEN split = 'test' THEN weight ELSE 0 END, total
 FROM (SELECT r.category, r.i, r.split_group, r.weight, s.a, s.b, s.c, s.total, CASE WHEN s.total * {0} - s.a >= greatest(s.total * 0.1::DOUBLE - s.b, {1}) THEN 'train' WHEN s.total * 0.1::DOUBLE - s.b >= {1} THEN 'val' ELSE 'test' END AS split
 FROM s JOIN r ON r.category = s.category AND r.i = s.i + 1))"""
THREE = "RECURSIVE " + GREEDY.format("0.8::DOUBLE", "s.total * 0.1::DOUBLE - s.c")
TWO = "RECURSIVE " + GREEDY.format("0.9::DOUBLE", "-1e300")


@query("SELECT category, split_group, split FROM s WHERE i > 0", THREE)
def w1_assign_splits(spark, sf_dir):
    return splits.assign_group_splits(B.videos(spark, sf_dir)).select("category", "split_group", "split")


@query("SELECT category, split_group, split FROM s WHERE i > 0", TWO)
def w1_assign_train_val(spark, sf_dir):
    return splits.assign_group_splits(B.videos(spark, sf_dir), splits.TWO_WAY).select("category", "split_group", "split")


@query("SELECT v.video_id, CASE WHEN v.video_id::BIGINT % 11 = 0 THEN 'test' ELSE g.split END AS split FROM videos v LEFT JOIN (SELECT split_group, arg_max(split, category) AS split FROM s WHERE i > 0 GROUP BY split_group) g ON v.split_group = g.split_group", THREE)
def j3_apply_splits(spark, sf_dir):
    v = B.videos(spark, sf_dir)
    official = v.filter(F.col("video_id").cast("long") % 11 == 0).select("video_path")
    return splits.apply_splits(v.drop("split"), splits.assign_splits(v), official).select("video_id", "split")


@query("SELECT video_id, 'test' AS split FROM videos", B.VIDEOS)
def j3_all_test(spark, sf_dir):
    v = B.videos(spark, sf_dir)
    return splits.apply_splits(v.drop("split"), splits.assign_splits(v), all_test=True).select("video_id", "split")


SAMPLED = B.VIDEOS + """, plan AS (SELECT category, video_id, k::BIGINT AS frame_number, greatest(k, ceil((k * 0.2::DOUBLE - 1e-9) * original_fps))::BIGINT AS original_frame_index, original_fps, num_frames
 FROM videos, generate_series(0, 1200) t(k) WHERE num_frames > 0 AND greatest(k, ceil((k * 0.2::DOUBLE - 1e-9) * original_fps)) < num_frames)"""


@query("SELECT video_id, frame_number, original_frame_index, round(original_frame_index / original_fps, 6) AS timestamp FROM plan", SAMPLED)
def w2_sample_frames(spark, sf_dir):
    return sampling.sample_frames(B.videos(spark, sf_dir), digits=6).select("video_id", F.col("frame_number").cast("long").alias("frame_number"), "original_frame_index", "timestamp")


@query("SELECT v.video_id, count(p.frame_number)::BIGINT AS expected FROM videos v LEFT JOIN plan p ON v.video_id = p.video_id GROUP BY v.video_id", SAMPLED)
def w3_expected_samples(spark, sf_dir):
    return sampling.expected_samples(B.videos(spark, sf_dir)).select("video_id", "expected")


@query("SELECT video_id, count(*) FILTER (WHERE r = frame_number)::BIGINT AS prefix FROM (SELECT video_id, frame_number, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS r FROM (SELECT DISTINCT video_id, frame_number FROM kept)) GROUP BY video_id", B.KEPT)
def w4_contiguous_prefix(spark, sf_dir):
    return sampling.contiguous_prefix(B.kept_frames(spark, sf_dir), ["video_id"]).select("video_id", "prefix")


@query("SELECT p.video_id, p.frame_number, p.original_frame_index, v.binary_label FROM plan p JOIN videos v ON p.video_id = v.video_id WHERE p.frame_number % 2 = 0", SAMPLED)
def j4_rebuild_frames(spark, sf_dir):
    v = B.videos(spark, sf_dir)
    # files 0, 2, 4, … up to the length in source frames: those beyond the plan go
    files = v.select("category", "video_id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("num_frames"), F.lit(1)).cast("int"), F.lit(2))).alias("frame_number"))
    return resume.rebuild_frames(files, v).select("video_id", F.col("frame_number").cast("long").alias("frame_number"), "original_frame_index", "binary_label")


PLANNED = B.VIDEOS + """, plan AS (SELECT category, video_id, lower(trim(split)) AS split, original_fps, binary_label, k::BIGINT AS frame_number, greatest(k, ceil((k * 1.0::DOUBLE - 1e-9) * original_fps))::BIGINT AS original_frame_index, video_id::BIGINT % 8 AS kind
 FROM videos, generate_series(0, 1200) t(k) WHERE num_frames > 0 AND greatest(k, ceil((k * 1.0::DOUBLE - 1e-9) * original_fps)) < num_frames),
 sizes AS (SELECT video_id, count(*) AS expected FROM plan GROUP BY video_id)"""


def half_extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Videos, frame rows, files and sampling plan of an extraction at one frame a second that was cut off in several ways, by number modulo 8.

    1: rows with a gap. 2: the last file missing. 3: a row twice. 4: a number that is none. 5: no rows. 6: no rows and no first
    file. 7: a file too many. Others are whole.
    """
    v = B.videos(spark, sf_dir)
    plan = sampling.written_plan(v, 1, digits=6)
    kind, n, size = F.col("video_id").cast("long") % 8, F.col("frame_number"), F.size("_at")
    path = F.concat("category", F.lit("/"), "video_id", F.lit("_frame_"), F.lpad(n.cast("string"), 5, "0"), F.lit(".jpg"))
    numbers = F.sequence(F.lit(0), size - 1)
    numbers = F.when(kind == 1, F.array_remove(numbers, 2)).when(kind == 3, F.array_append(numbers, 0)).otherwise(numbers)
    rows = sampling.planned(v, plan=plan).filter((size > 0) & ~kind.isin(5, 6)).withColumn("frame_number", F.explode(numbers))
    at, text_number = F.get("_at", n), F.when((kind == 4) & (n == 0), "x").otherwise(n.cast("string"))
    rows = rows.select("category", "video_id", F.upper("split").alias("split"), path.alias("frame_path"), text_number.alias("frame_number"), at["original_frame_index"].alias("original_frame_index"), at["timestamp"].alias("timestamp"), "binary_label")
    first, last = (kind == 6).cast("int"), F.col("expected").cast("int") - 1 - (kind == 2).cast("int") + (kind == 7).cast("int")
    files = sampling.expected_samples(v, plan=plan).filter((F.col("expected") > 0) & (first <= last)).select("category", "video_id", F.explode(F.sequence(first, last)).alias("frame_number"))
    return v, rows, files.withColumn("frame_path", path), plan


@query(
    """SELECT category || '|' || v.video_id || '|' || lower(trim(split)) AS video_key, CASE WHEN num_frames > 0 THEN e END AS expected, n AS rows, f AS files, num_frames > 0 AND kind = 0 OR num_frames > 0 AND kind = 1 AND e < 3 AS complete,
    CASE WHEN num_frames > 0 AND (kind = 0 OR kind = 1 AND e < 3) THEN 'keep' ELSE 'extract' END AS action FROM (SELECT v.*, kind, coalesce(expected, 0)::BIGINT AS e,
    (CASE WHEN kind IN (5, 6) THEN 0 ELSE coalesce(expected, 0) - (kind = 1 AND coalesce(expected, 0) > 2)::INTEGER + (kind = 3 AND coalesce(expected, 0) > 0)::INTEGER END)::BIGINT AS n,
    (CASE WHEN coalesce(expected, 0) = 0 THEN 0 ELSE expected - (kind IN (2, 6))::INTEGER + (kind = 7)::INTEGER END)::BIGINT AS f FROM (SELECT *, video_id::BIGINT % 8 AS kind FROM videos) v LEFT JOIN sizes s ON s.video_id = v.video_id) v""",
    PLANNED,
)
def a8_video_states(spark, sf_dir):
    """Manifest, rows and files of each video, and what is to be done, when there is no audit."""
    v, rows, files, plan = half_extracted(spark, sf_dir)
    states = resume.video_states(v, rows, files, B.audit(spark, sf_dir).filter("status = ''"), 1, plan)
    return states.select("video_key", "expected", "rows", "files", "complete", "action")


@query(
    "SELECT v.category, v.video_id, v.split, 'complete' AS status FROM videos v JOIN sizes s ON s.video_id = v.video_id WHERE v.video_id::BIGINT % 8 = 0 OR v.video_id::BIGINT % 8 = 1 AND expected < 3",
    PLANNED,
)
def s7_bootstrapped_audit(spark, sf_dir):
    """The audit that whole rows and files make up for."""
    v, rows, files, plan = half_extracted(spark, sf_dir)
    return resume.reconcile(v, rows, files, B.audit(spark, sf_dir).filter("status = ''"), 1, plan).audit


@query(
    """SELECT category, video_id, split, category || '/' || video_id || '_frame_' || lpad(frame_number::VARCHAR, 5, '0') || '.jpg' AS frame_path, frame_number::VARCHAR AS frame_number, original_frame_index, round(original_frame_index / original_fps, 6) AS timestamp, binary_label FROM plan WHERE kind IN (0, 5)""",
    PLANNED,
)
def j4_reconciled_frames(spark, sf_dir):
    """Rows that hold: those of audited videos, from their files where there are none; gapped ones go."""
    v, rows, files, plan = half_extracted(spark, sf_dir)
    audit = v.filter((F.col("video_id").cast("long") % 8).isin(0, 5, 6)).select("category", "video_id", "split", F.lit(" Complete").alias("status"))
    out = resume.reconcile(v, rows, files, audit, 1, plan).frames
    return out.withColumn("split", F.lower(F.trim("split")))


INTERPOLATED = B.DETECTIONS + """, j AS (SELECT p.category, p.video_id, p.pos, d.status, d.bbox, d.confidence, d.num_faces, CASE WHEN d.status = 'ok' AND d.k % 7 <> 0 THEN d.k END AS mark,
 CASE WHEN d.status = 'ok' THEN {'pos': p.pos, 'bbox': d.bbox, 'confidence': d.confidence, 'num_faces': d.num_faces, 'mark': CASE WHEN d.k % 7 <> 0 THEN d.k END} END AS rec
 FROM positioned p LEFT JOIN detections d ON p.category = d.category AND p.video_id = d.video_id AND p.pos = d.pos),
 n AS (SELECT *, last_value(rec IGNORE NULLS) OVER (PARTITION BY category, video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(rec IGNORE NULLS) OVER (PARTITION BY category, video_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM j),
 i AS (SELECT video_id, pos, CASE WHEN status IS NULL AND a IS NOT NULL AND b IS NOT NULL THEN 'interpolated' WHEN status = 'ok' THEN 'detected' END AS source, status, (pos - a.pos) / (b.pos - a.pos)::DOUBLE AS t, a, b, bbox, confidence, num_faces, mark FROM n)"""


@query(
    """SELECT video_id, pos, source, CASE WHEN source = 'interpolated' THEN 'ok' ELSE status END AS status, CASE WHEN source = 'interpolated' THEN round_even((1 - t) * a.bbox[1] + t * b.bbox[1], 0)::INTEGER ELSE bbox[1] END AS x1,
    CASE WHEN source = 'interpolated' THEN round_even((1 - t) * a.bbox[4] + t * b.bbox[4], 0)::INTEGER ELSE bbox[4] END AS y2, CASE WHEN source = 'interpolated' THEN greatest(a.num_faces, b.num_faces) ELSE num_faces END::INTEGER AS num_faces,
    round(CASE WHEN source = 'interpolated' THEN least(a.confidence, b.confidence) ELSE confidence END, 5) AS confidence, round(CASE WHEN source = 'interpolated' THEN (1 - t) * a.mark + t * b.mark ELSE mark END, 6)::DOUBLE AS nose FROM i""",
    INTERPOLATED,
)
def j5_interpolate_detections(spark, sf_dir):
    out = detections.interpolate_detections(B.positioned(spark, sf_dir), B.detections(spark, sf_dir), ["category", "video_id"])
    return out.select("video_id", F.col("pos").cast("long").alias("pos"), "source", "status", F.col("bbox")[0].alias("x1"), F.col("bbox")[3].alias("y2"), F.col("num_faces").cast("int").alias("num_faces"), F.round("confidence", 5).alias("confidence"), F.round(F.col("landmarks")["nose"][0], 6).alias("nose"))


@query(
    """SELECT video_id, category, source_id FROM (SELECT o_orderkey || '_' || o_custkey AS video_id, c AS category, CASE WHEN c = 'original' THEN o_orderkey::VARCHAR ELSE o_orderkey || '_' || o_custkey END AS source_id
    FROM orders, (VALUES ('original'), ('Deepfakes'), ('FaceSwap')) t(c)) WHERE NOT (category = 'original' AND source_id::VARCHAR IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 2 = 0)) AND NOT (category <> 'original' AND split_part(video_id, '_', 1)::BIGINT % 3 <> 0)"""
)
def j6_pair_with_original(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    pair = F.concat_ws("_", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    made = [o.filter("o_orderkey % 3 <> 0").select(F.lit(c).alias("category"), pair.alias("video_id")) for c in ("Deepfakes", "FaceSwap")]
    known = o.filter("o_orderkey % 2 = 0").select(F.lit("original").alias("category"), F.col("o_orderkey").cast("string").alias("video_id")).unionByName(made[0]).unionByName(made[1])
    pairs = resume.pair_with_original(o.select(pair.alias("video_id")), ["original", "Deepfakes", "FaceSwap"])
    return resume.missing_partners(pairs, known)


@query("SELECT key, label, prob_positive AS prob_one, k / 100.0::DOUBLE AS prob_two FROM preds", B.PREDS)
def j7_align_predictions(spark, sf_dir):
    p = B.preds(spark, sf_dir)
    return metrics.align_predictions(p, p.withColumn("prob_positive", F.col("k") / 100))


@query(
    """SELECT key, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY key) AS r FROM (SELECT key, CASE WHEN key::BIGINT % 50 = 0 THEN 'only_one' WHEN key::BIGINT % 77 = 0 THEN 'only_two' WHEN key::BIGINT % 33 = 0 THEN 'label' END AS kind FROM preds) WHERE kind IS NOT NULL) WHERE r <= 5 AND NOT (kind = 'only_one' AND key::BIGINT % 77 = 0)""",
    B.PREDS.replace("FROM frames)", "FROM frames WHERE NOT (event_id % 50 = 0 AND event_id % 77 = 0))"),
)
def j7_mismatched_predictions(spark, sf_dir):
    p = B.preds(spark, sf_dir)
    key = F.col("key").cast("long")
    one, two = p.filter(key % 77 != 0), p.filter(key % 50 != 0).withColumn("label", F.when((key % 33 == 0) & (key % 77 != 0), 1 - F.col("label")).otherwise(F.col("label")))
    return metrics.mismatched_predictions(one, two)


@query("SELECT key FROM frames WHERE category IN ('cat0', 'cat1') OR (category = 'cat2' AND video_id IN (SELECT DISTINCT video_id FROM frames WHERE category = 'cat2' ORDER BY 1 LIMIT 3))", B.FRAMES)
def j8_subset_by_videos(spark, sf_dir):
    return resume.subset_by_videos(B.frames(spark, sf_dir), 3, ["cat0", "cat1"], "cat2").select("key")


@query("SELECT key FROM frames WHERE event_id % 13 = 0", B.FRAMES)
def j9_missing_frame_files(spark, sf_dir):
    f = B.frames(spark, sf_dir).withColumn("frame_path", F.concat(F.col("key"), F.lit(".jpg")))
    return resume.missing_frame_files(f, f.filter("event_id % 13 <> 0")).select("key")


@query(
    """SELECT category, video_id, 'no_frames' AS gap FROM (SELECT DISTINCT category, video_id FROM frames) WHERE video_id::BIGINT % 10 = 0
    UNION ALL SELECT category, video_id, 'no_detections' FROM (SELECT DISTINCT category, video_id FROM frames WHERE video_id::BIGINT % 10 <> 0) WHERE video_id::BIGINT % 7 = 0""",
    B.FRAMES,
)
def j10_coverage_gaps(spark, sf_dir):
    f = B.frames(spark, sf_dir)
    own = f.filter(F.col("video_id").cast("long") % 10 != 0)
    return resume.coverage_gaps(f, own, own.filter(F.col("video_id").cast("long") % 7 != 0), ["category", "video_id"])


# counts and reports


@query("SELECT split, category, count(*)::BIGINT AS n FROM videos GROUP BY GROUPING SETS ((split), (category), ())", B.VIDEOS)
def a1_manifest_counts(spark, sf_dir):
    return reports.manifest_counts(B.videos(spark, sf_dir))


NORMAL = B.VIDEOS + ", v AS (SELECT category, CASE WHEN lower(trim(split)) IN ('train','val','test') THEN lower(trim(split)) ELSE 'missing' END AS split FROM videos)"


@query("SELECT split, count(*)::BIGINT AS n, printf('%.2f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS pct FROM v GROUP BY split", NORMAL)
def a2_split_report(spark, sf_dir):
    return reports.split_report(B.videos(spark, sf_dir))


@query(
    "SELECT category, train, val, test, missing, total, " + ", ".join(f"printf('%.2f%%', 100.0 * {s} / total) AS {s}_pct" for s in ("train", "val", "test", "missing")) + " FROM (SELECT category, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}')::BIGINT AS {s}" for s in ("train", "val", "test", "missing")) + ", count(*)::BIGINT AS total FROM v GROUP BY category)",
    NORMAL,
)
def a2_category_split_report(spark, sf_dir):
    return reports.category_split_report(B.videos(spark, sf_dir))


@query(
    """SELECT category, count(*)::BIGINT AS videos, sum(f)::BIGINT AS frames, sum(d)::BIGINT AS detected, count(*) FILTER (WHERE d = f)::BIGINT AS fully_detected,
    count(*) FILTER (WHERE d > 0 AND d < f)::BIGINT AS partially_detected, count(*) FILTER (WHERE d = 0)::BIGINT AS not_detected
    FROM (SELECT category, video_id, count(*) AS f, count(*) FILTER (WHERE event_type <> 'error' AND video_id::BIGINT % 6 <> 0 OR video_id::BIGINT % 6 = 1) AS d FROM frames GROUP BY ALL) GROUP BY category""",
    B.FRAMES,
)
def a3_status_report(spark, sf_dir):
    six = F.col("video_id").cast("long") % 6
    found = ((F.col("event_type") != "error") & (six != 0)) | (six == 1)
    return reports.status_report(B.frames(spark, sf_dir).withColumn("detected", found.cast("int")), ["video_id"])


STATUS = B.FRAMES + """, m AS (SELECT DISTINCT category, category || '/' || video_id AS video FROM frames), f AS (SELECT category, category || '/' || video_id AS video, key FROM frames WHERE video_id::BIGINT % 10 <> 0),
 au AS (SELECT DISTINCT key FROM frames WHERE event_id % 3 = 0 AND event_type <> 'error' OR video_id::BIGINT % 6 = 1), sh AS (SELECT key FROM frames WHERE event_id % 7 = 0 AND video_id::BIGINT % 4 <> 2),
 d AS (SELECT f.*, key IN (SELECT key FROM au) OR key IN (SELECT key FROM sh) AS done FROM f), v AS (SELECT video, count(*) AS n, count(*) FILTER (WHERE done) AS k FROM d GROUP BY video)"""


@query(
    """SELECT 'manifest_videos' AS metric, NULL::VARCHAR AS category, count(*)::BIGINT AS n FROM m UNION ALL SELECT 'frame_rows', NULL, count(*) FROM f UNION ALL SELECT 'audit_keys', NULL, count(*) FROM au UNION ALL SELECT 'shard_keys', NULL, count(*) FROM sh
    UNION ALL SELECT 'videos_without_frames', NULL, count(*) FROM m WHERE video NOT IN (SELECT video FROM f) UNION ALL SELECT 'videos_with_frames', NULL, count(*) FROM v UNION ALL SELECT 'detected_frames', NULL, sum(k) FROM v
    UNION ALL SELECT 'videos_with_detections', NULL, count(*) FROM v WHERE k > 0 UNION ALL SELECT 'fully_detected', NULL, count(*) FROM v WHERE k = n UNION ALL SELECT 'partially_detected', NULL, count(*) FROM v WHERE k > 0 AND k < n
    UNION ALL SELECT 'not_detected', NULL, count(*) FROM v WHERE k = 0 UNION ALL SELECT 'missing_frame_files', NULL, count(*) FROM f WHERE length(key) % 5 = 0 UNION ALL SELECT 'manifest_videos', category, count(*) FROM m GROUP BY category
    UNION ALL SELECT 'frame_rows', category, count(*) FROM f GROUP BY category UNION ALL SELECT 'detected_frames', category, count(*) FROM d WHERE done GROUP BY category""",
    STATUS,
)
def a3_pipeline_status(spark, sf_dir):
    """Manifest, frames, audit, shards and file listing as they come."""
    video = F.concat_ws("/", "category", "video_id")
    f = B.frames(spark, sf_dir).withColumns({"video": video, "frame_path": F.col("key")})
    number, event = F.col("video_id").cast("long"), F.col("event_id")
    audit = f.filter(((event % 3 == 0) & (F.col("event_type") != "error")) | (number % 6 == 1))
    files = f.filter(F.length("key") % 5 != 0)
    manifest = f.select("category", "video").distinct()
    return reports.pipeline_status(manifest, f.filter(number % 10 != 0), audit.select("key").union(audit.select("key")), f.filter((event % 7 == 0) & (number % 4 != 2)), files)


@query("SELECT category, count(DISTINCT video_id)::BIGINT AS videos, count(*)::BIGINT AS frames FROM kept GROUP BY category", B.KEPT)
def a4_subset_counts(spark, sf_dir):
    return reports.subset_counts(B.kept_frames(spark, sf_dir))


MEMBERS = B.FRAMES + ", m AS (SELECT CASE WHEN category = 'cat0' THEN 'test' ELSE 'train' END AS split, category || '-' || (frame_number // 50) AS shard, key, CASE WHEN k % 4 = 0 THEN 'cls' ELSE 'json' END AS suffix FROM frames)"


@query("SELECT split, count(DISTINCT shard)::BIGINT AS shards, count(DISTINCT CASE WHEN suffix = 'json' THEN key END)::BIGINT AS clips, ceil(count(DISTINCT CASE WHEN suffix = 'json' THEN key END) / 16.0)::BIGINT AS batches FROM m GROUP BY GROUPING SETS ((split), ())", MEMBERS)
def a5_count_clips(spark, sf_dir):
    split = F.when(F.col("category") == "cat0", "test").otherwise("train")
    members = B.frames(spark, sf_dir).select(split.alias("split"), F.concat_ws("-", "category", F.floor(F.col("frame_number") / 50).cast("string")).alias("shard"), "key", F.when(F.col("k") % 4 == 0, "cls").otherwise("json").alias("suffix"))
    return reports.count_clips(members).withColumn("batches", reports.batch_count(F.col("clips"), 16))


@query(
    """SELECT source, n AS negative_count, p AS positive_count, round(CASE WHEN n > 0 AND p > 0 THEN n / p END, 6) AS raw_pos_weight, round(CASE WHEN n > 0 AND p > 0 THEN least(n / p, 0.15) END, 6) AS effective_pos_weight
    FROM (SELECT source, count(*) FILTER (WHERE label = 0)::BIGINT AS n, count(*) FILTER (WHERE label = 1)::BIGINT AS p FROM labelled GROUP BY source)""",
    B.LABELS,
)
def a6_class_balance(spark, sf_dir):
    out = reports.class_balance(B.labels_by_source(spark, sf_dir), ["source"], max_pos_weight=0.15)
    return out.withColumns({c: F.round(c, 6) for c in ("raw_pos_weight", "effective_pos_weight")})


@query(
    """SELECT category, video_id, count(*)::BIGINT AS frames, count(*) FILTER (WHERE NOT e)::BIGINT AS processed, count(*) FILTER (WHERE NOT e AND st = 'ok')::BIGINT AS detected, count(*) FILTER (WHERE NOT e AND st = 'no_face')::BIGINT AS no_face,
    count(*) FILTER (WHERE NOT e AND st = 'missing_file')::BIGINT AS missing_file, count(*) FILTER (WHERE NOT e AND st = 'read_fail')::BIGINT AS read_fail, count(*) FILTER (WHERE NOT e AND st = 'detect_error')::BIGINT AS detect_error,
    count(*) FILTER (WHERE NOT e AND st IS NULL)::BIGINT AS unresolved, count(*) FILTER (WHERE source = 'interpolated')::BIGINT AS interpolated, count(*) FILTER (WHERE source = 'detected')::BIGINT AS direct,
    count(*) FILTER (WHERE NOT e AND st = 'ok' AND k % 11 = 0)::BIGINT AS crop_fail, count(*) FILTER (WHERE NOT e AND st = 'ok' AND k % 11 <> 0)::BIGINT AS written, count(*) FILTER (WHERE NOT e AND st = 'no_face')::BIGINT AS skipped_no_face,
    count(*) FILTER (WHERE e)::BIGINT AS skipped_existing FROM i2 GROUP BY GROUPING SETS ((category, video_id), ())""",
    INTERPOLATED
    + """, i2 AS (SELECT p.category, p.video_id, p.k, p.event_id % 9 = 0 AS e, i.source, CASE WHEN i.source IS NOT NULL THEN 'ok' WHEN i.status IS NULL THEN CASE p.event_id % 8 WHEN 1 THEN 'missing_file' WHEN 2 THEN 'read_fail' WHEN 3 THEN 'detect_error' END ELSE i.status END AS st
 FROM positioned p JOIN i ON i.video_id = p.video_id AND i.pos = p.pos)""",
)
def a7_detection_stats(spark, sf_dir):
    """All counters; some open frames fail in several ways, some boxes give no crop, some frames were written before."""
    by = ["category", "video_id"]
    event = F.col("event_id")
    found = detections.interpolate_detections(B.positioned(spark, sf_dir), B.detections(spark, sf_dir), by)
    failing = F.when(event % 8 == 1, "missing_file").when(event % 8 == 2, "read_fail").when(event % 8 == 3, "detect_error")
    sized = detections.with_crop(found.withColumns({"height": F.lit(480), "width": F.when(F.col("k") % 11 != 0, 640).otherwise(0), "status": F.coalesce("status", failing), "existing": event % 9 == 0}))
    return detections.detection_stats(sized, by, "existing")


@query(
    """SELECT video_id, expected, n AS rows, n = expected AND lo = 0 AND hi = expected - 1 AS complete FROM (SELECT f.video_id, count(*)::BIGINT AS expected, count(*) FILTER (WHERE event_type <> 'error' OR video_id::BIGINT % 2 = 0)::BIGINT AS n,
    min(frame_number) FILTER (WHERE event_type <> 'error' OR video_id::BIGINT % 2 = 0) AS lo, max(frame_number) FILTER (WHERE event_type <> 'error' OR video_id::BIGINT % 2 = 0) AS hi FROM frames f GROUP BY video_id)""",
    B.FRAMES,
)
def a8_metadata_complete(spark, sf_dir):
    f = B.frames(spark, sf_dir)
    expected = f.groupBy("video_id").agg(F.count("*").alias("expected"))
    own = f.filter((F.col("event_type") != "error") | (F.col("video_id").cast("long") % 2 == 0))
    return reports.metadata_complete(own, expected, ["video_id"])


@query("SELECT k || ' of ' || category AS error_message, count(*)::BIGINT AS n FROM frames WHERE event_type = 'error' GROUP BY ALL ORDER BY n DESC, error_message LIMIT 5", B.FRAMES)
def a18_top_errors(spark, sf_dir):
    found = B.frames(spark, sf_dir).select(F.when(F.col("event_type") == "error", "detect_error").otherwise("ok").alias("status"), F.concat_ws(" of ", F.col("k").cast("string"), "category").alias("error_message"))
    return detections.top_errors(found)


# metrics

CONF = B.PREDS + ", c AS (SELECT category, count(*) FILTER (WHERE NOT h AND label = 0)::BIGINT AS tn, count(*) FILTER (WHERE h AND label = 0)::BIGINT AS fp, count(*) FILTER (WHERE NOT h AND label = 1)::BIGINT AS fn, count(*) FILTER (WHERE h AND label = 1)::BIGINT AS tp, min(prob_positive) AS lo, max(prob_positive) AS hi, avg(prob_positive) AS mean, stddev_pop(prob_positive) AS std FROM (SELECT *, prob_positive >= 0.2 AS h FROM preds) GROUP BY category)"


@query(
    """SELECT category, tn, fp, fn, tp, round(lo, 6) AS prob_min, round(hi, 6) AS prob_max, round(mean, 6) AS prob_mean, round(std, 6) AS prob_std, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, tn + fp AS labels_negative, tp + fn AS labels_positive, tn + fn AS preds_negative, tp + fp AS preds_positive FROM c""",
    CONF,
)
def a9_binary_metrics(spark, sf_dir):
    out = metrics.binary_metrics(B.preds(spark, sf_dir), 0.2, ["category"])
    return out.withColumns({c: F.round(c, 6) for c in ("prob_min", "prob_max", "prob_mean", "prob_std", "accuracy", "balanced_accuracy", "f1", "precision", "recall", "specificity")})


@query(
    """SELECT category, round(sum(pos * (2 * (n - fp) + neg)) / 2.0 / (any_value(p) * any_value(n)::DOUBLE), 6) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY category ORDER BY weak DESC) AS fp, sum(pos) OVER (PARTITION BY category) AS p, sum(neg) OVER (PARTITION BY category) AS n
    FROM (SELECT category, weak, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM preds GROUP BY ALL)) GROUP BY category""",
    B.PREDS,
)
def a10_roc_auc(spark, sf_dir):
    p = B.preds(spark, sf_dir).select("category", "label", F.col("weak").alias("prob_positive"))
    return metrics.roc_auc(p, ["category"]).withColumn("auc", F.round("auc", 6))


CURVE = B.PREDS + """, g AS (SELECT prob_positive AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM preds GROUP BY 1),
 k AS (SELECT threshold, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY threshold DESC))"""


@query("SELECT round(threshold, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, (n - fp)::BIGINT AS tn, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM k", CURVE)
def a11_threshold_curve(spark, sf_dir):
    out = metrics.threshold_curve(B.preds(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", "tpr", "fpr", "precision", "recall")})


BEST = B.PREDS + """, t AS (SELECT DISTINCT prob_positive AS threshold, true AS own FROM preds UNION SELECT x::DOUBLE, false FROM (VALUES (0.05), (0.10), (0.15), (0.20), (0.25), (0.30), (0.35), (0.40), (0.45), (0.50)) v(x)),
 h AS (SELECT prob_positive, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM preds GROUP BY 1),
 u AS (SELECT threshold, own, 0 AS pos, 0 AS neg FROM t UNION ALL SELECT prob_positive, NULL, pos, neg FROM h),
 q AS (SELECT threshold, own, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM u WINDOW w AS (ORDER BY threshold DESC)),
 z AS (SELECT *, tp / p - fp / n AS youden, CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END AS f1, (tp / p + (n - fp) / n) / 2 AS bal FROM q WHERE own IS NOT NULL)"""


SHOWN = """round(threshold, 6) AS threshold, round({0}, 6) AS score, (n - fp)::BIGINT AS tn, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, tp::BIGINT AS tp, round((tp + n - fp) / (p + n), 6) AS accuracy, round(f1, 6) AS f1,
 round(bal, 6) AS balanced_accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(tp / p, 6) AS recall, NULL::VARCHAR AS warning"""


@query(
    f"""SELECT * FROM (SELECT 'youden' AS criterion, {SHOWN.format("youden")} FROM z WHERE own ORDER BY z.youden DESC, z.threshold DESC LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'f1', {SHOWN.format("z.f1")} FROM z ORDER BY z.f1 DESC, z.threshold LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'balanced_accuracy', {SHOWN.format("bal")} FROM z ORDER BY bal DESC, z.threshold LIMIT 1)""",
    BEST,
)
def a12_best_thresholds(spark, sf_dir):
    out = metrics.best_thresholds(B.preds(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", "score", "accuracy", "f1", "balanced_accuracy", "precision", "recall")})


@query("SELECT NULL::VARCHAR AS criterion, NULL::DOUBLE AS threshold, NULL::BIGINT AS tp, 'no threshold: all labels are of one class' AS warning FROM preds HAVING count(*) FILTER (WHERE label = 1) = 0 OR count(*) FILTER (WHERE label = 0) = 0", B.PREDS.replace("(k >= 50)::INTEGER AS label", "1 AS label"))
def a12_one_class(spark, sf_dir):
    return metrics.best_thresholds(B.preds(spark, sf_dir).withColumn("label", F.lit(1))).select("criterion", "threshold", "tp", "warning")


@query("SELECT round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision FROM k", CURVE)
def a13_average_precision(spark, sf_dir):
    return metrics.average_precision(B.preds(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


@query("SELECT label, bin, count(*)::BIGINT AS n, round(count(*) * 20.0::DOUBLE / sum(count(*)) OVER (PARTITION BY label), 6) AS density FROM (SELECT label, least(floor(weak * 20)::INTEGER, 19) AS bin FROM preds) GROUP BY label, bin", B.PREDS)
def a14_score_histogram(spark, sf_dir):
    return metrics.score_histogram(B.preds(spark, sf_dir).select("label", F.col("weak").alias("prob_positive"))).withColumn("density", F.round("density", 6))


@query("SELECT label, pred, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM (SELECT label, (prob_positive >= 0.2)::INTEGER AS pred FROM preds) GROUP BY label, pred", B.PREDS)
def a15_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(B.preds(spark, sf_dir), 0.2).withColumn("share", F.round("share", 6))


SWEEP = B.PREDS + """, ws AS (SELECT 0.1::DOUBLE + i * 0.1::DOUBLE AS weight FROM range(10) r(i)), mx AS (SELECT least(weight, 1.0::DOUBLE) AS weight, label, least(weight, 1.0::DOUBLE) * prob_positive + (1 - least(weight, 1.0::DOUBLE)) * weak AS prob FROM preds, ws),
 mg AS (SELECT weight, prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM mx GROUP BY ALL),
 ma AS (SELECT weight, sum(pos * (2 * (n - fp) + neg)) / 2.0 / (any_value(p) * any_value(n)::DOUBLE) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY weight ORDER BY prob DESC) AS fp, sum(pos) OVER (PARTITION BY weight) AS p, sum(neg) OVER (PARTITION BY weight) AS n FROM mg) GROUP BY weight),
 mm AS (SELECT weight, count(*) FILTER (WHERE (prob >= 0.5) = (label = 1)) / count(*) AS accuracy, CASE WHEN count(*) FILTER (WHERE prob >= 0.5 OR label = 1) > 0 THEN 2.0 * count(*) FILTER (WHERE prob >= 0.5 AND label = 1) / (count(*) FILTER (WHERE prob >= 0.5) + count(*) FILTER (WHERE label = 1)) ELSE 0 END AS f1 FROM mx GROUP BY weight)"""


@query("SELECT round(ma.weight, 6) AS weight, round(auc, 6) AS auc, round(accuracy, 6) AS accuracy, round(f1, 6)::DOUBLE AS f1 FROM ma JOIN mm ON ma.weight = mm.weight", SWEEP)
def a16_ensemble_sweep(spark, sf_dir):
    p = B.preds(spark, sf_dir)
    out = metrics.ensemble_sweep(p, p.withColumn("prob_positive", F.col("weak")))
    return out.select(*[F.round(c, 6).alias(c) for c in ("weight", "auc", "accuracy", "f1")])


@query("SELECT round(weight, 6) AS weight, round(auc, 6) AS auc FROM ma ORDER BY ma.auc DESC, ma.weight LIMIT 1", SWEEP)
def a16_best_weight(spark, sf_dir):
    p = B.preds(spark, sf_dir)
    return metrics.best_weight(metrics.ensemble_sweep(p, p.withColumn("prob_positive", F.col("weak")))).select(F.round("weight", 6).alias("weight"), F.round("auc", 6).alias("auc"))


@query("SELECT count(*)::BIGINT AS scanned, count(*) FILTER (WHERE prob_positive >= 0.5 AND label = 0)::BIGINT AS false_positives, count(*) FILTER (WHERE prob_positive < 0.5 AND label = 1)::BIGINT AS false_negatives FROM preds", B.PREDS)
def a17_failure_summary(spark, sf_dir):
    return metrics.failure_summary(B.preds(spark, sf_dir))


@query(
    """SELECT (SELECT count(*) FROM preds)::BIGINT AS total_scanned, (SELECT count(*) FROM a WHERE kind = 'FP')::BIGINT AS false_positives, (SELECT count(*) FROM a WHERE kind = 'FN')::BIGINT AS false_negatives, (SELECT count(*) FROM w)::INTEGER AS failures_saved,
    (SELECT count(*) FROM e)::INTEGER AS correct_saved, (SELECT count(*) FROM e WHERE label = 0)::INTEGER AS correct_real_saved, (SELECT count(*) FROM e WHERE label = 1)::INTEGER AS correct_fake_saved,
    (SELECT md5(string_agg(key || kind || label, ',' ORDER BY key)) FROM w) AS failures_md5, (SELECT string_agg(key, ',' ORDER BY key) FROM e) AS correct_keys""",
    B.PREDS + """, a AS (SELECT key, label, prob_positive, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS kind FROM preds WHERE (prob_positive >= 0.2) <> (label = 1)), w AS (SELECT * FROM a),
 e AS (SELECT key, label FROM (SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY key) AS r FROM preds WHERE (prob_positive >= 0.2) = (label = 1)) WHERE r <= 6)""",
)
def a17_failure_report(spark, sf_dir):
    out = metrics.failure_report(B.preds(spark, sf_dir), 0.2)
    return out.select("summary.*", "failures_md5", F.array_join("correct_examples.key", ",").alias("correct_keys"))


@query("SELECT key, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS kind FROM preds WHERE (prob_positive >= 0.5) <> (label = 1)", B.PREDS)
def l3_failures(spark, sf_dir):
    return metrics.failures(B.preds(spark, sf_dir)).select("key", "kind")


@query("SELECT key, label FROM (SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY key) AS r FROM preds WHERE (prob_positive >= 0.2) = (label = 1)) WHERE r <= 6", B.PREDS)
def l3_correct_examples(spark, sf_dir):
    return metrics.correct_examples(B.preds(spark, sf_dir), 12, 0.2).select("key", "label")


# sequences

CHOSEN = B.DETECTIONS + """, cand AS (SELECT category, video_id, row_number() OVER (PARTITION BY category, video_id ORDER BY pos) AS i, pos, status, k, value, 1 + k % 3 AS m FROM detections),
 boxes AS (SELECT c.*, j, [k + 7 * j, floor(value)::INTEGER % 300, k + 7 * j + 20 + (k + 13 * j) % 40, floor(value)::INTEGER % 300 + 25 + 3 * j] AS box, ((k + j) % 10) / 10.0::DOUBLE AS score FROM cand c, range(3) r(j) WHERE j < m AND status = 'ok'),
 fold AS (SELECT DISTINCT category, video_id, 0::BIGINT AS i, NULL::BIGINT AS pos, NULL::INTEGER[] AS box, NULL::INTEGER[] AS prev FROM cand
 UNION ALL SELECT n.category, n.video_id, n.i, n.pos, n.best, coalesce(n.best, n.prev) FROM (SELECT c.category, c.video_id, c.i, c.pos, f.prev, (SELECT arg_max(b.box, {'v': CASE WHEN f.prev IS NULL THEN 0 ELSE CASE WHEN greatest(0, least(b.box[3], f.prev[3]) - greatest(b.box[1], f.prev[1])) * greatest(0, least(b.box[4], f.prev[4]) - greatest(b.box[2], f.prev[2])) > 0
  THEN (greatest(0, least(b.box[3], f.prev[3]) - greatest(b.box[1], f.prev[1])) * greatest(0, least(b.box[4], f.prev[4]) - greatest(b.box[2], f.prev[2])))::DOUBLE / ((b.box[3] - b.box[1]) * (b.box[4] - b.box[2]) + (f.prev[3] - f.prev[1]) * (f.prev[4] - f.prev[2]) - (greatest(0, least(b.box[3], f.prev[3]) - greatest(b.box[1], f.prev[1])) * greatest(0, least(b.box[4], f.prev[4]) - greatest(b.box[2], f.prev[2])))::DOUBLE) ELSE 0 END * 1000000 END
  + (b.box[3] - b.box[1]) * (b.box[4] - b.box[2]) + 10.0 * b.score, 'j': -b.j}) FROM boxes b WHERE b.category = c.category AND b.video_id = c.video_id AND b.i = c.i) AS best FROM fold f JOIN cand c ON c.category = f.category AND c.video_id = f.video_id AND c.i = f.i + 1) n)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.detections(spark, sf_dir)
    k, v = F.col("k"), F.floor("value").cast("int")
    face = lambda j: F.struct(F.array(k + 7 * j, v % 300, k + 7 * j + 20 + (k + 13 * j) % 40, v % 300 + 25 + 3 * j).alias("bbox"), ((k + j) % 10 / 10).alias("score"), F.lit(None).cast("map<string,array<double>>").alias("landmarks"))
    some = F.when(F.col("status") == "ok", F.slice(F.array(face(0), face(1), face(2)), F.lit(1), 1 + k % 3))
    return d.select("category", "video_id", "pos", some.alias("candidates"))


@query("SELECT video_id, pos, box[1] AS x1, box[4] AS y2 FROM fold WHERE i > 0", "RECURSIVE " + CHOSEN)
def w6_choose_main_face(spark, sf_dir):
    out = detections.choose_main_face(candidates(spark, sf_dir), ["category", "video_id"])
    return out.select("video_id", F.col("pos").cast("long").alias("pos"), F.col("chosen.bbox")[0].alias("x1"), F.col("chosen.bbox")[3].alias("y2"))


OVERLAP = "(greatest(0, least(b.box[3], f.prev[3]) - greatest(b.box[1], f.prev[1])) * greatest(0, least(b.box[4], f.prev[4]) - greatest(b.box[2], f.prev[2])))::DOUBLE"
RESOLVED = INTERPOLATED + f""", own AS (SELECT p.category, p.video_id, p.pos, p.k, p.value, p.event_type, i.source, i.status, CASE WHEN source = 'interpolated' THEN list_transform(range(1, 5), lambda x: round_even((1 - t) * a.bbox[x] + t * b.bbox[x], 0)::INTEGER) ELSE i.bbox END AS known
 FROM positioned p JOIN i ON i.video_id = p.video_id AND i.pos = p.pos), faces AS (SELECT category, video_id, pos, j, [k + 5 * j, floor(value)::INTEGER % 200, k + 5 * j + 30 + (k + 11 * j) % 50, floor(value)::INTEGER % 200 + 35 + 2 * j] AS box, ((k + j) % 7) / 7.0::DOUBLE AS score
 FROM own, range(3) r(j) WHERE status IS NULL AND source IS NULL AND event_type <> 'view' AND j < 1 + k % 3),
 walk AS (SELECT DISTINCT category, video_id, -1::BIGINT AS pos, NULL::INTEGER[] AS box, NULL::INTEGER[] AS prev FROM own
 UNION ALL SELECT n.category, n.video_id, n.pos, n.best, coalesce(n.best, n.prev) FROM (SELECT c.category, c.video_id, c.pos, f.prev, coalesce(c.known, (SELECT arg_max(b.box, {{'v': CASE WHEN f.prev IS NOT NULL AND {OVERLAP} > 0 THEN {OVERLAP} / ((b.box[3] - b.box[1]) * (b.box[4] - b.box[2]) + (f.prev[3] - f.prev[1]) * (f.prev[4] - f.prev[2]) - {OVERLAP}) ELSE 0 END * 1000000
  + (b.box[3] - b.box[1]) * (b.box[4] - b.box[2]) + 10.0 * b.score, 'j': -b.j}}) FROM faces b WHERE b.category = c.category AND b.video_id = c.video_id AND b.pos = c.pos)) AS best FROM walk f JOIN own c ON c.category = f.category AND c.video_id = f.video_id AND c.pos = f.pos + 1) n)"""


@query(
    """SELECT o.video_id, o.pos, CASE WHEN o.source IS NOT NULL THEN o.source WHEN w.box IS NOT NULL THEN 'detected' END AS source, CASE WHEN w.box IS NOT NULL THEN 'ok' ELSE coalesce(o.status, 'no_face') END AS status, array_to_string(w.box, ',') AS bbox,
    CASE WHEN o.source IS NULL AND o.status IS NULL AND w.box IS NOT NULL THEN 1 + o.k % 3 END::INTEGER AS faces_now FROM own o JOIN walk w ON w.category = o.category AND w.video_id = o.video_id AND w.pos = o.pos""",
    "RECURSIVE " + RESOLVED,
)
def w6_second_pass(spark, sf_dir):
    """Frames outside good keyframes get a detection of their own, chosen by the last box before them."""
    by = ["category", "video_id"]
    found = detections.interpolate_detections(B.positioned(spark, sf_dir), B.detections(spark, sf_dir), by)
    k, v = F.col("k"), F.floor("value").cast("int")
    face = lambda j: F.struct(F.array(k + 5 * j, v % 200, k + 5 * j + 30 + (k + 11 * j) % 50, v % 200 + 35 + 2 * j).alias("bbox"), ((k + j) % 7 / 7).alias("score"), F.lit(None).cast("map<string,array<double>>").alias("landmarks"))
    some = F.when(F.col("event_type") != "view", F.slice(F.array(face(0), face(1), face(2)), F.lit(1), 1 + k % 3))
    asked = found.filter("status is null").select(*by, "pos", some.alias("candidates"))
    before = found.select(*by, "pos", F.col("status").alias("_before"))
    out = detections.second_pass(found, asked, by).join(before, [*by, "pos"])
    now = F.when(F.col("_before").isNull() & (F.col("status") == "ok"), F.col("num_faces").cast("int"))
    return out.select("video_id", F.col("pos").cast("long").alias("pos"), "source", "status", F.concat_ws(",", F.col("bbox").cast("array<string>")).alias("bbox"), now.alias("faces_now")).withColumn("bbox", F.nullif("bbox", F.lit("")))


@query("SELECT video_id, pos, status FROM detections", B.DETECTIONS)
def w5_keyframes(spark, sf_dir):
    return B.detections(spark, sf_dir).select("video_id", F.col("pos").cast("long").alias("pos"), "status")


WINDOWS = B.KEPT + """, o AS (SELECT *, row_number() OVER w - 1 AS clip_start, array_agg(frame_number) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS nums, array_agg(original_frame_index) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS idx
 FROM kept WINDOW w AS (PARTITION BY category, video_id ORDER BY frame_number, original_frame_index, key)),
 clips AS (SELECT *, row_number() OVER (PARTITION BY category, video_id ORDER BY clip_start) - 1 AS clip_id FROM o WHERE clip_start % 6 = 0 AND len(nums) = 8 AND nums[8] - nums[1] = 7)"""


@query(
    """SELECT category, video_id, video_id || '/clip_' || lpad(clip_id::VARCHAR, 6, '0') AS key, clip_id::INTEGER AS clip_id, clip_start::INTEGER AS clip_start, binary_label, CASE WHEN binary_label = 1 THEN 'fake' ELSE 'real' END AS label,
    array_to_string(nums, ',') AS frame_numbers, array_to_string(idx, ',') AS original_frame_indices, 4 AS default_center_index FROM clips""",
    WINDOWS,
)
def w7_build_clips(spark, sf_dir):
    out = clips.build_clips(B.kept_frames(spark, sf_dir), ["category", "video_id"])
    joined = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return out.select("category", "video_id", "key", "clip_id", "clip_start", "binary_label", "label", joined("frame_numbers"), joined("original_frame_indices"), "default_center_index")


@query(
    """SELECT video_id || '/clip_' || lpad(clip_id::VARCHAR, 6, '0') AS key, lower('TRAIN') AS split, category, video_id, 'v' || video_id AS video_name, binary_label, CASE WHEN binary_label = 1 THEN 'fake' ELSE 'real' END AS label, 8 AS clip_length, 1 AS frame_stride, 6 AS clip_stride,
    clip_start::INTEGER AS clip_start, 7 AS num_differences, array_to_string(nums, ',') AS frame_numbers, array_to_string(idx, ',') AS original_frame_indices, array_to_string(list_transform(nums, lambda x: x::VARCHAR || '.0'), ',') AS timestamps,
    array_to_string(list_transform(nums, lambda x: category || '/' || video_id || '/' || x), ',') AS source_keys, '2,3,4,5' AS center_candidate_indices, 4 AS default_center_index, 5.0::DOUBLE AS extraction_fps, 25.0::DOUBLE AS video_fps,
    240 + k AS height, 320 AS width, 'uint8' AS rgb_dtype, 'uint8' AS diff_dtype FROM clips""",
    WINDOWS,
)
def p17_clip_documents(spark, sf_dir):
    """Clips' whole metadata written as JSON and read again."""
    more = {"split": F.lit("train"), "video_name": F.concat(F.lit("v"), F.col("video_id")), "extraction_fps": F.lit(5.0), "video_fps": F.lit(25.0), "height": 240 + F.col("k"), "width": F.lit(320)}
    made = clips.build_clips(B.kept_frames(spark, sf_dir).withColumns(more), ["category", "video_id"], carry=tuple(more))
    back = samples.clip_json(made).select(samples.parse_sample_json("json").alias("d")).select("d.*").drop("spatial_sampling_note")
    lists = ("frame_numbers", "original_frame_indices", "timestamps", "source_keys", "center_candidate_indices")
    return back.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})


@query(
    """SELECT 'cat' || (video_id::BIGINT % 5) || '/' || video_id || '/' || pos AS key, video_id, pos::VARCHAR AS frame_number, source AS bbox_source, CASE WHEN source = 'interpolated' THEN round_even((1 - t) * a.bbox[1] + t * b.bbox[1], 0)::INTEGER ELSE bbox[1] END AS bbox_x1,
    CASE WHEN source = 'interpolated' THEN greatest(a.num_faces, b.num_faces) ELSE num_faces END::INTEGER AS num_faces, 1.3::DOUBLE AS crop_scale, 5 AS detect_every_k, '224,224' AS aligned_size, '' AS label FROM i WHERE source IS NOT NULL""",
    INTERPOLATED,
)
def p17_crop_documents(spark, sf_dir):
    """Frame crops' whole metadata written as JSON and read again."""
    found = detections.interpolate_detections(B.positioned(spark, sf_dir), B.detections(spark, sf_dir), ["category", "video_id"]).filter("status = 'ok'")
    cropped = detections.with_crop(found.withColumns({"height": F.lit(480), "width": F.lit(640)}))
    written = samples.crop_json(cropped, 1.3, 5, ".jpg", (224, 224))
    back = written.select(samples.parse_sample_json("json", samples.CROP_FIELDS).alias("d")).select("d.*")
    return back.select("key", "video_id", "frame_number", "bbox_source", "bbox_x1", "num_faces", "crop_scale", "detect_every_k", F.array_join(F.col("aligned_size").cast("array<string>"), ",").alias("aligned_size"), "label")


DUPLICATES = """f AS (SELECT l_orderkey AS video_id, l_linenumber AS frame_number, l_partkey AS original_frame_index, l_suppkey || '/' || l_extendedprice || '/' || l_quantity || '/' || strftime(l_shipdate, '%Y%m%d') AS key FROM lineitem),
 o AS (SELECT video_id, row_number() OVER w - 1 AS clip_start, array_agg(frame_number) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS nums FROM f WINDOW w AS (PARTITION BY video_id ORDER BY frame_number, original_frame_index, key))"""


@query("SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY clip_start) - 1)::INTEGER AS clip_id, clip_start::INTEGER AS clip_start, nums[1]::BIGINT AS first FROM o WHERE clip_start % 2 = 0 AND len(nums) = 3 AND nums[2] - nums[1] = 1 AND nums[3] - nums[2] = 1", DUPLICATES)
def w7_build_clips_with_repeats(spark, sf_dir):
    key = F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("string"), F.col("l_quantity").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))
    f = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("frame_number"), F.col("l_partkey").alias("original_frame_index"), key.alias("key"), F.lit(0.0).alias("timestamp"), F.lit(0).alias("binary_label"))
    return clips.build_clips(f, ["video_id"], clip_len=3, clip_stride=2).select("video_id", "clip_id", "clip_start", F.col("frame_numbers")[0].alias("first"))


@query(
    """SELECT category, sum(n)::BIGINT AS frames, count(*)::BIGINT AS videos, coalesce(sum(c), 0)::BIGINT AS clips, count(*) FILTER (WHERE c IS NULL)::BIGINT AS videos_without_clips
    FROM (SELECT category, video_id, count(*) AS n FROM kept GROUP BY ALL) a LEFT JOIN (SELECT category AS cc, video_id AS vv, count(*) AS c FROM clips GROUP BY ALL) b ON category = cc AND video_id = vv GROUP BY category""",
    WINDOWS,
)
def a19_clip_build_stats(spark, sf_dir):
    f = B.kept_frames(spark, sf_dir)
    by = ["category", "video_id"]
    return clips.clip_build_stats(f, clips.build_clips(f, by), by, "category")


DIFFS = B.PIXELS + ", d AS (SELECT video_id, frame_number, pixels, lag(pixels) OVER (PARTITION BY video_id ORDER BY frame_number) AS before FROM pixels), m AS (SELECT video_id, frame_number, list_transform(range(1, 65), lambda i: abs(pixels[i] - before[i])) AS difference, before IS NULL AS first FROM d)"


@query("SELECT video_id, frame_number, CASE WHEN first THEN NULL ELSE list_sum(difference)::BIGINT END AS total, CASE WHEN first THEN NULL ELSE difference[64]::INTEGER END AS last FROM m", DIFFS)
def w8_frame_difference(spark, sf_dir):
    out = pixels.frame_difference(B.pixels(spark, sf_dir), ["video_id"], ["frame_number"])
    return out.select("video_id", "frame_number", F.aggregate("difference", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("difference")[63].alias("last"))


@query("SELECT video_id, frame_number, round(motion, 6) AS motion, round(CASE WHEN max(motion) OVER (PARTITION BY video_id) > 0 THEN motion / max(motion) OVER (PARTITION BY video_id) ELSE 0 END, 6) AS motion_scaled FROM (SELECT video_id, frame_number, CASE WHEN first THEN 0 ELSE list_sum(difference) / 64.0::DOUBLE END AS motion FROM m)", DIFFS)
def w9_motion_magnitude(spark, sf_dir):
    out = pixels.motion_magnitude(pixels.frame_difference(B.pixels(spark, sf_dir), ["video_id"], ["frame_number"]), ["video_id"])
    return out.select("video_id", "frame_number", F.round("motion", 6).alias("motion"), F.round("motion_scaled", 6).alias("motion_scaled"))


@query(
    """SELECT run, epoch, round(best, 6) AS best, is_new_best, (epoch - coalesce(max(CASE WHEN is_new_best THEN epoch END) OVER w, 0))::BIGINT AS since_best FROM (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch) AS best,
    coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), metric IS NOT NULL) AS is_new_best FROM history) WINDOW w AS (PARTITION BY run ORDER BY epoch)""",
    B.HISTORY,
)
def w10_monitor_runs(spark, sf_dir):
    return history.monitor_runs(B.history(spark, sf_dir)).select("run", "epoch", F.round("best", 6).alias("best"), "is_new_best", "since_best")


@query("SELECT run, epoch AS best_epoch, round(metric, 6) AS best_metric FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS r FROM history WHERE metric IS NOT NULL) WHERE r = 1", B.HISTORY)
def w10_best_epochs(spark, sf_dir):
    return history.best_epochs(B.history(spark, sf_dir)).select("run", "best_epoch", F.round("best_metric", 6).alias("best_metric"))


@query("SELECT category, video_id, key FROM (SELECT *, row_number() OVER (PARTITION BY category, video_id ORDER BY frame_number) AS r FROM kept) WHERE r = 1", B.KEPT)
def w11_first_per_group(spark, sf_dir):
    return reports.first_per_group(B.kept_frames(spark, sf_dir), ["category", "video_id"], ["frame_number"]).select("category", "video_id", "key")


# order, limits, sets


@query("SELECT category, video_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY video_id) AS r FROM videos) WHERE r <= 4", B.VIDEOS)
def l2_cap_per_category(spark, sf_dir):
    return reports.cap_per_category(B.videos(spark, sf_dir), 4, ["video_id"]).select("category", "video_id")


@query("SELECT key FROM frames WHERE event_type = 'error' ORDER BY key LIMIT 20", B.FRAMES)
def l4_first_n_missing(spark, sf_dir):
    return reports.first_n_missing(B.frames(spark, sf_dir).filter("event_type = 'error'").select("key"))


SHUFFLED = B.FRAMES + ", sh AS (SELECT key, row_number() OVER (ORDER BY md5('42|3|' || key), key) - 1 AS rank FROM frames)"


@query("SELECT key, rank::BIGINT AS rank FROM sh", SHUFFLED)
def l5_seeded_shuffle(spark, sf_dir):
    """The permutation of an epoch, as ranks from counted ranges."""
    return pixels.shuffle_ranks(B.frames(spark, sf_dir).select("key"), seed=42, epoch=3)


@query("SELECT key, r::BIGINT AS r FROM (SELECT key, row_number() OVER (ORDER BY rank) - 1 AS r FROM sh)", SHUFFLED)
def l5_shuffled_order(spark, sf_dir):
    """Rows in the order of the permutation, numbered as they stand."""
    rows = pixels.seeded_shuffle(B.frames(spark, sf_dir).select("key"), seed=42, epoch=3)
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    counts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    own = placed.withColumn("part", F.shiftright("at", 33)).join(before, "part")
    return own.select("key", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("r"))


@query("SELECT (rank // 32)::BIGINT AS batch, string_agg(key, ',' ORDER BY rank) AS keys FROM sh WHERE rank >= 5 * 32 GROUP BY 1 HAVING count(*) = 32", SHUFFLED)
def x6_resumed_batches(spark, sf_dir):
    """Batches over all shards, taken up again at the sixth of an epoch."""
    out = pixels.shuffled_batches(B.frames(spark, sf_dir), 32, seed=42, epoch=3, first=5, drop_last=True)
    return out.select("batch", F.array_join("keys", ",").alias("keys"))


@query(
    """SELECT 'done' AS keys, count(*)::BIGINT AS n FROM frames WHERE event_id % 3 = 0 OR event_id % 7 = 0 UNION ALL SELECT 'done_and_known', count(*)::BIGINT FROM frames WHERE (event_id % 3 = 0 OR event_id % 7 = 0) AND event_type <> 'error'
    UNION ALL SELECT 'not_done', count(*)::BIGINT FROM frames WHERE event_id % 3 <> 0 AND event_id % 7 <> 0 AND event_type <> 'error' UNION ALL SELECT 'not_known', count(*)::BIGINT FROM frames WHERE (event_id % 3 = 0 OR event_id % 7 = 0) AND event_type = 'error'""",
    B.FRAMES,
)
def l6_key_algebra(spark, sf_dir):
    f = B.frames(spark, sf_dir)
    return resume.key_algebra(f.filter("event_id % 3 = 0"), f.filter("event_id % 7 = 0"), B.kept_frames(spark, sf_dir))


# arrays and pixels


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.images(spark, sf_dir)
    made = clips.build_clips(own, ["video_id"], clip_len=4, clip_stride=3)
    return pixels.stack_clips(made, own)


PIXEL_CLIPS = B.PIXELS + """, g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS n FROM pixels),
 pc AS (SELECT video_id, n AS s, video_id || '/clip_' || lpad((n // 3)::VARCHAR, 6, '0') AS key, array_agg(pixels) OVER (PARTITION BY video_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS px FROM g),
 st AS (SELECT key, px FROM pc WHERE s % 3 = 0 AND len(px) = 4)"""


@query(
    """SELECT key, 4 AS length, md5(string_agg(hex_frame, '' ORDER BY t)) AS rgb_md5, md5(string_agg(hex_change, '' ORDER BY t)) AS diff_md5 FROM (SELECT key, t, repeat(array_to_string(list_transform(px[t], lambda p: lpad(printf('%X', p), 2, '0')), ''), 3) AS hex_frame,
    CASE WHEN t > 1 THEN repeat(array_to_string(list_transform(range(1, 65), lambda i: lpad(printf('%X', abs(px[t][i] - px[t - 1][i])), 2, '0')), ''), 3) END AS hex_change FROM st, range(1, 5) r(t)) GROUP BY key""",
    PIXEL_CLIPS,
)
def x1_stack_clips(spark, sf_dir):
    return _stacked(spark, sf_dir).select("key", "length", F.md5(F.hex("rgb")).alias("rgb_md5"), F.md5(F.hex("diff")).alias("diff_md5"))


@query("SELECT key, CASE WHEN substr(key, -1) = '1' THEN 'rgb size' WHEN substr(key, -1) = '2' THEN 'missing diff' END AS error FROM st", PIXEL_CLIPS)
def x2_validate_clips(spark, sf_dir):
    end = F.substring("key", -1, 1)
    damaged = _stacked(spark, sf_dir).withColumns({"rgb": F.when(end == "1", F.substring("rgb", 1, 5)).otherwise(F.col("rgb")), "diff": F.when(end != "2", F.col("diff"))})
    return pixels.validate_clips(damaged, 4).select("key", "error")


INDICES = "CASE k % 4 WHEN 0 THEN [2, 3, 4, 5] WHEN 1 THEN [-1, 9, 6] WHEN 2 THEN []::INTEGER[] ELSE [8, 9] END"
DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


def _indices() -> F.Column:
    """Candidate lists of several kinds: good, partly outside, empty, all outside."""
    k = F.col("k") % 4
    return F.when(k == 0, F.array(*map(F.lit, (2, 3, 4, 5)))).when(k == 1, F.array(*map(F.lit, (-1, 9, 6)))).when(k == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(8), F.lit(9)))


@query(
    "SELECT event_id, CASE WHEN k % 10 < 8 THEN k % 10 WHEN k % 4 = 1 THEN 6 ELSE 4 END::INTEGER AS spatial_index, CASE WHEN k % 10 < 3 THEN k % 10 WHEN k % 4 = 0 THEN 2 ELSE 2 END::INTEGER AS of_three, CASE WHEN k % 10 < 2 THEN k % 10 ELSE 1 END::INTEGER AS of_two FROM frames",
    B.FRAMES,
)
def x3_choose_spatial_index(spark, sf_dir):
    """Candidates that don't fit the clip give way to the usual ones, and those to the clip's middle."""
    default = F.col("k") % 10
    return B.frames(spark, sf_dir).select("event_id", *[clips.choose_spatial_index(_indices(), default, F.lit(n)).alias(c) for n, c in ((8, "spatial_index"), (3, "of_three"), (2, "of_two"))])


@query(f"SELECT event_id, CASE WHEN k % 4 = 1 THEN 6 ELSE 2 + {DRAW.format("key || '|1|2'")} % 4 END::INTEGER AS spatial_index FROM frames", B.FRAMES)
def x3_choose_spatial_index_training(spark, sf_dir):
    """Hash-seeded choice among the candidates."""
    return B.frames(spark, sf_dir).select("event_id", clips.choose_spatial_index(_indices(), F.lit(4), F.lit(8), training=True, seed=1, epoch=2).alias("spatial_index"))


def _whole_numbers(df: DataFrame) -> DataFrame:
    """key, the spatial frame's pixels and the temporal differences as whole numbers again, joined by commas."""

    def run(batches):
        for rows in batches:
            spatial = [np.frombuffer(x, "<f4").reshape(3, -1) * pixels.STD[:, None] + pixels.MEAN[:, None] for x in rows["spatial"]]
            whole = lambda x: ",".join(map(str, np.rint(x.ravel() * 255).astype(int).tolist()))
            yield pd.DataFrame({"key": rows["key"], "spatial": [whole(x) for x in spatial], "temporal": [whole(np.frombuffer(x, "<f4")) for x in rows["temporal"]]})

    return df.mapInPandas(run, "key string, spatial string, temporal string")


AUGMENTED = PIXEL_CLIPS + f""", dr AS (SELECT key, px, {DRAW.format("key || '|1|0|0'")} / 4294967296.0::DOUBLE < 0.5 AS flip, 0.8::DOUBLE + 0.4::DOUBLE * ({DRAW.format("key || '|1|0|1'")} / 4294967296.0::DOUBLE) AS contrast, ({DRAW.format("key || '|1|0|2'")} / 4294967296.0::DOUBLE - 0.5) * 40.0::DOUBLE AS brightness FROM st),
 mi AS (SELECT key, contrast, brightness, list_transform(px, lambda f: list_transform(range(64), lambda i: f[CASE WHEN flip THEN (i // 8) * 8 + 7 - i % 8 ELSE i END + 1])) AS px FROM dr),
 au AS (SELECT key, list_transform(px, lambda f: list_transform(f, lambda p: round_even(least(greatest((p - list_sum(f) / 64.0::DOUBLE) * contrast + list_sum(f) / 64.0::DOUBLE + brightness, 0), 255), 0)::INTEGER)) AS px FROM mi)"""
FLAT = """SELECT key, array_to_string(list_concat(px[3], px[3], px[3]), ',') AS spatial, array_to_string(flatten(list_transform(range(1, 4), lambda t: flatten(list_transform(range(3), lambda c: list_transform(range(1, 65), lambda i: abs(px[t + 1][i] - px[t][i])))))), ',') AS temporal FROM """


@query(FLAT + "au", AUGMENTED)
def x4_augment_clips(spark, sf_dir):
    """One mirroring, contrast and brightness for a whole clip, and the differences taken again."""
    return _whole_numbers(pixels.prepare_clips(_stacked(spark, sf_dir).withColumn("spatial_index", F.lit(2)), training=True, seed=1))


@query(FLAT + "st", PIXEL_CLIPS)
def x5_normalize(spark, sf_dir):
    """The normalised floats turn into the same pixels again."""
    return _whole_numbers(pixels.prepare_clips(_stacked(spark, sf_dir).withColumn("spatial_index", F.lit(2))))


@query("SELECT category AS shard, b::BIGINT AS batch, array_to_string(list_sort(array_agg(key)), ',') AS keys FROM (SELECT category, key, (row_number() OVER (PARTITION BY category ORDER BY key) - 1) // 32 AS b FROM frames) GROUP BY category, b HAVING count(*) = 32", B.FRAMES)
def x6_batch_samples(spark, sf_dir):
    own = B.frames(spark, sf_dir).select(F.col("category").alias("shard"), "key")
    return pixels.batch_samples(own, 32, drop_last=True).select("shard", "batch", F.array_join("keys", ",").alias("keys"))


#: The crop box of `x7` is columns 0 to 6 and rows 1 to 7 of each image.
CROPPED = B.PIXELS + """, g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - 1 AS n FROM pixels), spot AS (SELECT i, greatest(least((i + 0.5) * 7 / 4.0::DOUBLE - 0.5, 6), 0) AS v FROM range(4) r(i)),
 co AS (SELECT key, n % 5 <> 0 AS ok, a.i AS i, b.i AS j, a.v - floor(a.v) AS fy, b.v - floor(b.v) AS fx, pixels[((1 + floor(a.v)) * 8 + floor(b.v) + 1)::INTEGER]::DOUBLE AS p, pixels[((1 + floor(a.v)) * 8 + least(floor(b.v) + 1, 6) + 1)::INTEGER]::DOUBLE AS q,
 pixels[((1 + least(floor(a.v) + 1, 6)) * 8 + floor(b.v) + 1)::INTEGER]::DOUBLE AS r, pixels[((1 + least(floor(a.v) + 1, 6)) * 8 + least(floor(b.v) + 1, 6) + 1)::INTEGER]::DOUBLE AS s FROM g, spot a, spot b)"""


@query(
    "SELECT key, CASE WHEN any_value(ok) THEN 'ok' ELSE 'crop_fail' END AS status, CASE WHEN any_value(ok) THEN string_agg(repeat(lpad(printf('%X', round_even((p * (1 - fx) + q * fx) * (1 - fy) + (r * (1 - fx) + s * fx) * fy, 0)::INTEGER), 2, '0'), 3), '' ORDER BY i, j) END AS crop FROM co GROUP BY key",
    CROPPED,
)
def x7_crop_pixels(spark, sf_dir):
    from framelake.functions.geometry import square_crop_box

    box = F.array(F.lit(1), F.lit(2), F.lit(5), F.lit(7))
    own = B.images(spark, sf_dir).withColumn("crop_box", F.when(F.col("frame_number") % 5 != 0, square_crop_box(box, F.col("height"), F.col("width"), 1.3)))
    return pixels.crop_pixels(own, 4, 4).select("key", "status", F.hex("crop").alias("crop"))


@query("SELECT event_id, value IS NOT NULL AS has_value, category || '|' || video_id || '|val' AS video_key FROM frames", B.FRAMES)
def p6_video_key(spark, sf_dir):
    return B.frames(spark, sf_dir).select("event_id", F.col("value").isNotNull().alias("has_value"), text.video_key("category", "video_id", F.lit("val")).alias("video_key"))


# one long video: all events in order of their number


def one_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    return e.select(F.lit("all").alias("video_id"), F.col("event_id").alias("frame_number"), F.col("event_id").alias("original_frame_index"), F.col("event_id").cast("string").alias("key"), F.lit(0.0).alias("timestamp"), F.lit(0).alias("binary_label"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    """SELECT (row_number() OVER (ORDER BY clip_start) - 1)::INTEGER AS clip_id, clip_start::BIGINT AS clip_start, array_to_string(nums, ',') AS frame_numbers FROM (SELECT row_number() OVER w - 1 AS clip_start, array_agg(event_id) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS nums
    FROM events WHERE event_type <> 'error' WINDOW w AS (ORDER BY event_id)) WHERE clip_start % 6 = 0 AND len(nums) = 8 AND nums[8] - nums[1] = 7"""
)
def w7_one_long_video(spark, sf_dir):
    """Its windows run over stretches in many tasks."""
    own = one_video(spark, sf_dir).filter("event_type <> 'error'")
    return clips.build_clips(own, ["video_id"], stretch=500).select("clip_id", "clip_start", F.concat_ws(",", F.col("frame_numbers").cast("array<string>")).alias("frame_numbers"))


@query(
    """SELECT pos, CASE WHEN NOT key_frame AND a IS NOT NULL AND b IS NOT NULL THEN 'interpolated' WHEN ok THEN 'detected' END AS source, CASE WHEN ok THEN x ELSE CASE WHEN NOT key_frame THEN round_even((1 - (pos - a.pos) / (b.pos - a.pos)::DOUBLE) * a.x + (pos - a.pos) / (b.pos - a.pos)::DOUBLE * b.x, 0)::INTEGER END END AS x1,
    CASE WHEN ok THEN n ELSE CASE WHEN NOT key_frame AND a IS NOT NULL AND b IS NOT NULL THEN greatest(a.n, b.n) END END::INTEGER AS num_faces FROM n""",
    """p AS (SELECT event_type, floor(value)::INTEGER % 300 AS x, 1 + floor(value)::INTEGER % 3 AS n, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS total FROM events),
 k AS (SELECT *, pos % 5 = 0 OR pos = total - 1 AS key_frame, (pos % 5 = 0 OR pos = total - 1) AND event_type NOT IN ('error', 'view') AS ok FROM p),
 r AS (SELECT *, CASE WHEN ok THEN {'pos': pos, 'x': x, 'n': n} END AS rec FROM k),
 n AS (SELECT *, last_value(rec IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(rec IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM r)""",
)
def j5_one_long_video(spark, sf_dir):
    """Positions by a range sort; keyframes before and after from the stretch or from summaries of others."""
    placed = stretches.with_position(one_video(spark, sf_dir), ["video_id"], ["frame_number"])
    x, n = F.floor("value").cast("int") % 300, 1 + F.floor("value").cast("int") % 3
    ok = ~F.col("event_type").isin("error", "view")
    found = detections.keyframes(placed).select("video_id", "pos", F.when(ok, "ok").otherwise("no_face").alias("status"), F.when(ok, n).alias("num_faces"), F.when(ok, 0.5).alias("confidence"), F.when(ok, F.array(x, F.lit(0), x + 9, F.lit(9))).alias("bbox"), F.lit(None).cast("map<string,array<double>>").alias("landmarks"))
    out = detections.interpolate_detections(placed, found, ["video_id"], stretch=500)
    return out.select(F.col("pos").cast("long").alias("pos"), "source", F.col("bbox")[0].alias("x1"), F.col("num_faces").cast("int").alias("num_faces"))


@query("SELECT event_id AS frame_number, round(abs(value - lag(value) OVER (ORDER BY event_id)), 6) AS difference FROM events")
def w8_one_long_video(spark, sf_dir):
    own = one_video(spark, sf_dir).select("video_id", "frame_number", F.array("value").alias("pixels"))
    return pixels.frame_difference(own, ["video_id"], ["frame_number"], stretch=500).select("frame_number", F.round(F.col("difference")[0], 6).alias("difference"))
