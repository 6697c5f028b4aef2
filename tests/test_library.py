"""Small frames with known answers for the reference operators."""

from __future__ import annotations

import io
import math
import os
import random
import tarfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.functions import geometry, scores, text
from framelake.operators import clips, detections, history, metrics, pixels, reports, resume, sampling, splits, user
from framelake.sources import images, shards, tables
from framelake.streaming import streams

KEY = ["category", "video_id"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# functions


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, geometry.lerp_bbox(box(0, 0, 10, 10), box(10, 10, 20, 20), F.lit(0.5))) == [5, 5, 15, 15]
    assert one(spark, geometry.bbox_iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, geometry.bbox_iou(F.lit(None).cast("array<int>"), box(5, 0, 15, 10))) == 0
    assert one(spark, geometry.clip_bbox(box(-5, 2, 400, 9), F.lit(64), F.lit(64))) == [0, 2, 63, 9]
    assert one(spark, geometry.clip_bbox(box(70, 2, 400, 9), F.lit(64), F.lit(64))) is None
    x1, y1, x2, y2 = one(spark, geometry.square_crop_box(box(10, 10, 30, 40), F.lit(64), F.lit(64), 1.3))
    assert x2 - x1 == y2 - y1 and 0 <= x1 < x2 <= 64
    assert one(spark, geometry.square_crop_box(box(10, 10, 10, 40), F.lit(64), F.lit(64))) is None


def test_names_and_labels(spark):
    rows = [("original", "124", None, "a/b_frame_00012.jpg"), ("Deepfakes", "1_2", "x\\y", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "category string, video_id string, video_name string, frame_path string")
    got = df.select(text.canonical_video_id("category", "video_name", "video_id").alias("c"), text.group_key("category", "video_name", "video_id", "frame_path").alias("g"), text.parse_frame_filename("frame_path").alias("p"), text.split_group_key("category", "video_id").alias("s")).collect()
    assert [r.c for r in got] == ["124", "1_2", "unknown_video"]
    assert [r.g for r in got] == ["original/124", "Deepfakes/x\\y", "unknown_video"]
    assert got[0].p == ("b", 12) and got[1].p is None and [r.s for r in got[:2]] == ["124", "1_2"]
    label = lambda *a, **k: one(spark, text.resolve_label(*[F.lit(x).cast("string") for x in a], **k))
    assert [label("1", "0", "real"), label(None, "0", "fake"), label(None, "7", " Fake"), label(None, None, None), label(None, "1", None, invert=True)] == [1, 0, 1, -1, 0]
    with pytest.raises(Exception, match="no label"):
        label(None, None, "?", strict=True)
    # a bad class part is not mended by other fields; only "0" and "1" are numeric labels
    assert [label("2", "1", "fake"), label(" 1 ", None, None), label("x", "0", "real"), label(None, " 1", "real"), label(None, "01", "fake"), label(None, None, "1"), label(None, None, "real", polarity="real")] == [-1, 1, -1, 0, 1, -1, 1]
    for bad in ("2", "x", ""):
        with pytest.raises(Exception, match="no label"):
            label(bad, "1", "fake", strict=True)
    assert {c: one(spark, text.category_label(F.lit(c))) for c in ("original", "YouTube-real", "Celeb-real", "FaceSwap", "DeepFakeDetection", "x")} == {"original": 1, "YouTube-real": 1, "Celeb-real": 1, "FaceSwap": 0, "DeepFakeDetection": None, "x": None}
    assert [one(spark, text.crop_label(F.lit(a), F.lit(b))) for a, b in (("Fake ", "0"), ("", "0"), (None, "1"), ("other", "1"))] == [1, 0, 1, -1]
    assert [one(spark, text.clip_label(F.lit(a), F.lit(b))) for a, b in ((" 1", "real"), ("7", "Original"), (None, None))] == [1, 0, -1]
    assert one(spark, text.safe_int(F.lit("3.7"), 9)) == 9 and one(spark, text.safe_int_trunc(F.lit("3.7"))) == 3


def test_candidates_and_losses(spark):
    assert scores.center_candidates(8) == [2, 3, 4, 5] and scores.center_candidates(4) == [1, 2, 3]
    assert one(spark, scores.warmup_factor(F.lit(1), 4)) == 0.5
    loss = one(spark, scores.bce_loss(F.lit(0.3), F.lit(1)))
    p = 1 / (1 + math.exp(-0.3))
    assert loss == pytest.approx(-0.95 * math.log(p) - 0.05 * math.log(1 - p))


# splits and sampling


def greedy(rows, ratios):
    import hashlib
    from collections import Counter

    out = {}
    for category in {c for c, _ in rows}:
        weights = Counter(g for c, g in rows if c == category)
        total, counts = sum(weights.values()), dict.fromkeys(ratios, 0)
        names = list(ratios)
        for g, w in sorted(weights.items(), key=lambda x: (-x[1], hashlib.md5(x[0].encode()).hexdigest())):
            best = max(names, key=lambda n: (total * ratios[n] - counts[n], -names.index(n)))
            out[category, g] = best
            counts[best] += w
    return out


@pytest.mark.parametrize("ratios", [splits.THREE_WAY, splits.TWO_WAY])
def test_splits_follow_the_loop(spark, ratios):
    r = random.Random(3)
    rows = [(f"c{r.randrange(3)}", f"g{int(r.expovariate(0.05))}") for _ in range(900)] + [("d", f"x{k}") for k in range(10)]
    df = spark.createDataFrame(rows, "category string, split_group string")
    got = {(x.category, x.split_group): x.split for x in splits.assign_group_splits(df, ratios).collect()}
    assert got == greedy(rows, ratios)
    if ratios is splits.THREE_WAY:
        assert sorted(s for (c, _), s in got.items() if c == "d") == ["test", "train", "train", "train", "train", "train", "train", "train", "train", "val"]


def test_phases_follow_the_loop():
    """Runs of equal weights against one pick after the other, with ties and far apart deficits."""
    r = random.Random(4)
    for _ in range(3000):
        ratios = r.choice([[0.8, 0.1, 0.1], [0.9, 0.1], [1.0], [0.25] * 4, [0.5, 0.3, 0.2]])
        runs = [(w, r.randint(1, 40)) for w in sorted(r.sample(range(1, 12), r.randint(1, 4)), reverse=True)]
        total = sum(w * n for w, n in runs)
        targets, counts, want = [total * x for x in ratios], [0] * len(ratios), [0] * len(ratios)
        for weight, n in runs:
            found = splits.phases(targets, counts, weight, n)
            assert len(found) <= len(ratios) and found[0][0] == 1
            for rank in range(1, n + 1):
                best = max(range(len(ratios)), key=lambda s: (targets[s] - want[s], -s))
                want[best] += weight
                first, turn = [p for p in found if p[0] <= rank][-1]
                assert turn[(rank - first) % len(turn)] == best
            assert counts == want


def test_many_groups_of_one_weight(spark):
    """A million groups of one category and weight: a few phases, no stretch for each of them."""
    import time

    df = spark.range(1_000_000).select(F.lit("c").alias("category"), F.concat(F.lit("g"), "id").alias("split_group"))
    began = time.perf_counter()
    shares = {r.split: r["count"] for r in splits.assign_group_splits(df).groupBy("split").count().collect()}
    assert shares == {"train": 800_000, "val": 100_000, "test": 100_000} and time.perf_counter() - began < 120


def test_sampling_follows_the_loop(spark):
    def loop(fps, n, target):
        out, due = [], 0.0
        for k in range(n):
            if k / fps + 1e-9 >= due:
                out.append(k)
                due += 1.0 / max(target, 1)
        return out

    for fps in (4.0, 5.0, 23.976, 25.0, 29.97, 30.0, 59.94):
        for n in (1, 7, 900, 20_000):
            for target in (1, 5, 7):
                assert sampling.sample_indices(fps, n, target).tolist() == loop(fps, n, target), (fps, n, target)
    videos = spark.createDataFrame([("a", 5.0, 5), ("b", 0.0, 5), ("c", None, 5), ("d", 25.0, 0)], "video_id string, original_fps double, num_frames int")
    assert [(r.video_id, r.original_frame_index) for r in sampling.sample_frames(videos).collect()] == [("a", k) for k in range(5)]
    assert {r.video_id: r.expected for r in sampling.expected_samples(videos).collect()} == {"a": 5, "b": 0, "c": 0, "d": 0}


def test_prefix_and_completeness(spark):
    df = spark.createDataFrame([("a", k) for k in (0, 1, 3, 1)] + [("b", 1)] + [("c", 0)], "video_id string, frame_number long")
    assert {r.video_id: r.prefix for r in sampling.contiguous_prefix(df, ["video_id"]).collect()} == {"a": 2, "b": 0, "c": 1}
    expected = spark.createDataFrame([("a", 4), ("c", 1), ("e", 0)], "video_id string, expected long")
    assert {r.video_id: r.complete for r in reports.metadata_complete(df, expected, ["video_id"]).collect()} == {"a": False, "c": True, "e": True}


# resume


def test_resume(spark):
    manifest = spark.createDataFrame([("original", "1", "Train"), ("original", "2", "val")], "category string, video_id string, split string")
    audit = spark.createDataFrame([("original", "1", "train", " COMPLETE "), ("original", "2", "val", "failed")], "category string, video_id string, split string, status string")
    assert [r.video_id for r in resume.pending_videos(manifest, audit).collect()] == ["2"]
    assert resume.pending_videos(manifest, audit, resume=False).count() == 2


# detections


def test_detection_chain(spark):
    rows = [("original", "v", k) for k in range(4)]
    frames = detections.with_position(spark.createDataFrame(rows, "category string, video_id string, frame_number long"), KEY, ["frame_number"])
    keys = detections.keyframes(frames, 2)
    assert sorted(r.pos for r in keys.collect()) == [0, 2, 3]
    face = "struct<bbox:array<int>,score:double,landmarks:map<string,array<double>>>"
    found = keys.withColumn("candidates", F.when(F.col("pos") < 3, F.expr(f"array(cast(named_struct('bbox', array(20, 20, 80, 80), 'score', 0.99D, 'landmarks', map('nose', array(1D, 2D))) as {face}))")))
    chosen = detections.choose_main_face(found, KEY)
    done = chosen.select(*KEY, "pos", F.when(F.col("chosen").isNotNull(), "ok").otherwise("no_face").alias("status"), F.size("candidates").alias("num_faces"), F.col("chosen.score").alias("confidence"), F.col("chosen.bbox").alias("bbox"), F.col("chosen.landmarks").alias("landmarks"))
    out = detections.interpolate_detections(frames, done, KEY)
    sized = detections.with_crop(out.withColumns({"height": F.lit(100), "width": F.lit(100)}))
    total = detections.detection_stats(sized, KEY).filter("video_id is null").first()
    assert (total.frames, total.written, total.interpolated, total.no_face, total.unresolved) == (4, 3, 1, 1, 0)
    middle = out.filter("pos = 1").first()
    assert middle.bbox == [20, 20, 80, 80] and middle.landmarks == {"nose": [1.0, 2.0]} and middle.source == "interpolated"


def test_main_face_keeps_to_the_last_box():
    faces = [{"bbox": [0, 0, 10, 10], "score": 0.9}, {"bbox": [50, 50, 90, 90], "score": 0.5}]
    assert detections.main_face(faces, None) == 1 and detections.main_face(faces, [1, 1, 9, 9]) == 0
    assert detections.main_face([faces[0], faces[0]], None) == 0


def test_second_pass(spark):
    """Frames outside good keyframes: the last box decides, failures keep their name, frames that were not tried stay open."""
    frames = detections.with_position(spark.createDataFrame([("o", "v", k) for k in range(7)], "category string, video_id string, frame_number long"), KEY, ["frame_number"])
    keys = spark.createDataFrame([("o", "v", 0, "ok", 1, 0.9, [0, 0, 10, 10]), ("o", "v", 2, "no_face", None, None, None)], "category string, video_id string, pos int, status string, num_faces int, confidence double, bbox array<int>").withColumn("landmarks", F.lit(None).cast("map<string,array<double>>"))
    found = detections.interpolate_detections(frames, keys, KEY)
    faces = "array(named_struct('bbox', array(1, 1, 9, 9), 'score', 0.5D, 'landmarks', cast(null as map<string,array<double>>)), named_struct('bbox', array(50, 50, 90, 90), 'score', 0.7D, 'landmarks', cast(null as map<string,array<double>>)))"
    tried = found.filter("pos in (1, 3, 4, 5)").select(*KEY, "pos", F.when(F.col("pos") != 4, F.expr(faces)).alias("candidates"), F.when(F.col("pos") == 5, "read_fail").alias("status"))
    out = {r.pos: r for r in detections.second_pass(found, tried, KEY).collect()}
    assert {k: (r.status, r.source, r.bbox, r.num_faces) for k, r in out.items()} == {
        0: ("ok", "detected", [0, 0, 10, 10], 1),
        1: ("ok", "detected", [1, 1, 9, 9], 2),
        2: ("no_face", None, None, None),
        3: ("ok", "detected", [1, 1, 9, 9], 2),
        4: ("no_face", None, None, None),
        5: ("read_fail", None, None, None),
        6: (None, None, None, None),
    }


def test_user_detector(spark):
    class Detector:
        def detect_faces(self, image, threshold):
            if image.shape[0] == 3:
                raise ValueError("too small")
            return {"f": {"facial_area": [1, 1, 3, 3], "score": 0.9}, "bad": {"facial_area": [1]}} if image[0, 0, 0] else {}

    rows = [("a", bytes([9] * 48), 4, 4), ("b", bytes(48), 4, 4), ("c", bytes(27), 3, 3)]
    out = {r.key: r for r in user.detect_faces(spark.createDataFrame(rows, "key string, image binary, height int, width int"), Detector).collect()}
    assert [out[k].status for k in "abc"] == ["ok", "no_face", "detect_error"]
    assert out["a"].candidates[0].bbox == [1, 1, 3, 3] and out["c"].error_message == "ValueError: too small"
    failed = spark.createDataFrame([("detect_error", m) for m in ("b", "a", "b", None)], "status string, error_message string")
    assert [(r.error_message, r.n) for r in detections.top_errors(failed).collect()] == [("b", 2), ("a", 1)]


# clips


def frames_of(spark, numbers, video="124", label=1):
    rows = [("train", "original", video, n, n, f"{video}/{n}", float(n), label) for n in numbers]
    return spark.createDataFrame(rows, "split string, category string, video_id string, frame_number long, original_frame_index long, key string, timestamp double, binary_label int")


def test_clips(spark):
    by = ["split", "category", "video_id"]
    out = clips.build_clips(frames_of(spark, range(4)), by, clip_len=4).collect()
    assert [r.key for r in out] == ["124/clip_000000"] and out[0].label == "fake" and out[0].source_keys == [f"124/{k}" for k in range(4)]
    assert clips.build_clips(frames_of(spark, [0, 1, 3, 4]), by, clip_len=4).count() == 0
    starts = [r.clip_start for r in clips.build_clips(frames_of(spark, range(6)), by, clip_len=3, clip_stride=2).orderBy("clip_start").collect()]
    assert starts == [0, 2]
    assert [r.frame_numbers for r in clips.build_clips(frames_of(spark, [0, 2, 4, 6, 8]), by, clip_len=2, frame_stride=1, clip_stride=1).collect()] == []
    assert [r.frame_numbers for r in clips.build_clips(frames_of(spark, range(7)), by, clip_len=3, frame_stride=2, clip_stride=6).collect()] == [[0, 2, 4]]
    two = frames_of(spark, range(4)).unionByName(frames_of(spark, range(4), "other/124"))
    assert clips.build_clips(two, by, clip_len=4).count() == 2


def test_clips_follow_the_loop(spark):
    r = random.Random(9)
    numbers = sorted(k for k in range(300) if r.random() < 0.93) + [5, 5]
    got = [(x.clip_start, x.frame_numbers) for x in clips.build_clips(frames_of(spark, numbers), KEY, 4, 1, 3).orderBy("clip_start").collect()]
    ordered = sorted(numbers)
    want = [(s, ordered[s : s + 4]) for s in range(0, len(ordered) - 3, 3) if all(b - a == 1 for a, b in zip(ordered[s : s + 3], ordered[s + 1 : s + 4], strict=True))]
    assert got == want


# metrics


def test_metrics_against_numpy(spark):
    r = np.random.default_rng(0)
    y, p = r.integers(0, 2, 400), np.round(r.random(400), 2)
    df = spark.createDataFrame(pd.DataFrame({"key": [str(k) for k in range(400)], "label": y.astype(int), "prob_positive": p}))
    pairs = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert metrics.roc_auc(df).first().auc == pytest.approx(pairs)
    found = {x.criterion: x for x in metrics.best_thresholds(df).collect()}
    youden = {t: ((p >= t) & (y == 1)).sum() / y.sum() - ((p >= t) & (y == 0)).sum() / (1 - y).sum() for t in np.unique(p)}
    assert found["youden"].threshold == pytest.approx(max(t for t, v in youden.items() if v > max(youden.values()) - 1e-12))
    f1 = {t: 2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum()) for t in np.unique([*p, *metrics.DEFAULT_THRESHOLDS])}
    assert found["f1"].threshold == pytest.approx(min(t for t, v in f1.items() if v > max(f1.values()) - 1e-12))
    assert math.isnan(metrics.roc_auc(df.filter("label = 1")).first().auc) and [r.warning is not None and r.criterion is None for r in metrics.best_thresholds(df.filter("label = 1")).collect()] == [True]
    m = metrics.binary_metrics(df, 0.5).first()
    assert m.tp == ((p >= 0.5) & (y == 1)).sum() and m.prob_std == pytest.approx(p.std())


def test_alignment(spark):
    a = spark.createDataFrame([("x", 1, 0.5), ("y", 0, 0.2)], "key string, label int, prob_positive double")
    assert metrics.align_predictions(a, a).count() == 2
    with pytest.raises(Exception, match="match at key y"):
        metrics.align_predictions(a, a.filter("key = 'x'")).collect()
    assert metrics.ensemble_weights(0.1, 1.0, 0.1)[-1] == 1.0 and metrics.ensemble_weights(0.0, 1.0, 0.3)[-1] == 1.0


def test_class_balance(spark):
    df = lambda *y: spark.createDataFrame([(v,) for v in y], "label int")
    assert reports.class_balance(df(1, 0, 0, 0)).first().raw_pos_weight == 3.0
    assert reports.class_balance(df(1, 0, 0, 0), invert=True).first().raw_pos_weight == pytest.approx(1 / 3)
    capped = reports.class_balance(df(1, 0, 0, 0, 0, 0), max_pos_weight=2.0).first()
    assert (capped.raw_pos_weight, capped.effective_pos_weight) == (5.0, 2.0)
    assert reports.class_balance(df(1, 1)).first().raw_pos_weight is None


def test_runs(spark):
    rows = [("a", k + 1, v) for k, v in enumerate([0.1, 0.3, float("nan"), 0.3, 0.2, 0.4])]
    out = history.monitor_runs(spark.createDataFrame(rows, "run string, epoch long, metric double"), patience=3).orderBy("epoch").collect()
    assert [r.is_new_best for r in out] == [True, True, False, False, False, True] and [r.since_best for r in out] == [0, 0, 1, 2, 3, 0] and [r.stopped for r in out] == [False] * 4 + [True] * 2
    metric = lambda auc: one(spark, history.selection_metric(F.lit(auc), F.lit(0.42)))
    assert metric(0.81) == ("val_auc", 0.81) and metric(float("nan")) == ("neg_val_loss", -0.42)


# pixels


def test_pixels(spark):
    r = np.random.default_rng(1)
    raw = r.integers(0, 256, (4, 6, 5, 3), dtype=np.uint8)
    frames = frames_of(spark, range(4))
    images_ = spark.createDataFrame([(f"124/{k}", raw[k].tobytes(), 6, 5) for k in range(4)], "key string, image binary, height int, width int")
    stacked = pixels.stack_clips(clips.build_clips(frames, KEY, clip_len=4), images_)
    row = stacked.first()
    want = raw.transpose(0, 3, 1, 2)
    diff = np.abs(np.diff(want.astype(int), axis=0)).astype(np.uint8)
    assert bytes(row.rgb) == want.tobytes() and bytes(row["diff"]) == diff.tobytes()
    checked = pixels.validate_clips(stacked, 8)
    assert checked.first().error == "clip length" and pixels.validate_clips(stacked, 4).first().error is None
    with pytest.raises(Exception, match="clip length"):
        pixels.require_valid(checked).collect()
    ready = pixels.prepare_clips(stacked.withColumn("spatial_index", F.lit(2))).first()
    spatial = np.frombuffer(ready.spatial, "<f4").reshape(3, 6, 5)
    assert np.allclose(spatial, (want[2] / 255 - pixels.MEAN[:, None, None]) / pixels.STD[:, None, None], atol=1e-5)
    assert np.allclose(np.frombuffer(ready.temporal, "<f4"), diff.ravel() / 255)
    twice = [pixels.prepare_clips(stacked.withColumn("spatial_index", F.lit(2)), training=True, seed=4).first().spatial for _ in range(2)]
    assert twice[0] == twice[1]
    scored = user.score_clips(pixels.prepare_clips(stacked.withColumn("spatial_index", F.lit(2))), lambda: lambda spatial, temporal: [len(x) / 1000 for x in spatial]).first()
    assert scored.prob_positive == pytest.approx(0.36)
    crop = pixels.crop_pixels(images_.withColumn("crop_box", F.array(F.lit(1), F.lit(1), F.lit(4), F.lit(4))), 3, 3).filter("key = '124/0'").first()
    assert bytes(crop.crop) == raw[0, 1:4, 1:4].tobytes()
    assert pixels.resized(np.full((4, 4, 3), 7, np.uint8), 9, 2).tolist() == np.full((9, 2, 3), 7).tolist()


def test_batches(spark):
    df = spark.createDataFrame([("s", f"{k}") for k in range(5)], "shard string, key string")
    assert sorted(len(r["keys"]) for r in pixels.batch_samples(df, 2).collect()) == [1, 2, 2]
    assert pixels.batch_samples(df, 2, drop_last=True).count() == 2 and one(spark, reports.batch_count(F.lit(5), 2)) == 3
    shuffled = [[r.key for r in pixels.seeded_shuffle(df, 1, e).collect()] for e in (0, 0, 1)]
    assert shuffled[0] == shuffled[1] != shuffled[2] and sorted(shuffled[2]) == sorted(shuffled[0])


# sources


def test_shards(spark, tmp_path):
    out = str(tmp_path / "shards")
    rows = [(f"v{k // 3}", f"v{k // 3}/clip_{k:03d}", {"json": b"{}", "rgb.npy": bytes([k] * 10)}) for k in range(9)]
    df = spark.createDataFrame(rows, "video string, key string, parts map<string,binary>")
    shards.write_shards(df, out, maxcount=2, tasks=2)
    n = len(os.listdir(out))
    back = {r.key: {k: bytes(v) for k, v in r.parts.items()} for r in shards.read_shards(spark, f"{out}/shard-*.tar").collect()}
    assert back == {k: p for _, k, p in rows} and n >= 5
    shards.write_shards(df.limit(1), out, tasks=1)
    assert len(os.listdir(out)) == n + 1 and f"shard-{n:06d}.tar" in os.listdir(out)
    assert reports.count_clips(shards.shard_members(shards.read_shards(spark, f"{out}/shard-{{000000..000001}}.tar"), "train")).filter("split is not null").first().shards == 2
    with pytest.raises(Exception, match="no shard"):
        shards.read_shards(spark, str(tmp_path / "none-*.tar")).collect()


def test_adjacent_members_join(tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as archive:
        for name in ("k1.json", "k1.diff.npy", "k2.json", "k1.cls"):
            info = tarfile.TarInfo(name)
            info.size = 1
            archive.addfile(info, io.BytesIO(b"x"))
    assert [(k, sorted(p)) for _, k, p in shards.samples_of(str(tmp_path / "a.tar"))] == [("k1", ["diff.npy", "json"]), ("k2", ["json"]), ("k1", ["cls"])]


def test_manifest_files(spark, tmp_path):
    for name in ("original/1.MP4", "original/notes.txt", "Deepfakes/1_2.avi", "Other/3.mp4", "original/deep/4.mp4"):
        path = tmp_path / "videos" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"0")
    found = {(r.category, r.video_path, r.video_id) for r in tables.list_videos(spark, str(tmp_path / "videos")).collect()}
    assert found == {("original", "original/1.MP4", "1"), ("Deepfakes", "Deepfakes/1_2.avi", "1_2")}
    (tmp_path / "m.csv").write_text("video_id,video_path,category,binary_label,split,original_fps,num_frames\n1,a.mp4,original,1, Train,x,5\n,b.mp4,original,1,val,5,5\n")
    manifest = tables.read_manifest(spark, str(tmp_path / "m.csv"))
    assert [tuple(r) for r in manifest.collect()] == [("1", "a.mp4", "original", 1, "", "train", 0.0, 5)]
    tables.write_manifest(manifest, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/parquet")).columns == tables.MANIFEST
    (tmp_path / "bad.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_manifest(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "list.txt").write_text("1 a/b.mp4\nshort\n0  c.mp4\n")
    assert {r.video_path for r in tables.read_official_test_list(spark, str(tmp_path / "list.txt")).collect()} == {"a/b.mp4", "c.mp4"}
    assert tables.read_official_test_list(spark, str(tmp_path / "none.txt")).count() == 0


def test_prediction_files(spark, tmp_path):
    df = spark.createDataFrame([("k1", "v", "c", "fake", 1, 0.7, 2), ("k2", "v", "c", "real", 0, 0.4, 2)], "key string, video_id string, category string, label_name string, label int, prob_positive double, spatial_index int")
    tables.write_predictions(df, str(tmp_path / "p"), 0.5)
    assert {(r.key, r.label, r.prob_positive) for r in tables.read_predictions(spark, str(tmp_path / "p")).collect()} == {("k1", 1, 0.7), ("k2", 0, 0.4)}
    tables.write_predictions(df.union(df), str(tmp_path / "q"))
    with pytest.raises(ValueError, match="repeated keys"):
        tables.read_predictions(spark, str(tmp_path / "q"))
    tables.write_metrics(metrics.binary_metrics(df), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first().confusion_matrix.tp == 1
    (tmp_path / "run.json").write_text('{"run": "a", "train": [{"loss": 1.0}, {"loss": 0.5}], "val": [{"auc": 0.9, "learning_rates": [0.1]}]}')
    assert sorted((r.stage, r.epoch) for r in tables.read_history(spark, str(tmp_path / "run.json")).collect()) == [("train", 1), ("train", 2), ("val", 1)]


def test_frame_files_and_guard(spark, tmp_path):
    row = {c: "1" for c in tables.FRAMES} | {"split": "train", "category": "original"}
    df = spark.createDataFrame(pd.DataFrame([row]))
    tables.write_frame_metadata(df, str(tmp_path / "frames"))
    tables.write_frame_metadata(df, str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 2
    df.write.csv(str(tmp_path / "csv"), header=True)
    assert tables.read_frame_metadata(spark, str(tmp_path / "csv"), split=" TRAIN ", limit=5).count() == 1
    assert tables.read_frame_metadata(spark, str(tmp_path / "csv"), split="val").count() == 0
    tables.guarded_write(df, str(tmp_path / "guarded"))
    with pytest.raises(Exception, match="(?i)exist"):
        tables.guarded_write(df, str(tmp_path / "guarded"))
    tables.guarded_write(df, str(tmp_path / "guarded"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "guarded")).count() == 1
    audit = spark.createDataFrame([("c", "v", "train", "Complete")], "category string, video_id string, split string, status string")
    tables.append_audit(audit, str(tmp_path / "audit"))
    assert [r.video_key for r in tables.read_completed_videos(spark, str(tmp_path / "audit")).collect()] == ["c|v|train"]


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(pixels: np.ndarray) -> bytes:
        h, w, _ = pixels.shape
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.png").write_bytes(png(np.full((2, 3, 3), 9, np.uint8)))
    (tmp_path / "v/b.png").write_bytes(b"broken")
    frames = spark.createDataFrame([("v/a.png",), ("v/b.png",), ("v/c.png",)], "frame_path string")
    out = {r.frame_path: r for r in images.read_frame_images(spark, str(tmp_path), frames).collect()}
    assert [out[f"v/{k}.png"].load_status for k in "abc"] == ["ok", "read_fail", "missing_file"] and (out["v/a.png"].height, out["v/a.png"].width) == (2, 3)


# streams


def test_late_frames_come_out_apart(spark, tmp_path):
    streams.use_rocksdb(spark)
    folder = str(tmp_path / "in")
    frames = lambda numbers: spark.createDataFrame([("v", n, f"k{n}") for n in numbers], "video string, frame_number long, key string").coalesce(1)
    schema = "video string, frame_number long, key string"
    for numbers in ([0, 1, 2, 3, 4], [5, 6, 7, 2]):
        frames(numbers).write.mode("append").parquet(folder)
        stream = streams.stream_clips(spark.readStream.schema(schema).parquet(folder), 4, 2)
        write = lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.clip_start for r in out.filter("not late").collect()) == [0, 2, 4] and [r.frame_numbers for r in out.filter("late").collect()] == [[2]]


def test_frames_out_of_order_and_eviction(spark, tmp_path):
    """Frames wait for the watermark, later ones come out apart, and the state of a video that is over goes."""
    streams.use_rocksdb(spark)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "video string, frame_number long, key string, ts timestamp"
    rows = [
        [("v", n, n) for n in (3, 1, 0, 2, 5)],
        [("v", 4, 4), ("v", 7, 7), ("v", 6, 6), ("w", 0, 30)],  # the watermark stands before frame 4 yet
        [("v", 2, 2), ("w", 1, 31), ("x", 0, None)],  # now behind all frames of v
        [("w", 2, 95), ("w", 4, 100), ("w", 3, 98)],  # one of three is passed at once
        [("z", 0, 500)],  # far behind w
    ]
    totals, clips, late = [], [], []

    def keep(batch, n):
        for r in batch.collect():
            (late if r.late else clips).append((r.video, r.clip_start, r.frame_numbers))

    for part in rows:
        timed = spark.createDataFrame([(v, n, f"k{n}", at) for v, n, at in part], "video string, frame_number long, key string, at long")
        timed.withColumn("ts", F.timestamp_seconds(F.col("at") + 1000)).drop("at").coalesce(1).write.mode("append").parquet(folder)
        stream = streams.stream_clips(spark.readStream.schema(schema).parquet(folder), 4, 2, time="ts", delay="4 seconds", idle_seconds=50)
        run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        totals.append([p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]][-1])
    assert sorted(clips) == [("v", 0, [0, 1, 2, 3]), ("v", 2, [2, 3, 4, 5]), ("v", 4, [4, 5, 6, 7]), ("w", 0, [0, 1, 2, 3])]
    assert sorted(late) == [("v", None, [2]), ("x", None, [0])]
    assert max(totals) > totals[-1]


def test_reconcile(spark):
    """As a directory with rows, files and an audit of several kinds would be taken up again."""
    manifest = spark.createDataFrame([("c", f"v{k}", "train", 1, 5.0 if k != 8 else 0.0, 4) for k in range(10)], "category string, video_id string, split string, binary_label int, original_fps double, num_frames long")
    numbers = {0: "0123", 1: "013", 2: "0123", 3: "00123", 5: "", 6: "", 7: "0123", 8: "0123", 9: ""}
    columns = "category string, video_id string, split string, frame_path string, frame_number string, original_frame_index long, timestamp double, binary_label int"
    frames = spark.createDataFrame([("c", f"v{k}", " Train", "p", n, int(n), 0.0, 1) for k, own in numbers.items() for n in own] + [("c", "gone", "train", "p", "0", 0, 0.0, 1)], columns)
    filed = {0: "0123", 1: "0123", 2: "012", 3: "0123", 5: "0123", 6: "123", 7: "01234", 8: "0123", 9: "01234"}
    files = spark.createDataFrame([("c", f"v{k}", int(n), f"c/v{k}_frame_0000{n}.jpg") for k, own in filed.items() for n in own], "category string, video_id string, frame_number int, frame_path string")
    audit = lambda *done: spark.createDataFrame([("c", v, "TRAIN", "Complete ") for v in done] + [("c", "v1", "train", "failed")], "category string, video_id string, split string, status string")
    states = {r.video_key: (r.complete, r.bootstrapped, r.action) for r in resume.video_states(manifest, frames, files, audit()).collect()}
    assert states.pop("c|v0|train") == (True, True, "keep") and len(states) == 10 and set(states.values()) == {(False, False, "extract")}
    out = resume.reconcile(manifest, frames, files, audit())
    assert [(r.video_id, r.status) for r in out.audit.collect()] == [("v0", "complete")] and {r.video_id for r in out.frames.collect()} == {"v0"}
    # an audit that knows a video is believed, and nothing is made up
    out = resume.reconcile(manifest, frames, files, audit("v3", "v5", "v6", "v9", "gone"))
    assert {r.video_key.split("|")[1]: r.action for r in out.states.filter("complete").collect()} == {"v3": "keep", "v5": "rebuild", "v6": "lost", "v9": "rebuild", "gone": "keep"}
    assert out.audit.count() == 0
    rows = sorted((r.video_id, r.frame_number, r.original_frame_index, r.frame_path) for r in out.frames.collect())
    assert rows == sorted([("gone", "0", 0, "p"), *(("v3", n, int(n), "p") for n in "00123"), *((v, n, int(n), f"c/{v}_frame_0000{n}.jpg") for v in ("v5", "v9") for n in "0123")])
    assert resume.video_states(manifest.limit(0), frames.limit(0), files.limit(0), audit().limit(0)).count() == 0


def test_files_count_towards_completeness(spark):
    numbers = lambda rows: spark.createDataFrame([(v, n) for v, own in rows.items() for n in own], "video_id string, frame_number long")
    expected = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3), ("d", 0)], "video_id string, expected long")
    out = reports.metadata_complete(numbers({"a": [0, 1, 2], "b": [0, 1, 2], "c": [0, 1, 3]}), expected, ["video_id"], numbers({"a": [2, 1, 0, 0], "b": [0, 2], "c": [0, 1, 2]}))
    assert {r.video_id: (r.rows, r.files, r.complete) for r in out.collect()} == {"a": (3, 3, True), "b": (3, 2, False), "c": (3, 3, False), "d": (0, 0, True)}


def test_main_face_over_stretches(spark):
    """A long video in stretches of 16 positions, over several tasks, as one fold from its first frame to its last."""
    r = random.Random(11)
    rows, want = [], {}
    for video, length in ((None, 5), ("long", 700), ("short", 3), ("void", 40)):
        box = None
        for pos in range(0, 5 * length, 5):
            some = None if video == "void" or r.random() < 0.3 else [(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 5))]
            faces = some and [{"bbox": [x, y, x + 30 + r.randrange(9), y + 40], "score": r.random(), "landmarks": None} for x, y in some]
            known = [r.randrange(50), 0, 60, 60] if faces is None and r.random() < 0.1 and video != "void" else None
            face = None
            if known:
                box = known
            elif faces:
                face = faces[detections.main_face(faces, box)]
                box = face["bbox"]
            rows.append((video, pos, faces, known))
            want[video, pos] = face and face["bbox"]
    df = spark.createDataFrame(rows, "video string, pos long, candidates array<struct<bbox:array<int>,score:double,landmarks:map<string,array<double>>>>, known array<int>").repartition(7)
    for stretch in (16, 100_000):
        out = detections.choose_main_face(df, ["video"], "known", stretch)
        assert {(x.video, x.pos): x.chosen and x.chosen.bbox for x in out.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = detections.choose_main_face(df, ["video"], "known", 16).filter("video = 'long'")
        tasks = sum(n > 0 for n in out.rdd.glom().map(len).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_stretch_maps_compose():
    """A stretch's map applied to any box before it is the fold over the stretch."""
    r = random.Random(12)
    face = lambda: {"bbox": [x := r.randrange(40), y := r.randrange(40), x + 20, y + 25], "score": r.random()}
    for _ in range(300):
        frames = [None if r.random() < 0.4 else [face() for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(12))]
        own = detections.StretchMap()
        for f in frames:
            own.add(f, None)
        for before in (None, [0, 0, 30, 30], face()["bbox"]):
            box = before
            for f in frames:
                if f:
                    box = f[detections.main_face(f, box)]["bbox"]
            got = before if not own.boxes else own.boxes[0 if own.first is None else detections.main_face(own.first, before)]
            assert got == box


def test_new_samples_and_the_days_they_read(spark, tmp_path):
    """Late, repeated and undated samples once each; a batch reads the audit of its own days only."""
    folder, audit, out = (str(tmp_path / x) for x in ("in", "audit", "out"))

    def deliver(rows, checkpoint):
        df = spark.createDataFrame(rows, "key string, day string")
        df.select("key", F.to_timestamp("day").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        streams.stream_new_samples(spark.readStream.schema("key string, ts timestamp").parquet(folder), audit, out, str(tmp_path / checkpoint)).awaitTermination()

    deliver([("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-02"), ("n", None)], "c1")
    deliver([("c", "2024-06-01")], "c1")
    # the audit of a day that no batch asks for may be anything
    broken = next(p for p in (tmp_path / "audit/day=2024-06-01").rglob("*.parquet"))
    kept = broken.read_bytes()
    broken.write_bytes(b"broken")
    deliver([("a", "2024-01-01"), ("late", "2024-01-01"), ("n", None)], "c1")
    broken.write_bytes(kept)
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "late", "n"]
    # a stream that starts anew finds nothing new
    deliver([("d", "2024-01-02")], "c2")
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d", "late", "n"]


def test_shuffled_batches_start_anywhere(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"))
    whole = {r.batch: r["keys"] for r in pixels.shuffled_batches(df, 30, 7, 2).collect()}
    assert sorted(k for keys in whole.values() for k in keys) == sorted(f"k{n}" for n in range(1000)) and {len(k) for k in whole.values()} == {30, 10}
    ranges = pixels.shuffle_ranges(df, 7, 2)
    for first, stop in ((0, 4), (13, 14), (20, None), (40, None)):
        part = {r.batch: r["keys"] for r in pixels.shuffled_batches(df, 30, 7, 2, ranges=ranges, first=first, stop=stop).collect()}
        assert part == {b: k for b, k in whole.items() if b >= first and (stop is None or b < stop)}
    order = [r.key for r in pixels.seeded_shuffle(df, 7, 2).collect()]
    assert order == [k for b in sorted(whole) for k in whole[b]]
    assert {r.batch: r["keys"] for r in pixels.shuffled_batches(df, 30, 7, 3).collect()} != whole
    assert 33 not in {r.batch for r in pixels.shuffled_batches(df, 30, 7, 2, drop_last=True).collect()}


def test_only_the_frames_own_files_are_opened(spark, tmp_path):
    from pyarrow.fs import LocalFileSystem

    for k in range(5):
        (tmp_path / f"v{k}").mkdir()
        (tmp_path / f"v{k}/a.bin").write_bytes(bytes([k] * 12))
    opened = []

    class Store:
        def open_input_stream(self, place):
            opened.append(place)
            return LocalFileSystem().open_input_stream(place)

        def get_file_info(self, place):
            return LocalFileSystem().get_file_info(place)

    square = lambda raw: np.frombuffer(raw, np.uint8).reshape(2, 2, 3)
    assert images.image_of(Store(), str(tmp_path / "v3/a.bin"), square) == ("ok", 2, 2, bytes([3] * 12)) and opened == [str(tmp_path / "v3/a.bin")]
    assert images.image_of(Store(), str(tmp_path / "v9/a.bin"), square)[0] == "missing_file"
    assert images.image_of(Store(), str(tmp_path), square)[0] == "read_fail"
    (tmp_path / "v4/a.bin").write_bytes(b"short")
    frames = spark.createDataFrame([("v0/a.bin", 1), ("v4/a.bin", 2), ("none", 3), (None, 4)], "frame_path string, n int")
    out = {r.n: r for r in images.read_frame_files(frames, str(tmp_path), square, rows=2).collect()}
    assert [out[n].load_status for n in (1, 2, 3, 4)] == ["ok", "read_fail", "missing_file", "missing_file"] and bytes(out[1].image) == bytes(12)


def test_clips_are_stacked_as_frames_go_by(spark):
    """Clips across Arrow batches, of several sizes and lengths, with frames that are lacking or shared; no task per clip, no pandas."""
    r = np.random.default_rng(3)
    size = lambda n: (2 + n % 2, 3) if n < 30 else (4, 5)
    pictures = {f"k{n}": (*size(n // 10 * 10), r.integers(0, 256, (*size(n // 10 * 10), 3)).astype(np.uint8)) for n in range(60)}
    frames = spark.createDataFrame([(k, x.tobytes(), h, w) for k, (h, w, x) in pictures.items()], "key string, image binary, height int, width int").repartition(3)
    source = {f"c{n}": [f"k{n // 10 * 10 + (n + t) % 10}" for t in range(2 + n % 4)] for n in range(60)} | {"lacks": ["k1", "gone", "k3"], "alone": ["k5"], "none": ["gone"]}
    made = spark.createDataFrame(list(source.items()), "key string, source_keys array<string>")
    want = {}
    for key, names in source.items():
        if own := [pictures[x] for x in names if x in pictures]:
            rgb = np.stack([x.transpose(2, 0, 1) for _, _, x in own])
            diff = np.abs(np.diff(rgb.astype(np.int16), axis=0)).astype(np.uint8)
            want[key] = (len(own), *own[0][:2], rgb.tobytes(), diff.tobytes())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for most in (1, 100, 1 << 24):
            out = pixels.stack_clips(made, frames, batch_bytes=most)
            assert {x.key: (x.length, x.height, x.width, bytes(x.rgb), bytes(x.diff)) for x in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "InPandas" not in out._jdf.queryExecution().toString()


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """A task for each known folder, however many files there are, and names and kinds of entries as folders hold them."""
    files = spark.range(0, 600, 1, 1).select(F.concat(F.lit("Deepfakes/v"), "id", F.lit(".mp4")).alias("frame_path"), F.lit(b"0").alias("content"))
    images.write_frame_files(files.unionAll(files), str(tmp_path), tasks=5)
    for name in ("original/_one.mp4", "original/.two.AVI", "original/a b%20c.mov", "original/.mp4", "original/deep.mp4/4.mp4", "csv/5.mp4", "6.mp4", "FaceSwap"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"0")
    want = {("original", "original/_one.mp4", "_one"), ("original", "original/.two.AVI", ".two"), ("original", "original/a b%20c.mov", "a b%20c")}
    want |= {("Deepfakes", f"Deepfakes/v{k}.mp4", f"v{k}") for k in range(600)}
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}", f"file:{tmp_path}", os.path.relpath(tmp_path)):
        found = tables.list_videos(spark, root, rows=7)
        assert found.rdd.getNumPartitions() == len(text.CATEGORY_LABELS) and {tuple(r) for r in found.collect()} == want
    assert found.count() == 603
    with pytest.raises(FileNotFoundError):
        tables.list_videos(spark, f"{tmp_path}/none")
    below = {r.video_path for r in tables.files_below(spark, f"file:{tmp_path}").collect()}
    assert {"original/a b%20c.mov", "original/deep.mp4/4.mp4", "6.mp4", "Deepfakes/v3.mp4"} <= below


def test_alignment_error_names_examples(spark):
    side = lambda rows: spark.createDataFrame([(k, y, 0.5) for k, y in rows], "key string, label int, prob_positive double")
    one, two = side([("a", 0), ("b", 1), *((f"x{k}", 1) for k in range(9))]), side([("a", 1), ("b", 1), ("z", 0)])
    with pytest.raises(ValueError, match="first side: x0, x1, x2, x3, x4; only on the second side: z; with other labels: a$"):
        metrics.align_predictions(one, two, examples=5)
    assert metrics.align_predictions(one, one, examples=5).count() == 11


def test_rebuilt_frames_by_words(spark, capsys):
    """Numbers around the ends of words, outside the plan, without a video or listed twice; the plan is no table of rows that could be sent to all tasks."""
    videos = spark.createDataFrame([("o", "a", 1, 10.0, 400), ("o", "b", 0, 4.0, 9), ("o", "c", 0, None, 9)], "category string, video_id string, binary_label int, original_fps double, num_frames long")
    numbers = {"a": [0, 1, 63, 64, 65, 127, 128, 199, 200, 500, -1, None], "b": [0, 8, 9, 64, -64], "c": [0], "gone": [0]}
    files = spark.createDataFrame([("o", v, n) for v, own in numbers.items() for n in own] + [("o", "a", 64)], "category string, video_id string, frame_number int")
    for rows in (files, files.withColumn("path", F.lit("x"))):
        out = resume.rebuild_frames(rows, videos)
        plan = {(r.video_id, r.frame_number): (r.original_frame_index, r.timestamp) for r in sampling.sample_frames(videos).collect()}
        have = out.select("video_id", "frame_number", "original_frame_index", "timestamp").collect()
        assert {(r[0], r[1]): (r[2], r[3]) for r in have} == {k: at for k, at in plan.items() if k[1] in numbers[k[0]]}
        assert len(have) == 10 + (rows is not files)
    assert dict(out.dtypes)["frame_number"] == "int"
    resume.rebuild_frames(files, videos).explain()
    assert capsys.readouterr().out.count("posexplode") == 0


def test_sampled_frames_rounded(spark):
    """Timestamps that are rounded once for each distinct rate and length are those of rounded rows."""
    videos = spark.range(40).select("id", F.lit(29.97).alias("original_fps"), (F.col("id") * 20).alias("num_frames"))
    plain = sampling.sample_frames(videos).withColumn("timestamp", F.round("timestamp", 6))
    assert sorted(sampling.sample_frames(videos, digits=6).collect()) == sorted(plain.collect())


def test_numbered_by_words(spark):
    """Whole numberings over several words, with gaps, repeats, negative numbers and none."""
    groups = {"whole": range(130), "gap": [k for k in range(130) if k != 64], "twice": [*range(64), 63], "shifted": range(1, 65), "negative": range(-1, 64), "null": [0, 1, None], "none": [None], "one": [0], "word": range(64)}
    rows = spark.createDataFrame([(g, n) for g, own in groups.items() for n in own], "g string, frame_number long").repartition(5)
    have = {r.g: (r.rows, r.whole) for r in reports.exactly_numbered(rows, ["g"]).collect()}
    assert have == {g: (len(list(own)), g in ("whole", "one", "word")) for g, own in groups.items()}
    words = {r.word: r.bits & (1 << 64) - 1 for r in reports.number_words(rows.filter("g = 'negative'"), ["g"]).collect()}
    assert words == {-1: 1 << 63, 0: (1 << 64) - 1}


def test_video_states_by_words(spark):
    """Files below, at and beyond the expected number around the ends of words, of which none is a row of its own in a shuffle."""
    sizes = {"a": 64, "b": 65, "c": 127, "d": 128, "e": 200, "f": 1}
    manifest = spark.createDataFrame([("o", v, "train", 5.0, n) for v, n in sizes.items()], "category string, video_id string, split string, original_fps double, num_frames long")
    files = spark.createDataFrame([("o", v, k) for v, n in sizes.items() for k in range(n + (v == "e")) if (v, k) != ("d", 127)] + [("o", "a", 3), ("o", "f", -1)], "category string, video_id string, frame_number long")
    rows = manifest.limit(0).selectExpr("category", "video_id", "split", "0L as frame_number")
    audit = manifest.selectExpr("category", "video_id", "split", "'complete' as status")
    out = resume.video_states(manifest, rows, files, audit, 5)
    have = {r.video_key[2]: (r.expected, r.files, r.action) for r in out.collect()}
    assert have == {"a": (64, 64, "rebuild"), "b": (65, 65, "rebuild"), "c": (127, 127, "rebuild"), "d": (128, 127, "lost"), "e": (200, 201, "rebuild"), "f": (1, 2, "rebuild")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "Aggregate [frame_number" not in plan and "bit_or" in plan


def test_failure_report_is_whole(spark):
    """Every wrong prediction counts and is part of the MD5, in order of key; a report without any has none."""
    import hashlib

    preds = spark.createDataFrame([(f"k{n}", n % 2, 0.9 if n % 3 else 0.1) for n in range(1000)], "key string, label int, prob_positive double").repartition(5)
    wrong = sorted(f"k{n}" + ("FN1" if n % 2 else "FP0") for n in range(1000) if (n % 3 > 0) != (n % 2 == 1))
    row = metrics.failure_report(preds, 0.5).first()
    wanted = ",".join(sorted(wrong, key=lambda x: x[:-3]))
    assert (row.summary.failures_saved, row.failures_md5) == (len(wrong), hashlib.md5(wanted.encode()).hexdigest())
    assert metrics.failure_report(preds.filter("key = 'k1'"), 0.5).first().failures_md5 is None


def test_arriving_frames_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """A part of the frames that arrive is not one task's file."""
    from framelake.plans import streams as plans

    frames = spark.range(0, 4000, 1, 4).select((F.col("id") % 40).cast("string").alias("video_id"), F.floor(F.col("id") / 40).alias("frame_number"), F.col("id").alias("event_id"), F.col("id").cast("string").alias("key"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    monkeypatch.setattr(plans.B, "kept_frames", lambda spark, sf_dir: frames)
    monkeypatch.setattr(plans, "scratch", lambda spark, name: str(tmp_path / name))
    streams.use_rocksdb(spark)
    plans.arrived_clips(spark, "", "1 hour").count()
    assert len([x for x in os.listdir(tmp_path / "frames") if x.endswith(".parquet")]) > plans.ARRIVALS


def test_shapes_are_planned_once(spark):
    """The sampling function runs above the distinct of rates and lengths, not for each video, whatever filters its result."""
    videos = spark.range(50).select(F.lit(25.0).alias("original_fps"), (F.col("id") % 3 * 50).alias("num_frames"))
    for out in (sampling.sample_frames(videos), sampling.expected_samples(videos).filter("expected > 3")):
        lines = [x.strip(" :+-") for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
        calls = [k for k, x in enumerate(lines) if x.startswith("ArrowEvalPython")]
        assert len(calls) == 1 and lines[calls[0] + 1].startswith("Aggregate")
    odd = spark.createDataFrame([(25.0, 100), (float("nan"), 100), (None, 100), (0.0, 9), (25.0, 0)], "original_fps double, num_frames long")
    for plan in (None, sampling.written_plan(odd)):
        assert sorted(r.expected for r in sampling.expected_samples(odd, plan=plan).collect()) == [0, 0, 0, 0, 20]
        assert sampling.planned(odd, plan=plan).count() == 1


def test_rows_are_sifted(spark):
    """No row with a key goes, nearly all others do, and a key that is null on both sides does no harm."""
    rows = spark.range(20000).select(F.col("id").cast("string").alias("k")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    keys = spark.range(0, 20000, 10).select(F.col("id").cast("string").alias("k"))
    for own in (keys, keys.union(keys)):
        left = [r.k for r in resume.sifted(rows, own, ["k"]).collect()]
        assert {r.k for r in keys.collect()} <= set(left) and len(left) == len(set(left)) < 2100
    assert resume.sifted(rows, keys.limit(0), ["k"]).count() == 0


def test_rebuilt_rows_are_not_joined_with_the_plan_by_number(spark):
    """Files meet their video and its plan as one list, and few rows of other videos get as far as a join with the states."""
    manifest = spark.createDataFrame([("c", f"v{k}", "train", 1, 5.0, 700) for k in range(4)], "category string, video_id string, split string, binary_label int, original_fps double, num_frames long")
    frames = spark.range(700).selectExpr("'c' AS category", "'v0' AS video_id", "'train' AS split", "'p' AS frame_path", "cast(id AS string) AS frame_number", "id AS original_frame_index", "0.5D AS timestamp", "1 AS binary_label")
    # twice one file, and numbers that the plan has not
    files = spark.createDataFrame([("c", f"v{k}", n, f"{k}/{n}") for k in (1, 2) for n in [*range(702), 5, -1] if (k, n) != (2, 9)], "category string, video_id string, frame_number int, frame_path string")
    audit = manifest.selectExpr("category", "video_id", "split", "'complete' AS status")
    out = resume.reconcile(manifest, frames, files, audit, plan=sampling.written_plan(manifest, digits=1))
    assert {r.video_key: r.action for r in out.states.collect()} == {"c|v0|train": "keep", "c|v1|train": "rebuild", "c|v2|train": "lost", "c|v3|train": "lost"}
    have = sorted((int(r.frame_number), r.original_frame_index, r.timestamp) for r in out.frames.filter("video_id = 'v1'").collect())
    assert have == sorted((n, n, round(n / 5, 1)) for n in [*range(700), 5]) and out.frames.count() == 1401
    plan = out.frames._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "_set#" in plan
