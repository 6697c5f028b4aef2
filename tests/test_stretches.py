"""Long videos in stretches: as their windows over the whole video."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import clips, detections, pixels, stretches

BY = ["category", "video_id"]


@pytest.fixture(scope="module")
def frames(spark):
    """Videos of several lengths with gaps, one of them long, and one without a name."""
    r = random.Random(21)
    rows = []
    for category, video, length in (("a", "long", 900), ("a", None, 70), (None, "x", 33), ("b", "one", 1), ("b", "two", 64)):
        n = 0
        for _ in range(length):
            n += 1 if r.random() < 0.95 else 2
            rows.append((category, video, n, n * 10, f"{video}/{n}", float(n), 1, r.randrange(99), r.choice(["ok", "ok", "no_face"])))
    return spark.createDataFrame(rows, "category string, video_id string, frame_number long, original_frame_index long, key string, timestamp double, binary_label int, value int, status string").repartition(5)


def same(one, two):
    order = lambda df: sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert sorted(one.columns) == sorted(two.columns) and order(one) == order(two)


def test_positions(frames):
    same(stretches.with_position(frames, BY, ["frame_number"]).withColumn("pos", F.col("pos").cast("int")), detections.with_position(frames, BY, ["frame_number"]))


@pytest.mark.parametrize("stretch", [8, 64, 10_000])
@pytest.mark.parametrize(("clip_len", "frame_stride", "clip_stride"), [(8, 1, 6), (3, 2, 2), (2, 1, 1)])
def test_clips(frames, stretch, clip_len, frame_stride, clip_stride):
    plain = clips.build_clips(frames, BY, clip_len, frame_stride, clip_stride, carry=("value",))
    long = clips.build_clips(frames, BY, clip_len, frame_stride, clip_stride, carry=("value",), stretch=stretch)
    same(long.withColumn("clip_start", F.col("clip_start").cast("int")), plain)


@pytest.mark.parametrize("stretch", [7, 64, 10_000])
def test_interpolation(frames, stretch):
    placed = detections.with_position(frames, BY, ["frame_number"])
    ok = F.col("status") == "ok"
    found = detections.keyframes(placed, 9).select(*BY, "pos", "status", F.when(ok, 1).alias("num_faces"), F.when(ok, F.col("value") / 100).alias("confidence"), F.when(ok, F.array("value", "value", F.col("value") + 9, F.col("value") + 9)).alias("bbox"), F.lit(None).cast("map<string,array<double>>").alias("landmarks"))
    placed = placed.drop("status")
    same(detections.interpolate_detections(placed, found, BY, stretch), detections.interpolate_detections(placed, found, BY))


@pytest.mark.parametrize("stretch", [1, 16, 10_000])
def test_differences(frames, stretch):
    own = frames.select(*BY, "frame_number", F.array("value", "value").alias("pixels"))
    same(pixels.frame_difference(own, BY, ["frame_number"], stretch=stretch), pixels.frame_difference(own, BY, ["frame_number"]))


def test_a_long_video_lies_in_many_tasks(spark):
    n = 200_000
    video = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_number"), F.col("id").alias("original_frame_index"), F.col("id").cast("string").alias("key"), F.lit(0.0).alias("timestamp"), F.lit(0).alias("binary_label"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = clips.build_clips(video, ["video_id"], stretch=10_000)
        shares = [r["count"] for r in made.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(shares) == len(range(0, n - 7, 6)) and len(shares) > 2 and max(shares) < 0.7 * sum(shares)
