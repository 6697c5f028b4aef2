"""Fixed-length sliding clips over a video's frames; pixels stay out of the windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.scores import OF_EIGHT, center_candidates, default_position, inside_clip
from framelake.functions.text import clip_label_text, draw
from framelake.operators import stretches


def build_clips(frames: DataFrame, by: list[str], clip_len: int = 8, frame_stride: int = 1, clip_stride: int = 6, video_path: str = "video_id", carry: tuple[str, ...] = (), stretch: int | None = None) -> DataFrame:
    """One row per clip of frames that follow each other at `frame_stride`.

    Frames (frame_number, original_frame_index, key, timestamp, binary_label) are ordered in each video; windows start at
    every `clip_stride`-th position, and only windows without gaps get a clip number. `carry`: columns that a clip takes
    from its first frame. With `stretch`, for videos too long for one task, a video is sorted by ranges and its windows run over so many
    positions at a time (see `stretches`).
    """
    ordering = ["frame_number", "original_frame_index", "key"]
    if stretch is None:
        order = Window.partitionBy(*by).orderBy(*ordering)
        placed = frames.withColumn("clip_start", F.row_number().over(order) - 1)
    else:
        reach = (clip_len - 1) * frame_stride
        order = Window.partitionBy(*by, "_stretch").orderBy("pos")
        placed = stretches.bordered(stretches.with_position(frames, by, ordering), reach, max(stretch, reach)).withColumn("clip_start", F.col("pos"))
    frame = F.struct("frame_number", "original_frame_index", "timestamp", "key")
    ahead = {f"_frame{k}": F.lead(frame, k * frame_stride).over(order) for k in range(1, clip_len)}
    placed = placed.withColumns({"_frame0": frame, **ahead})
    starts = placed.filter((F.col("clip_start") % clip_stride == 0) & F.col(f"_frame{clip_len - 1}").isNotNull())
    starts = starts if stretch is None else starts.filter(~F.col("_border"))
    picked = starts.withColumn("_own", F.array(*[F.col(f"_frame{k}") for k in range(clip_len)])).drop(*[f"_frame{k}" for k in range(clip_len)])
    numbers = F.col("_own.frame_number")
    steps = F.zip_with(F.slice(numbers, 2, clip_len - 1), F.slice(numbers, 1, clip_len - 1), lambda b, a: b - a)
    whole = picked.filter(F.forall(steps, lambda d: d == max(1, frame_stride)))
    if stretch is None:
        whole = whole.withColumn("clip_id", F.row_number().over(Window.partitionBy(*by).orderBy("clip_start")) - 1)
    else:
        whole = stretches.ranked(whole, by, "clip_start", "clip_id", max(stretch, reach)).withColumn("clip_id", F.col("clip_id").cast("int"))
    centers = center_candidates(clip_len)
    return whole.select(
        *by,
        F.concat(F.col(video_path).cast("string"), F.format_string("/clip_%06d", "clip_id")).alias("key"),
        "clip_id",
        "clip_start",
        "binary_label",
        clip_label_text("binary_label").alias("label"),
        F.lit(clip_len).alias("clip_length"),
        F.lit(clip_len - 1).alias("num_differences"),
        numbers.alias("frame_numbers"),
        F.col("_own.original_frame_index").alias("original_frame_indices"),
        F.col("_own.timestamp").alias("timestamps"),
        F.col("_own.key").alias("source_keys"),
        F.array(*map(F.lit, centers)).cast("array<int>").alias("center_candidate_indices"),
        F.lit(default_position(centers)).alias("default_center_index"),
        *carry,
    )


def clip_build_stats(frames: DataFrame, clips: DataFrame, by: list[str], split: str) -> DataFrame:
    """Per split: frames, videos, clips and videos without a clip."""
    videos = frames.groupBy(*by).agg(F.count("*").alias("frames"))
    counted = videos.join(clips.groupBy(*by).agg(F.count("*").alias("clips")), by, "left")
    return counted.groupBy(split).agg(F.sum("frames").alias("frames"), F.count("*").alias("videos"), F.coalesce(F.sum("clips"), F.lit(0).cast("long")).alias("clips"), F.count_if(F.col("clips").isNull()).alias("videos_without_clips"))


def choose_spatial_index(candidates, default, clip_len, training: bool = False, seed: int = 0, epoch: int = 0, key: str = "key", fallback: tuple[int, ...] = tuple(OF_EIGHT)):
    """Training: a candidate by a hash of key, seed and epoch; else the stored default if it lies inside the clip, else the middle candidate.

    Candidates outside the clip don't count; without any (or a null list) those of `fallback` do, and then the clip's middle.
    """
    middle = F.array(F.greatest(F.lit(0), F.floor(clip_len / 2).cast("int")))
    valid = F.coalesce(inside_clip(candidates, clip_len), inside_clip(F.array(*map(F.lit, fallback)).cast("array<int>"), clip_len), middle)
    if training:
        return F.element_at(valid, (draw(key, F.lit(seed), F.lit(epoch)) % F.size(valid) + 1).cast("int"))
    return F.when((default >= 0) & (default < clip_len), default).otherwise(F.element_at(valid, (F.size(valid) / 2).cast("int") + 1))
