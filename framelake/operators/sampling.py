"""Which source frames of a video are kept at a target rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.staging import scratch


def sample_indices(fps: float, frames: int, target: int) -> np.ndarray:
    """First source frame at or after each tick (with 1e-9 of slack), at most one tick a frame."""
    if fps <= 0 or frames <= 0:
        return np.empty(0, np.int64)
    period = 1.0 / max(target, 1)
    n = min(frames, int(frames / fps / period) + 2)
    ticks = np.concatenate(([0.0], np.cumsum(np.full(n, period))))[: n + 1]
    due = lambda k: k / fps + 1e-9 >= ticks
    first = np.maximum(0, np.ceil((ticks - 1e-9) * fps).astype(np.int64))
    first = np.where((first > 0) & due(first - 1), first - 1, np.where(due(first), first, first + 1))
    k = np.arange(len(first))
    first = np.maximum.accumulate(first - k) + k
    return first[first < frames]


def shape_plan(videos: DataFrame, target_fps: int = 5, digits: int | None = None) -> DataFrame:
    """Each distinct (original_fps, num_frames) of `videos` with `_at`, the original_frame_index and timestamp of each kept frame in order.

    Timestamps are rounded to `digits`. Rates or lengths that give no frames are left out.
    """

    @F.pandas_udf("array<long>")
    def indices(fps: pd.Series, frames: pd.Series) -> pd.Series:
        return pd.Series([sample_indices(f, int(n), target_fps) for f, n in zip(fps, frames, strict=True)])

    # else a filter on the result takes the function along below the distinct, where it is called for each video
    indices = indices.asNondeterministic()

    def placed(k: Column) -> Column:
        at = k / F.col("original_fps")
        return F.struct(k.alias("original_frame_index"), (at if digits is None else F.round(at, digits)).alias("timestamp"))

    usable = videos.filter((F.col("original_fps") > 0) & ~F.isnan(F.col("original_fps").cast("double")) & (F.col("num_frames") > 0))
    shapes = usable.select(F.col("original_fps").cast("double"), F.col("num_frames").cast("long")).distinct()
    return shapes.withColumn("_at", indices("original_fps", "num_frames")).withColumn("_at", F.transform("_at", placed))


def written_plan(videos: DataFrame, target_fps: int = 5, digits: int | None = None) -> DataFrame:
    """`shape_plan` as a table in the shared folder, for use in several places: Spark knows its size when it plans their joins."""
    path = scratch(videos.sparkSession, "shape_plan")
    shape_plan(videos, target_fps, digits).write.parquet(path)
    return videos.sparkSession.read.parquet(path)


def planned(videos: DataFrame, target_fps: int = 5, digits: int | None = None, plan: DataFrame | None = None) -> DataFrame:
    """Rows of `videos` with `_at`, the original_frame_index and timestamp of each kept frame in order; videos without frames go.

    Both are worked out, and timestamps rounded to `digits`, once for each distinct (fps, number of frames). `plan`: a
    `shape_plan` that has them already.
    """
    plan = shape_plan(videos, target_fps, digits) if plan is None else plan
    usable = videos.filter((F.col("original_fps") > 0) & (F.col("num_frames") > 0))
    typed = usable.withColumns({"original_fps": F.col("original_fps").cast("double"), "num_frames": F.col("num_frames").cast("long")})
    return typed.join(plan, ["original_fps", "num_frames"]).select(*videos.columns, "_at")


def sample_frames(videos: DataFrame, target_fps: int = 5, digits: int | None = None) -> DataFrame:
    """Rows of `videos` (original_fps, num_frames) once per kept frame, with frame_number, original_frame_index, timestamp.

    The positions are worked out once for each distinct (fps, number of frames). Null rates or lengths give no frames.
    `digits`: those that timestamps are rounded to.
    """
    out = planned(videos, target_fps, digits).select(*videos.columns, F.posexplode("_at").alias("frame_number", "_at"))
    return out.select(*videos.columns, "frame_number", "_at.original_frame_index", "_at.timestamp")


def expected_samples(videos: DataFrame, target_fps: int = 5, plan: DataFrame | None = None) -> DataFrame:
    """Rows of `videos` with the number of frames that sampling keeps; `plan`: a `shape_plan` that has them already."""

    @F.pandas_udf("long")
    def count(fps: pd.Series, frames: pd.Series) -> pd.Series:
        return pd.Series([len(sample_indices(f, int(n), target_fps)) if f == f and n == n else 0 for f, n in zip(fps, frames, strict=True)])

    rate, length = F.col("original_fps").cast("double"), F.col("num_frames").cast("long")
    if plan is not None:
        counted = plan.select(F.col("original_fps").alias("_f"), F.col("num_frames").alias("_n"), F.size("_at").cast("long").alias("_expected"))
        return videos.join(counted, (rate == F.col("_f")) & (length == F.col("_n")), "left").withColumn("expected", F.coalesce("_expected", F.lit(0).cast("long"))).drop("_f", "_n", "_expected")
    count = count.asNondeterministic()  # as in `shape_plan`
    shapes = videos.select(rate, length).distinct()
    counted = shapes.withColumn("expected", F.when((F.col("original_fps") > 0) & (F.col("num_frames") > 0), count(F.coalesce("original_fps", F.lit(0.0)), F.coalesce("num_frames", F.lit(0).cast("long")))).otherwise(0).cast("long"))
    key = [rate.eqNullSafe(F.col("_f")), length.eqNullSafe(F.col("_n"))]
    return videos.join(counted.toDF("_f", "_n", "expected"), key, "left").drop("_f", "_n")


def contiguous_prefix(frames: DataFrame, by: list[str]) -> DataFrame:
    """Per video the length of the run 0, 1, 2, … of its distinct frame numbers."""
    numbers = frames.select(*by, "frame_number").distinct()
    ranked = numbers.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("frame_number")) - 1)
    return ranked.groupBy(*by).agg(F.count_if(F.col("_rank") == F.col("frame_number")).alias("prefix"))
