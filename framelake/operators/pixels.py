"""Pixel work in Arrow batches, and its small-array forms as column expressions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.text import draw
from framelake.operators import stretches

#: Channel means and deviations of the usual image normalisation.
MEAN, STD = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


def frame_difference(frames: DataFrame, by: list[str], order: list[str], pixels: str = "pixels", stretch: int | None = None) -> DataFrame:
    """Adds `difference`, the absolute change of each value since the frame before (null for a first frame).

    With `stretch`, for videos too long for one task, a video is compared so many positions at a time (see `stretches`).
    """
    if stretch is None:
        seen = frames.withColumn("_before", F.lag(pixels).over(Window.partitionBy(*by).orderBy(*order)))
    else:
        placed = stretches.bordered(stretches.with_position(frames, by, order), 1, stretch)
        compared = placed.withColumn("_before", F.lag(pixels).over(Window.partitionBy(*by, "_stretch").orderBy("pos")))
        # the first row of a stretch is compared where it is the last one's border
        seen = compared.filter(F.col("_border") | (F.col("pos") % stretch != 0) | (F.col("pos") == 0)).select(*frames.columns, "_before")
    return seen.withColumn("difference", F.zip_with("_before", F.col(pixels), lambda a, b: F.abs(b - a))).drop("_before")


def motion_magnitude(differences: DataFrame, by: list[str]) -> DataFrame:
    """Adds motion, the mean of `difference` (first frame 0), and motion_scaled, its share of the video's greatest."""
    mean = F.aggregate("difference", F.lit(0.0), lambda a, x: a + x) / F.size("difference")
    moved = differences.withColumn("motion", F.coalesce(mean, F.lit(0.0)))
    most = F.max("motion").over(Window.partitionBy(*by))
    return moved.withColumn("motion_scaled", F.when(most > 0, F.col("motion") / most).otherwise(0.0))


def stack_clips(clips: DataFrame, pixels: DataFrame, batch_bytes: int = 16 << 20) -> DataFrame:
    """key, rgb (T,3,H,W) and diff (T-1,3,H,W) bytes of clips (key, source_keys) from frames (key, image HWC bytes, height, width).

    Source keys meet their pixels in one join; a clip's frames are then dealt to one task and sorted, and clips are stacked as
    their frames go by: one clip and an Arrow batch are in memory together, and clips leave in batches of about `batch_bytes`.
    """
    wanted = clips.select(F.col("key").alias("clip"), F.posexplode("source_keys").alias("t", "key"))
    joined = wanted.join(pixels.select("key", "image", "height", "width"), "key").select("clip", "t", "height", "width", "image")
    schema = pa.schema([("key", pa.string()), ("length", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("diff", pa.binary())])

    def stacked(clip: str, h: int, w: int, own: list[bytes]) -> dict:
        rgb = np.stack([np.frombuffer(x, np.uint8).reshape(h, w, 3).transpose(2, 0, 1) for x in own])
        diff = np.abs(np.diff(rgb.astype(np.int16), axis=0)).astype(np.uint8)
        return {"key": clip, "length": len(own), "height": h, "width": w, "rgb": rgb.tobytes(), "diff": diff.tobytes()}

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("clip", "height", "width", "image")), strict=True))
        for clip, frames in itertools.groupby(rows, lambda row: row[0]):
            (_, h, w, image), *others = frames
            out.append(stacked(clip, h, w, [image, *(x[3] for x in others)]))
            size += len(out[-1]["rgb"]) + len(out[-1]["diff"])
            if size >= batch_bytes or len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    placed = joined.repartition("clip").sortWithinPartitions("clip", "t")
    return placed.mapInArrow(stack, "key string, length int, height int, width int, rgb binary, diff binary")


def validate_clips(samples: DataFrame, clip_len: int | None = None) -> DataFrame:
    """Adds `error`, null for samples whose parts are there and whose lengths agree with each other and with `clip_len`."""
    frame = 3 * F.col("height") * F.col("width")
    error = F.when(F.col("rgb").isNull(), "missing rgb").when(F.col("diff").isNull(), "missing diff").when(F.col("length") < 2, "too short")
    error = error.when(F.length("rgb") != F.col("length") * frame, "rgb size").when(F.length("diff") != (F.col("length") - 1) * frame, "diff size")
    return samples.withColumn("error", error if clip_len is None else error.when(F.col("length") != clip_len, "clip length"))


def require_valid(validated: DataFrame) -> DataFrame:
    """Evaluation mode: a bad sample is an error."""
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("key"), F.lit(": "), F.col("error"))).cast("string")).otherwise(F.col("key"))
    return validated.withColumn("key", checked).drop("error")


def augment_parameters(seed: int, epoch: int, key: str = "key") -> dict[str, Column]:
    """flip, contrast and brightness of a clip from a hash of key, seed and epoch, so that a retry gives the same."""
    share = lambda k: draw(key, F.lit(seed), F.lit(epoch), F.lit(k)) / float(1 << 32)
    return {"flip": share(0) < 0.5, "contrast": 0.8 + 0.4 * share(1), "brightness": (share(2) - 0.5) * 40.0}


def augmented(rgb: np.ndarray, flip: bool, contrast: float, brightness: float) -> np.ndarray:
    """One clip (T,3,H,W): mirrored, contrast about each frame's channel means, brightness, clamped."""
    out = (rgb[..., ::-1] if flip else rgb).astype(np.float64)
    mean = out.mean(axis=(2, 3), keepdims=True)
    return np.clip((out - mean) * contrast + mean + brightness, 0, 255).round().astype(np.uint8)


def prepare_clips(samples: DataFrame, training: bool = False, seed: int = 0, epoch: int = 0) -> DataFrame:
    """key, spatial (3,H,W) and temporal (T-1,3,H,W) little-endian floats of valid samples with spatial_index.

    Training augments a clip with one set of parameters and takes the differences again.
    """
    frames = samples.select("key", "length", "height", "width", "rgb", "spatial_index")
    for name, column in (augment_parameters(seed, epoch) if training else {"flip": F.lit(False), "contrast": F.lit(1.0), "brightness": F.lit(0.0)}).items():
        frames = frames.withColumn(name, column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            spatial, temporal = [], []
            for r in rows.itertuples(index=False):
                rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.length, 3, r.height, r.width)
                if training:
                    rgb = augmented(rgb, r.flip, r.contrast, r.brightness)
                spatial.append(((rgb[r.spatial_index].astype(np.float32) / 255 - MEAN[:, None, None]) / STD[:, None, None]).astype("<f4").tobytes())
                temporal.append((np.abs(np.diff(rgb.astype(np.int16), axis=0)).astype(np.float32) / 255).astype("<f4").tobytes())
            yield pd.DataFrame({"key": rows["key"], "spatial": spatial, "temporal": temporal})

    return frames.mapInPandas(run, "key string, spatial binary, temporal binary")


def batch_samples(samples: DataFrame, size: int, drop_last: bool = False, shard: str = "shard", order: str = "key") -> DataFrame:
    """Batches of `size` samples within each shard, in order: shard, batch, keys."""
    row = F.row_number().over(Window.partitionBy(shard).orderBy(order))
    batches = samples.withColumn("batch", F.floor((row - 1) / size)).groupBy(shard, "batch").agg(F.array_sort(F.collect_list(order)).alias("keys"))
    return batches.filter(F.size("keys") == size) if drop_last else batches


#: Leading hex digits of a shuffled key that name its range: 4096 ranges.
RANGE_DIGITS = 3


def shuffle_key(seed: int, epoch: int, key: str = "key") -> Column:
    """The place of a key in the permutation of an epoch, as 32 hex digits: the same on every run and machine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")).cast("binary"))


def seeded_shuffle(samples: DataFrame, seed: int, epoch: int, key: str = "key") -> DataFrame:
    """A full permutation by a hash of seed, epoch and key."""
    return samples.orderBy(shuffle_key(seed, epoch, key), key)


def shuffle_ranges(samples: DataFrame, seed: int, epoch: int, key: str = "key") -> DataFrame:
    """range, n, before: the samples in each range of the permutation and in those before it; at most 4096 rows.

    This is all that a restart needs to know of an epoch; it can be kept with the checkpoint.
    """
    named = samples.select(F.substring(shuffle_key(seed, epoch, key), 1, RANGE_DIGITS).alias("range"))
    counted = named.groupBy("range").agg(F.count("*").alias("n"))
    return counted.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n"))


def shuffle_ranks(samples: DataFrame, seed: int, epoch: int, key: str = "key", ranges: DataFrame | None = None, first: int = 0, stop: int | None = None) -> DataFrame:
    """Samples with `rank`, their 0-based place in the permutation, from rank `first` up to `stop` (not included; None: the end).

    A rank is the place in a range and the samples in the ranges before. Ranges that lie outside fall before anything is
    sorted, so a stretch of an epoch costs a scan of the keys and the sorting of what it touches.
    """
    counted = shuffle_ranges(samples, seed, epoch, key) if ranges is None else ranges
    inside = F.col("before") + F.col("n") > first
    touched = counted.filter(inside if stop is None else inside & (F.col("before") < stop)).select("range", "before")
    placed = samples.withColumn("_at", shuffle_key(seed, epoch, key)).withColumn("range", F.substring("_at", 1, RANGE_DIGITS))
    joined = placed.join(touched, "range")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("_at", key)) - 1
    ranked = joined.withColumn("rank", rank.cast("long")).filter(F.col("rank") >= first).select(*samples.columns, "rank")
    return ranked if stop is None else ranked.filter(F.col("rank") < stop)


def shuffled_batches(samples: DataFrame, size: int, seed: int, epoch: int, key: str = "key", ranges: DataFrame | None = None, first: int = 0, stop: int | None = None, drop_last: bool = False) -> DataFrame:
    """batch, keys (in order) of the batches `first` .. `stop` - 1 of an epoch; batches run over shards.

    A run that died after some batches goes on with the next one: its batches are those it would have had. A last batch
    that is not full is left out with `drop_last`.
    """
    ranked = shuffle_ranks(samples.select(key), seed, epoch, key, ranges, first * size, None if stop is None else stop * size)
    grouped = ranked.groupBy(F.floor(F.col("rank") / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("key")))), lambda x: x["key"]).alias("keys"))
    return grouped.filter(F.size("keys") == size) if drop_last else grouped


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    place = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = place(height, image.shape[0]), place(width, image.shape[1])
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    pixels = image.astype(np.float64)
    top = pixels[y0][:, x0] * (1 - fx) + pixels[y0][:, x1] * fx
    bottom = pixels[y1][:, x0] * (1 - fx) + pixels[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)


def crop_pixels(images: DataFrame, out_height: int = 224, out_width: int = 224) -> DataFrame:
    """key, status and crop (HWC bytes) of images (key, image HWC bytes, height, width, crop_box); no box is crop_fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            crops = []
            for r in rows.itertuples(index=False):
                if r.crop_box is None or r.image is None:
                    crops.append(None)
                    continue
                x1, y1, x2, y2 = r.crop_box
                part = np.frombuffer(r.image, np.uint8).reshape(r.height, r.width, 3)[y1:y2, x1:x2]
                crops.append(resized(part, out_height, out_width).tobytes() if part.size else None)
            yield pd.DataFrame({"key": rows["key"], "status": ["crop_fail" if c is None else "ok" for c in crops], "crop": crops})

    return images.select("key", "image", "height", "width", "crop_box").mapInPandas(run, "key string, status string, crop binary")
