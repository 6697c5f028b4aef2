"""Resume, clip building and status as Structured Streaming jobs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def stream_new_samples(samples: DataFrame, audit_path: str, out_path: str, checkpoint: str, time: str = "ts") -> StreamingQuery:
    """Each key once, however late or often it comes: an anti-join on the audit, which then grows.

    The audit lies in a folder for each day of `time`, and a batch reads those of its own days only: a sample that comes
    again has the time it had, so the audit's age costs nothing. Samples without a time have a day of their own. Rows of one batch are written
    under its name, so a batch that is run again replaces what it wrote; a stream with another checkpoint has names of its own.
    """
    day = F.coalesce(F.to_date(time).cast("string"), F.lit("none"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"{zlib.crc32(checkpoint.encode()):08x}-{batch_id}"
        dated = batch.dropDuplicates(["key"]).withColumn("day", day)
        days = [r.day for r in dated.select("day").distinct().collect()]
        # a batch that is run again finds its own audit rows of the attempt before and keeps those samples
        try:
            kept = spark.read.schema("key string, status string, day string, batch string").parquet(audit_path)
            done = kept.filter(F.col("day").isin(days) & (F.col("batch") != name)).select("key")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            done = None
        new = dated if done is None else dated.join(done, "key", "left_anti")
        new.withColumn("batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path)
        written = spark.read.parquet(out_path).filter(F.col("batch") == name)
        written.select(F.col("key").cast("string").alias("key"), F.lit("complete").alias("status"), F.col("day").cast("string").alias("day"), "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(audit_path)

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_status(audit: DataFrame) -> DataFrame:
    """Running number of completed videos per category and split (update mode)."""
    return audit.filter(F.lower(F.trim("status")) == "complete").groupBy("category", "split").agg(F.count("*").alias("completed"))


def stream_hourly_status(audit: DataFrame, time: str = "updated_at", late: str = "1 hour") -> DataFrame:
    """Completed videos per hour (append mode: an hour comes out once the watermark has passed it)."""
    done = audit.filter(F.lower(F.trim("status")) == "complete").withWatermark(time, late)
    return done.groupBy(F.window(time, "1 hour").alias("hour"), "category").agg(F.count("*").alias("completed"))


CLIPS = "video string, key string, clip_id long, clip_start long, frame_numbers array<long>, source_keys array<string>, late boolean"


class ClipBuilder(StatefulProcessor):
    """Clips of a video as its frames come in order: the last frames, the next start and the next number are the state.

    A frame at or below the last one seen is late: it comes out by itself, marked so. Metadata only, never pixels.
    """

    def __init__(self, clip_len: int = 8, clip_stride: int = 6, frame_stride: int = 1):
        self.clip_len, self.clip_stride, self.frame_stride = clip_len, clip_stride, frame_stride
        self.need = (clip_len - 1) * frame_stride + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getListState("frames", "n long, key string")
        self.at = handle.getValueState("at", "position long, clip long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from made(self.advanced(key[0], sorted((int(r.frame_number), r.key) for batch in rows for r in batch.itertuples(index=False))))

    def advanced(self, video: str, rows: list[tuple[int, str]]) -> list[tuple]:
        """Clips and late frames of further frames, which are in order."""
        position, clip, last = self.at.get() if self.at.exists() else (0, 0, -1)
        held = list(self.frames.get())
        out = []
        for n, name in rows:
            if n <= last:
                out.append(late_frame(video, n, name))
                continue
            last = n
            held.append((n, name))
            position += 1
            start = position - self.need
            if start < 0:
                continue
            window = held[-self.need :: self.frame_stride]
            if start % self.clip_stride == 0 and all(b[0] - a[0] == self.frame_stride for a, b in zip(window[:-1], window[1:], strict=True)):
                out.append((video, f"{video}/clip_{clip:06d}", clip, start, [x[0] for x in window], [x[1] for x in window], False))
                clip += 1
            held = held[-(self.need - 1) :]
        self.frames.put(held)
        self.at.update((position, clip, last))
        return out

    def close(self) -> None:
        pass


def late_frame(video: str, n: int, key: str) -> tuple:
    return video, None, None, None, [n], [key], True


def made(out: list[tuple]) -> Iterator[pd.DataFrame]:
    if out:
        yield pd.DataFrame(out, columns=["video", "key", "clip_id", "clip_start", "frame_numbers", "source_keys", "late"])


class TimedClipBuilder(ClipBuilder):
    """Frames wait, in any order, until the watermark has passed them, and then go into clips in order of their number.

    A frame that the watermark passed before it came is late. A video of which nothing has come for `idle` milliseconds of
    event time behind its last frame loses its state; frames that still come for it are a new video.
    """

    def __init__(self, clip_len: int, clip_stride: int, frame_stride: int, idle: int):
        super().__init__(clip_len, clip_stride, frame_stride)
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, n long, key string")
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        frames = [(None if pd.isna(r.at_ms) else int(r.at_ms), int(r.frame_number), r.key) for batch in rows for r in batch.itertuples(index=False)]
        new = [f for f in frames if f[0] is not None and f[0] > passed]
        if new:
            newest = max(at for at, _, _ in new)
            self.waiting.appendList(new)
            self.newest.update((max(newest, self.newest.get()[0]) if self.newest.exists() else newest,))
            self.handle.registerTimer(min(at for at, _, _ in new))
        yield from made([late_frame(key[0], n, name) for at, n, name in frames if at is None or at <= passed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [f for f in waiting if f[0] <= passed]
        if ready:
            rest = [f for f in waiting if f[0] > passed]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(at for at, _, _ in rest))
            else:
                self.waiting.clear()
            yield from made(self.advanced(key[0], sorted((n, name) for _, n, name in ready)))
            waiting = rest
        if not waiting and self.newest.exists():
            gone = self.newest.get()[0] + self.idle
            if gone <= passed:
                for state in (self.frames, self.at, self.waiting, self.newest):
                    state.clear()
            elif ready:
                self.handle.registerTimer(gone)


def stream_clips(frames: DataFrame, clip_len: int = 8, clip_stride: int = 6, frame_stride: int = 1, time: str | None = None, delay: str = "1 hour", idle_seconds: float = 86_400) -> DataFrame:
    """Clips of a stream of frames (video, frame_number, key), every `frame_stride`-th frame of a window; needs the RocksDB state store.

    Without `time` the frames of a video must come in order, and its state stays. With it, the name of a timestamp column, frames may be `delay`
    late: they come out in clips once the watermark has passed them, those that come later still are marked late (so are
    frames without a time), and the state of a video goes `idle_seconds` of event time after its last frame.
    """
    if time is None:
        return frames.groupBy("video").transformWithStateInPandas(statefulProcessor=ClipBuilder(clip_len, clip_stride, frame_stride), outputStructType=CLIPS, outputMode="Append", timeMode="None")
    # the time goes on as a number: late rows are the processor's to report, and Spark would drop those of a time column
    timed = frames.withWatermark(time, delay).select("video", "frame_number", "key", F.unix_millis(time).alias("at_ms"))
    builder = TimedClipBuilder(clip_len, clip_stride, frame_stride, int(idle_seconds * 1000))
    return timed.groupBy("video").transformWithStateInPandas(statefulProcessor=builder, outputStructType=CLIPS, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

