"""Queries that run as streams over the files there are, and give what the batch would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans import bindings as B
from framelake.plans.registry import query
from framelake.sources.staging import scratch
from framelake.streaming import streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream."""
    schema = B.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, spark: SparkSession, mode: str = "append", places: tuple[str, str] | None = None) -> DataFrame:
    """All rows that a stream gives until its input ends; in update and complete mode the last of each batch.

    `places`: folders of the output and the checkpoint, for a stream that goes on from where it ended.
    """
    out, checkpoint = places or (scratch(spark, "stream"), scratch(spark, "checkpoint"))
    write = lambda batch, n: batch.withColumn("batch_id", F.lit(n)).write.mode("append").parquet(out)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT DISTINCT (event_id // 2)::VARCHAR AS key FROM events")
def r1_stream_new_samples(spark, sf_dir):
    keyed = event_stream(spark, sf_dir).select(F.floor(F.col("event_id") / 2).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    audit, out = scratch(spark, "audit"), scratch(spark, "samples")
    streams.stream_new_samples(keyed, audit, out, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("key")


@query("SELECT event_id::VARCHAR AS key FROM events WHERE ts IS NOT NULL")
def r1_replayed_samples(spark, sf_dir):
    """All samples delivered twice, and read by two streams: the audit's days know them."""
    path = scratch(spark, "delivered")
    rows = B.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    audit, out = scratch(spark, "audit"), scratch(spark, "samples")
    for _ in range(2):
        rows.write.mode("append").parquet(path)
        delivered = spark.readStream.schema("key string, ts timestamp").parquet(path)
        streams.stream_new_samples(delivered, audit, out, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("key")


@query("SELECT 'cat' || (user_id % 5) AS category, 'train' AS split, count(*)::BIGINT AS completed FROM events WHERE event_type <> 'error' GROUP BY 1")
def r3_stream_status(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").otherwise(" Complete")
    audit = event_stream(spark, sf_dir).select(F.concat(F.lit("cat"), F.col("user_id") % 5).alias("category"), F.lit("train").alias("split"), status.alias("status"))
    rows = drained(streams.stream_status(audit), spark, "complete")
    last = rows.groupBy().agg(F.max("batch_id").alias("last"))
    return rows.join(F.broadcast(last), rows.batch_id == last.last).select("category", "split", "completed")


@query(
    """SELECT video_id AS video, (row_number() OVER (PARTITION BY video_id ORDER BY clip_start) - 1)::BIGINT AS clip_id, clip_start::BIGINT AS clip_start, nums[1]::BIGINT AS first FROM o WHERE clip_start % 6 = 0 AND len(nums) = 8 AND nums[8] - nums[1] = 7""",
    B.KEPT + ", o AS (SELECT video_id, row_number() OVER w - 1 AS clip_start, array_agg(frame_number) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS nums FROM kept WINDOW w AS (PARTITION BY video_id ORDER BY frame_number))",
)
def r2_stream_clips(spark, sf_dir):
    """Frames are numbered in batch, written as files, and read again as a stream."""
    path = scratch(spark, "frames")
    B.kept_frames(spark, sf_dir).select(F.col("video_id").alias("video"), "frame_number", "key").write.parquet(path)
    streams.use_rocksdb(spark)
    frames = spark.readStream.schema("video string, frame_number long, key string").parquet(path)
    out = drained(streams.stream_clips(frames), spark)
    return out.filter(~F.col("late")).select("video", "clip_id", "clip_start", F.col("frame_numbers")[0].alias("first"))


@query(
    """SELECT video_id AS video, (row_number() OVER (PARTITION BY video_id ORDER BY clip_start) - 1)::BIGINT AS clip_id, clip_start::BIGINT AS clip_start, array_to_string([nums[1], nums[3], nums[5]], ',') AS frame_numbers FROM o WHERE clip_start % 4 = 0 AND len(nums) = 5 AND nums[3] - nums[1] = 2 AND nums[5] - nums[3] = 2""",
    B.KEPT + ", o AS (SELECT video_id, row_number() OVER w - 1 AS clip_start, array_agg(frame_number) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS nums FROM kept WINDOW w AS (PARTITION BY video_id ORDER BY frame_number))",
)
def r2_stream_strided_clips(spark, sf_dir):
    """Every second frame of each window."""
    path = scratch(spark, "frames")
    B.kept_frames(spark, sf_dir).select(F.col("video_id").alias("video"), "frame_number", "key").write.parquet(path)
    streams.use_rocksdb(spark)
    frames = spark.readStream.schema("video string, frame_number long, key string").parquet(path)
    out = drained(streams.stream_clips(frames, clip_len=3, clip_stride=4, frame_stride=2), spark)
    return out.filter(~F.col("late")).select("video", "clip_id", "clip_start", F.array_join(F.col("frame_numbers").cast("array<string>"), ",").alias("frame_numbers"))


#: Parts that the frames arrive in; every third frame arrives up to 50 minutes after its time.
ARRIVALS = 5
ARRIVED = B.KEPT + """, a AS (SELECT *, epoch_ms(ts) AS at_ms, epoch_ms(ts) + CASE WHEN event_id % 3 = 0 THEN (event_id % 50) * 60000 ELSE 0 END AS came FROM kept),
 s AS (SELECT min(came) AS lo, max(came) AS hi FROM a), p AS (SELECT a.*, least(((came - lo) * 5) // greatest(hi - lo, 1), 4) AS part FROM a, s)"""


def arrived_clips(spark: SparkSession, sf_dir: str, delay: str) -> DataFrame:
    """Clips of frames that arrive in parts: the stream goes on for each part, which is one batch of as many files as tasks wrote."""
    staged, path = scratch(spark, "arriving"), scratch(spark, "frames")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    came = at + F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50 * 60000).otherwise(0)
    # frames are numbered once
    B.kept_frames(spark, sf_dir).select(F.col("video_id").alias("video"), "frame_number", "key", F.col("ts").cast("timestamp").alias("ts"), came.alias("came")).write.parquet(staged)
    rows = spark.read.parquet(staged)
    ends = rows.agg(F.min("came").alias("lo"), F.max("came").alias("hi")).first()
    part = F.least(F.floor((F.col("came") - ends.lo) * ARRIVALS / max(ends.hi - ends.lo, 1)), F.lit(ARRIVALS - 1))
    places = scratch(spark, "stream"), scratch(spark, "checkpoint")
    for k in range(ARRIVALS):
        rows.filter(part == k).drop("came").write.mode("append").parquet(path)
        frames = spark.readStream.schema("video string, frame_number long, key string, ts timestamp").parquet(path)
        out = drained(streams.stream_clips(frames, time="ts", delay=delay, idle_seconds=10**9), spark, places=places)
    return out


@query(
    """SELECT video_id AS video, (row_number() OVER (PARTITION BY video_id ORDER BY clip_start) - 1)::BIGINT AS clip_id, clip_start::BIGINT AS clip_start, array_to_string(keys, ',') AS source_keys FROM o WHERE clip_start % 6 = 0 AND len(nums) = 8 AND nums[8] - nums[1] = 7""",
    ARRIVED + """, passed AS (SELECT * FROM p WHERE at_ms <= (SELECT max(at_ms) FROM p) - 3600000),
 o AS (SELECT video_id, row_number() OVER w - 1 AS clip_start, array_agg(frame_number) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS nums, array_agg(key) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS keys FROM passed WINDOW w AS (PARTITION BY video_id ORDER BY frame_number))""",
)
def r2_out_of_order_clips(spark, sf_dir):
    """Frames that come within the hour of the watermark, in any order, give the clips of the batch up to the watermark."""
    streams.use_rocksdb(spark)
    out = arrived_clips(spark, sf_dir, "1 hour")
    return out.filter(~F.col("late")).select("video", "clip_id", "clip_start", F.array_join("source_keys", ",").alias("source_keys"))


@query("SELECT video_id AS video, key FROM p WHERE at_ms <= (SELECT max(q.at_ms) FROM p q WHERE q.part < p.part) - 300000", ARRIVED)
def r2_late_frames(spark, sf_dir):
    """With five minutes of patience, the frames that come after the watermark has passed them."""
    streams.use_rocksdb(spark)
    out = arrived_clips(spark, sf_dir, "5 minutes")
    return out.filter("late").select("video", F.col("source_keys")[0].alias("key"))


@query(
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, 'cat' || (user_id % 5) AS category, count(*)::BIGINT AS completed FROM events WHERE event_type <> 'error'
    AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type <> 'error') GROUP BY 1, 2"""
)
def r3_hourly_status(spark, sf_dir):
    """Hours that the watermark has passed."""
    status = F.when(F.col("event_type") == "error", "failed").otherwise("complete")
    audit = event_stream(spark, sf_dir).select(F.concat(F.lit("cat"), F.col("user_id") % 5).alias("category"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    out = drained(streams.stream_hourly_status(audit), spark)
    return out.select(F.date_format("hour.start", "yyyy-MM-dd HH").alias("hour"), "category", "completed")
