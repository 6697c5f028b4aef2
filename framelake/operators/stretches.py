"""Sequence operators on long videos: positions from one range sort, and stretches of positions with border rows.

A window over a video puts it into one task. Here its frames are sorted once by ranges, so that a long video lies in many
tasks; a position is the place in a range and the rows of the video in the ranges before. From then on a stretch of
positions is a partition of its own, and takes along the few rows of its neighbours that its windows reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.staging import scratch

#: Positions of a stretch.
STRETCH = 8192
#: Low bits of a row's number: its place in its partition.
PLACE_BITS = 33


def with_position(frames: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds pos, the 0-based place of the frame in its video, and frames_in_video, as `detections.with_position` does.

    Frames with equal `order` stand in any order. The sorted rows are written to the shared folder once: their numbers must
    not change between counting and use.
    """
    spark = frames.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc(c) for c in [*by, *order]]
    path = scratch(spark, "sorted_frames")
    frames.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright("_at", PLACE_BITS).alias("_part")
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a row for each range that holds a part of the video
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "frames_in_video": F.sum("_n").over(Window.partitionBy(*by))})
    joined = together(rows.withColumn("_part", part), known, [*by, "_part"])
    return joined.select(*frames.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "frames_in_video")


def together(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null; the right ones are dropped."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on], how).drop(*[f"_right_{c}" for c in on])


def stretch_of(size: int) -> Column:
    return F.floor(F.col("pos") / size).cast("long")


def bordered(positioned: DataFrame, reach: int, size: int = STRETCH) -> DataFrame:
    """Rows with their stretch `_stretch`, and the first `reach` rows of each stretch once more in the one before (`_border`)."""
    if reach > size:
        raise ValueError("a window may not reach over a whole stretch")
    own = stretch_of(size)
    border = (F.col("pos") % size < reach) & (own > 0)
    copies = F.when(border, F.array(own, own - 1)).otherwise(F.array(own))
    return positioned.withColumn("_stretch", F.explode(copies)).withColumn("_border", F.col("_stretch") < own)


def carried(rows: DataFrame, by: list[str], value: Column, name: str, size: int = STRETCH) -> DataFrame:
    """Adds the last value before (`last_<name>`) and the first one after (`next_<name>`) each row; null values are passed over.

    `rows` have pos. Stretches look into themselves; what comes from others is the last or first value of those, a row for
    each stretch.
    """
    placed = rows.withColumns({"_stretch": stretch_of(size), "_value": value})
    inside = Window.partitionBy(*by, "_stretch").orderBy("pos")
    ends = placed.filter("_value is not null").groupBy(*by, "_stretch").agg(F.max_by("_value", "pos").alias("_last"), F.min_by("_value", "pos").alias("_first"))
    stretches = together(placed.select(*by, "_stretch").distinct(), ends, [*by, "_stretch"], "left")
    across = Window.partitionBy(*by).orderBy("_stretch")
    outside = stretches.select(
        *by,
        "_stretch",
        F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_from_before"),
        F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_from_after"),
    )
    seen = placed.withColumns(
        {
            f"last_{name}": F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
            f"next_{name}": F.first("_value", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    joined = together(seen, outside, [*by, "_stretch"])
    filled = joined.withColumns({f"last_{name}": F.coalesce(f"last_{name}", "_from_before"), f"next_{name}": F.coalesce(f"next_{name}", "_from_after")})
    return filled.drop("_stretch", "_value", "_from_before", "_from_after")


def ranked(rows: DataFrame, by: list[str], order: str, name: str, size: int = STRETCH) -> DataFrame:
    """Adds the 0-based rank of each row in its group by `order`, a position: rows before in its stretch and in those before."""
    placed = rows.withColumn("_part", F.floor(F.col(order) / size).cast("long"))
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy(order)
    return together(placed.withColumn("_rank", F.row_number().over(inside) - 1), known, [*by, "_part"]).withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")
