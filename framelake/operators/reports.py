"""Counts and reports over manifests, frames and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.text import SPLITS, normalize_split, text


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """Videos in all, per split and per category; the other column is null."""
    split, category = F.col("split"), F.col("category")
    return manifest.groupingSets([[split], [category], []], "split", "category").agg(F.count("*").alias("n"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.2f%%", 100.0 * part / whole)).otherwise("0.00%")


def split_report(manifest: DataFrame) -> DataFrame:
    """Per split the number and share of videos; a split other than train, val and test is `missing`."""
    counted = manifest.select(normalize_split("split", "missing").alias("split")).groupBy("split").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))


def category_split_report(manifest: DataFrame) -> DataFrame:
    """Per category the total, and number and share of each split; blank categories are `missing`."""
    category = F.when(text("category") == "", "missing").otherwise(text("category"))
    wide = manifest.select(category.alias("category"), normalize_split("split", "missing").alias("split")).groupBy("category").pivot("split", [*SPLITS, "missing"]).count()
    names = [*SPLITS, "missing"]
    filled = wide.select("category", *[F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in names])
    total = sum((F.col(s) for s in names[1:]), F.col(names[0]))
    return filled.withColumn("total", total).withColumns({f"{s}_pct": percent(F.col(s), F.col("total")) for s in names})


def status_report(frames: DataFrame, by: list[str]) -> DataFrame:
    """Per category: videos, frames, detected frames, and videos fully, partly and not detected (column `detected` 0/1)."""
    videos = frames.groupBy("category", *by).agg(F.count("*").alias("frames"), F.sum(F.col("detected").cast("long")).alias("detected"))
    full, none = F.col("detected") == F.col("frames"), F.col("detected") == 0
    return videos.groupBy("category").agg(
        F.count("*").alias("videos"),
        F.sum("frames").alias("frames"),
        F.sum("detected").alias("detected"),
        F.count_if(full).alias("fully_detected"),
        F.count_if(~full & ~none).alias("partially_detected"),
        F.count_if(none).alias("not_detected"),
    )


def pipeline_status(manifest: DataFrame, frames: DataFrame, audit: DataFrame, shards: DataFrame, files: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """How far detection has come, as rows (metric, category, n); category is null for metrics over all.

    `manifest`: category, video. `frames`: category, video, key, and frame_path if `files` (frame_path) is given. `audit`
    and `shards`: keys of finished samples. `split` keeps manifest and frame rows of that split. Videos and keys count
    once however often they are listed; a frame is detected if the audit or a shard holds its key.
    """
    if split is not None:
        manifest, frames = (x.filter(normalize_split("split") == split.strip().lower()) for x in (manifest, frames))
    # a bit for the audit, one for the shards, and beside them the rows of each frame: one grouping by key
    done = (F.col("_done").bitwiseAND(3) != 0) & F.col("key").isNotNull()
    marks = [x.select("key", F.lit(None).cast("struct<category:string,video:string>").alias("_frame"), F.lit(bit).alias("_bit")) for bit, x in ((1, audit), (2, shards))]
    rows = frames.select("key", F.struct(text("category").cast("string").alias("category"), F.col("video").cast("string").alias("video")).alias("_frame"), F.lit(0).alias("_bit"))
    counted = rows.unionByName(marks[0]).unionByName(marks[1]).groupBy("key", "_frame").agg(F.count("*").alias("_n"), F.bit_or("_bit").alias("_bit"))
    # what has the key may be a frame, or several, and marks: few rows each
    keys = counted.groupBy("key").agg(F.bit_or("_bit").alias("_done"), F.collect_list(F.when(F.col("_frame").isNotNull(), F.struct("_frame", "_n"))).alias("_frames"))
    named = lambda metric, n: F.struct(F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("category"), n.alias("n"))
    stacked = lambda df, metrics: df.agg(F.array(*[named(m, n) for m, n in metrics.items()]).alias("_m")).select(F.inline("_m"))
    marked = keys.select("key", done.cast("long").alias("_done"), F.explode("_frames").alias("_f")).select("key", "_done", "_f._frame.category", "_f._frame.video", "_f._n")
    # a key counts once in a video, whatever categories its rows name
    videos = marked.select("video", "key", "_done").distinct().groupBy("video").agg(F.count("*").alias("keys"), F.sum("_done").alias("found"))
    listed = manifest.select(F.col("video").cast("string").alias("video")).distinct().withColumn("_listed", F.lit(True))
    known = videos.withColumn("_v", F.lit(True)).join(listed, "video", "full_outer")
    full, own = F.col("found") == F.col("keys"), F.col("_v").isNotNull()
    count = F.count_if
    by_category = lambda df, metric, n: df.groupBy("category").agg(n.alias("n")).select(F.lit(metric).alias("metric"), "category", "n")
    parts = [
        stacked(
            known,
            {
                "manifest_videos": count(F.col("_listed").isNotNull()),
                "videos_without_frames": count(F.col("_listed").isNotNull() & ~own),
                "videos_with_frames": count(own),
                "detected_frames": F.coalesce(F.sum("found"), F.lit(0)),
                "videos_with_detections": count(F.col("found") > 0),
                "fully_detected": count(own & full),
                "partially_detected": count(own & ~full & (F.col("found") > 0)),
                "not_detected": count(F.col("found") == 0),
            },
        ),
        stacked(keys, {"audit_keys": count(F.col("_done").bitwiseAND(1) != 0), "shard_keys": count(F.col("_done").bitwiseAND(2) != 0), "frame_rows": F.coalesce(F.sum(F.aggregate("_frames", F.lit(0).cast("long"), lambda a, x: a + x["_n"])), F.lit(0))}),
        by_category(manifest.select(text("category").alias("category")), "manifest_videos", F.count("*")),
        by_category(marked, "frame_rows", F.sum("_n")),
        by_category(marked.filter("_done = 1"), "detected_frames", F.sum("_n")),
    ]
    if files is not None:
        parts.append(stacked(frames.join(files.select("frame_path").distinct(), "frame_path", "left_anti"), {"missing_frame_files": F.count("*")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def subset_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("category").agg(F.countDistinct("video_id").alias("videos"), F.count("*").alias("frames"))


def count_clips(members: DataFrame) -> DataFrame:
    """Per split and in total (null): shards, and distinct samples with a JSON part. `members`: split, shard, key, suffix."""
    return members.groupingSets([[F.col("split")], []], "split").agg(F.countDistinct("shard").alias("shards"), F.countDistinct(F.when(F.col("suffix") == "json", F.col("key"))).alias("clips"))


def batch_count(n: Column, size: int, drop_last: bool = False) -> Column:
    return (F.floor(n / size) if drop_last else F.ceil(n / size)).cast("long")


def class_balance(samples: DataFrame, by: list[str] | None = None, invert: bool = False, max_pos_weight: float | None = None) -> DataFrame:
    """Numbers of each class (label 0/1) and the positives' weight: raw neg / pos, and capped; null if a class is empty."""
    label = 1 - F.col("label") if invert else F.col("label")
    counts = samples.groupBy(*(by or [])).agg(F.count_if(label == 0).alias("negative_count"), F.count_if(label == 1).alias("positive_count"))
    raw = F.when((F.col("negative_count") > 0) & (F.col("positive_count") > 0), F.col("negative_count") / F.col("positive_count"))
    effective = raw if max_pos_weight is None else F.when(raw.isNotNull(), F.least(raw, F.lit(float(max_pos_weight))))
    return counts.withColumns({"raw_pos_weight": raw, "effective_pos_weight": effective})


def number_words(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group its frame numbers as bits of words: word (number // 64), bits, and the rows that name one of these numbers.

    Rows of a group that lie near one another are one row before the shuffle. Rows without a number have no word.
    """
    n = F.col("frame_number").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(63).cast("int"))
    return rows.select(*by, F.shiftright(n, 6).alias("word"), bit.alias("_bit")).groupBy(*by, "word").agg(F.bit_or("_bit").alias("bits"), F.count("*").alias("rows"))


def word_facts() -> dict[str, Column]:
    """Of each row of `number_words`: how many different numbers it stands for, its word, and its last number."""
    return {"different": F.bit_count("bits"), "first": F.col("word"), "last": F.col("word") * 64 + F.length(F.bin("bits")) - 1}


def exact_numbers() -> Column:
    """Whether numbers are 0 .. rows - 1, each once: by sums of `rows` and `different`, the least `first` and the greatest `last`."""
    # so many different numbers from 0 to the last are all of them
    return F.coalesce((F.col("different") == F.col("rows")) & (F.col("first") >= 0) & (F.col("last") == F.col("rows") - 1), F.lit(False))


def exactly_numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group the number of rows, and whether their frame numbers are exactly 0 .. rows - 1, each once."""
    facts = word_facts()
    own = number_words(rows, by).groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum(facts["different"]).alias("different"), F.min(facts["first"]).alias("first"), F.max(facts["last"]).alias("last"))
    return own.select(*by, "rows", exact_numbers().alias("whole"))


def metadata_complete(frames: DataFrame, expected: DataFrame, by: list[str], files: DataFrame | None = None) -> DataFrame:
    """Per video of `expected` (column expected): whether its frame numbers are exactly 0 .. expected - 1, each once.

    With `files` (by, frame_number) the numbers of its files must be so, too; their number is the column `files`.
    """

    def part(rows: DataFrame, name: str) -> DataFrame:
        return exactly_numbered(rows, by).select(*by, F.col("rows").alias(name), F.col("whole").alias(f"_{name}"))

    def good(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}") & (F.col(name) == F.col("expected")), F.col("expected") == 0)

    joined = expected.join(part(frames, "rows"), by, "left")
    count = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    if files is None:
        return joined.select(*by, "expected", count("rows"), good("rows").alias("complete"))
    both = joined.join(part(files.select(*by, "frame_number").distinct(), "files"), by, "left")
    return both.select(*by, "expected", count("rows"), count("files"), (good("rows") & good("files")).alias("complete"))


def first_per_group(samples: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, by aggregation rather than by a sorted window."""
    rest = [c for c in samples.columns if c not in by]
    return samples.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def cap_per_category(videos: DataFrame, n: int, order: list[str]) -> DataFrame:
    return videos.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def first_n_missing(keys: DataFrame, n: int = 20) -> DataFrame:
    return keys.orderBy("key").limit(n)
