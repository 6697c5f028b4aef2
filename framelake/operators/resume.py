"""What is still to do, what is missing, and set algebra on keys."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.text import video_key
from framelake.operators.reports import exact_numbers, number_words, word_facts
from framelake.operators.sampling import expected_samples, planned, shape_plan, written_plan
from framelake.sources.staging import scratch


def completed_videos(audit: DataFrame) -> DataFrame:
    """Keys of videos that the audit calls complete, in any case."""
    return audit.filter(F.lower(F.trim("status")) == "complete").select(video_key("category", "video_id", "split").alias("video_key")).distinct()


def pending_videos(manifest: DataFrame, audit: DataFrame, resume: bool = True) -> DataFrame:
    """Videos that are not complete; all of them without `resume`."""
    if not resume:
        return manifest
    keyed = manifest.withColumn("video_key", video_key("category", "video_id", "split"))
    return keyed.join(completed_videos(audit), "video_key", "left_anti").drop("video_key")


def pending_frames(frames: DataFrame, audit_keys: DataFrame, shard_keys: DataFrame) -> DataFrame:
    """Frames whose key neither the audit nor a shard holds."""
    done = audit_keys.select("key").union(shard_keys.select("key")).distinct()
    return frames.join(done, "key", "left_anti")


def missing_frame_files(frames: DataFrame, listing: DataFrame) -> DataFrame:
    return frames.join(listing.select("frame_path").distinct(), "frame_path", "left_anti")


def tagged(by: list[str], *sources: DataFrame) -> DataFrame:
    """The distinct `by` of all sources with `sources`, a bit for each that holds it (the first is 1, the second 2 ...): one grouping."""
    parts = [s.select(*by, F.lit(1 << k).alias("sources")) for k, s in enumerate(sources)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*by).agg(F.bit_or("sources").alias("sources"))


def coverage_gaps(manifest: DataFrame, frames: DataFrame, detected: DataFrame, by: list[str]) -> DataFrame:
    """Videos of the manifest without frames, and videos with frames but without detections."""
    own = F.col("sources")
    gap = F.when(own.bitwiseAND(3) == 1, "no_frames").when(own.bitwiseAND(6) == 2, "no_detections")
    return tagged(by, manifest, frames, detected).select(*by, gap.alias("gap")).filter("gap is not null")


def subset_by_videos(frames: DataFrame, n: int, real: list[str], synthetic: str) -> DataFrame:
    """All rows of the real categories, and those of the first `n` videos (in order) of the synthetic one."""
    chosen = frames.filter(F.col("category") == synthetic).select("video_id").distinct().orderBy("video_id").limit(n)
    return frames.filter(F.col("category").isin(real)).unionByName(frames.filter(F.col("category") == synthetic).join(chosen, "video_id", "left_semi"))


def pair_with_original(videos: DataFrame, categories: list[str]) -> DataFrame:
    """For each manipulated video and category its partner, and the original named before the `_` of the id."""
    pairs = videos.filter(F.col("video_id").contains("_")).select("video_id").distinct()
    wanted = pairs.select("video_id", F.explode(F.array(*map(F.lit, categories))).alias("category"))
    source = F.when(F.col("category") == "original", F.substring_index("video_id", "_", 1)).otherwise(F.col("video_id"))
    return wanted.withColumn("source_id", source)


def missing_partners(pairs: DataFrame, videos: DataFrame) -> DataFrame:
    """Pairs whose video does not exist."""
    known = videos.select("category", F.col("video_id").alias("source_id")).distinct()
    return pairs.join(known, ["category", "source_id"], "left_anti").select("video_id", "category", "source_id")


def rebuild_frames(files: DataFrame, videos: DataFrame, target_fps: int = 5) -> DataFrame:
    """Frame files (category, video_id, frame_number) with their manifest row and source frame; numbers outside the sampling plan go.

    A video's files meet its row of the manifest as words of bits, and the plan as one list for each (fps, number of
    frames): neither files nor plan are rows before the result. A file that is listed twice is one, but for other columns of `files`.
    """
    by = ["category", "video_id"]
    # hints: a table's files may be small enough to be sent to all tasks while its rows, or what is made of them, are not
    own = number_words(files, by).join(videos.select(*by, "binary_label", "original_fps", "num_frames").hint("shuffle_hash"), by)
    placed = planned(own, target_fps, plan=shape_plan(videos, target_fps))
    first = F.greatest("word", F.lit(0)) * 64
    in_word = F.sequence(F.lit(0), F.least(F.lit(63), F.size("_at") - first - 1).cast("int"))
    there = F.filter(in_word, lambda k: F.getbit("bits", k) == 1)
    numbers = F.when((F.col("word") >= 0) & (first < F.size("_at")), there)
    rows = placed.withColumn("_k", F.explode(numbers)).withColumn("_n", (first + F.col("_k")).cast("int"))
    at = F.get("_at", F.col("_n"))
    rebuilt = rows.select(*by, F.col("_n").cast(files.schema["frame_number"].dataType).alias("frame_number"), at["original_frame_index"].alias("original_frame_index"), at["timestamp"].alias("timestamp"), "binary_label", "original_fps", "num_frames")
    return rebuilt if len(files.columns) == 3 else files.join(rebuilt.hint("merge"), [*by, "frame_number"])


def key_algebra(audit: DataFrame, shards: DataFrame, frames: DataFrame) -> DataFrame:
    """Sizes of the key sets: done (audit or shard), done and known, known but not done, done but not known."""
    own = F.col("sources")
    done, known = own.bitwiseAND(3) != 0, own.bitwiseAND(4) != 0
    sets = {"done": done, "done_and_known": done & known, "not_done": known & ~done, "not_known": done & ~known}
    counted = tagged(["key"], audit, shards, frames).agg(*[F.count_if(c).alias(name) for name, c in sets.items()])
    return counted.unpivot([], list(sets), "keys", "n")


def _number(rows: DataFrame) -> Column:
    """frame_number, a number or its text, as long; null where it is none."""
    n = F.col("frame_number")
    return n.cast("long") if isinstance(rows.schema["frame_number"].dataType, T.IntegralType) else F.trim(n.cast("string")).try_cast("long")


def video_states(manifest: DataFrame, frames: DataFrame, files: DataFrame, audit: DataFrame, target_fps: int = 5, plan: DataFrame | None = None) -> DataFrame:
    """Where each video stands: video_key, expected, rows, files, complete, bootstrapped, action.

    `manifest`: category, video_id, split, original_fps, num_frames. `frames`: rows written so far (category, video_id,
    split, frame_number as text or number). `files`: frame files there are (category, video_id, frame_number). `audit`: category, video_id,
    split, status.

    A video is complete if the audit says so. An audit without complete videos is made up for: then those are complete
    whose rows are numbered 0 .. expected - 1, each once, and whose files are numbered likewise. A rate or length that is
    not known expects nothing and completes nothing. `plan`: a `shape_plan` of the manifest, if there is one. Actions:
    `keep` the rows; `rebuild` them from the files (complete, without rows, all files there); `lost` (complete, without
    rows, files missing: nothing can be done, and the audit stands); `extract` again, rows that there are go. Videos that
    only frames or the audit know have no expected number.
    """
    key = video_key("category", "video_id", "split").alias("video_key")
    usable = (F.col("original_fps") > 0) & (F.col("num_frames") > 0)
    expecting = expected_samples(manifest, target_fps, plan).select(key, F.trim("category").alias("category"), F.trim("video_id").alias("video_id"), F.when(usable, F.col("expected")).alias("expected"))
    # dealt out once, for the grouping and for the join
    listed = expecting.repartition("category", "video_id").groupBy("video_key", "category", "video_id").agg(F.max("expected").alias("expected"))
    found = files.select(F.trim("category").alias("category"), F.trim("video_id").alias("video_id"), _number(files).alias("frame_number")).filter("frame_number is not null")
    # numbers below the expected one that have a file: all of them are there if these are as many
    below = F.col("expected") - F.greatest("word", F.lit(0)) * 64
    due = F.when((F.col("word") < 0) | (below <= 0), 0).when(below >= 64, F.bit_count("bits")).otherwise(F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), below.cast("int"))))))
    filed = listed.join(number_words(found, ["category", "video_id"]), ["category", "video_id"], "left").select("video_key", "expected", F.bit_count("bits").cast("long").alias("files"), due.cast("long").alias("due"))
    words = number_words(frames.select(key, _number(frames).alias("frame_number")), ["video_key"])
    written = words.select("video_key", "rows", *[c.alias(name) for name, c in word_facts().items()])
    audited = audit.filter(F.lower(F.trim("status")) == "complete").select(key).distinct().withColumn("audited", F.lit(True))
    none = audited.agg(F.count("*") == 0).scalar()
    # one grouping instead of joins
    sums = [F.sum(c).alias(c) for c in ("files", "due", "rows", "different")]
    joined = filed.unionByName(written, allowMissingColumns=True).unionByName(audited, allowMissingColumns=True).groupBy("video_key").agg(F.max("expected").alias("expected"), *sums, F.min("first").alias("first"), F.max("last").alias("last"), F.max("audited").alias("audited"))
    joined = joined.withColumn("numbered", exact_numbers())
    rows, counted = F.coalesce("rows", F.lit(0)), F.coalesce("files", F.lit(0))
    all_there = (F.col("due") == F.col("expected")) & (F.col("expected") > 0)
    whole = F.coalesce(F.col("numbered") & (F.col("rows") == F.col("expected")) & all_there & (F.col("files") == F.col("expected")), F.lit(False))
    states = joined.select("video_key", "expected", rows.alias("rows"), counted.alias("files"), F.coalesce("audited", F.lit(False)).alias("audited"), (none & whole).alias("bootstrapped"), F.coalesce(all_there, F.lit(False)).alias("all_there"))
    complete = F.col("audited") | F.col("bootstrapped")
    action = F.when(~complete, "extract").when(F.col("rows") > 0, "keep").when(F.col("all_there"), "rebuild").otherwise("lost")
    return states.select("video_key", "expected", "rows", "files", complete.alias("complete"), "bootstrapped", action.alias("action"))


def sifted(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """`rows` without nearly all of those whose `by` is not in `keys`, so that few of them are dealt out for the join that decides.

    Two bits of a word stand for a key. There are 2^20 words at most, however many keys there are: the words are sent to all
    tasks, and with tens of millions of keys more and more rows pass.
    """
    hashed = F.xxhash64(*by)
    word = F.col("_hash").bitwiseAND((1 << 20) - 1)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("_hash", shift).bitwiseAND(63).cast("int"))
    bits = bit(20).bitwiseOR(bit(26))
    words = keys.select(hashed.alias("_hash")).select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_set"))
    return rows.withColumn("_hash", hashed).join(F.broadcast(words), (word == F.col("_word")) & (bits.bitwiseAND(F.col("_set")) == bits), "left_semi").drop("_hash")


class Reconciled(NamedTuple):
    """State of each video, audit rows that are still to be appended, and the frame rows that hold from now on."""

    states: DataFrame
    audit: DataFrame
    frames: DataFrame


def reconcile(manifest: DataFrame, frames: DataFrame, files: DataFrame, audit: DataFrame, target_fps: int = 5, plan: DataFrame | None = None) -> Reconciled:
    """Brings audit, frame rows and files into agreement (see `video_states`).

    `manifest` also has binary_label, `files` frame_path, and `frames` the columns category, video_id, split, frame_path,
    frame_number, original_frame_index, timestamp, binary_label. Rows of videos that are to be extracted again are left out, those of
    complete videos without rows come back from their files. `plan`: as in `video_states`; timestamps are as it has them.
    """
    spark = manifest.sparkSession
    path = scratch(spark, "video_states")
    plan = written_plan(manifest, target_fps) if plan is None else plan
    video_states(manifest, frames, files, audit, target_fps, plan).write.parquet(path)
    states = spark.read.parquet(path)
    key = video_key("category", "video_id", "split")
    listed = manifest.withColumn("video_key", key)
    boot = listed.join(states.filter("bootstrapped").select("video_key"), "video_key", "left_semi")
    entries = boot.select("category", "video_id", "split", F.lit("complete").alias("status")).distinct()
    columns = ["category", "video_id", "split", "frame_path", "frame_number", "original_frame_index", "timestamp", "binary_label"]
    # hints: as in `rebuild_frames`; after sifting few rows are dealt out for them
    hold, again = (states.filter(F.col("action") == action).select("video_key") for action in ("keep", "rebuild"))
    kept = sifted(frames.withColumn("video_key", key), hold, ["video_key"]).join(hold.hint("shuffle_hash"), "video_key", "left_semi").select(*columns)
    path = scratch(spark, "rebuilt_videos")
    sifted(listed, again, ["video_key"]).join(again, "video_key", "left_semi").select("category", "video_id", "split", "binary_label", "original_fps", "num_frames").write.parquet(path)
    lost = spark.read.parquet(path)
    # a video's files meet its row of the manifest, and the plan as one list
    own = files.select("category", "video_id", F.col("frame_number").cast("int").alias("frame_number"), "frame_path")
    own = sifted(own, lost, ["category", "video_id"]).join(lost.hint("shuffle_hash"), ["category", "video_id"])
    at = F.get("_at", F.col("frame_number"))
    rebuilt = planned(own, target_fps, plan=plan).filter(at.isNotNull()).withColumns({"original_frame_index": at["original_frame_index"], "timestamp": at["timestamp"]})
    same = [F.col(c).cast(kept.schema[c].dataType).alias(c) for c in columns]
    return Reconciled(states, entries, kept.unionByName(rebuilt.select(*same)))
