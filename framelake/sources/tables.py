"""Manifests, frame metadata, audits, predictions, metrics and histories as files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.scores import pred_at
from framelake.functions.text import CATEGORY_LABELS, filled, normalize_split, safe_float, safe_int, text, video_key

#: File endings that count as videos.
VIDEO_ENDINGS = ("mp4", "avi", "mov", "mkv", "webm")
#: The columns of each kind of file, in order.
MANIFEST = ["video_id", "video_path", "category", "binary_label", "compression", "split", "original_fps", "num_frames"]
FRAMES = [
    "frame_path", "video_id", "video_path", "video_name", "category", "label", "binary_label", "split", "frame_number",
    "original_frame_index", "timestamp", "video_fps", "extraction_fps", "width", "height", "video_duration",
    "total_video_frames", "extraction_date",
]
PREDICTIONS = ["key", "video_id", "category", "label_name", "label", "prob_positive", "pred", "spatial_index"]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def list_videos(spark: SparkSession, root: str, rows: int = 10_000) -> DataFrame:
    """category, video_path (relative) and video_id of the video files directly under known category folders.

    Where `pyarrow.fs` knows the file system of `root`, a task lists each of these folders when the rows are asked for: no other
    folder is listed, no file is opened, and no name passes through the driver. A store hands out a folder as one list, so its
    entries are in that task's memory at once; they leave it `rows` at a time. Other stores are listed by Spark's reader, on the
    driver and without the names that begin with `_` or `.`. A root that isn't there is an error.
    """
    whole = root if ":" in root else os.path.abspath(root)
    try:
        store, base = FileSystem.from_uri(whole)
    except (pa.ArrowException, OSError):
        return known_videos(files_below(spark, root))
    if store.get_file_info(base).type != FileType.Directory:
        raise FileNotFoundError(f"no folder {root}")
    known = [*CATEGORY_LABELS]

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(whole)
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            folder = f"{base.rstrip('/')}/{known[k]}"
            if store.get_file_info(folder).type == FileType.Directory:
                listed = store.get_file_info(FileSelector(folder))
                for at in range(0, len(listed), rows):
                    found = [f"{known[k]}/{x.base_name}" for x in listed[at : at + rows] if x.type == FileType.File]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["video_path"])

    return known_videos(spark.range(0, len(known), 1, len(known)).mapInArrow(names, "video_path string"))


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """video_path, relative, of all files below `root` that Spark's readers list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    # whole paths, with or without the scheme and authority that `root` names; a relative root is one of this machine
    below = re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", root if ":" in root else os.path.abspath(root)).rstrip("/") + "/"
    return files.select(F.substring("path", F.locate(below, F.col("path")) + len(below), F.length("path")).alias("video_path"))


def known_videos(files: DataFrame) -> DataFrame:
    """category, video_path and video_id of the paths (video_path, relative) that are videos directly under known category folders."""
    pattern = r"([^/]+)/([^/]+)\.([^./]+)$"
    found = files.select("video_path").filter(F.size(F.split("video_path", "/")) == 2)
    named = found.select(F.regexp_extract("video_path", pattern, 1).alias("category"), "video_path", F.regexp_extract("video_path", pattern, 2).alias("video_id"), F.lower(F.regexp_extract("video_path", pattern, 3)).alias("ending"))
    return named.filter(F.col("category").isin(*CATEGORY_LABELS) & F.col("ending").isin(*VIDEO_ENDINGS)).drop("ending")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed manifest rows; rows with a blank category, id or path are dropped."""
    raw = require(read_csv(spark, path), ["video_id", "video_path", "category"])
    column = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    typed = raw.select(
        text("video_id").alias("video_id"),
        text("video_path").alias("video_path"),
        text("category").alias("category"),
        safe_int(column("binary_label")).cast("int").alias("binary_label"),
        text(column("compression")).alias("compression"),
        normalize_split(column("split")).alias("split"),
        safe_float(column("original_fps")).alias("original_fps"),
        safe_int(column("num_frames")).alias("num_frames"),
    )
    return typed.filter((F.col("category") != "") & (F.col("video_id") != "") & (F.col("video_path") != ""))


def write_manifest(df: DataFrame, path: str) -> None:
    """`path`/csv and `path`/parquet, in fixed column order, sorted by category and id."""
    ordered = df.select(*MANIFEST).sort("category", "video_id")
    ordered.write.mode("overwrite").csv(f"{path}/csv", header=True)
    ordered.write.mode("overwrite").parquet(f"{path}/parquet")


def read_official_test_list(spark: SparkSession, path: str) -> DataFrame:
    """video_path: the second word of each line; shorter lines are skipped, a missing file is an empty list."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "video_path string")
    words = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.size(words) >= 2).select(words[1].alias("video_path")).distinct()


def read_frame_metadata(spark: SparkSession, path: str, split: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Frame rows as text; the limit counts rows in order of the frame path before the split is looked at."""
    rows = require(read_csv(spark, path), ["frame_path", "video_id", "category"])
    if limit is not None:
        rows = rows.orderBy("frame_path").limit(limit)
    if split is not None:
        rows = require(rows, ["split"]).filter(normalize_split("split") == split.strip().lower())
    return rows if category is None else rows.filter(F.col("category") == category)


def write_frame_metadata(df: DataFrame, path: str) -> None:
    df.select(*FRAMES).write.mode("append").partitionBy("split", "category").parquet(path)


def append_audit(df: DataFrame, path: str, write_id: str | None = None) -> None:
    """One row per finished video or sample; each split has a folder of its own.

    With `write_id` the rows lie in a folder of that name, which an append that is run again replaces: each row is there once.
    """
    if write_id is None:
        df.write.mode("append").partitionBy("split").parquet(path)
    else:
        named = df.withColumn("write_id", F.lit(write_id))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "write_id").parquet(path)


def read_completed_videos(spark: SparkSession, path: str) -> DataFrame:
    audit = spark.read.parquet(path)
    return audit.filter(F.lower(F.trim("status")) == "complete").select(video_key("category", "video_id", "split").alias("video_key")).distinct()


def guarded_write(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Fails if the output of one of the splits exists; with `overwrite` only those splits are replaced."""
    writer = df.write.partitionBy("split")
    if overwrite:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)


def write_predictions(df: DataFrame, path: str, threshold: float = 0.5) -> None:
    df.withColumn("pred", pred_at(F.col("prob_positive"), threshold)).select(*PREDICTIONS).write.mode("overwrite").csv(path, header=True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Typed predictions; blank or repeated keys, unreadable numbers and empty files are errors."""
    raw = require(read_csv(spark, path), ["key", "label", "prob_positive"])
    typed = raw.select(filled("key").alias("key"), *[F.col(c) for c in ("video_id", "category", "label_name") if c in raw.columns], F.trim("label").try_cast("int").alias("label"), F.trim("prob_positive").try_cast("double").alias("prob_positive"))
    state = typed.agg(F.count("*").alias("n"), F.count_if(F.col("key").isNull()).alias("blank"), F.count_if(F.col("label").isNull() | F.col("prob_positive").isNull()).alias("bad")).first()
    if not state.n or state.blank or state.bad:
        raise ValueError(f"{path}: {state.n} rows, {state.blank} without key, {state.bad} without label or probability")
    if repeated := [r.key for r in typed.groupBy("key").count().filter("count > 1").orderBy("key").limit(5).collect()]:
        raise ValueError(f"{path}: repeated keys, as {', '.join(repeated)}")
    return typed


def write_metrics(df: DataFrame, path: str) -> None:
    """One-row metrics with nested counts as a JSON document."""
    counts = F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix")
    labels = F.struct(F.col("labels_negative").alias("negative"), F.col("labels_positive").alias("positive")).alias("label_distribution")
    preds = F.struct(F.col("preds_negative").alias("negative"), F.col("preds_positive").alias("positive")).alias("prediction_distribution")
    probs = F.struct(F.col("prob_min").alias("min"), F.col("prob_max").alias("max"), F.col("prob_mean").alias("mean"), F.col("prob_std").alias("std")).alias("probability_summary")
    df.select("accuracy", "balanced_accuracy", "f1", "precision", "recall", counts, labels, preds, probs).coalesce(1).write.mode("overwrite").json(path)


def write_failure_report(df: DataFrame, path: str, failures: DataFrame | None = None) -> None:
    """The one row of `failure_report` as a JSON document; with `failures` these and it are the folders `failures` and `report` in `path`."""
    if failures is None:
        df.coalesce(1).write.mode("overwrite").json(path)
    else:
        df.coalesce(1).write.mode("overwrite").json(f"{path}/report")
        failures.write.mode("overwrite").json(f"{path}/failures")


def read_history(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """run, stage, epoch, loss, accuracy, f1, auc from run documents (one a file, or one a line) with a list of epochs per stage."""
    epoch = "struct<loss:double,accuracy:double,f1:double,auc:double,learning_rates:array<double>>"
    runs = spark.read.schema(f"run string, train array<{epoch}>, val array<{epoch}>").json(path, multiLine=multi_line)
    stages = [runs.select("run", F.lit(s).alias("stage"), F.posexplode(s).alias("epoch", "e")).select("run", "stage", (F.col("epoch") + 1).alias("epoch"), "e.*") for s in ("train", "val")]
    return stages[0].unionByName(stages[1])
