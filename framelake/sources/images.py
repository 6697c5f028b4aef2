"""Image files of frame rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_frame_images(spark: SparkSession, root: str, frames: DataFrame) -> DataFrame:
    """Frames with image (HWC bytes), height, width and load_status: ok, read_fail for broken files, missing_file without one.

    Spark's image source decodes every file under `root`. To open only the frames' own files, with a decoder of
    your own, use `read_frame_files`.
    """
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    # the file's path after the root
    relative = F.substring_index(F.col("image.origin"), root.rstrip("/") + "/", -1)
    loaded = images.select(relative.alias("frame_path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("image"))
    return with_images(frames, loaded)


def with_images(frames: DataFrame, loaded: DataFrame) -> DataFrame:
    """Frames joined with images (frame_path, height, width, image) and load_status; a broken file has a negative height."""
    status = F.when(F.col("height").isNull(), "missing_file").when(F.col("height") < 0, "read_fail").otherwise("ok")
    return frames.join(loaded, "frame_path", "left").withColumn("load_status", status)


def image_of(store: FileSystem, place: str, decode: Callable[[bytes], np.ndarray]) -> tuple[str, int | None, int | None, bytes | None]:
    """load_status, height, width and HWC bytes of one file."""
    try:
        with store.open_input_stream(place) as file:
            raw = file.read()
    except FileNotFoundError:
        return "missing_file", None, None, None
    except OSError:
        return ("read_fail" if store.get_file_info(place).type != FileType.NotFound else "missing_file"), None, None, None
    try:
        image = np.ascontiguousarray(decode(raw), np.uint8)
        height, width, _ = image.shape
    except Exception:  # noqa: BLE001  whatever a decoder says of a broken file
        return "read_fail", None, None, None
    return "ok", height, width, image.tobytes()


def read_frame_files(frames: DataFrame, root: str, decode: Callable[[bytes], np.ndarray], rows: int = 64) -> DataFrame:
    """Frames with image (HWC bytes), height, width and load_status (ok, read_fail, missing_file) of their own files.

    `frame_path` is the path under `root`, of any file system that `pyarrow.fs` knows; no other file is listed or opened, and no pixels
    are shuffled. `decode` makes an array (height, width, channels) of a file's bytes. `rows`: frames whose pixels a task holds.
    """
    names = [c for c in frames.columns]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(root)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = [("missing_file", None, None, None) if p is None else image_of(store, f"{base.rstrip('/')}/{p}", decode) for p in batch.column("frame_path").to_pylist()]
                status, height, width, image = zip(*found, strict=True)
                arrays = [*batch.columns, pa.array(status, pa.string()), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(image, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "load_status", "height", "width", "image"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(load, f"{columns}, load_status string, height int, width int, image binary")


def write_frame_files(files: DataFrame, root: str, tasks: int | None = None) -> None:
    """Writes each row's content to its frame_path under `root`; rows that are written again are replaced.

    With `tasks` the rows are dealt to so many tasks by their paths, for many small files out of few partitions; else they are
    written where they are.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("frame_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder = f"{base.rstrip('/')}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base.rstrip('/')}/{path}") as out:
                    out.write(content)
        yield from ()

    own = files.select("frame_path", "content")
    placed = own if tasks is None else own.repartition(tasks, "frame_path")
    placed.mapInArrow(save, "done int").write.format("noop").mode("overwrite").save()
