"""Tar shards of samples: members that share a base key are one sample."""

from __future__ import annotations

import fnmatch
import io
import itertools
import json
import re
import tarfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from framelake.functions.text import resolve_label

SCHEMA = "shard string, key string, parts map<string, binary>"
#: Endings of several parts that stay whole.
LONG_ENDINGS = ("rgb.npy", "diff.npy")


def member_key(name: str) -> tuple[str, str]:
    """(base key, ending) of a member's name."""
    folder, slash, file = name.rpartition("/")
    for ending in LONG_ENDINGS:
        if file.endswith(f".{ending}"):
            return folder + slash + file[: -len(ending) - 1], ending
    stem, _, ending = file.partition(".") if file.count(".") == 1 else file.rpartition(".")
    return folder + slash + stem, ending


def store_of(uri: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI (local, HDFS or an object store) and the path in it."""
    return FileSystem.from_uri(uri)


class Member(NamedTuple):
    """A file in a tar: its sample's key, its ending, and where its header, its bytes begin and how many these are."""

    key: str
    part: str
    header: int
    offset: int
    size: int


#: Ends a tar that this library wrote. Before it stands the length of the index, before that the index; tar readers stop earlier.
MAGIC = b"FLSHARD1"
#: Bytes between two wanted members that are read along with them: headers and their filling.
GAP = 1536


def index_of(file: pa.NativeFile, size: int) -> list[Member]:
    """Members of a tar in order: from the index at its end, else header by header; no member's bytes are read."""
    if size > 16:
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] == MAGIC:
            length = int.from_bytes(tail[:8], "little")
            file.seek(size - 16 - length)
            return [Member(*x) for x in json.loads(zlib.decompress(file.read(length)))]
    file.seek(0)
    with tarfile.open(fileobj=file, mode="r:") as archive:
        return [Member(*member_key(m.name), m.offset, m.offset_data, m.size) for m in archive if m.isfile()]


def read_members(file: pa.NativeFile, members: list[Member]) -> dict[str, bytes]:
    """Bytes by ending; neighbours are read at once."""
    out: dict[str, bytes] = {}
    run: list[Member] = []
    for member in [*members, None]:
        if run and (member is None or not 0 <= member.offset - run[-1].offset - run[-1].size <= GAP):
            file.seek(run[0].offset)
            raw = file.read(run[-1].offset + run[-1].size - run[0].offset)
            out |= {m.part: raw[m.offset - run[0].offset :][: m.size] for m in run}
            run = []
        run.append(member)
    return out


def samples_of(path: str, parts: list[str] | None = None, start: int = 0, stop: int | None = None, wanted: Callable[[str], bool] | None = None) -> Iterator[tuple[str, str, dict[str, bytes]]]:
    """Samples of one shard that begin in a stretch of its bytes; only adjacent members join.

    Only bytes of the endings in `parts` (None: all), and of samples whose key is `wanted`, are read.
    """
    store, place = store_of(path)
    shard = place.rpartition("/")[2]
    with store.open_input_file(place) as file:
        for key, members in itertools.groupby(index_of(file, file.size()), lambda m: m.key):
            own = list(members)
            if own[0].header >= start and (stop is None or own[0].header < stop) and (wanted is None or wanted(key)):
                yield shard, key, read_members(file, [m for m in own if parts is None or m.part in parts])


def expand(pattern: str) -> dict[str, int]:
    """Paths of a glob or `{000..009}` pattern, in order, and their sizes; none is an error."""
    if found := re.search(r"\{(\d+)\.\.(\d+)\}", pattern):
        first, last = found.groups()
        names = [pattern.replace(found[0], str(k).zfill(len(first))) for k in range(int(first), int(last) + 1)]
    else:
        names = [pattern]
    paths = {}
    for name in names:
        folder, _, file = name.rpartition("/")
        store, place = store_of(folder)
        listed = store.get_file_info(FileSelector(place, allow_not_found=True))
        paths |= {f"{folder}/{x.base_name}": x.size for x in listed if x.type == FileType.File and fnmatch.fnmatchcase(x.base_name, file)}
    if not paths:
        raise FileNotFoundError(f"no shard matches {pattern}")
    return dict(sorted(paths.items()))


class ShardSource(DataSource):
    """Format `shards`: shard, key, parts of the samples in tar files, written rolled by count and bytes.

    Options for reading: `parts` (endings to read, by comma; without it all), `split_bytes` (of a tar for one task). Filters on shard
    and key reach the files. Options for writing: `maxcount`, `maxsize`, `start_shard`, `write_id` (see `ShardWriter`).
    """

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(dict(self.options))


class IndexSource(DataSource):
    """Format `shard_index`: the members of tar files, without their bytes."""

    @classmethod
    def name(cls) -> str:
        return "shard_index"

    def schema(self) -> str:
        return "shard string, key string, part string, offset long, size long"

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(dict(self.options) | {"split_bytes": 1 << 62})


def passes(filters: list[Filter], value: str) -> bool:
    for f in filters:
        if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
            return False
    return True


class ShardReader(DataSourceReader):
    """A task for each stretch of a tar; whole tars, and samples before their bytes are read, fall to filters on shard and key."""

    def __init__(self, options: dict[str, str]):
        self.pattern, self.split_bytes = options["path"], int(options.get("split_bytes", 128 << 20))
        self.parts = options["parts"].split(",") if "parts" in options else None
        self.on: dict[str, list[Filter]] = {"shard": [], "key": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in self.on:
                self.on[f.attribute[0]].append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = []
        for path, size in expand(self.pattern).items():
            if passes(self.on["shard"], path.rpartition("/")[2]):
                found += [InputPartition((path, at, at + self.split_bytes)) for at in range(0, max(size, 1), self.split_bytes)]
        return found or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            path, start, stop = partition.value
            yield from samples_of(path, self.parts, start, stop, lambda key: passes(self.on["key"], key))


class IndexReader(ShardReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            store, place = store_of(partition.value[0])
            with store.open_input_file(place) as file:
                for m in index_of(file, file.size()):
                    if passes(self.on["key"], m.key):
                        yield place.rpartition("/")[2], m.key, m.part, m.offset, m.size


class Written(WriterCommitMessage):
    def __init__(self, task: int, files: list[str]):
        self.task, self.files = task, files


class ShardWriter(DataSourceArrowWriter):
    """Tasks write under names of their own; the commit numbers the files in order of task, after the highest one there.

    The commit first writes down which file gets which name. If it dies between two moves, the next commit in the folder, or
    `recover_shards`, does the rest. With the option `write_id` a finished write is remembered under that name, and one
    that is run again adds nothing. One write at a time may commit to a folder.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most, self.most_bytes = int(options.get("maxcount", 10_000)), int(options.get("maxsize", 2_000_000_000))
        self.first = int(options.get("start_shard", 0))
        self.keep, self.write_id = "write_id" in options, options.get("write_id") or uuid.uuid4().hex
        if not re.fullmatch(r"[\w.]+", self.write_id):
            raise ValueError(f"write_id may hold letters, digits, _ and . only: {self.write_id}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        return self.written(iterator, context.partitionId(), context.taskAttemptId())

    def written(self, iterator: Iterator[pa.RecordBatch], task: int, attempt: int) -> Written:
        store, place = store_of(self.path)
        store.create_dir(place, recursive=True)
        files, archive, stream, index, count, size = [], None, None, [], 0, 0

        def close() -> None:
            archive.close()
            raw = zlib.compress(json.dumps(index).encode())
            stream.write(raw + len(raw).to_bytes(8, "little") + MAGIC)
            stream.close()

        for batch in iterator:
            for row in batch.to_pylist():
                parts = dict(row["parts"])
                bytes_now = sum(map(len, parts.values()))
                if archive is None or count >= self.most or (count and size + bytes_now > self.most_bytes):
                    if archive:
                        close()
                    files.append(f"{place}/_part-{self.write_id}-{task:05d}-{attempt}-{len(files):05d}.tar")
                    stream = store.open_output_stream(files[-1])
                    archive, index, count, size = tarfile.open(fileobj=stream, mode="w|"), [], 0, 0
                for ending in sorted(parts):
                    info = tarfile.TarInfo(f"{row['key']}.{ending}")
                    info.size = len(parts[ending])
                    header = archive.offset
                    archive.addfile(info, io.BytesIO(parts[ending]))
                    index.append(Member(*member_key(info.name), header, archive.offset - -(-info.size // 512) * 512, info.size))
                count, size = count + 1, size + bytes_now
        if archive:
            close()
        return Written(task, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, place = store_of(self.path)
        finish_commits(self.path)
        files = [file for message in sorted((m for m in messages if m), key=lambda m: m.task) for file in message.files]
        if finished(self.path, self.write_id):
            for file in files:
                store.delete_file(file)
            return
        listed = store.get_file_info(FileSelector(place, allow_not_found=True))
        at = max([self.first, *(int(m[1]) + 1 for x in listed if (m := re.fullmatch(r"shard-(\d+)\.tar", x.base_name)))])
        moves = [[file, f"{place}/shard-{at + k:06d}.tar"] for k, file in enumerate(files)]
        if not moves and not self.keep:
            return
        store.create_dir(place, recursive=True)
        journal = f"{place}/_commit-{self.write_id}.json"
        with store.open_output_stream(f"{journal}.new") as out:
            out.write(json.dumps({"keep": self.keep, "moves": moves}).encode())
        store.move(f"{journal}.new", journal)
        finish(store, journal)

    def abort(self, messages: list[Written | None]) -> None:
        """Files that the journal of an interrupted commit names stay for it."""
        store, place = store_of(self.path)
        if there(store, f"{place}/_commit-{self.write_id}.json"):
            return
        for message in messages:
            for file in message.files if message else ():
                if there(store, file):
                    store.delete_file(file)


def there(store: FileSystem, file: str) -> bool:
    return store.get_file_info(file).type == FileType.File


def finished(path: str, write_id: str) -> bool:
    """Whether a write of that name has been committed to the folder."""
    store, place = store_of(path)
    return there(store, f"{place}/_done-{write_id}.json")


def finish(store: FileSystem, journal: str) -> None:
    """Does what a journal says is to do; it may be done in part, or run again."""
    with store.open_input_file(journal) as file:
        said = json.loads(file.read())
    for source, target in said["moves"]:
        if there(store, source):
            store.move(source, target)
    if said["keep"]:
        store.move(journal, journal.replace("/_commit-", "/_done-"))
    else:
        store.delete_file(journal)


def finish_commits(path: str) -> None:
    """Finishes the interrupted commits of a folder."""
    store, place = store_of(path)
    for x in store.get_file_info(FileSelector(place, allow_not_found=True)):
        if re.fullmatch(r"_commit-[\w.]+\.json", x.base_name):
            finish(store, x.path)


def recover_shards(path: str, older_than: float = 86_400) -> None:
    """Finishes interrupted commits, and deletes files of writes that died before theirs, if nothing was written to them for that many seconds."""
    finish_commits(path)
    store, place = store_of(path)
    for x in store.get_file_info(FileSelector(place, allow_not_found=True)):
        if re.match(r"_part-|_commit-.*\.new$", x.base_name) and time.time() - x.mtime_ns / 1e9 >= older_than:
            store.delete_file(x.path)


def read_shards(spark: SparkSession, pattern: str, parts: list[str] | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """shard, key, parts of all samples; the folder must be one that all machines see.

    `parts`: the endings whose bytes are read (None: all). A tar is read by a task for every `split_bytes` of it. Filters on
    shard and key (equal, in, starts with) are pushed to the files.
    """
    spark.dataSource.register(ShardSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("shards").option("split_bytes", split_bytes)
    return (reader if parts is None else reader.option("parts", ",".join(parts))).load(pattern)


def read_shard_index(spark: SparkSession, pattern: str) -> DataFrame:
    """shard, key, part, offset, size of all members, from the tars' indexes or headers alone."""
    spark.dataSource.register(IndexSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("shard_index").load(pattern)


def read_shard_labels(spark: SparkSession, pattern: str, invert: bool = False, strict: bool = False) -> DataFrame:
    """shard, key, label (1 fake, 0 real, -1 unknown) of all samples, from their label and JSON members alone."""
    own = read_shards(spark, pattern, ["json", "cls"])
    word = lambda c: F.col("parts")[c].cast("string")
    field = lambda c: F.get_json_object(word("json"), f"$.{c}")
    return own.select("shard", "key", resolve_label(word("cls"), field("binary_label"), field("label"), invert=invert, strict=strict).alias("label"))


def write_shards(samples: DataFrame, path: str, maxcount: int = 10_000, maxsize: int = 2_000_000_000, start_shard: int = 0, tasks: int | None = None, video: str = "video", write_id: str | None = None) -> None:
    """Samples (video, key, parts) as numbered tars; a video's samples stay together and in order.

    With `write_id` a write that is run again under that name adds nothing if it was finished before; its samples are not even
    computed.
    """
    if write_id is not None and finished(path, write_id):
        return
    spark = samples.sparkSession
    spark.dataSource.register(ShardSource)
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = samples.repartitionByRange(n, video).sortWithinPartitions(video, "key")
    named = {} if write_id is None else {"write_id": write_id}
    placed.select(F.lit("").alias("shard"), "key", "parts").write.format("shards").options(path=path, maxcount=maxcount, maxsize=maxsize, start_shard=start_shard, **named).mode("append").save()


def shard_members(shards: DataFrame, split: str) -> DataFrame:
    """split, shard, key, suffix of each member, for counting: of `read_shard_index`, or of `read_shards` if the bytes are there."""
    suffix = F.col("part") if "part" in shards.columns else F.explode(F.map_keys("parts"))
    return shards.select(F.lit(split).alias("split"), "shard", "key", suffix.alias("suffix"))
