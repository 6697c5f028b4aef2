"""Tar shards: what is read of them, and commits that die."""

from __future__ import annotations

import io
import os
import tarfile
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

from framelake.operators import reports
from framelake.sources import shards


class Counted:
    """A file that counts the bytes read of it."""

    read_bytes = 0

    def __init__(self, file):
        self.file = file

    def read(self, *n):
        raw = self.file.read(*n)
        Counted.read_bytes += len(raw)
        return raw

    def __getattr__(self, name):
        return getattr(self.file, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


@pytest.fixture
def counted(monkeypatch):
    real = shards.store_of

    class Store:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, place):
            return Counted(self.store.open_input_file(place))

        def __getattr__(self, name):
            return getattr(self.store, name)

    monkeypatch.setattr(shards, "store_of", lambda uri: (Store(real(uri)[0]), real(uri)[1]))
    Counted.read_bytes = 0
    return Counted


def write(path, rows, task=0, attempt=0, **options):
    """One task's files, as the writer of an own process would leave them."""
    writer = shards.ShardWriter({"path": str(path)} | options)
    batch = pa.RecordBatch.from_pylist([{"shard": "", "key": k, "parts": list(p.items())} for k, p in rows], schema=pa.schema([("shard", pa.string()), ("key", pa.string()), ("parts", pa.map_(pa.string(), pa.binary()))]))
    return writer, writer.written(iter([batch]), task, attempt)


def foreign(path, rows):
    """A tar of another program: no index at its end, folders among the members, long names."""
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as archive:
        folder = tarfile.TarInfo("some")
        folder.type = tarfile.DIRTYPE
        archive.addfile(folder)
        for key, parts in rows:
            for ending, raw in parts.items():
                info = tarfile.TarInfo(f"{key}.{ending}")
                info.size = len(raw)
                archive.addfile(info, io.BytesIO(raw))


ROWS = [(f"v{k // 10}/{'long' * 40 if k % 7 == 0 else ''}clip_{k:03d}", {"cls": str(k % 2).encode(), "json": b'{"binary_label": 1}', "rgb.npy": os.urandom(60_000)}) for k in range(40)]


@pytest.mark.parametrize("own", [True, False])
def test_labels_cost_no_pixels(tmp_path, counted, own):
    if own:
        writer, message = write(tmp_path, ROWS)
        writer.commit([message])
    else:
        foreign(tmp_path / "shard-000000.tar", ROWS)
    path = str(tmp_path / "shard-000000.tar")
    size = os.path.getsize(path)
    reader = shards.ShardReader({"path": path, "parts": "json,cls"})
    found = {key: parts for part in reader.partitions() for _, key, parts in reader.read(part)}
    assert found == {k: {"cls": p["cls"], "json": p["json"]} for k, p in ROWS}
    labels = sum(len(p["cls"]) + len(p["json"]) for _, p in ROWS)
    per_member = 120 if own else 1600  # an entry of the index, or the header and what stands between
    assert counted.read_bytes <= labels + len(ROWS) * (shards.GAP + 3 * per_member) < size / 8
    counted.read_bytes = 0
    index = shards.IndexReader({"path": path})
    members = [m for part in index.partitions() for m in index.read(part)]
    assert len(members) == 120 and sum(m[4] for m in members) == labels + 40 * 60_000 and counted.read_bytes < len(ROWS) * 3 * per_member + 1024


@pytest.mark.parametrize("own", [True, False])
def test_a_tar_in_many_tasks(tmp_path, own):
    if own:
        writer, message = write(tmp_path, ROWS)
        writer.commit([message])
    else:
        foreign(tmp_path / "shard-000000.tar", ROWS)
    path = str(tmp_path / "shard-000000.tar")
    reader = shards.ShardReader({"path": path, "split_bytes": "100000"})
    tasks = [[(key, parts) for _, key, parts in reader.read(p)] for p in reader.partitions()]
    assert len(tasks) == -(-os.path.getsize(path) // 100_000) and [x for t in tasks for x in t] == ROWS and max(map(len, tasks)) <= 2
    assert list(shards.samples_of(path)) == [("shard-000000.tar", *x) for x in ROWS]


def test_other_programs_read_the_tars(tmp_path):
    writer, message = write(tmp_path, ROWS)
    writer.commit([message])
    for mode in ("r:", "r|"):
        with open(tmp_path / "shard-000000.tar", "rb") as file, tarfile.open(fileobj=file, mode=mode) as archive:
            assert sum(1 for _ in archive) == 120


def test_pruned_tars_and_keys(tmp_path, counted):
    for k in range(4):
        foreign(tmp_path / f"shard-{k:06d}.tar", ROWS[10 * k : 10 * k + 10])
    reader = shards.ShardReader({"path": f"{tmp_path}/shard-*.tar"})
    other = IsNotNull(("key",))
    left = list(reader.pushFilters([In(("shard",), ("shard-000001.tar", "shard-000002.tar")), StringStartsWith(("key",), "v2/"), EqualTo(("key",), ROWS[25][0]), other]))
    assert left == [other]
    parts = reader.partitions()
    assert {p.value[0].rpartition("/")[2] for p in parts} == {"shard-000001.tar", "shard-000002.tar"}
    assert [key for p in parts for _, key, _ in reader.read(p)] == [ROWS[25][0]] and counted.read_bytes < 60_000 + 60 * 2000
    nothing = shards.ShardReader({"path": f"{tmp_path}/shard-*.tar"})
    assert list(nothing.pushFilters([EqualTo(("shard",), "none")])) == [] and [list(nothing.read(p)) for p in nothing.partitions()] == [[]]


def test_filters_reach_the_files(spark, tmp_path):
    for k in range(4):
        foreign(tmp_path / f"shard-{k:06d}.tar", ROWS[10 * k : 10 * k + 10])
    pattern = f"{tmp_path}/shard-*.tar"
    one = shards.read_shards(spark, pattern).filter((F.col("shard") == "shard-000002.tar") & F.col("key").startswith("v2/clip"))
    assert one.rdd.getNumPartitions() == 1 and sorted(r.key for r in one.collect()) == sorted(k for k, _ in ROWS[20:30] if "long" not in k)
    assert shards.read_shards(spark, pattern).filter("shard = 'none'").count() == 0
    balance = reports.class_balance(shards.read_shard_labels(spark, pattern)).first()
    assert (balance.negative_count, balance.positive_count) == (20, 20)
    assert reports.class_balance(shards.read_shard_labels(spark, pattern, invert=True)).first().raw_pos_weight == 1.0
    counted = reports.count_clips(shards.shard_members(shards.read_shard_index(spark, pattern), "train")).filter("split is null").first()
    assert (counted.shards, counted.clips) == (4, 40)


class Dies(Exception):
    pass


def all_rows(path):
    return [x[1:] for p in shards.expand(f"{path}/shard-*.tar") for x in shards.samples_of(p)]


@pytest.mark.parametrize("step", range(6))
@pytest.mark.parametrize("named", [False, True])
def test_commit_that_dies(tmp_path, monkeypatch, step, named):
    """The commit stops before its journal, or after any of its moves; whoever comes next finishes it."""
    options = {"maxcount": "10"} | ({"write_id": "w1"} if named else {})
    first, message = write(tmp_path, ROWS[:10])
    first.commit([message])
    writer, message = write(tmp_path, ROWS[10:], **options)
    real, moves = shards.store_of, []

    class Store:
        def __init__(self, store):
            self.store = store

        def move(self, *names):
            if len(moves) == step:
                raise Dies
            moves.append(names)
            self.store.move(*names)

        def __getattr__(self, name):
            return getattr(self.store, name)

    with monkeypatch.context() as m:
        m.setattr(shards, "store_of", lambda uri: (Store(real(uri)[0]), real(uri)[1]))
        try:
            writer.commit([message])
            assert step == 5 or step == 4 and not named
        except Dies:
            writer.abort([message])
    if step == 0:  # no journal: the write has failed as a whole, and its files are gone
        assert all_rows(tmp_path) == ROWS[:10]
    if named or step == 0:  # the job is run again under its name
        again, message = write(tmp_path, ROWS[10:], attempt=1, **options)
        again.commit([message])
    shards.recover_shards(str(tmp_path), older_than=0)
    assert all_rows(tmp_path) == ROWS
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith("_done")) == [f"shard-{k:06d}.tar" for k in range(4)]


def test_files_of_dead_writes_go(tmp_path):
    write(tmp_path, ROWS[:3])
    shards.recover_shards(str(tmp_path))
    assert len(os.listdir(tmp_path)) == 1
    time.sleep(0.01)
    shards.recover_shards(str(tmp_path), older_than=0)
    assert os.listdir(tmp_path) == []


def test_write_again_under_its_name(spark, tmp_path):
    rows = [(f"v{k // 3}", f"v{k // 3}/clip_{k:03d}", {"json": b"{}"}) for k in range(9)]
    df = spark.createDataFrame(rows, "video string, key string, parts map<string,binary>")
    for name in ("a", "a", "b"):
        shards.write_shards(df, str(tmp_path), maxcount=2, tasks=2, write_id=name)
    assert shards.read_shards(spark, f"{tmp_path}/shard-*.tar").count() == 18


def test_finished_write_computes_nothing(spark, tmp_path):
    rows = [(f"v{k // 3}", f"v{k // 3}/clip_{k:03d}", {"json": b"{}"}) for k in range(9)]
    df = spark.createDataFrame(rows, "video string, key string, parts map<string,binary>")
    shards.write_shards(df, str(tmp_path), maxcount=2, tasks=2, write_id="a")
    before = sorted(os.listdir(tmp_path))
    broken = df.withColumn("key", F.raise_error(F.lit("computed again")).cast("string"))
    shards.write_shards(broken, str(tmp_path), maxcount=2, tasks=2, write_id="a")
    assert sorted(os.listdir(tmp_path)) == before and shards.read_shards(spark, f"{tmp_path}/shard-*.tar").count() == 9
    with pytest.raises(Exception, match="computed again"):
        shards.write_shards(broken, str(tmp_path), tasks=2, write_id="b")
