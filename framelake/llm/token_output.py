"""Token-id files: ids ranked by frequency, coded in one to four bytes with the lengths in separate control bytes.

A corpus is a folder of three Parquet tables. `blocks`: documents in ascending doc_id order, with their ids, numbers of
tokens, control bytes (two bits a token, each document from a new byte on) and data bytes, and the place of the block's
first token in its part. `parts`: the tokens before each part; parts follow each other by number. `ranks`: the token id
of each rank.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.bpe import PIECE, ChunkIds, Splitter, flat_ids, local_file, per_worker
from framelake.llm.common import drop_staged, partitions, pieces, returning, staged

#: For each control byte the byte counts of its four tokens.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1

BLOCKS = "part int, local_start long, doc_ids binary, counts binary, control binary, data binary"


def library_ids(path: str, width: str) -> ChunkIds:
    """Ids of chunks by the tokenizers library; every distinct piece is encoded once in a worker."""

    def make(p: str) -> ChunkIds:
        splitter = Splitter(p)
        model = splitter.tokenizer.model
        return ChunkIds(splitter, lambda words: {w: [t.id for t in model.tokenize(w)] for w in words}, width)

    return per_worker(f"library{width}", path, make)


def encode(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of consecutive documents with `counts` tokens each, and the data bytes of each document."""
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slots = -(-counts // 4) * 4
    ends = np.cumsum(counts)
    padded = np.zeros(int(slots.sum()), np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(np.cumsum(slots) - slots - (ends - counts), counts)] = more
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    split = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    before = np.concatenate(([0], np.cumsum(more + np.int64(1))))
    return control, split[np.arange(4, dtype=np.uint8) <= more[:, None]], before[ends] - before[ends - counts]


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed numbers, and how many each row has; no row may be null."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def cut(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches of bytes as an array of binaries."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of consecutive documents with `counts` tokens each."""
    slots = -(-counts // 4) * 4
    first = np.repeat(np.cumsum(slots) - slots, slots)
    real = np.arange(len(first)) - first < np.repeat(counts, slots)
    lengths = LENGTHS[control].ravel()[real]
    starts = np.cumsum(lengths) - lengths
    data = np.concatenate((data, np.zeros(3, np.uint8)))
    out = data[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        out |= np.where(lengths > k, data[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def ids_in(path: str) -> int:
    """One more than the greatest token id of the vocabulary file."""
    spec = json.load(open(local_file(path), encoding="utf-8"))
    return 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])


def tokenise(docs: DataFrame, path: str, end_id: int, width: str) -> DataFrame:
    """doc_id and the ids of the text and `end_id`, as little-endian unsigned integers of numpy type `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = library_ids(path, width), np.array([end_id], width).tobytes()
        for whole in batches:
            for batch in pieces(whole, PIECE):
                bounds, raw = flat_ids(batch.column("text"), ids_of)
                out = [b"".join((raw[a:b], end)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(returning(run), "doc_id long, ids binary")


def token_counts(tokens: DataFrame, width: str) -> DataFrame:
    """id and count over the whole corpus; each task sends one row for each id that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                seen = np.bincount(flat(batch.column("ids"), width)[0])
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def borders(tokens: DataFrame, parts: int, sampled: int = 64) -> np.ndarray:
    """doc_ids between `parts` parts of about the same size, from a sample of so many doc_ids a part; only the balance hangs on it."""
    n = tokens.count()
    some = tokens.select("doc_id").filter("doc_id is not null")
    chosen = some if n <= parts * sampled else some.sample(parts * sampled / n, seed=1)
    ids = np.sort(np.array([r.doc_id for r in chosen.collect()], np.int64))
    return np.unique(ids[np.arange(1, parts) * len(ids) // parts]) if len(ids) else ids


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, block_tokens: int = 1 << 20) -> None:
    """Writes the corpus to the new folder `folder`.

    The rank table is at most as long as the vocabulary file and the parts are a few for each shuffle partition; but for
    these and 64 doc_ids a part nothing passes through the driver. Null texts are empty and consist of the end id; null doc_ids come first, and rows of
    one doc_id are in order of their number of tokens and then of their bytes.
    """
    most = max(ids_in(path), end_id + 1)
    width = "<u2" if most <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    tokens = staged(tokenise(docs, path, end_id, width), "tokens")
    ranked = [row.id for row in token_counts(tokens, width).orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame(list(enumerate(ranked)), "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                ids, counts = flat(batch.column("ids"), width)
                control, data, sizes = encode(rank_of[ids], counts)
                doc_id = batch.column("doc_id")
                part = np.where(doc_id.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, doc_id.fill_null(0).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), cut(control, -(-counts // 4)), cut(data, sizes), pa.array(part, pa.int32())], names=["doc_id", "n", "control", "data", "part"])

    parts = 4 * partitions(spark)
    bounds = borders(tokens, parts)
    coded = tokens.mapInArrow(returning(code), "doc_id long, n long, control binary, data binary, part int")
    placed = coded.repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", "n", "data")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, held, tokens_held = -1, 0, [], 0

        def block() -> pa.RecordBatch:
            ids = np.array([x[0] is not None for x in held]), np.array([x[0] or 0 for x in held], "<i8")
            row = {"part": at, "local_start": start, "doc_ids": ids[0].tobytes() + ids[1].tobytes(), "counts": np.array([x[1] for x in held], "<i8").tobytes(), "control": b"".join([x[2] for x in held]), "data": b"".join([x[3] for x in held])}
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=list(row))

        for batch in batches:
            for doc_id, n, control, data, own in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n", "control", "data", "part")), strict=True):
                if held and (own != at or tokens_held + n > block_tokens):
                    yield block()
                    start, held, tokens_held = start + tokens_held, [], 0
                if own != at:
                    at, start = own, 0
                held.append((doc_id, n, control, data))
                tokens_held += n
        if held:
            yield block()

    placed.mapInArrow(returning(pack), BLOCKS).write.parquet(f"{folder}/blocks")
    drop_staged(tokens)
    totals = part_totals(spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"))
    starts = zip(sorted(totals), accumulate([0, *(totals[k] for k in sorted(totals))]), strict=False)
    spark.createDataFrame(list(starts), "part int, start long").coalesce(1).write.parquet(f"{folder}/parts")


def part_totals(blocks: DataFrame) -> dict[int, int]:
    """Tokens of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [int(np.frombuffer(x.as_buffer(), "<i8").sum()) for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(totals, pa.int64())], names=["part", "n"])

    return {row.part: row.n for row in blocks.select("part", "counts").mapInArrow(run, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()}


def read_tokens(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """One row per document from the folder alone: doc_id, start, n_tokens, ids_crc32, and with `keep_ids` ids."""
    ranked = [r.id for r in spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").orderBy("rank").collect()]
    starts = {r.part: r.start for r in spark.read.schema("part int, start long").parquet(f"{folder}/parts").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    by_rank = np.array([*ranked, 0], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<i8")
                known = np.frombuffer(row["doc_ids"][: len(counts)], bool)
                doc_ids = np.frombuffer(row["doc_ids"][len(counts) :], "<i8")
                ids = by_rank[decode(np.frombuffer(row["control"], np.uint8), np.frombuffer(row["data"], np.uint8), counts)]
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                out = [pa.array(doc_ids, mask=~known), pa.array(starts[row["part"]] + row["local_start"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array([ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return blocks.mapInArrow(returning(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))
