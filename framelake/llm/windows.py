"""Repeated windows across documents: equal windows meet in a bucket, the first one stays, all later ones are removed.

A window is a run of consecutive units (words or bytes) of one document. Consecutive windows with the same minimiser, the
least hash of their runs of `k` units, travel as one packed string to the bucket of that minimiser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import mix, partitions, pieces, returning


#: Low bits that hold a place in a flat array of units.
PLACE = np.uint64((1 << 26) - 1)


#: Compression of packed strings and of texts on their way.
LEVEL = 4


#: Types of the numbers of packed super-k-mers.
KINDS = ("<u4", "<u2", "<i8", "<i4", "<i4", "<i4")


@dataclass
class Runs:
    """Super-k-mers: minimiser and its place after the first unit, document, first unit, number of windows, and the packed
    bytes one after the other."""

    least: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    length: np.ndarray
    packed: np.ndarray

    def take(self, chosen: np.ndarray) -> Runs:
        ends = np.concatenate(([0], np.cumsum(self.length)))
        strings = pa.Array.from_buffers(pa.large_binary(), len(self.length), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.packed))])
        data = strings.take(pa.array(chosen)).buffers()[2]
        return Runs(*(getattr(self, f.name)[chosen] for f in fields(self)[:-1]), np.frombuffer(data or b"", np.uint8))

    def dump(self) -> bytes:
        """Compressed; of the minimiser 32 bits, enough to tell most groups of one bucket apart, and of the places the steps.

        Places and lengths fit 32 bits, as no text reaches 2^31 bytes; steps between documents' places may wrap and wrap back.
        """
        values = self.least >> np.uint64(32), self.anchor, np.diff(self.doc, prepend=0), np.diff(self.start, prepend=0), self.count, self.length - self.count
        # first bytes of all numbers, then second bytes and so on: most are zero
        columns = [x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T for x, kind in zip(values, KINDS, strict=True)]
        return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([len(self.least).to_bytes(8, "little"), *(x.tobytes() for x in columns), self.packed.tobytes()]))

    @staticmethod
    def load(raws: list[bytes]) -> Runs:
        parts = []
        for raw in raws:
            data = zstandard.ZstdDecompressor().decompress(raw)
            n, at, columns = int.from_bytes(data[:8], "little"), 8, []
            for kind in KINDS:
                size = np.dtype(kind).itemsize
                columns.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
                at += n * size
            least, anchor, doc, start, count, more = columns
            count = count.astype(np.int64)
            parts.append([least.astype(np.uint64), anchor.astype(np.int64), np.cumsum(doc), np.cumsum(start, dtype=np.int32).astype(np.int64), count, count + more, np.frombuffer(data, np.uint8, -1, at)])
        return Runs(*map(np.concatenate, zip(*parts, strict=True)))


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of `data`, one after the other."""
    total = int(lengths.sum())
    if not total:
        return data[:0]
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_runs(units: np.ndarray, row: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first unit in the flat array, number of windows, minimiser, its place) of each super-k-mer.

    All windows of a super-k-mer hold the same occurrence of their minimiser, so no two of them are equal.

    `units`: hashes of all units; `row`: the row of each.
    """
    n = len(units) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    grams, have = units, 1
    factor = np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        while have < k:  # runs of `have` units grow to at most twice that
            step = min(have, k - have)
            grams = grams[: len(grams) - step] * factor + mix(grams[step:])
            have, factor = have + step, factor * np.uint64(0x9E3779B97F4A7C15)
        grams = mix(grams)
    # the leftmost run of the least hash: its place, in the low bits, decides between equal hashes
    least = sliding_least((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64) & PLACE, window - k + 1)
    whole = row[:n] == row[window - 1 :]
    begins = whole.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | (row[1:n] != row[: n - 1])
    start = np.nonzero(begins)[0]
    place = np.cumsum(begins) - 1
    count = np.bincount(place[whole], minlength=len(start)) if len(start) else np.empty(0, np.int64)
    at = (least[start] & PLACE).astype(np.int64)
    return start, count, grams[at], at


def spread(runs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], units: np.ndarray, window: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers (as of `window_runs`) of minimisers that are among `often` become windows of their own.

    Such a window goes by the hash of its own units: equal ones still meet, and all others part.
    """
    start, count, least, at = runs
    own = np.isin(least, often)
    if not own.any():
        return runs
    n = count[own]
    places = np.repeat(start[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hashes = np.zeros(len(places), np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0xC2B2AE3D27D4EB4F) + units[places + k]
    return np.concatenate((start[~own], places)), np.concatenate((count[~own], np.ones(len(places), count.dtype))), np.concatenate((least[~own], mix(hashes))), np.concatenate((at[~own], np.repeat(at[own], n)))


def frequent_minimisers(rows: DataFrame, split: Callable[[pa.RecordBatch, np.ndarray], Iterator[Runs]], piece: int, one_in: int = 64, distinct: int = 256, most: int = 4096) -> np.ndarray:
    """Minimisers with `distinct` different super-k-mers or more among one document in `one_in`, the `most` frequent at most.

    This only decides how work is dealt: whichever minimisers it names, the result is the same.
    """
    none = np.empty(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, piece):
                for runs in split(batch, none):
                    least, n = np.unique(runs.least[~repeated_within(runs)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(least[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["least", "n"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).mapInArrow(returning(count), "least long, n long")
    found = sample.groupBy("least").agg(F.sum("n").alias("n")).filter(F.col("n") >= distinct).orderBy(F.desc("n"), "least").limit(most).collect()
    return np.array([r.least for r in found], np.int64).view(np.uint64)


def repeated_within(runs: Runs) -> np.ndarray:
    """Mask of super-k-mers that equal an earlier one among these: minimiser, length and bytes alike."""
    again = np.zeros(len(runs.least), bool)
    order = np.lexsort((runs.start, runs.doc, runs.length, runs.least))
    least, length = runs.least[order], runs.length[order]
    same = (least[1:] == least[:-1]) & (length[1:] == length[:-1])
    if not same.any():
        return again
    begins = np.cumsum(runs.length) - runs.length
    groups = np.split(order, np.nonzero(~same)[0] + 1) if len(order) < 1000 else _groups(order, same)
    raw = runs.packed.tobytes()
    for group in groups:
        if len(group) > 1:
            seen: set[bytes] = set()
            for at in group.tolist():
                own = raw[begins[at] : begins[at] + runs.length[at]]
                if own in seen:
                    again[at] = True
                seen.add(own)
    return again


def _groups(order: np.ndarray, same: np.ndarray) -> Iterator[np.ndarray]:
    """Only the groups with more than one member."""
    edges = np.diff(np.concatenate(([0], same.astype(np.int8), [0])))
    for start, stop in zip(np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0], strict=True):
        yield order[start : stop + 1]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def by_minimiser(runs: Runs, most_bytes: int = 4 << 20) -> Iterator[Runs]:
    """The super-k-mers whose minimiser others have too, in portions of about `most_bytes` with all of their minimisers."""
    order = np.nonzero(repeated(runs.least))[0]
    order = order[np.argsort(runs.least[order], kind="stable")]
    least, ends = runs.least[order], np.cumsum(runs.length[order])
    cuts = np.append(np.nonzero(least[1:] != least[:-1])[0] + 1, len(order))
    start = 0
    while start < len(order):
        reached = np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, "right")
        stop = cuts[max(np.searchsorted(cuts, reached, "right") - 1, np.searchsorted(cuts, start, "right"))]
        yield runs.take(order[start:stop])
        start = int(stop)


RANGES = pa.schema([("doc_id", pa.int64()), ("ranges", pa.binary())])


def ranges_of(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows of removed windows: for each document its (first window, number of windows) pairs, packed."""
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    cuts = np.nonzero(doc[1:] != doc[:-1])[0] + 1
    begins = np.concatenate(([0], cuts)).astype(int) if len(doc) else np.empty(0, int)
    pairs = np.stack((start, count), 1).astype("<i4").reshape(-1, 2)
    packed = [x.tobytes() for x in np.split(pairs, cuts)] if len(doc) else []
    return pa.RecordBatch.from_arrays([pa.array(doc[begins], pa.int64()), pa.array(packed, pa.binary())], schema=RANGES)


def removed_windows(docs: DataFrame, split: Callable[[pa.RecordBatch, np.ndarray], Iterator[Runs]], resolve: Callable[[Runs], tuple[np.ndarray, np.ndarray, np.ndarray]], piece: int, expansion: float, bucket_bytes: int = 32 << 20) -> DataFrame:
    """doc_id and packed ranges of windows that also start earlier, several rows a document.

    `split` gives the super-k-mers of a record batch, given minimisers to spread (see `spread`); `resolve` the (doc, first
    window, number) of later windows among super-k-mers, of which all with one minimiser are there. Buckets are as many as
    the text asks for. Before they travel, super-k-mers that are equal in one slice of a task are combined: the first one
    goes on, the others are later ones whatever else there is, so copies don't pile up in a bucket. A passage that many
    documents hold in different surroundings has frequent minimisers, whose windows are spread.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(2 * partitions(spark), int(total * expansion) // bucket_bytes)
    often = frequent_minimisers(rows, split, piece)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, piece):
                for runs in split(batch, often):
                    again = repeated_within(runs)
                    settled = ranges_of(runs.doc[again], runs.start[again], runs.count[again])
                    n = settled.num_rows
                    spread = (mix(settled.column("doc_id").to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(spread), settled.column("doc_id"), settled.column("ranges"), pa.nulls(n, pa.binary())], names=["bucket", "doc_id", "ranges", "runs"])
                    bucket = (mix(runs.least) % np.uint64(buckets)).astype(np.int32)
                    left = np.nonzero(~again)[0]
                    left = left[np.argsort(bucket[left], kind="stable")]
                    own = bucket[left]
                    cuts = np.nonzero(own[1:] != own[:-1])[0] + 1
                    blobs = [runs.take(x).dump() for x in np.split(left, cuts)] if len(left) else []
                    keys = own[np.concatenate(([0], cuts)).astype(int)] if len(left) else own
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary()), pa.array(blobs, pa.binary())], names=["bucket", "doc_id", "ranges", "runs"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = -1

        def bucket() -> list[pa.RecordBatch]:
            later = [ranges_of(*resolve(own)) for own in by_minimiser(Runs.load(held))]
            return pa.Table.from_batches(later, RANGES).combine_chunks().to_batches()

        for batch in batches:
            passed = batch.filter(batch.column("doc_id").is_valid())
            yield passed.select(["doc_id", "ranges"])
            for key, raw in zip(batch.column("bucket").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if raw is None:
                    continue
                if key != at and held:
                    yield from bucket()
                    held = []
                at = key
                held.append(raw)
        if held:
            yield from bucket()

    placed = rows.mapInArrow(returning(pack), "bucket int, doc_id long, ranges binary, runs binary").repartition(max(partitions(spark), buckets // 4), "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(returning(settle), "doc_id long, ranges binary")


def later_windows(windows: Callable[[np.ndarray], np.ndarray], hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Mask of windows that equal an earlier one by (doc, at).

    They are sorted by hash, and neighbours of one hash are compared unit by unit; `windows` gives the units of some of
    them, a row each. Should two different windows have one hash, they are sorted by their units instead.
    """
    order = np.lexsort((at, doc, hashes))
    alike = np.nonzero(hashes[order[1:]] == hashes[order[:-1]])[0]
    for k in range(0, len(alike), step):
        own = alike[k : k + step]
        if (windows(order[own + 1]) != windows(order[own])).any():
            _, kind = np.unique(windows(np.arange(len(hashes))), axis=0, return_inverse=True)
            return later_windows(lambda x: np.zeros((len(x), 1)), kind.ravel(), doc, at)
    later = np.zeros(len(hashes), bool)
    later[order[alike + 1]] = True
    return later


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, packed text (see `unpacked`) and the list of packed ranges of each document (null: none)."""
    lists = ranges.groupBy("doc_id").agg(F.collect_list("ranges").alias("ranges"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for whole in batches:
            for batch in pieces(whole):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if t is None else compressor.compress(t) for t in texts], pa.binary())], names=["doc_id", "text"])

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(returning(pack), "doc_id long, text binary")
    return packed.join(lists, "doc_id", "left")


def unpacked(texts: pa.Array) -> list[bytes]:
    """The texts' bytes; null is empty."""
    decompressor = zstandard.ZstdDecompressor()
    return [b"" if t is None else decompressor.decompress(t) for t in texts.to_pylist()]


def covered(ranges: list[bytes] | None, units: int, window: int) -> np.ndarray:
    """Mask of the units inside removed windows."""
    steps = np.zeros(units + 1, np.int32)
    if ranges:
        pairs = np.frombuffer(b"".join(ranges), "<i4").reshape(-1, 2)
        np.add.at(steps, pairs[:, 0], 1)
        np.add.at(steps, np.minimum(pairs[:, 0] + pairs[:, 1] + window - 1, units), -1)
    return np.cumsum(steps[:-1]) > 0
