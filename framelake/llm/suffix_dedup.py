"""Repeated byte strings across documents, by suffix arrays.

Strings that share a minimiser meet in a bucket (see `windows`). There they are laid end to end as blocks of bytes counted
from the minimiser on, the suffix array of the blocks is built, and neighbours with common prefixes form the classes of
equal strings and equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm.common import mix, pieces, returning
from framelake.llm.windows import Runs, covered, gather, later_windows, removed_windows, repeated, spread, unpacked, window_runs, with_ranges

#: Bytes of the runs whose least hash is a window's minimiser; bytes of a text that are looked at together.
GRAM, CHUNK = 16, 1 << 20


def split_bytes(window: int):
    hashes = mix(np.arange(1, 257, dtype=np.uint64))

    def split(batch: pa.RecordBatch, often: np.ndarray) -> Iterator[Runs]:
        doc_ids, texts = batch.column("doc_id").to_numpy(), batch.column("text").cast(pa.binary()).to_pylist()
        # long texts in overlapping chunks: each window lies in one
        chunks = [(k, at, text[at : at + CHUNK + window - 1]) for k, text in enumerate(texts) for at in range(0, max(1, len(text) - window + 1), CHUNK)]
        while chunks:
            held, size = [], 0
            while chunks and (not held or size + len(chunks[-1][2]) <= 3 * CHUNK):
                held.append(chunks.pop())
                size += len(held[-1][2])
            data = np.frombuffer(b"".join([x[2] for x in held]), np.uint8)
            length = np.array([len(x[2]) for x in held])
            row, first = np.repeat(np.arange(len(held), dtype=np.int32), length), np.cumsum(length) - length
            units = hashes[data]
            start, count, least, at = spread(window_runs(units, row, window, GRAM), units, window, often)
            own = row[start] if len(start) else np.empty(0, int)
            doc, base = doc_ids[np.array([x[0] for x in held])], np.array([x[1] for x in held])
            yield Runs(least, at - start, doc[own], start - first[own] + base[own], count, count + window - 1, gather(data, start, count + window - 1))

    return split


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers in linear time, by grouping.

    A group holds the suffixes whose Lyndon prefix begins alike so far; its name is its first slot, so names order groups.
    Groups are taken from the highest down. The previous smaller suffix of each member is then known to be followed by
    the group's prefix, once for each member that points to it, and moves up within its own group accordingly. At the
    end the groups are the Lyndon groups, and one scan from the smallest suffix up fills their slots.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    begins = np.nonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[0]
    group = np.empty(n, np.int64)
    group[order] = np.repeat(begins, np.diff(np.append(begins, n)))
    group = group.tolist()
    members: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    start_of: dict[int, int] = {}
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True):
        members[begin], size[begin], start_of[end] = order[begin:end].tolist(), end - begin, begin
    previous = [-1] * n
    end = n
    while end:
        start = start_of[end]
        moved: dict[tuple[int, int], list[int]] = {}
        last, pointers = -1, 0
        for i in members.pop(start):
            if group[i] != start:
                continue
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            if j < 0:
                continue
            if j == last:
                pointers += 1
                continue
            if last >= 0:
                moved.setdefault((pointers, group[last]), []).append(last)
            last, pointers = j, 1
        if last >= 0:
            moved.setdefault((pointers, group[last]), []).append(last)
        by_pointers: dict[int, list[int]] = {}
        for pointers, old in moved:
            by_pointers.setdefault(pointers, []).append(old)
        for pointers in range(max(by_pointers, default=0), 0, -1):  # no more rounds than members
            for old in by_pointers.get(pointers, ()):
                own = moved[pointers, old]
                left = size[old] - len(own)
                if left:
                    new = old + left
                    start_of[new + len(own)], start_of[new] = new, old
                    members[new], size[new], size[old] = own, len(own), left
                    for j in own:
                        group[j] = new
        end = start
    slot = list(range(n))  # of each group, the next slot to fill
    out, placed = [-1] * n, [False] * n
    for k in range(-1, n):
        j = n - 1 if k < 0 else out[k] - 1
        while j >= 0 and not placed[j]:
            at = slot[group[j]]
            slot[group[j]] = at + 1
            out[at], placed[j] = j, True
            j = previous[j]
    return np.array(out, np.int64)


class Bytes:
    """The packed bytes of super-k-mers, read eight at a time from any place on."""

    def __init__(self, packed: np.ndarray):
        self.padded = np.concatenate((packed, np.zeros(8, np.uint8)))
        self.words = np.ndarray((len(packed) + 1,), "<u8", self.padded, strides=(1,))

    def stretches(self, at: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
        """The stretches of `length` bytes from `at` on as words; bytes beyond a stretch are zero."""
        for k in range(0, int(length.max(initial=0)), 8):
            left = np.clip(length - k, 0, 8)
            shift = (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)) & np.uint64(63)
            word = self.words[np.minimum(at + k, len(self.words) - 1)]
            yield np.where(left > 0, word & (np.uint64(0xFFFFFFFFFFFFFFFF) >> shift), np.uint64(0))

    def hashes(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = length.astype(np.uint64)
        for word in self.stretches(at, length):
            out = mix(out * np.uint64(31) + word)
        return out

    def same(self, one: np.ndarray, two: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For pairs of stretches of equal length, whether their bytes are the same."""
        out = np.ones(len(one), bool)
        for a, b in zip(self.stretches(one, length), self.stretches(two, length), strict=True):
            out &= a == b
        return out


def block_names(data: Bytes, at: np.ndarray, size: int) -> np.ndarray:
    """A number for each block of `size` bytes from the places `at` on, the same for equal blocks only."""
    wide = [data.words[at + k] for k in range(0, size, 8)]
    mixed = np.zeros(len(at), np.uint64)
    for x in wide:
        mixed = mix(mixed * np.uint64(31) + x)
    _, first, name = np.unique(mixed, return_index=True, return_inverse=True)
    if any((x != x[first[name]]).any() for x in wide):  # two blocks with one hash
        _, name = np.unique(np.stack(wide, 1), axis=0, return_inverse=True)
    return name.ravel()


class Letters:
    """Super-k-mers as strings of blocks of `size` bytes, counted from each one's minimiser on, and their suffix array.

    All windows of a super-k-mer hold its minimiser, so equal windows lie alike around it: they are made of the same
    blocks and of a few bytes before and after them.
    """

    def __init__(self, runs: Runs, size: int):
        self.size, self.data = size, Bytes(runs.packed)
        self.begin = np.cumsum(runs.length) - runs.length
        self.lead = runs.anchor % size  # bytes before the first block
        self.blocks = (runs.length - self.lead) // size
        self.first = np.cumsum(self.blocks + 1) - self.blocks - 1  # each one's first letter; a zero follows its last
        owner = np.repeat(np.arange(len(self.blocks)), self.blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(self.blocks) - self.blocks, self.blocks)
        self.text = np.zeros(int(self.blocks.sum()) + len(self.blocks), np.int64)
        self.text[self.first[owner] + number] = block_names(self.data, self.begin[owner] + self.lead[owner] + size * number, size) + 1
        self.order = suffix_array(self.text)

    def prefix_classes(self, depth: int) -> np.ndarray:
        """For each number of letters up to `depth`, the class of each suffix among those that begin with the same ones."""
        padded = np.concatenate((self.text, np.zeros(depth, np.int64)))
        differs, out = np.zeros(len(self.text), bool), np.empty((depth, len(self.text)), np.int64)
        for d in range(depth):
            differs[1:] |= padded[self.order[1:] + d] != padded[self.order[:-1] + d]
            out[d, self.order] = np.cumsum(differs)
        return out

    def equal_runs(self, runs: Runs) -> np.ndarray:
        """Mask of the super-k-mers that equal an earlier one.

        Equal ones are neighbours in the suffix array, with the same letters to the end, and have the same bytes before and
        after these. Of the others, windows are still compared one by one.
        """
        whole = np.full(len(self.text), -1)
        whole[self.first] = np.arange(len(self.first))
        ordered = whole[self.order]
        ordered = ordered[ordered >= 0]
        now, before = ordered[1:], ordered[:-1]
        same = (self.blocks[now] == self.blocks[before]) & (self.lead[now] == self.lead[before]) & (runs.length[now] == runs.length[before])
        for d in range(int(self.blocks.max(initial=0))):
            some = np.nonzero(same & (self.blocks[now] > d))[0]
            same[some] = self.text[self.first[now[some]] + d] == self.text[self.first[before[some]] + d]
        kind = np.empty(len(self.first), np.int64)
        kind[ordered] = np.cumsum(np.concatenate(([True], ~same)))
        end = self.begin + self.lead + self.size * self.blocks
        tail = runs.length - self.lead - self.size * self.blocks
        around = mix(self.data.hashes(self.begin, self.lead)) ^ self.data.hashes(end, tail)
        order = np.lexsort((runs.start, runs.doc, around, kind))
        now, before = order[1:], order[:-1]
        alike = np.nonzero((kind[now] == kind[before]) & (around[now] == around[before]))[0]
        now, before = now[alike], before[alike]
        again = np.zeros(len(self.first), bool)
        again[now[self.data.same(self.begin[before], self.begin[now], self.lead[now]) & self.data.same(end[before], end[now], tail[now])]] = True
        return again


def resolve_bytes(window: int):
    size = next((x for x in (32, 8) if window >= 2 * x - 1), None)
    if size is None or window < GRAM:
        raise ValueError(f"windows of {window} bytes are too short")

    def resolve(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of equal windows all but the first, from neighbours in one suffix array over all super-k-mers (see `Letters`)."""
        letters = Letters(runs, size)
        again = letters.equal_runs(runs)
        copies = runs.doc[again], runs.start[again], runs.count[again]
        # the windows of the others, as the letters that they hold and the bytes around these
        rest = np.nonzero(~again)[0]
        count = runs.count[rest]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        own = np.repeat(rest, count)
        head = (letters.lead[own] - step) % size
        depth = (window - head) // size
        kind = letters.prefix_classes(window // size)[depth - 1, letters.first[own] + (step + head - letters.lead[own]) // size]
        kind = (kind * (window // size + 1) + depth) * size + head  # windows of one kind hold the same letters in the same places
        often = repeated(kind)
        own, step, head, depth, kind = (x[often] for x in (own, step, head, depth, kind))
        place = letters.begin[own] + step
        tail = head + size * depth
        around = mix(letters.data.hashes(place, head)) ^ letters.data.hashes(place + tail, window - tail)
        doc, at = runs.doc[own], runs.start[own] + step
        order = np.lexsort((at, doc, around, kind))
        now, before = order[1:], order[:-1]
        alike = np.nonzero((kind[now] == kind[before]) & (around[now] == around[before]))[0]
        now, before = now[alike], before[alike]
        if not (letters.data.same(place[before], place[now], head[now]) & letters.data.same(place[before] + tail[before], place[now] + tail[now], window - tail[now])).all():
            # different bytes with one hash: all of these windows are sorted by their bytes instead
            now = np.nonzero(later_windows(lambda x: runs.packed[place[x][:, None] + np.arange(window)], kind.astype(np.uint64), doc, at))[0]
        return tuple(map(np.concatenate, zip(copies, (doc[now], at[now], np.ones(len(now), np.int64)), strict=True)))

    return resolve


def remove_repeats(docs: DataFrame, window: int = 100, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `keep_text` kept (binary).

    Removes each UTF-8 byte inside a string of `window` bytes that also starts earlier (smaller doc_id, or same document
    and earlier start), judged on the input. Null texts are empty. Rows with a null doc_id have no place in the order:
    they lose nothing and make no other row lose anything. doc_ids are taken as unique; rows that repeat one are strings
    of one document, and each of them loses what any of them loses.
    """
    ranges = removed_windows(docs, split_bytes(window), resolve_bytes(window), 4 << 20, 4.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                rows: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for text, ranges in zip(unpacked(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                    kept = text
                    removed = spans = 0
                    if ranges:
                        gone = covered(ranges, len(text), window)
                        removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    for name, value in zip(rows, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                        rows[name].append(value)
                kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if keep_text else {})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[k], kind) for k, kind in kinds.items())], names=["doc_id", *kinds])

    return with_ranges(docs, ranges).mapInArrow(returning(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
