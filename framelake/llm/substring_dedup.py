"""Repeated word windows across documents, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from framelake.llm.common import mix, pieces, returning, word_hashes, words_of
from framelake.llm.windows import Runs, covered, gather, later_windows, removed_windows, repeated, repeated_within, spread, unpacked, window_runs, with_ranges

#: Words of the runs whose least hash is a window's minimiser; words of a batch that are looked at together.
GRAM, CHUNK = 4, 1 << 22


def spaced(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words with a space after each, as bytes, and where each begins."""
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    ends = np.cumsum(length + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = raw
    return out, np.concatenate(([0], ends))


def split_words(window: int):
    def split(batch: pa.RecordBatch, often: np.ndarray) -> Iterator[Runs]:
        offsets, words = words_of(batch.column("text"))
        doc_ids, row = batch.column("doc_id").to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        for low in range(0, max(1, len(words) - window + 1), CHUNK):  # overlapping, so that each window lies in one chunk
            own, home = words.slice(low, CHUNK + window - 1), row[low : low + CHUNK + window - 1]
            units = word_hashes(own)
            start, count, least, _ = spread(window_runs(units, home, window, GRAM), units, window, often)
            text, at = spaced(own)
            begin, stop = at[start], at[start + count + window - 1]
            yield Runs(least, np.zeros_like(start), doc_ids[home[start]], low + start - offsets[home[start]], count, stop - begin, gather(text, begin, stop - begin))

    return split


def resolve_words(window: int):
    def resolve(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorts all windows of the bucket; the words are coded by number, so equality is exact.

        Of equal super-k-mers only the first one's windows are sorted: all windows of the others are later ones.
        """
        again = repeated_within(runs)
        copies = runs.doc[again], runs.start[again], runs.count[again]
        runs = runs.take(np.nonzero(~again)[0])
        runs = runs.take(np.nonzero(repeated(runs.least))[0])
        if not len(runs.least):
            return copies
        words = pa.array(runs.packed.tobytes().decode().split(" ")[:-1]).dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        number = runs.count + window - 1
        first = np.repeat(np.cumsum(number) - number, runs.count)
        step = np.arange(int(runs.count.sum())) - np.repeat(np.cumsum(runs.count) - runs.count, runs.count)
        place, doc, at = first + step, np.repeat(runs.doc, runs.count), np.repeat(runs.start, runs.count) + step
        hashes = np.zeros(len(place), np.uint64)
        units = mix(codes.astype(np.uint64) + np.uint64(1))
        with np.errstate(over="ignore"):
            for k in range(window):
                hashes = hashes * np.uint64(0xC2B2AE3D27D4EB4F) + units[place + k]
        span = np.arange(window)
        later = later_windows(lambda x: codes[place[x][:, None] + span], hashes, doc, at)
        return tuple(map(np.concatenate, zip(copies, (doc[later], at[later], np.ones(int(later.sum()), np.int64)), strict=True)))

    return resolve


def remove_repeats(docs: DataFrame, window: int = 20, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with `keep_text` kept.

    Removes each word inside a run of `window` words that also starts earlier (smaller doc_id, or same document and
    earlier start), judged on the input. Null texts have no words. Rows with a null doc_id have no place in the order:
    they lose nothing and make no other row lose anything. doc_ids are taken as unique; rows that repeat one are windows
    of one document, and each of them loses what any of them loses.
    """
    ranges = removed_windows(docs, split_words(window), resolve_words(window), 4 << 20, 3.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
                for text, ranges in zip(unpacked(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                    words = text.split()
                    gone = covered(ranges, len(words), window) if ranges else None
                    kept = b" ".join(words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                    rows["n_words"].append(len(words))
                    rows["n_removed"].append(0 if gone is None else int(gone.sum()))
                    rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    rows["kept"].append(kept.decode() if keep_text else None)
                kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.string()} if keep_text else {})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[k], kind) for k, kind in kinds.items())], names=["doc_id", *kinds])

    return with_ranges(docs, ranges).mapInArrow(returning(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else ""))
