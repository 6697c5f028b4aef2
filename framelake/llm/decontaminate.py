"""Benchmark decontamination: test items inside documents, up to an error budget.

An item with budget e is cut into e + 1 pieces; e errors leave one of them whole, so exact piece hits (all pieces of all
items in one automaton) name the places where Myers' bit-parallel edit distance then decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import pieces, returning

#: Bytes of benchmark items in one automaton, which takes some forty times that in each Python worker.
BLOCK = 4 << 20


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


@dataclass
class Item:
    item_id: int
    text: str
    budget: int

    @cached_property
    def masks(self) -> dict[str, int]:
        """Of each character the bits of its places; made when the item's first piece is hit."""
        out: dict[str, int] = {}
        for k, c in enumerate(self.text):
            out[c] = out.get(c, 0) | 1 << k
        return out

    def distance(self, window: str) -> int:
        """Least edit distance between the item and any stretch of `window` (Myers, one machine of len(item) bits)."""
        last, all_bits = 1 << (len(self.text) - 1), (1 << len(self.text)) - 1
        plus, minus, score, least = all_bits, 0, len(self.text), len(self.text)
        masks = self.masks
        for c in window:
            same = masks.get(c, 0)
            down = same | minus
            along = (((same & plus) + plus) ^ plus) | same
            up_plus, up_minus = minus | ~(along | plus), plus & along
            if up_plus & last:
                score += 1
            elif up_minus & last:
                score -= 1
                if score < least:
                    least = score
            up_plus, up_minus = up_plus << 1, up_minus << 1
            plus, minus = (up_minus | ~(down | up_plus)) & all_bits, up_plus & down & all_bits
        return least

    def cuts(self) -> list[int]:
        """Ends of the budget + 1 pieces."""
        n = self.budget + 1
        return [len(self.text) * k // n for k in range(n + 1)]


class Finder:
    """All items' pieces in one automaton."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.items = items
        places: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(items):
            cuts = item.cuts()
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                places.setdefault(item.text[start:stop], []).append((k, stop))
        for piece, at in places.items():
            self.automaton.add_word(piece, at)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Least distance within budget of each item found in the normalised text, by place of the item."""
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        if not len(self.automaton):
            return found
        for end, places in self.automaton.iter(text):
            for k, stop in places:
                if found.get(k) == 0:
                    continue
                item = self.items[k]
                start = end + 1 - stop
                near = start // (item.budget + 1)
                if (k, near) in tried:
                    continue
                tried.add((k, near))
                low = near * (item.budget + 1)  # every start of this stretch, and the budget around it
                n, e = len(item.text), item.budget
                distance = 0 if text.startswith(item.text, start) and start >= 0 else item.distance(text[max(0, low - e) : low + e + n + e + 1])
                if distance <= e and distance < found.get(k, e + 1):
                    found[k] = distance
        return found


def blocks(benchmark: DataFrame, share: float, min_chars: int, block_bytes: int) -> Iterator[list[tuple[int, str, int]]]:
    """(item_id, normalised text, budget) in blocks of about `block_bytes`; each block alone comes to the driver."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = -(-total // block_bytes)
    for k in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        texts = [(r.item_id, normal(r.text)) for r in own.orderBy("item_id", "text").collect()]
        yield [(i, t, int(len(t) * share)) for i, t in texts if len(t) >= max(min_chars, 1)]


def matches(docs: DataFrame, benchmark: DataFrame, share: float = 1 / 12, min_chars: int = 0, block_bytes: int = BLOCK) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, item_chars.

    The budget is `share` of the item's normalised characters, rounded down, so items under 1 / `share` characters are
    found verbatim only, wherever they stand. Callers who take short items for ordinary phrases can leave out those under
    `min_chars` characters. Items without a character, null items and null documents match nothing. A benchmark above
    `block_bytes` is taken in blocks, one pass over the documents each. Repeated items and repeated doc_ids give rows of
    their own; other columns are not read.
    """
    out = None
    for block in blocks(benchmark, share, min_chars, block_bytes):
        found = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_search(docs, block), "doc_id long, item_id long, distance long, item_chars long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long, item_chars long")


def _search(docs: DataFrame, block: list[tuple[int, str, int]]):
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder([Item(*x) for x in sent.value])
        for whole in batches:
            for batch in pieces(whole):
                rows = [(d, finder.items[k].item_id, e, len(finder.items[k].text)) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, e in finder.find(normal(t)).items()]
                names = ["doc_id", "item_id", "distance", "item_chars"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=names)

    return returning(run)


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 1 / 12, min_chars: int = 0, block_bytes: int = BLOCK) -> DataFrame:
    """The documents in which no item is found (see `matches`), with all their columns; null texts and repeated rows stay."""
    for block in blocks(benchmark, share, min_chars, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder([Item(*x) for x in sent.value])
            for whole in batches:
                for batch in pieces(whole):
                    yield batch.filter(pa.array([not finder.find(normal(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(returning(run), docs.schema)
    return docs
