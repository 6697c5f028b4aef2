"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

Equal shingle sets are collapsed first. Bands then name candidates. In a first round each band's members are compared
with its smallest document; where a band still holds several components, its members are compared across components in
blocks inside tasks, the closest pairs of two components first, so that no link needs a band's pairs to be listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import drop_staged, gram_hashes, mix, partitions, pieces, returning, staged, word_hashes, words_of

#: Words of a shingle; coordinates of a sketch (a power of two); coordinates of a band and bands.
#: A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 < 0.00001.
SHINGLE, WIDTH, ROWS, BANDS = 5, 1024, 4, 32
#: Two bits of each coordinate serve estimates. At similarity 0.75 they agree in a share of 0.8125, with a standard
#: deviation of 0.0122; six of these below lies the least share at which a pair is verified.
LEAST_AGREEMENT = 0.739
#: Share of agreeing coordinates at similarity 0.75, and the coordinates of longer sketches, of the documents that still meet
#: others across components. Their deviation is half as large, and so is the distance of their limit from that share.
AGREEMENT, LONG = 0.8125, 4096
BLOCK = 2048
#: Pairs of two components in a block of a band that are compared before all others.
CLOSEST = 4
#: Edges of a vertex that meet in one task.
HUB = 4096


def agreement(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of the coordinates whose two bits agree, for rows of packed bits."""
    differ = one ^ two
    return 1 - np.bitwise_count((differ | differ >> np.uint8(1)) & np.uint8(0x55)).sum(1, dtype=np.int64) / (4 * differ.shape[1])


def long_limit(least_agreement: float) -> float:
    """The limit of long sketches that lies as many of their deviations below `AGREEMENT`; 0 stays 0, and what lies above stays."""
    return AGREEMENT - (AGREEMENT - least_agreement) * (WIDTH / LONG) ** 0.5 if 0 < least_agreement < AGREEMENT else least_agreement


def two_bits(coordinates: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, packed in rows of bytes."""
    bits = (mix(coordinates) & np.uint64(3)).astype(np.uint8).reshape(len(coordinates), -1, 4)
    return bits @ np.array([1, 4, 16, 64], np.uint8)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of the distinct shingles of each text, in order of both; words are lower-cased in A-Z.

    With fewer than `k` words the whole sequence is the one shingle.
    """
    offsets, words = words_of(texts)
    coded = words.dictionary_encode()
    lowered = pa.array([w.translate(LOWER) for w in coded.dictionary.cast(pa.binary()).to_pylist()], pa.binary())
    hashes = word_hashes(lowered)[coded.indices.to_numpy()] if len(lowered) else np.empty(0, np.uint64)
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), counts)
    grams = gram_hashes(hashes, k)
    inside = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.empty(0, bool)
    row, gram = [rows[: len(grams)][inside]], [grams[inside]]
    for n in range(1, k):
        short = np.nonzero(counts == n)[0]
        if len(short):
            row.append(short)
            gram.append(gram_hashes(hashes, n)[offsets[short]] ^ np.uint64(n))
    row, gram = np.concatenate(row), np.concatenate(gram)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sketch(row: np.ndarray, gram: np.ndarray, n_rows: int, width: int = WIDTH) -> np.ndarray:
    """Fast similarity sketch of each row's set: `width` coordinates, equal with the sets' similarity as probability.

    In round i < width every element falls into a hashed bin; in round width + i all fall into bin i, so each bin of a
    non-empty set is filled after 2 * width rounds at the latest. A bin keeps its first round's least hash.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_rows * width, empty)
    shift, low = np.uint64(64 - (width.bit_length() - 1)), np.uint64((1 << 53) - 1)
    out = out.reshape(n_rows, width)
    for i in range(2 * width):
        if not len(row):
            break
        hashed = mix(gram + np.uint64((i + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
        bins = (hashed >> shift).astype(np.int64) if i < width else np.full(len(row), i - width)
        np.minimum.at(out.ravel(), row * width + bins, (np.uint64(i) << np.uint64(53)) | (hashed & low))
        if i % 8 == 7:
            own = np.unique(row)
            unfilled = np.zeros(n_rows, bool)
            unfilled[own] = (out[own] == empty).any(1)
            row, gram = row[unfilled[row]], gram[unfilled[row]]
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set in two numbers, band hashes and two bits of each coordinate."""
    kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "low": pa.int64(), "high": pa.int64(), "bands": pa.list_(pa.int64()), "bytes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2 << 20, 1024):
                n = batch.num_rows
                row, gram = shingle_sets(batch.column("text"))
                sizes = np.bincount(row, minlength=n)
                coordinates = sketch(row, gram, n)
                low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(low, row, mix(gram))
                np.bitwise_xor.at(high, row, mix(gram ^ np.uint64(0x5851F42D4C957F2D)))
                banded = np.zeros((n, BANDS), np.uint64)
                for k in range(ROWS):
                    banded = mix(banded * np.uint64(31) + coordinates[:, k : BANDS * ROWS : ROWS])
                banded = (banded >> np.uint64(7) << np.uint64(6)) >> np.uint64(1) | np.arange(BANDS, dtype=np.uint64)
                raw = two_bits(coordinates)
                some = sizes > 0
                ends = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
                arrays = [batch.column("doc_id"), pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.ListArray.from_arrays(ends, banded[some].astype(np.int64).ravel()), pa.array([x.tobytes() for x in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(returning(run), "doc_id long, n_shingles long, low long, high long, bands array<long>, bytes binary")


def long_sketches(texts: DataFrame) -> DataFrame:
    """doc and two bits of each coordinate of its long sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20, 256):
                row, gram = shingle_sets(batch.column("text"))
                raw = two_bits(sketch(row, gram, batch.num_rows, LONG))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([x.tobytes() for x in raw], pa.binary())], names=["doc", "bytes"])

    return texts.select("doc", "text").mapInArrow(returning(run), "doc long, bytes binary")


def across_bands(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of the bands' members (band, b) those in bands with several components: band, doc, c and the band's size n."""
    known = members.select("band", F.col("b").alias("doc")).join(labels.select(F.col("v").alias("doc"), "c"), "doc", "left").select("band", "doc", F.coalesce("c", "doc").alias("c"))
    mixed = known.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).filter(F.col("least") < F.col("most"))
    return known.join(mixed.select("band", "n"), "band")


def estimates(pairs: DataFrame, least_agreement: float) -> DataFrame:
    """Of pairs with both sketches' bytes, those whose coordinates agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, WIDTH // 4) for k in ("bytes_a", "bytes_b"))
                near = agreement(one, two) >= least_agreement
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "bytes_a", "bytes_b").mapInArrow(returning(run), "a long, b long")


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Stretches of rows with equal `key` from a stream that is sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in key], 1)
        cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(keys[start].tolist())
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those with similarity of at least 0.75 on the full shingle sets.

    Partners of one `a` are dealt over as many tasks as their number asks for; each task holds one set and streams the others.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 64)).cast("int").alias("salt"))
    first = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("doc"), F.lit(0).alias("turn"))
    wanted = first.unionByName(dealt.select("a", "salt", F.col("b").alias("doc"), F.lit(1).alias("turn")))
    rows = wanted.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    spark = pairs.sparkSession
    placed = rows.select("a", "salt", "turn", "doc", "text").repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "turn", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.uint64)
        for whole in batches:
            for batch in pieces(whole):
                row, gram = shingle_sets(batch.column("text"))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                a, b = [], []
                for k, (one, salt, turn, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "turn", "doc")), strict=True)):
                    own = gram[ends[k] : ends[k + 1]]
                    if turn == 0:
                        at, held = (one, salt), own
                    elif at == (one, salt):
                        place = np.searchsorted(held, own)
                        both = int((held[np.minimum(place, len(held) - 1)] == own).sum()) if len(held) else 0
                        if 100 * both >= 75 * (len(held) + len(own) - both) > 0:
                            a.append(one)
                            b.append(doc)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return placed.mapInArrow(returning(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """v and the least vertex c reachable from it, for the vertices of `links` (a, b).

    The edges of a hub are dealt over as many parts as their number asks for, and its label goes to each of them.
    """
    edges = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = staged(edges.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("u", "v").alias("c")), "labels")
    wide = staged(edges.groupBy("u").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).filter("parts > 1"), "hubs")
    hubs = not wide.isEmpty()
    if hubs:
        parts = F.coalesce("parts", F.lit(1))
        dealt = staged(edges.join(wide, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), parts).cast("int").alias("part")), "edges")
        drop_staged(edges)
        edges = dealt
    while True:
        told = labels.select(F.col("v").alias("u"), "c")
        if hubs:
            told = told.join(wide, "u", "left").select("u", "c", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        heard = edges.join(told, ["u", "part"] if hubs else "u").groupBy("v").agg(F.min("c").alias("heard"))
        least = labels.join(heard, "v").select("v", "c", F.least("c", "heard").alias("least"))
        jump = labels.select(F.col("v").alias("least"), F.col("c").alias("beyond"))
        after = staged(least.join(jump, "least", "left").select("v", F.coalesce("beyond", "least").alias("c"), (F.coalesce("beyond", "least") < F.col("c")).alias("changed")), "labels")
        drop_staged(labels)
        labels = after
        if after.filter("changed").isEmpty():
            drop_staged(edges, wide)
            return after


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (v, c) of `components` after further links."""
    root = lambda k: labels.select(F.col("v").alias(k), F.col("c").alias(f"c{k}"))
    both = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = components(both.filter("a <> b"))
    old = labels.join(up.select(F.col("v").alias("c"), F.col("c").alias("top")), "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    new = up.join(labels.select("v"), "v", "left_anti").select("v", "c")
    out = staged(old.unionByName(new), "labels")
    drop_staged(up, labels)
    return out


class Best:
    """Pairs of documents, of which for each two components only the `closest` go on (None: all)."""

    def __init__(self, closest: int | None, most: int = 1 << 16):
        self.closest, self.most, self.held, self.number = closest, most, [], 0

    def add(self, *columns: np.ndarray) -> None:
        """Components, documents and agreement of some pairs."""
        self.held.append(columns)
        self.number += len(columns[4])

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.number > self.most:
            if self.closest is None:
                yield from self.rest()
            else:
                self.cut()

    def cut(self) -> None:
        one, two, a, b, alike = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((b, a, -alike, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        begins = np.nonzero(new)[0]
        turn = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        kept = order[turn < self.closest]
        self.held, self.number = [tuple(x[kept] for x in (one, two, a, b, alike))], len(kept)
        self.most = max(self.most, 2 * self.number)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            if self.closest is not None:
                self.cut()
            a, b = (np.concatenate([x[k] for x in self.held]) for k in (2, 3))
            self.held, self.number = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def across(members: DataFrame, least_agreement: float, closest: int | None = None) -> DataFrame:
    """Pairs (a, b) of different components in one band whose sketches agree, each in its first shared band only.

    `members`: band, doc, c, n (see `across_bands`), bands, bytes. Large bands are cut into blocks by hash, and pairs of blocks meet in tasks. With
    `closest`, of each two components that meet there only so many pairs, those that agree best.
    """
    spark = members.sparkSession
    sized = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = sized.withColumn("block", block).select("band", "doc", "c", "block", "bands", "bytes", F.inline(meets))
    placed = dealt.repartition(partitions(spark), "band", "i", "j").sortWithinPartitions("band", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["band", "i", "j"]):
            doc, comp, block = (group.column(k).to_numpy() for k in ("doc", "c", "block"))
            if len(doc) < 2 or (comp == comp[0]).all():
                continue
            band, i, j = (group.column(k)[0].as_py() for k in ("band", "i", "j"))
            bands = np.stack(group.column("bands").combine_chunks().to_numpy(zero_copy_only=False))
            raw = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8).reshape(len(doc), -1)
            earlier = band & (BANDS - 1)
            left = np.nonzero(block == i)[0]
            best = Best(closest)
            for at in left.tolist():
                other = (comp != comp[at]) & (block == j) & ((doc > doc[at]) | (i != j))
                other = np.nonzero(other)[0]
                alike = agreement(raw[other], raw[at])
                near = alike >= least_agreement
                other, alike = other[near], alike[near]
                first = ~(bands[other, :earlier] == bands[at, :earlier]).any(1)
                other, alike = other[first], alike[first]
                if len(other):
                    best.add(np.minimum(comp[at], comp[other]), np.maximum(comp[at], comp[other]), np.minimum(doc[at], doc[other]), np.maximum(doc[at], doc[other]), alike)
                    yield from best.full()
            yield from best.rest()

    return placed.mapInArrow(returning(run), "a long, b long")


def near_duplicates(docs: DataFrame, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id of its near-duplicates), kept.

    Links join documents of similarity 0.75 or more on 5-word shingles. Texts without words have no shingles and no
    links. A null doc_id has no component and is kept; doc_ids are taken as unique, rows that repeat one share its component.
    Candidates whose sketches agree in a share below `least_agreement` are not compared; 0 compares all of them. Longer
    sketches, of the last turns, have a limit as many of their deviations below the share at similarity 0.75.
    """
    found = staged(sketches(docs), "sketches")
    some = found.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = staged(some.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")), "sets")
    banded = sets.select("doc", F.explode("bands").alias("band"))
    leaders = staged(banded.groupBy("band").agg(F.min("doc").alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "a"), "leaders")
    members = staged(banded.join(leaders, "band").select("band", "a", F.col("doc").alias("b")), "members")
    in_band = members.select(F.col("b").alias("doc")).distinct()
    candidates = staged(sets.join(in_band, "doc", "left_semi").select("doc", "bands", "bytes"), "candidates")
    texts = staged(docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(in_band.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi"), "texts")
    raw = candidates.select("doc", "bytes")
    pairs = members.filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(raw.toDF("a", "bytes_a"), "a").join(raw.toDF("b", "bytes_b"), "b")
    near = staged(estimates(pairs, least_agreement), "pairs")
    links = staged(verified(near, texts), "links")
    labels = components(links)
    # most components that belong together are found by their closest pairs; then all other pairs are compared
    tried, seen, long = near.select("a", "b"), [near], None
    for closest in (CLOSEST, None):
        mixed = staged(across_bands(members, labels), "mixed")
        if long is None:  # the second turn's documents are among these
            own = texts.withColumnRenamed("doc_id", "doc").join(mixed.select("doc").distinct(), "doc", "left_semi")
            long = staged(long_sketches(own), "long")
        meeting = mixed.join(candidates.select("doc", "bands"), "doc").join(long, "doc")
        limit = long_limit(least_agreement)
        far = staged(across(meeting, limit, closest).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        drop_staged(mixed)
        if far.isEmpty():
            continue
        more = staged(verified(far, texts), "links")
        if not more.isEmpty():
            labels = joined(labels, more)
        drop_staged(more)
        tried = tried.unionByName(far)
        seen.append(far)
    drop_staged(leaders, members, candidates, texts, long, *seen)
    named = sets.select("low", "high", "n_shingles", "doc").join(labels, F.col("doc") == F.col("v"), "left").select("low", "high", "n_shingles", F.coalesce("c", "doc").alias("component"))
    named = staged(named, "components")
    drop_staged(labels, links, sets)
    out = found.select("doc_id", "n_shingles", "low", "high").join(named, ["low", "high", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
