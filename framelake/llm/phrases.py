"""Phrases whose words go together: counts of all phrases from a weighted de Bruijn graph.

The nodes of a language's graph are runs of four words, an edge is a run of five, and its weight is how often it occurs. A
run that a piece's end cuts short is filled up with ends and gives the correction for nodes that nothing follows. So each
word occurrence is one edge, a phrase's count is the weight of the edges that begin with it, and shorter phrases need no
counting of their own.

Edges are summed in slices of text, dealt to buckets by ranges of an order in which edges with the same first words lie
together, and summed there. Only phrases on the border of two ranges have parts in both. Of the frequent edges those that
follow each other without branching are joined to paths; the nodes within a path are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import drop_staged, mix, partitions, pieces, returning, staged

LONGEST = 5
#: Least count of a candidate; phrases reported for a language.
LEAST, TOP = 100, 2000
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Text of a bucket and of a slice, in bytes; edges of a sample that the ranges are fitted on, for each bucket.
BUCKET, SLICE, SAMPLED = 8 << 20, 16 << 20, 16
#: Bits of each of the first four words' hashes in an edge's order.
BITS = 16

#: Classes of bytes: 0 in a word, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_in_pieces(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in lower case, the word at each place, and the piece of each place."""
    raw = np.frombuffer(text, np.uint8)
    kinds = KINDS[raw]
    inside = np.concatenate(([False], kinds == 0, [False]))
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    starts, stops = edges[::2], edges[1::2]
    ends = np.concatenate(([0], np.cumsum(stops - starts)))
    letters = LOWER[raw[inside[1:-1]]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(np.nonzero(kinds == 2)[0], starts)


def in_order(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each distinct word by its hash (from 1 on; 0 is the end of a piece), and the first bits of the hash of each rank."""
    own = words.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), np.uint64, len(own))
    order = np.argsort(hashes, kind="stable")
    same = np.nonzero(hashes[order[1:]] == hashes[order[:-1]])[0]
    if len(same):  # different words with one hash
        order = np.array(sorted(range(len(own)), key=lambda k: (hashes[k], own[k])), np.int64)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(1, len(own) + 1)
    return rank, np.concatenate(([np.uint64(0)], hashes[order] >> np.uint64(64 - BITS)))


def summed(columns: list[np.ndarray], weight: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct edges in order (one column of ranks under `size` for each word) and their weights."""
    bits = max(1, int(size).bit_length())
    keys, room = [], 0
    for column in columns:
        column = column.astype(np.uint64)
        if keys and room >= bits:
            keys[-1] = keys[-1] << np.uint64(bits) | column
            room -= bits
        else:
            keys.append(column)
            room = 64 - bits
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.nonzero(new)[0]
    return [c[order[first]] for c in columns], np.add.reduceat(weight[order], first) if len(first) else weight[:0]


def order_of(columns: list[np.ndarray], bits: np.ndarray, lang: str) -> np.ndarray:
    """Place of each edge in the order of all edges: the first bits of its first four words' hashes, turned by language."""
    turn = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()) >> (64 - BITS))
    out = bits[columns[0]] + turn & np.uint64((1 << BITS) - 1)
    for column in columns[1:4]:
        out = out << np.uint64(BITS) | bits[column]
    return out


def edges_of(text: bytes) -> tuple[pa.Array, list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct words by rank, columns of the distinct edges, their weights, and bits of the hashes by rank."""
    words, codes, piece = words_in_pieces(text)
    rank, bits = in_order(words)
    at = rank[codes]
    columns = [at]
    for k in range(1, LONGEST):
        column = np.zeros(len(at), np.int64)
        same = piece[k:] == piece[: max(0, len(piece) - k)]
        column[: len(same)][same] = at[k:][same]
        columns.append(column)
    columns, weight = summed(columns, np.ones(len(at), np.int64), len(words))
    ordered = words.take(pa.array(np.argsort(rank)))
    return ordered, columns, weight, bits


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language, line by line, about `SLICE` bytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for whole in batches:
        for batch in pieces(whole, SLICE // 4):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary()).to_pylist()
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text) + 1
            if size >= SLICE:
                for lang in list(held):
                    yield lang, b"\n".join(held.pop(lang))
                size = 0
    for lang in list(held):
        yield lang, b"\n".join(held.pop(lang))


def dump(words: pa.Array, columns: list[np.ndarray], weight: np.ndarray) -> bytes:
    """Edges and the words in them, compressed."""
    used, codes = np.unique(np.concatenate(columns), return_inverse=True)
    names = b" ".join(words.take(pa.array(used[used > 0] - 1)).to_pylist())
    codes = codes + (used[0] > 0)  # 0 stays the end
    kind = np.uint16 if len(used) < 65535 else np.uint32
    head = np.array([len(weight), kind().itemsize, len(names)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + names + codes.astype(kind).tobytes() + weight.astype(np.uint32).tobytes())


def load(raw: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words from 1 on, codes (a row for each word of an edge) and weights."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, width, names = np.frombuffer(data, np.int64, 3)
    words = data[24 : 24 + names].split(b" ") if names else []
    codes = np.frombuffer(data, np.uint16 if width == 2 else np.uint32, LONGEST * n, 24 + names).reshape(LONGEST, n)
    return words, codes.astype(np.int64), np.frombuffer(data, np.uint32, n, 24 + names + codes.nbytes).astype(np.int64)


def borders(docs: DataFrame) -> np.ndarray:
    """Borders of the buckets in the order of edges, from a sample; there is a bucket for each 8 MB of text.

    Only the balance of the buckets hangs on the sample. The borders take eight bytes for 8 MB of text, and the driver
    sees sixteen times that.
    """
    count, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(1, -(-size // BUCKET))
    if buckets == 1:
        return np.empty(0, np.uint64)
    share = max(1, min(500, count // 2000))
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).dropDuplicates(["lang", "text"])
    thin = max(1, size // share // 6 // (buckets * SAMPLED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in slices(batches):
            _, columns, _, bits = edges_of(text)
            values = order_of(columns, bits, lang)
            chosen = values[mix(values) % np.uint64(thin) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(chosen.view(np.int64))], names=["at"])

    sampled = np.sort(np.array([r.at for r in some.mapInArrow(returning(run), "at long").collect()], np.int64).view(np.uint64))
    if not len(sampled):
        return np.empty(0, np.uint64)
    return np.unique(sampled[np.arange(1, buckets) * len(sampled) // buckets])


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, size, phrase and f of all phrases of at most five words with f of at least `least`; size 0: words in all.

    `docs`: lang (not null) and text.
    """
    limits = borders(docs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in slices(batches):
            words, columns, weight, bits = edges_of(text)
            if not len(weight):
                continue
            bucket = np.searchsorted(limits, order_of(columns, bits, lang), "right")
            if len(limits) < 65536:
                bucket = bucket.astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            columns, weight, bucket = [c[order] for c in columns], weight[order], bucket[order]
            first = np.nonzero(np.diff(bucket.astype(np.int64), prepend=-1))[0].tolist()
            found = [(int(bucket[i]), dump(words, [c[i:j] for c in columns], weight[i:j])) for i, j in zip(first, [*first[1:], len(bucket)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([lang] * len(found), pa.string()), pa.array([r for _, r in found], pa.binary())], names=["bucket", "lang", "raw"])

    dealt = docs.select("lang", "text").mapInArrow(returning(deal), "bucket long, lang string, raw binary")
    placed = dealt.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "lang")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            for bucket, lang, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "raw")), strict=True):
                if own != (bucket, lang):
                    if held:
                        yield from whole(*own, held)
                    own, held = (bucket, lang), []
                held.append(raw)
        if held:
            yield from whole(*own, held)

    def whole(bucket: int, lang: str, raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, columns, weight, bits = merged(raws)
        value = order_of(columns, bits, lang)
        low = limits[bucket - 1] if bucket else np.uint64(0)
        high = limits[bucket] - np.uint64(1) if bucket < len(limits) else np.uint64((1 << 64) - 1)
        yield named(lang, 0, [b""], np.array([weight.sum()]))
        change = np.zeros(len(weight), bool)
        change[:1] = True
        for size in range(1, LONGEST + 1):
            column = columns[size - 1]
            change[1:] |= column[1:] != column[:-1]
            first = np.nonzero(change)[0]
            total = np.add.reduceat(weight, first)
            if size < 4:  # others lie in one bucket
                rest = np.uint64((1 << (64 - BITS * size)) - 1)
                split = ((value[first] & ~rest) < low) | ((value[first] | rest) > high)
            else:
                split = np.zeros(len(first), bool)
            kept = (column[first] > 0) & (split | (total >= least))
            rows = first[kept]
            if len(rows):
                phrases = [b" ".join(x) for x in zip(*(words.take(pa.array(c[rows] - 1)).to_pylist() for c in columns[:size]), strict=True)]
                yield named(lang, size, phrases, total[kept])

    def named(lang: str, size: int, phrases: list[bytes], total: np.ndarray) -> pa.RecordBatch:
        n = len(phrases)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([size] * n, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(total, pa.int64())], names=["lang", "size", "phrase", "f"])

    parts = placed.mapInArrow(returning(gather), "lang string, size int, phrase string, f long")
    return parts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("size") == 0))


def merged(raws: list[bytes]) -> tuple[pa.Array, list[np.ndarray], np.ndarray, np.ndarray]:
    """As `edges_of`, from dumped edges."""
    words, parts, weights = [], [], []
    for raw in raws:
        own, codes, weight = load(raw)
        codes = np.where(codes > 0, codes + len(words), 0)
        words += own
        parts.append(codes)
        weights.append(weight)
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    rank, bits = in_order(coded.dictionary)
    to = np.concatenate(([0], rank[coded.indices.to_numpy()]))
    columns, weight = summed(list(to[np.concatenate(parts, 1)]), np.concatenate(weights), len(rank))
    return coded.dictionary.take(pa.array(np.argsort(rank))), columns, weight, bits


def part(phrase: str, start: int, length: F.Column | int) -> F.Column:
    """Some words of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(start), length if isinstance(length, F.Column) else F.lit(length)), " ")


def paths(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unary paths of the graph of frequent phrases (see `counts`), and the nodes within them.

    A node is within a path if all its weight comes from one edge and goes on to one edge. Paths: lang, phrase (any
    length), f, edges. A path lies in a piece of text, so it ends. Pointers double: long paths take few rounds.
    """
    edges = found.filter(F.col("size") == LONGEST)
    nodes = found.filter(F.col("size") == LONGEST - 1).select("lang", F.col("phrase").alias("node"), "f")
    into = edges.select("lang", part("phrase", 2, LONGEST - 1).alias("node"), "f", F.col("phrase").alias("edge"))
    out = edges.select("lang", part("phrase", 1, LONGEST - 1).alias("node"), "f", F.col("phrase").alias("then"))
    inner = staged(nodes.join(into, ["lang", "node", "f"]).join(out, ["lang", "node", "f"]).select("lang", "node", "edge", "then"), "inner")
    steps = edges.select("lang", F.col("phrase").alias("edge"), "f").join(inner.select("lang", "edge", "then"), ["lang", "edge"], "left")
    steps = staged(steps.select("lang", "edge", "f", F.coalesce("then", "edge").alias("to"), F.col("then").isNotNull().cast("long").alias("ahead")), "steps")
    while True:
        onward = steps.select("lang", F.col("edge").alias("to"), F.col("to").alias("beyond"), F.col("ahead").alias("more"))
        after = staged(steps.join(onward, ["lang", "to"]).select("lang", "edge", "f", F.col("beyond").alias("to"), (F.col("ahead") + F.col("more")).alias("ahead"), (F.col("more") > 0).alias("moved")), "steps")
        drop_staged(steps)
        steps = after
        if after.filter("moved").isEmpty():
            break
    joined = steps.groupBy("lang", "to").agg(F.max("f").alias("f"), F.count("*").alias("edges"), F.array_sort(F.collect_list(F.struct((-F.col("ahead")).alias("place"), "edge"))).alias("run"))
    last = F.transform(F.slice("run", 2, F.greatest(F.size("run") - 1, F.lit(0))), lambda x: F.substring_index(x["edge"], " ", -1))
    whole = F.array_join(F.concat(F.array(F.col("run")[0]["edge"]), last), " ")
    return joined.select("lang", whole.alias("phrase"), "f", "edges"), inner.select("lang", F.col("node").alias("phrase"))


def candidates(found: DataFrame, along: DataFrame, within: DataFrame) -> DataFrame:
    """lang, phrase, size, a of the phrases of two to five words that no longer one of the same count holds.

    A phrase within a longer one of the same count is also within one that is longer by a word, as counts only fall.
    """
    words = F.split("phrase", " ")
    ends = F.explode(F.sequence(F.lit(1), F.size(words) - LONGEST + 1))
    longest = along.select("lang", "f", words.alias("words"), ends.alias("start")).select("lang", F.array_join(F.slice("words", F.col("start"), F.lit(LONGEST)), " ").alias("phrase"), F.lit(LONGEST).alias("size"), "f")
    shorter = found.filter(F.col("size").between(2, LONGEST - 1))
    longer = found.filter(F.col("size").between(3, LONGEST))
    ends = longer.select("lang", "f", F.explode(F.array(part("phrase", 1, F.col("size") - 1), part("phrase", 2, F.col("size") - 1))).alias("phrase"))
    most = ends.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = shorter.join(within, ["lang", "phrase"], "left_anti").join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("f")))
    return longest.unionByName(left.select("lang", "phrase", "size", "f")).withColumnRenamed("f", "a")


def scored(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates with l, r and score of the cut that scores least; whole numbers of up to 38 digits in between."""
    cut = chosen.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part("phrase", 1, F.col("k")).alias("one"), F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("two"))
    count = lambda name, f: found.filter("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cut.join(count("one", "l"), ["lang", "one"]).join(count("two", "r"), ["lang", "two"])
    both = both.join(found.filter("size = 0").select("lang", F.col("f").alias("n")), "lang")
    exact = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    best = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language by score, count and bytes: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null lang is `und`; languages without candidates have no rows, nor has an empty table. Rows that
    repeat a row count again. Only `lang` and `text` are read. Counts may reach 10^16.
    """
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    found = staged(counts(read, least), "counts")
    along, within = paths(found)
    rated = scored(found, candidates(found, along, within))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # first the best of each of many parts of a language, then the best of these
    dealt = rated.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    order = Window.partitionBy("lang").orderBy(*best)
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
