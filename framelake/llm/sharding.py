"""Contiguous sharding of equal-text groups with the smallest possible largest shard.

Groups are ordered by a hash of their text, so a shard is a range of hashes and every document finds its shard by
itself, without a join. The driver never sees the groups: it searches over sums of hash ranges and asks for finer sums
only inside the ranges that can still hold a cut.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import partitions, staged

#: Bits of the hash that orders groups; first and further bits by which ranges are told apart.
BITS, FIRST, STEP = 63, 14, 5


def group_key(text: Column) -> Column:
    """Equal texts have equal keys; null is as empty. Different texts whose keys meet stay together, which breaks nothing."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)


def cut(sizes: list[int], capacity: int, shards: int, walls: list[int] | None = None) -> list[int] | None:
    """Greedy check: ends of the shards if at most `shards` of them hold at most `capacity` each, else None.

    `walls`: places at which a shard must end, whatever it holds.
    """
    if max(sizes, default=0) > capacity:
        return None
    ends = list(accumulate(sizes))
    walls = [*(walls or []), len(ends)]
    out, filled = [], 0
    while len(out) < shards and (out[-1] if out else 0) < len(ends):
        out.append(min(bisect_right(ends, filled + capacity), walls[bisect_right(walls, out[-1] if out else 0)]))
        filled = ends[out[-1] - 1]
    return out if not ends or out[-1] == len(ends) else None


def smallest_capacity(sizes: list[int], shards: int, walls: list[int] | None = None) -> int:
    """Binary search for the smallest capacity that `cut` finds feasible."""
    low, high = max([-(-sum(sizes) // shards), *sizes]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if cut(sizes, middle, shards, walls) is not None else (middle + 1, high)
    return low


class RangeSums:
    """Sizes of consecutive hash ranges: ranges of one group are atomic, others are known by their sum.

    No range reaches over one of the `alone` keys, which have none themselves; between two ranges of different sections,
    the parts between these keys, is a wall.
    """

    def __init__(self, groups: DataFrame, alone: list[int]):
        self.alone = sorted(alone)
        self.groups = groups.filter(~F.col("key").isin(self.alone)) if alone else groups
        self.rows = self._sums(self.groups, FIRST)

    def _sums(self, groups: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        """(first hash, bits, size, number of groups) of each range that has groups, in order."""
        cell = F.shiftright("key", BITS - bits)
        section = F.size(F.filter(F.array(*map(F.lit, self.alone)), lambda k: k < F.col("key"))) if self.alone else F.lit(0)
        found = groups.groupBy(cell.alias("cell"), section.alias("section")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        after = lambda r: self.alone[r.section - 1] + 1 if r.section else 0
        return sorted((max(r.cell << (BITS - bits), after(r)), bits, r.size, r.n) for r in found)

    def walls(self) -> list[int]:
        starts = [x[0] for x in self.rows]
        return sorted({k for key in self.alone if 0 < (k := bisect_right(starts, key)) < len(starts)})

    def finer(self, wanted: set[int]) -> None:
        """Splits the ranges at these places of the list by further bits of the hash."""
        cell = lambda x: (x[1], x[0] >> (BITS - x[1]))
        own = {cell(self.rows[k]) for k in wanted}
        kept = [x for x in self.rows if cell(x) not in own]
        for bits in sorted({bits for bits, _ in own}):
            cells = sorted(c for b, c in own if b == bits)
            kept += self._sums(self.groups.filter(F.shiftright("key", BITS - bits).isin(cells)), min(BITS, bits + STEP))
        self.rows = sorted(kept)


def trajectory(ends: list[int], atomic: list[bool], capacity: int, shards: int, optimistic: bool, walls: list[int]) -> list[tuple[int, int]]:
    """Greedy cuts over range sums as (position, place of the range that the cut falls in).

    Pessimistic: cut only between ranges. Optimistic: cut at the full capacity inside a range of several groups.
    """
    out, filled, total = [], 0, ends[-1]
    walls = [*walls, len(ends)]
    while len(out) < shards and filled < total:
        wall = walls[bisect_right(walls, bisect_right(ends, filled))]
        k = min(bisect_right(ends, filled + capacity), wall)
        inside = optimistic and k < wall and not atomic[k]
        reached = filled + capacity if inside else ends[k - 1] if k else 0
        if reached <= filled and not inside:
            break
        filled = reached
        out.append((filled, k))
    return out


def plan_cuts(groups: DataFrame, shards: int, alone: list[int] | None = None, most_ranges: int = 400_000) -> tuple[int, list[int]]:
    """The smallest capacity of a contiguous partition of `groups` (key, size), and the first keys of all shards but the first.

    Groups of the keys `alone` are shards by themselves where they stand, beside the `shards` others, and don't count for
    the capacity. Each round keeps the capacities that are neither surely feasible nor surely not, and splits the ranges in which
    their cuts may fall. A round sends at most `most_ranges` sums; ranges wait for the next round beyond that.
    """
    sums = RangeSums(groups, alone or [])
    if not sums.rows:
        return 0, sorted(alone or [])[1:]
    while True:
        walls = sums.walls()
        sizes, counts = [x[2] for x in sums.rows], [x[3] for x in sums.rows]
        ends, atomic = list(accumulate(sizes)), [n == 1 or x[1] == BITS for x, n in zip(sums.rows, counts, strict=True)]
        surely = smallest_capacity(sizes, shards, walls)
        low, high = max([-(-ends[-1] // shards), *(s for s, a in zip(sizes, atomic, strict=True) if a)]), surely
        while low < high:  # the smallest capacity that is not surely infeasible
            middle = (low + high) // 2
            reached = trajectory(ends, atomic, middle, shards, True, walls)
            low, high = (low, middle) if reached and reached[-1][0] >= ends[-1] else (middle + 1, high)
        least, most = trajectory(ends, atomic, low, shards, False, walls), trajectory(ends, atomic, surely, shards, True, walls)
        open_ranges: set[int] = set()
        for i in range(shards):
            first = least[i][1] if i < len(least) else least[-1][1] if least else 0
            last = most[min(i, len(most) - 1)][1]
            open_ranges.update(k for k in range(first, min(last, len(atomic) - 1) + 1) if not atomic[k])
        if not open_ranges:
            break
        if len(open_ranges) << STEP > most_ranges:
            open_ranges = set(sorted(open_ranges)[: most_ranges >> STEP])
        sums.finer(open_ranges)
    places = [0, *(cut(sizes, surely, shards, walls) or [])[:-1]]
    return surely, sorted({*(sums.rows[k][0] for k in places), *sums.alone})[1:]


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, slot_buckets: int = 512) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (null: none) plus `overhead`. Documents of equal text are one group and share a shard,
    and shards are consecutive ranges of all groups in order of their hash, the largest of them as small as whole groups
    allow (`plan_cuts`). Where groups above the mean of what is left set that size, other shards could be filled as far and
    leave none to the rest: such groups are ranges by themselves, where that makes no shard larger, and the capacity is
    searched for the rest. Slots number each shard's documents from 0, by hash bucket and doc_id; null and repeated doc_ids
    are rows as others.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), group_key(F.col("text")).alias("key")), "sized")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size").alias("n")).first().n or 0
    large: list[tuple[int, int]] = []
    for row in groups.orderBy(F.desc("size"), "key").limit((shards - 1) // 2).collect():
        if row.size * (shards - len(large)) <= total:
            break
        large.append((row.key, row.size))
        total -= row.size
    capacity, starts = plan_cuts(groups, shards)
    if large:
        rest, cuts = plan_cuts(groups, shards - len(large), [key for key, _ in large])
        if max(rest, large[0][1]) <= capacity:
            starts = cuts
    shard = F.size(F.filter(F.array(*[F.lit(k) for k in starts]), lambda k: k <= F.col("key"))) if starts else F.lit(0)
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slot_buckets)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), bucket.alias("bucket"))
    # at most shards x slot_buckets rows, whatever the input
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before")))
    numbered = placed.repartition(partitions(spark), "shard", "bucket").withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")))
    return numbered.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

