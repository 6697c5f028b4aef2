"""Near-duplicate vectors: a robust-pruned flat graph over overlapping cluster shards, searched by ranges.

Equal vectors of one label are one class. Classes are dealt by k-means, level by level, until a shard holds a bounded
number; a vector near the border of two clusters goes to both. Each shard gives a graph in which a vertex keeps a
neighbour only if no kept one is much nearer to it; the lists of a vertex are united over its shards. Every vector is then
searched for from its shard's medoid, greedily, and whatever lies within the range is expanded until nothing new comes up.
Links are confirmed in double precision, and a fiftieth of the vectors is held against brute force in the shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import drop_staged, returning, staged
from framelake.llm.minhash import components

#: Least cosine of a link.
LEAST = 0.98
#: Vectors of a shard; children of a cluster; vectors that its centres are fitted on, in the mean.
SHARD, CHILDREN, SAMPLE = 4096, 8, 2000
#: A vector goes to every cluster whose border with its nearest one is not further away than this. Two unit vectors at
#: cosine 0.98 are 0.2 apart; a border parts them only if they differ by more than twice the margin along its normal,
#: which is 4 standard deviations for differences in any direction of 64. From 0.1 on none is parted.
MARGIN = 0.05
#: A child that holds more than this share of its cluster is dense: it is dealt out in blocks, and blocks meet in pairs.
DENSE = 0.8
#: Neighbours of a vertex, vectors that a search holds, factor of robust pruning, ring around the range that is expanded too.
DEGREE, BEAM, ALPHA, RING = 24, 32, 1.2, 0.02
#: Least recall of the audited vectors of a shard; below it the shard is searched again with a wider beam.
RECALL = 0.95
BATCH = 256


def classes(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that may link: space (label and length), two hashes, cid (least vec_id), n and the vector."""
    fine = F.col("vec_id").isNotNull() & F.col("space").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return keyed(vectors).filter(fine).groupBy("space", "low", "high").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.first("vector").alias("vector"))


def keyed(vectors: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    space = F.concat_ws("/", F.col("label").cast("string"), F.size("vector").cast("string"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"))
    space = F.when(F.col("label").isNotNull() & F.col("vector").isNotNull(), space)
    return rows.select("vec_id", "vector", space.alias("space"), F.xxhash64("vector").alias("low"), F.xxhash64(F.reverse("vector"), F.lit(1)).alias("high"))


def units(found: DataFrame) -> DataFrame:
    """Classes with their vectors at length one, as bytes of doubles; `shard` is the path of clusters so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for vector in batch.column("vector").to_numpy(zero_copy_only=False):
                vector = vector / np.abs(vector).max()
                raw.append((vector / np.sqrt(vector @ vector)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("space"), batch.column("cid"), batch.column("n"), pa.array(raw, pa.binary())], names=["shard", "cid", "n", "unit"])

    return found.select("space", "cid", "n", "vector").mapInArrow(returning(run), "shard string, cid long, n long, unit binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; the first centres are far from each other."""
    first = [x[int(np.argmin(x @ x.mean(0)))]]
    nearest = x @ first[0]
    for _ in range(k - 1):
        first.append(x[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, x @ first[-1])
    c = np.array(first)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.maximum(length, 1e-300), c)
    return c


def near_centres(x: np.ndarray, c: np.ndarray, margin: float) -> np.ndarray:
    """Whether each vector belongs to each cluster: its nearest one, and those whose border with that is near."""
    like = x @ c.T
    own = np.argmax(like, 1)
    apart = np.linalg.norm(c[own][:, None] - c[None], axis=2)
    return like[np.arange(len(x)), own][:, None] - like <= margin * apart + 1e-12


def shards(placed: DataFrame, size: int = SHARD, margin: float = MARGIN) -> DataFrame:
    """shard (number), cid, n, unit and the numbers of all shards (`homes`) of each class, at most about `size` in each."""
    level = placed.withColumn("parent", F.lit(None).cast("long"))
    done, read = [], []
    while True:
        level = staged(level, "level")
        sizes = level.groupBy("shard").agg(F.count("*").alias("size"), F.max("parent").alias("parent"))
        big = staged(sizes.filter(F.col("size") > size).withColumn("dense", F.coalesce(F.col("size") > DENSE * F.col("parent"), F.lit(False))), "big")
        rest = level.drop("parent")
        done.append(rest.join(big.select("shard"), "shard", "left_anti"))
        read += [level, big]
        if big.isEmpty():
            break
        blocks = F.ceil(F.col("size") / (size // 2)).cast("int")
        block = F.pmod(F.xxhash64("cid"), blocks)
        meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.concat_ws("-", F.col("shard"), F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
        dense = rest.join(big.filter("dense").select("shard", "size"), "shard").withColumn("block", block.cast("int"))
        done.append(dense.select(F.explode(meets).alias("shard"), "cid", "n", "unit"))
        loose = big.filter("not dense").select("shard", "size")
        rows = rest.join(loose, "shard")
        some = rows.filter(F.pmod(F.xxhash64("cid", F.lit(3)), F.ceil(F.col("size") / SAMPLE)) == 0)

        def fit(group: pa.Table) -> pa.Table:
            k = min(CHILDREN, max(2, -(-2 * group.column("size")[0].as_py() // size)))
            c = centres(matrix(group.column("unit")), k)
            return pa.table({"shard": [group.column("shard")[0].as_py()], "centres": pa.array([c.tobytes()], pa.binary())})

        fitted = staged(some.select("shard", "size", "unit").groupBy("shard").applyInArrow(fit, "shard string, centres binary"), "centres")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = np.array(batch.column("shard").to_pylist(), object)
                raw = dict(zip(names, batch.column("centres").to_pylist(), strict=True))
                x, at, to = matrix(batch.column("unit")), [], []
                for name, own in raw.items():
                    rows = np.nonzero(names == name)[0]
                    member = near_centres(x[rows], np.frombuffer(own, np.float64).reshape(-1, x.shape[1]), margin)
                    row, child = np.nonzero(member)
                    at += rows[row].tolist()
                    to += [f"{name}.{c}" for c in child.tolist()]
                taken = batch.select(["cid", "n", "unit", "size"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.string()), *taken.columns], names=["shard", "cid", "n", "unit", "parent"])

        read.append(fitted)
        level = _by_length(rows.join(fitted, "shard").select("shard", "cid", "n", "unit", "size", "centres", F.length("unit").alias("bytes")), deal)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    numbered = staged(whole.select(F.xxhash64("shard").alias("shard"), "cid", "n", "unit"), "shards")
    drop_staged(*read)
    homes = numbered.groupBy("cid").agg(F.collect_set("shard").alias("homes"))
    return numbered.join(homes, "cid").select("shard", "cid", "n", "unit", "homes")


def _by_length(dealt: DataFrame, deal: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`deal` over batches whose vectors have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("bytes").to_numpy()
            for length in np.unique(lengths):
                yield from deal([batch.filter(pa.array(lengths == length))])

    return dealt.mapInArrow(returning(run), "shard string, cid long, n long, unit binary, parent long")


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """The nearest vertices found greedily from `start` for each query, at most `beam` each (-1: none)."""
    n = len(queries)
    ids, like = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32)
    ids[:, 0], like[:, 0] = start, queries @ x[start]
    open_, seen = np.zeros((n, beam), bool), np.zeros((n, len(x)), bool)
    open_[:, 0] = seen[:, start] = True
    while True:
        best = np.where(open_, like, -np.inf)
        at = np.argmax(best, 1)
        rows = np.nonzero(best[np.arange(n), at] > -np.inf)[0]
        if not len(rows):
            return ids
        open_[rows, at[rows]] = False
        near = graph[ids[rows, at[rows]]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        seen[rows[r], near[r, c]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("ij,ij->i", x[near[r, c]], queries[rows[r]])
        all_ids = np.concatenate((ids[rows], near), 1)
        all_like = np.concatenate((like[rows], new), 1)
        all_open = np.concatenate((open_[rows], fresh), 1)
        order = np.argsort(-all_like, 1, kind="stable")[:, :beam]
        ids[rows], like[rows], open_[rows] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_like, all_open))


def pruned(x: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, least: float, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: of each vertex's candidates (-1: none) the nearest, then the next that is not much nearer to a kept one.

    Candidates within the range are not pruned, but take no more than half of the places: copies of one vector are all
    nearest to it, and would else hang on it alone; the other half leads away from them.
    """
    none = (near < 0) | (near == own[:, None])
    far = np.where(none, np.inf, 1 - np.einsum("ijk,ik->ij", x[near], x[own]))
    order = np.argsort(far, 1, kind="stable")
    near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
    alive, points, inside = far < np.inf, x[near], far <= 1 - least
    alive &= ~inside | (np.cumsum(inside, 1) <= degree // 2)
    out, rows = np.full((len(own), degree), -1, np.int32), np.arange(len(own))
    for k in range(degree):
        at = np.argmax(alive, 1)
        some = alive[rows, at]
        if not some.any():
            break
        out[some, k] = near[some, at[some]]
        between = 1 - np.einsum("ijk,ik->ij", points, points[rows, at])
        alive &= ~(some[:, None] & (alpha**2 * between <= far)) | inside & alive
        alive[rows, at] = False
    return out


def build(x: np.ndarray, least: float = LEAST, degree: int = DEGREE, beam: int = BEAM) -> np.ndarray:
    """The graph of a shard: neighbours of each vertex (-1: none). Vertices come in batches, as many as there are, at most 256."""
    m = len(x)
    graph = np.full((m, degree), -1, np.int32)
    start = medoid(x)
    order = np.random.default_rng(m).permutation(m)
    order = np.concatenate(([start], order[order != start]))
    begun = 1
    while begun < m:
        batch = order[begun : begun + min(begun, BATCH)]
        found = beam_search(x, graph, start, x[batch], beam)
        graph[batch] = pruned(x, batch, found, degree, least)
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order_in = np.lexsort((source, -np.einsum("ij,ij->i", x[source], x[target]), target))
        source, target = source[order_in], target[order_in]
        told, first, count = np.unique(target, return_index=True, return_counts=True)
        turn = np.arange(len(target)) - np.repeat(first, count)
        fits = turn < 2 * degree  # the nearest new ones; the others reach it through these
        came = np.full((len(told), 2 * degree), -1, np.int32)
        came[np.searchsorted(told, target[fits]), turn[fits]] = source[fits]
        both = np.concatenate((graph[told], came), 1)
        few = (both >= 0).sum(1) <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)[:, :degree]
        graph[told[few]] = packed[few]
        if not few.all():
            graph[told[~few]] = pruned(x, told[~few], both[~few], degree, least)
        begun += len(batch)
    return graph


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(0)))


def within(x: np.ndarray, graph: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Matrix of the pairs found: greedy search for every vertex from the medoid, then expansion of all within the range."""
    m, start = len(x), medoid(x)
    found = np.zeros((m, m), bool)
    for begin in range(0, m, BATCH):
        own = np.arange(begin, min(m, begin + BATCH))
        ids = beam_search(x, graph, start, x[own], beam)
        row, node = np.nonzero(ids >= 0)
        node = ids[row, node]
        like = np.einsum("ij,ij->i", x[own[row]], x[node])
        row, node = (np.concatenate((v[like >= least - RING], w)) for v, w in ((row, np.arange(len(own))), (node, own)))
        seen = np.zeros((len(own), m), bool)
        seen[row, node] = True
        while len(row):
            found[own[row], node] = True
            fresh = []
            for at in range(0, len(row), 1 << 14):  # neighbours of so many vertices at a time
                r, near = np.repeat(row[at : at + (1 << 14)], graph.shape[1]), graph[node[at : at + (1 << 14)]].ravel()
                r, near = r[near >= 0], near[near >= 0]
                new = ~seen[r, near]
                pair = np.unique(r[new].astype(np.int64) * m + near[new])
                r, near = pair // m, pair % m
                seen[r, near] = True
                inside = np.einsum("ij,ij->i", x[own[r]], x[near]) >= least - RING
                fresh.append((r[inside], near[inside]))
            row, node = (np.concatenate([f[k] for f in fresh]) for k in (0, 1))
    return found


def links_of(unit: np.ndarray, graph: np.ndarray, audited: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs i < j of a shard, confirmed in double precision, and the audited vertices' links found and in truth."""
    x, beam = unit.astype(np.float32), BEAM
    truth = (unit[audited] @ unit.T >= least).sum(1) - 1
    while True:
        found = within(x, graph, least, beam)
        found |= found.T
        i, j = np.nonzero(np.triu(found, 1))
        sure = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 65536]], unit[j[k : k + 65536]]) >= least for k in range(0, len(i), 65536)] or [np.empty(0, bool)])
        i, j = i[sure], j[sure]
        got = (np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x)))[audited]
        if got.sum() >= RECALL * truth.sum() or beam >= len(x):
            return np.stack((i, j)), got, truth
        beam *= 2


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Least vertex of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs[0]], root[pairs[1]])
        after = root.copy()
        np.minimum.at(after, pairs[0], low)
        np.minimum.at(after, pairs[1], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def graphs(dealt: DataFrame, least: float) -> DataFrame:
    """cid and the united neighbours of each class over its shards."""

    def run(group: pa.Table) -> pa.Table:
        cid = group.column("cid").to_numpy()
        graph = build(matrix(group.column("unit")).astype(np.float32), least)
        ends = np.concatenate(([0], np.cumsum((graph >= 0).sum(1)))).astype(np.int32)
        return pa.table({"cid": cid, "near": pa.ListArray.from_arrays(ends, cid[graph[graph >= 0]])})

    lists = dealt.select("shard", "cid", "unit").groupBy("shard").applyInArrow(run, "cid long, near array<long>")
    return lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def searched(dealt: DataFrame, flat: DataFrame, least: float) -> DataFrame:
    """cid, root (a linked class of its shard, the least), weighed links, and links found and true of audited classes.

    A pair that meets in several shards counts in the one of least number.
    """

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("cid").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        cid, weight, unit = group.column("cid").to_numpy(), group.column("n").to_numpy(), matrix(group.column("unit"))
        near = group.column("near").combine_chunks()
        flat, owner = near.flatten().to_numpy(), np.repeat(np.arange(len(cid)), np.diff(near.offsets.to_numpy()))
        place = np.minimum(np.searchsorted(cid, flat), len(cid) - 1)
        member = cid[place] == flat
        owner, place = owner[member], place[member]
        count = np.bincount(owner, minlength=len(cid))
        graph = np.full((len(cid), max(1, count.max(initial=0))), -1, np.int32)
        graph[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = place
        audited = np.nonzero(cid % 50 == 0)[0]
        pairs, got, truth = links_of(unit, graph, audited, least)
        root = roots(len(cid), pairs)
        home = group.column("shard")[0].as_py()
        homes = group.column("homes").to_pylist()
        lower = sorted({h for own in homes for h in own if h < home})
        if lower:
            at = {h: k for k, h in enumerate(lower)}
            member = np.zeros((len(cid), len(lower)), bool)
            for k, own in enumerate(homes):
                member[k, [at[h] for h in own if h < home]] = True
            here = np.concatenate([~(member[i] & member[j]).any(1) for i, j in (pairs[:, k : k + 65536] for k in range(0, pairs.shape[1], 65536))] or [np.empty(0, bool)])
            pairs = pairs[:, here]
        links = np.bincount(pairs[0], weight[pairs[1]], len(cid)) + np.bincount(pairs[1], weight[pairs[0]], len(cid))
        seen = np.zeros((2, len(cid)), np.int64)
        seen[:, audited] = got, truth
        return pa.table({"cid": cid, "root": cid[root], "links": links.astype(np.int64), "found": seen[0], "true": seen[1]})

    rows = dealt.join(flat, "cid").select("shard", "cid", "n", "unit", "homes", "near")
    return rows.groupBy("shard").applyInArrow(run, "cid long, root long, links long, found long, true long")


def near_vectors(vectors: DataFrame, least: float = LEAST, size: int = SHARD, margin: float = MARGIN) -> DataFrame:
    """One row per vector: vec_id, n_links (vectors of its label within the range), component_id, kept, audit_found, audit_true.

    Vectors link at a cosine of `least` or more if their labels are equal and not null and they have one length. Null, empty or zero
    vectors, and those with null or non-finite components, link with nothing, nor do rows without vec_id, which are kept
    and have no component. Rows that repeat a vector link with each other. vec_ids are taken as unique: rows of one vec_id
    with several vectors share a component. The last two columns hold, for classes whose id is divisible by 50, the linked
    classes found and those by brute force, within their shards. Further columns are ignored; an empty table gives no rows.
    """
    found = staged(classes(vectors), "classes")
    dealt = staged(shards(units(found), size, margin), "dealt")
    flat = staged(graphs(dealt, least), "graph")
    links = staged(searched(dealt, flat, least), "links")
    drop_staged(dealt, flat)
    labels = components(links.filter("root <> cid").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("found").alias("audit_found"), F.sum("true").alias("audit_true"))
    known = found.select("space", "low", "high", "cid", "n").join(counts, "cid").join(labels.withColumnRenamed("v", "cid"), "cid", "left")
    known = staged(known.select("space", "low", "high", "n", "links", F.coalesce("c", "cid").alias("component"), "audit_found", "audit_true"), "known")
    drop_staged(labels, links)
    rows = keyed(vectors).select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("space")).alias("space"), "low", "high")
    out = rows.join(known, ["space", "low", "high"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    number = F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0))
    return out.select("vec_id", number.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), "audit_found", "audit_true")
