"""Near-duplicate vectors against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from framelake.llm import vectors
from framelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def truth(rows):
    """vec_id -> (links, least reachable vec_id) over all pairs of rows (vec_id, embedding, label)."""
    fine = [(v, np.array(e, float), l) for v, e, l in rows if v is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {v: set() for v, _, _ in rows}
    for i, (a, x, l) in enumerate(fine):
        for b, y, k in fine[i + 1 :]:
            if l == k and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    root = {}
    for v in sorted(x for x in links if x is not None):
        stack = [v] if v not in root else []
        while stack:
            w = stack.pop()
            if w not in root:
                root[w] = v
                stack += links[w]
    return {v: (len(links[v]), root.get(v)) for v in links}


def found(df):
    rows = df.collect()
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}, sum(r.audit_found or 0 for r in rows), sum(r.audit_true or 0 for r in rows)


def test_query_against_brute_force(spark):
    given = pd.read_parquet(f"{SF}/embeddings.parquet")
    got, _, _ = found(QUERIES["op13_vector_near_dedup"](spark, SF))
    assert got == truth([(int(v), e.astype(float).tolist(), int(l)) for v, e, l in given[["vec_id", "embedding", "label"]].itertuples(index=False)])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [1.0, inf], 1)]
    rows += [(10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e300, 1e290], 1), (13, [1e-300, 0.0], 1), (14, [-1.0, 0.0], 1), (20, [5.0, 5.0], 3), (21, [5.0, 5.0], 3), (22, [5.0, 5.0], 3), (23, [1.0, 0.1], 1)]
    got, _, _ = found(vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id as cid", "'x' as shard", "0 as n")))
    want = truth(rows) | {12: (4, 1), 1: (4, 1), 2: (4, 1), 13: (4, 1), 23: (4, 1)}
    assert got == want
    lost = vectors.near_vectors(spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in lost) == [(0, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)]
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_shards_and_blocks(spark, dense):
    """Small shards, so that clusters are split over and over, and a dense group that only blocks can deal."""
    r = np.random.default_rng(8)
    base = r.normal(size=(500, 16))
    near = base[:120] + 0.02 * r.normal(size=(120, 16))
    groups = [base[200] + 0.11 * r.normal(size=(150 if dense else 20, 16)), base[201] + 0.2 * r.normal(size=(60, 16))]
    points = np.concatenate([base, near, *groups, base[5:6]])
    rows = [(k, x.tolist(), 1 if k % 7 else 2) for k, x in enumerate(points)]
    got, audit_found, audit_true = found(vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), size=64))
    want = truth(rows)
    links, true = (sum(x[0] for x in d.values()) for d in (got, want))
    assert got.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in want)
    assert links >= 0.99 * true and audit_found >= 0.95 * audit_true
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.99 * len(want)


def test_every_pair_shares_a_shard(spark):
    """With a margin of 0.1 no border parts two vectors within the range."""
    r = np.random.default_rng(9)
    base = r.normal(size=(300, 8))
    points = np.concatenate([base, base + 0.05 * np.linalg.norm(base, axis=1)[:, None] * r.normal(size=base.shape) / np.sqrt(8)])
    df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(points)], SCHEMA)
    dealt = vectors.shards(vectors.units(vectors.classes(df)), size=100, margin=0.1)
    homes = {x.cid: set(x.homes) for x in dealt.collect()}
    x = points / np.linalg.norm(points, axis=1)[:, None]
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True):
        assert homes[i] & homes[j]
    assert len({h for own in homes.values() for h in own}) > 4
