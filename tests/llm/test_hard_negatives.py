import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from sanscope.llm import hard_negatives as H
from sanscope.llm.queries import ORACLE, op13_hard_negatives

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()),
                       # columns whose names the operator uses itself
                       T.StructField("v", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("score", T.LongType())])


def frame(spark, rows, slices=3):
    rows = [(*r, "v", "s", 1) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(slices) if rows else spark.createDataFrame([], SCHEMA)


def brute(rows, every=50):
    live = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    live = sorted(live)
    anchors = {}
    for i, label, v in live:
        if i % every == 0:
            anchors.setdefault(i, (label, v))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = set()
    for i, (label, v) in anchors.items():
        scored = sorted((-dot(v, w), j, other) for j, other, w in live if j != i)
        for s, j, other in [x for x in scored if x[2] == label][:5]:
            found = [(t, k) for t, k, o in scored if o != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out |= {(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(found)}
    return out


def got(result):
    rows = [tuple(r) for r in result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, n=400, dim=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    rows = []
    for i in range(n):
        label = int(r.integers(0, 4))
        v = [float(np.float32(x)) for x in centres[label] * 0.4 + r.normal(size=dim) * 0.3]
        rows.append((i, v, label))
    return rows


@pytest.mark.parametrize("options", [{}, {"shard": 20}, {"shard": 64, "block": 3}])
def test_matches_brute_force(spark, options):
    rows = made(1)
    assert got(H.hard_negatives(frame(spark, rows), **options)) == brute(rows)


def test_broken_rows_ties_and_copies(spark):
    """Copies of one vector, nulls everywhere, infinities, short and empty vectors, repeated ids."""
    rows = made(2, 150)
    same = rows[0][1]
    rows += [(1000 + k, same, k % 3) for k in range(300)] + rows[:20]
    rows += [(2000, None, 1), (2050, [], 1), (2100, [1.0, None], 1), (2150, [math.inf] * 8, 2), (2200, [math.nan] * 8, 2),
             (2250, same[:3], 0), (None, same, 0), (2300, same, None), (2350, [0.0] * 8, 3), (50, same, 3), (7, rows[9][1], 2),
             (2400, [1e30] * 8, 1)]
    want = brute([r for r in rows if r[0] != 2400])
    assert got(H.hard_negatives(frame(spark, rows), shard=40)) == want and want


def test_empty_tables(spark):
    assert got(H.hard_negatives(frame(spark, []))) == set()
    assert got(H.hard_negatives(frame(spark, [(0, None, 1), (50, [1.0], None)]))) == set()
    assert got(H.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]))) == set()


def test_large_numbers_stay_exact(spark):
    r = random.Random(3)
    rows = [(k, [float(np.float32(r.uniform(-2e5, 2e5))) for _ in range(6)], k % 3) for k in range(120)]
    assert got(H.hard_negatives(frame(spark, rows), every=10)) == brute(rows, every=10)


def tree_of(points):
    t = H.CoverTree(points)
    return t, points[t.order].astype(np.float64), t.order, np.array(t.radius), t.nodes()


@pytest.mark.parametrize("n,dim", [(1, 3), (2, 3), (500, 2), (500, 5), (3000, 3)])
def test_cover_tree_invariants(n, dim):
    """Every row is below one leaf, within the radius of each node above it, and radii fall."""
    points = np.random.default_rng(n).integers(-300, 300, (n, dim))
    t, vectors, order, radius, nodes = tree_of(points)
    assert sorted(order) == list(range(n)) and (nodes[0][0], nodes[1][0]) == (0, n)
    norms = (vectors**2).sum(axis=1)
    augmented = np.column_stack([vectors, np.sqrt(norms.max() - norms)])
    for a, b, c, d, r in zip(*nodes, radius):
        apart = np.sqrt(((augmented[a:b] - augmented[a]) ** 2).sum(axis=1))
        assert apart.max() <= r + 1e-6
        if c < d:
            assert [nodes[0][c], *nodes[1][c:d]] == [a, *nodes[0][c + 1 : d], b] and (radius[c:d] < r).all()


def test_search_prunes_clustered_rows_and_is_exact():
    r = np.random.default_rng(5)
    centres = r.integers(-2000, 2000, (40, 6))
    points = centres[r.integers(0, 40, 4000)] + r.integers(-40, 40, (4000, 6))
    _, vectors, order, radius, nodes = tree_of(points)
    anchors = points[:25].astype(np.float64)
    scores = (anchors @ points.T).astype(np.int64)
    low, high = np.full((25, 2), 10**6), np.column_stack([np.full(25, 10**9), (0.9 * scores.max(axis=1)).astype(np.int64)])
    best = H.Best(50, 3)
    verified = H.search(vectors, order, radius, nodes, anchors, low, high, best, np.arange(50).reshape(25, 2), np.full(25, -1))
    for a in range(25):
        for w in range(2):
            fits = [(-s, k) for k, s in enumerate(scores[a].tolist()) if low[a, w] <= s <= high[a, w]]
            assert [(-s, k) for s, k in zip(best.score[2 * a + w].tolist(), best.id[2 * a + w].tolist())] == sorted(fits)[:3]
    assert verified < 0.25 * scores.size


def test_query_and_statement(spark, sf):
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    want = duckdb.sql(ORACLE["op13_hard_negatives"]).fetchall()
    assert got(op13_hard_negatives(spark, sf)) == set(want) and len(want) > 50
