"""Dual-tree mining against all pairs."""

import math
import random

import numpy as np
import pytest
from concordat.llm import dual_tree, hard_negatives, queries
from pyspark.sql import functions as F

KIND = "vec_id bigint, embedding array<float>, label int, block string, low int"


def plain(rows):
    """rows: (vec_id, embedding, label) as the query takes them."""
    used = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((key, (label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for i, (a, label, v) in enumerate(used):
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), key, other == label) for j, (key, other, w) in enumerate(used) if j != i]
        scored.sort(key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fits = [(n, t) for t, n, same in scored if not same and -50 * s <= -100 * t <= -95 * s]
            out += [(a, p, k, n, -s, -t) for k, (n, t) in enumerate(fits[:3], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def mined(frame, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(frame, F.col("id") % 50 == 0, label=label, **options)


def test_tree_holds_its_rows():
    random.seed(1)
    rows = np.floor(np.random.default_rng(1).normal(size=(1000, 5)) * 50)
    rows[:300] = rows[0]
    tree = dual_tree.Tree(rows)
    assert sorted(tree.order.tolist()) == list(range(1000)) and len(tree.begin) > 5
    for a, b, c, r in zip(tree.begin, tree.end, tree.centre, tree.radius):
        assert np.sqrt(((rows[tree.order[a:b]] - c) ** 2).sum(axis=1)).max() <= r + 1e-9


def test_pruning_leaves_nodes_out(monkeypatch):
    """Of two far clusters the search for one scores few pairs of leaves."""
    scored = []
    whole = dual_tree.np.nonzero
    monkeypatch.setattr(dual_tree.np, "nonzero", lambda x: (scored.append(x.size), whole(x))[1])
    make = np.random.default_rng(3)
    near, far = make.normal(size=(2000, 8)) + 40, make.normal(size=(2000, 8)) - 40
    rows = np.floor(np.concatenate([near, far]))
    side = lambda x: dual_tree.Side(np.arange(len(x)), np.arange(len(x)), np.zeros(len(x), np.int64), x)
    low, high = np.full((200, 1), -dual_tree.LONG), np.full((200, 1), dual_tree.LONG)
    a, _, c, score = dual_tree.search(side(rows[:200]), side(rows), low, high, 3, True)
    assert sum(scored) < 200 * 4000 * 0.6
    products = rows[:200] @ rows.T
    for k in range(200):
        want = sorted(((-products[k, j], j) for j in range(4000) if j != k))[:3]
        assert [(-s, j) for j, s in zip(c[a == k].tolist(), score[a == k].tolist())] == want


@pytest.mark.parametrize("options", [{}, {"block": 40, "anchors_block": 3, "pivots": 4}])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, options, seed):
    random.seed(seed)
    some = [[round(random.gauss(0.1, 0.3), random.choice([1, 5])) for _ in range(4)] for _ in range(200)]
    rows = [(k, random.choice(some), random.randint(0, 2)) for k in range(400)]
    rows += [(450, None, 1), (500, [0.1, None, 0.2, 0.3], 1), (550, [float("nan")] * 4, 1), (600, [float("inf"), 0.0, 0.0, 0.0], 1), (650, [0.1] * 4, None), (None, [0.5] * 4, 1), (700, [], 1), (750, [0.4], 1), (800, [0.0] * 4, 2), (850, [0.3] * 6, 0)]
    rows += rows[50:52] * 2 + rows[:1]
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], KIND)
    assert rows_of(mined(frame, **options)) == plain(rows)


def test_large_components(spark):
    """Scores beyond 2^53 are exact."""
    random.seed(4)
    rows = [(k, [random.uniform(1e5, 3e5) for _ in range(4)], k % 3) for k in range(0, 300, 5)]
    frame = spark.createDataFrame([(*r, "", 0) for r in rows], KIND.replace("float", "double"))
    got = rows_of(mined(frame))
    assert got == plain(rows) and max(r[4] for r in got) > 2**53


def test_empty(spark):
    assert mined(spark.createDataFrame([], KIND)).count() == 0
    assert mined(spark.createDataFrame([(50, [1.0], 1, "", 0)], KIND)).count() == 0
    assert mined(spark.createDataFrame([(51, [1.0], 1, "", 0), (52, [1.0], 2, "", 0)], KIND)).count() == 0


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = rows_of(queries.op12_hard_negatives(spark, sf))
    assert got and got == plain(rows)
