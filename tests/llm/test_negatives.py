"""Hard negatives against exhaustive search."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, step=100):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y, *_ in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ya in {(i, tuple(v), y) for i, v, y in ok if i % step == 0}:
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in ok if i != a and len(v) == len(va)), key=lambda r: r[:2])
        for p, positive, _ in [r for r in scored if r[2] == ya][:5]:
            fits = [(s, i) for s, i, y in scored if y != ya and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, positive, k, i, -p, -s) for k, (s, i) in enumerate(fits[:5], 1)]
    return sorted(out)


@pytest.fixture
def small_tree(monkeypatch):
    for name, value in (("LEAF", 20), ("FAN", 4), ("BLOCK", 16), ("ANCHORS", 3), ("FIRST", 1)):
        monkeypatch.setattr(negatives, name, value)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in np.float32(row)], int(rng.integers(0, 4))) for i, row in enumerate(x)]


def test_equals_exhaustive_search_over_many_leaves(spark, small_tree):
    rows = clustered(900, 12, 1)
    rows += [(1000 + k, rows[k % 3][1], k % 2) for k in range(120)]  # equal vectors, ties by id
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), anchors=50)
    assert sorted(map(tuple, got.collect())) == plain(rows, 50)


def test_rows_that_take_no_part_lengths_repeats_and_large_numbers(spark, small_tree):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3 if i % 2 else 5)], i % 3) for i in range(200)]
    rows += [(None, [1.0] * 5, 1), (300, None, 1), (301, [1.0, None, 1.0], 1), (302, [float("nan")] * 3, 1), (303, [float("inf")] * 3, 1), (304, [1.0] * 3, None), (305, [], 1), (400, [], 1), (401, [], 0)]
    rows += [(i, [rng.uniform(-1e5, 1e5) for _ in range(4)], i % 2) for i in range(500, 640)]
    rows += [rows[40], rows[41]]  # a repeated anchor and a repeated row
    got = negatives.mine(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", leaf string"), anchors=20)
    assert sorted(map(tuple, got.collect())) == plain(rows, 20)
    huge = negatives.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA))
    assert huge.collect() == []
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_leaves_out_only_leaves_without_the_window():
    rows = np.array([r[1] for r in clustered(3000, 6, 2)])
    x = np.floor(256 * rows)
    length = np.square(x).sum(axis=1)
    radius = float(np.sqrt(length.max()))
    lifted = negatives._lifted(x, length, radius)
    tree = negatives.Tree(lifted[::3], radius, 60, 4)
    low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
    high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]

    def seen(node, child, far):
        low[node][:, child] = np.minimum(low[node][:, child], far.min(axis=0))
        high[node][:, child] = np.maximum(high[node][:, child], far.max(axis=0))
    leaf = tree.place(lifted, seen)
    tree.low, tree.high = low, high
    visited = 0
    for k in range(0, 3000, 100):
        scores = x @ x[k]
        least, most = np.sort(scores)[-40], np.sort(scores)[-10]
        reached = tree.reach(x[k], int(length[k]), np.array([least]), np.array([most]))
        assert set(leaf[(scores >= least) & (scores <= most)].tolist()) <= set(reached)
        visited += len(reached)
    assert visited < 0.8 * 30 * tree.leaves
