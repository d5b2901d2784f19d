from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import negatives
from tidefold.llm.negatives import hard_negatives

DDL = "vec_id long, embedding array<float>, label int, key long, leaf int, v string, slot long, score long"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """With columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, e, y, 1, 2, "x", 3, 4) for i, e, y in rows], DDL)


def vectors(n, width, seed, groups=6):
    random_ = np.random.default_rng(seed)
    centres = random_.standard_normal((groups, width))
    rows = []
    for i in range(n):
        x = centres[i % groups] + 0.6 * random_.standard_normal(width)
        rows.append((i, [float(np.float32(c)) for c in x / np.linalg.norm(x)], int(random_.integers(4))))
    return rows


def brute(rows, is_anchor):
    """All pairs, in Python's integers; shorter vectors are filled up with zeros."""
    usable = {
        (i, y, tuple(int(np.floor(256 * float(np.float32(x)))) for x in e)) for i, e, y in rows
        if i is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)
    }
    found = []
    for i, y, a in usable:
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(a, b)), j, z) for j, z, b in usable if j != i]
        like = sorted(s for s in scored if s[2] == y)[:5]
        other = sorted(s for s in scored if s[2] != y)
        for p, j, _ in like:
            fits = [(s, n) for s, n, _ in other if 30 * -p <= 100 * -s <= 90 * -p][:10]
            found += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fits, 1)]
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    if small:  # several groups of vectors and of anchors for each leaf, a sample that is a part
        monkeypatch.setattr(negatives, "COMPONENTS_AT_ONCE", 6 * 20)
        monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 5)
        monkeypatch.setattr(negatives, "SAMPLE", 60)
        monkeypatch.setattr(negatives, "LEAVES", 5)
    rows = vectors(300, 6, 1)
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(40)]  # many equal vectors: ties
    rows += [rows[20], rows[20], (20, rows[21][1], 1)]  # a repeated row, and another vector of the same id
    rows += [(2000, None, 1), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2020, [NAN] + [0.0] * 5, 1), (2030, [INF] + [0.0] * 5, 1)]
    rows += [(None, rows[3][1], 1), (2040, rows[3][1], None), (2050, [0.0] * 6, 2), (2060, [], 2), (2070, [0.5, 0.5], 3)]
    found = hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert found.dtypes == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
        ("positive_score", "bigint"), ("negative_score", "bigint"),
    ]
    wanted = brute(rows, lambda i: i % 10 == 0)
    assert rows_of(found) == wanted and len(wanted) > 500


def test_few_rows_and_no_rows(spark):
    for rows in ([], [(0, [1.0, 0.0], 1)], [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.5, 0.2], 2)], [(0, [], 1), (1, [], 1), (3, [], 2)]):
        assert rows_of(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_are_scored_in_whole_numbers(spark):
    rows = [(i, [2.0**20 * (1 + i % 7), 2.0**21 + i, float(i)], i % 2) for i in range(30)]
    assert rows_of(hard_negatives(frame(spark, rows), F.col("vec_id") < 3)) == brute(rows, lambda i: i < 3)


def test_the_tree_leaves_out_leaves_and_misses_none():
    random_ = random.Random(3)
    points = np.array([[random_.choice([0, 400, -300]) + random_.randrange(40) for _ in range(3)] for _ in range(2000)], np.int64)
    top = float((points * points).sum(axis=1).max())
    lifted = negatives.lifted(points.astype(float), top)
    tree = negatives.grow(lifted[:400], 1) | {"top": top}
    ranges = negatives.no_ranges(tree)
    leaf = negatives.route(lifted, tree, ranges)
    anchors = points[::50]
    scores = anchors @ points.T
    lows, highs = np.percentile(scores, [90, 50], axis=1).astype(np.int64).T, np.percentile(scores, [92, 51], axis=1).astype(np.int64).T
    highs[0, 1] = lows[0, 1] - 1  # an empty window
    reached = negatives.visited(negatives.lifted(anchors.astype(float), top, anchors=True), lows, highs, tree, ranges)
    for i, mine in enumerate(scores):
        inside = ((mine >= lows[i, 0]) & (mine <= highs[i, 0])) | ((mine >= lows[i, 1]) & (mine <= highs[i, 1]))
        assert reached[i, np.unique(leaf[inside])].all()
    assert reached.mean() < 0.8
