from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import ann
from tidefold.llm.ann import fit, nearest, scan

DDL = "vec_id long, embedding array<float>, label int, list int, vector string, ids string, score double, bound double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y", 0.5, 0.1) for i, v in rows], DDL)


def brute(rows, k, step):
    fine = sorted({
        (i, tuple(v)) for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    })
    out = {}
    for i, v in fine:
        if i % step == 0:
            far = {}
            for j, w in fine:
                if j != i and len(w) == len(v):
                    d = float(np.sqrt(((np.float32(w).astype(float) - np.float32(v).astype(float)) ** 2).sum()))
                    far[j] = min(d, far.get(j, np.inf))
            out[i] = sorted((d, j) for j, d in far.items())[:k]
    return out


def vectors(n, width, seed=1, clusters=20):
    random = np.random.default_rng(seed)
    centre = random.standard_normal((clusters, width))
    points = centre[random.integers(0, clusters, n)] + random.standard_normal((n, width))
    return [(k, list(map(float, np.float32(p)))) for k, p in enumerate(points)]


def awkward(width):
    nan, inf = float("nan"), float("inf")
    shared = [0.5] * width
    odd = [(5000, None), (5010, []), (5020, [0.0] * width), (5030, [nan] + [1.0] * (width - 1)),
           (5040, [inf] * width), (None, [1.0] * width), (5050, [None] + [1.0] * (width - 1))]
    return odd + [(6000 + k, shared) for k in range(200)] + [(6000, shared), (7000, [1.0, 2.0]), (7010, [1.0, 2.5])]


def test_small_tables_are_exact(spark):
    """Ties, repeated rows, a vector that many rows share, vectors of another length, too few candidates."""
    for rows in (awkward(4), awkward(4) + vectors(60, 4), vectors(7, 3), [(0, [1.0])]):
        found = {}
        for r in nearest(table(spark, rows), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
            assert r.rank == len(found.setdefault(r.query_id, [])) + 1
            found[r.query_id].append((r.score, r.vec_id))
        expected = {q: v for q, v in brute(rows, 10, 10).items() if v}
        if len(rows) <= 8:
            assert found == {q: [(pytest.approx(d), j) for d, j in v] for q, v in expected.items()}
        assert set(found) == set(expected)
        hits = sum(len({j for _, j in found[q]} & {j for _, j in v}) for q, v in expected.items())
        assert hits >= 0.9 * sum(map(len, expected.values()))
        assert all(len(found[q]) == len(v) for q, v in expected.items())
        if 6000 in expected:
            assert found[6000] == [(0.0, 6000 + k) for k in range(1, 11)]


def test_recall(spark, monkeypatch):
    """Several lists, each dealt to several tasks."""
    monkeypatch.setattr(ann, "VECTORS_AT_ONCE", 100)
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 20)
    rows = vectors(3000, 32)
    found = {}
    for r in nearest(table(spark, rows), F.col("vec_id") % 10 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute(rows, 10, 10)
    hits = sum(len(found[q] & {j for _, j in v}) for q, v in expected.items())
    assert hits / 3000 >= 0.9


def test_scan_abandons_but_keeps_the_nearest():
    rows = np.array([v for _, v in vectors(2000, 64)])
    rotation, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((64, 64)))
    kept = scan(rows[:50], np.full(50, np.inf), rows, rotation, 10)
    hits = 0
    for query, alive in zip(rows[:50], kept):
        best = np.argsort(((rows - query) ** 2).sum(1))[:11]
        hits += len(set(best) & set(alive))
    assert hits >= 0.97 * 550
    assert np.mean([len(a) for a in kept]) < 1000  # of 2000


def test_without_the_test_no_neighbour_is_lost():
    """The fallback: no bound to start with, and only what is farther than the bound goes; also k + 2 vectors alone."""
    random = np.random.default_rng(8)
    rotation, _ = np.linalg.qr(random.standard_normal((48, 48)))
    for n in (12, 13, 500, 3000):
        held = random.standard_normal((n, 48)) * random.choice([0.1, 1, 5], (n, 1))
        asked = held[:40] + 0.01
        found = scan(asked, np.full(len(asked), np.inf), held, rotation, 10, errors=float("inf"))
        for query, alive in zip(asked, found):
            far = ((held - query) ** 2).sum(axis=1)
            assert set(np.argsort(far, kind="stable")[:11]) <= set(alive)


def test_recall_where_the_fit_sees_a_quarter(spark, monkeypatch):
    """Lists, probes and bounds are fitted on a part of the vectors; all are indexed."""
    rows = vectors(1600, 64, seed=3, clusters=1)
    monkeypatch.setattr(ann, "SAMPLE", 400)
    found = {}
    for r in nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute(rows, 10, 100)
    assert all(len(found[q]) == 10 for q in expected)
    assert sum(len(found[q] & {j for _, j in v}) for q, v in expected.items()) >= 0.9 * 10 * len(expected)


def test_empty_table(spark):
    empty = table(spark, [])
    assert nearest(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert fit(spark.createDataFrame([], "vector array<double>")) is None
