from __future__ import annotations

from hashlib import sha256

import numpy as np
import pytest

from tidefold.llm import clustering
from tidefold.llm.clustering import assign, cluster, exact, vantage_tree

DDL = "vec_id long, embedding array<double>, v string, cluster string, distance string, at int, n int"


def frame(spark, rows):
    """With columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, e, "x", "y", "z", 1, 2) for i, e in rows], DDL)


def brute(rows, clusters, rounds, width):
    """Plain loops over Python's integers."""
    kept = [
        (i, [int(np.floor(1024 * x)) for x in e]) for i, e in rows
        if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)
    ]
    drawn = lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=drawn)[:clusters]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((away(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centres[n] = [sum(c) // len(members) for c in zip(*members)]
    placed = [(i, *nearest(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in placed if m == n) for _, _, n in placed}
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, total[n], sum(total.values()), names[n]) for i, d, n in placed), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n=200, width=4):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(random.standard_normal(width), 1)]) for i in range(n)]  # round: many ties
    rows += [(1000 + i, rows[3][1]) for i in range(120)] + [rows[9], rows[9], (9, rows[10][1]), (None, rows[11][1])]
    nan, inf = float("nan"), float("inf")
    return rows + [(500, None), (501, []), (502, [1.0]), (503, [nan] * width), (504, [inf] + [0.0] * (width - 1)), (505, [None] * width)]


@pytest.mark.parametrize("clusters", [1, 2, 8, 13])
def test_equals_plain_loops(spark, clusters):
    rows = corpus()
    found = cluster(frame(spark, rows).repartition(3), clusters=clusters, rounds=4, width=4)
    assert found.dtypes == [
        ("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"),
        ("inertia", "bigint"), ("centroid_sha256", "string"),
    ]
    assert rows_of(found) == brute(rows, clusters, 4, 4)


def test_few_equal_and_no_vectors(spark):
    for rows in ([], [(1, [0.5] * 4)], [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(20)], [(None, [1.0] * 4), (None, [2.0] * 4)]):
        assert rows_of(cluster(frame(spark, rows), width=4)) == brute(rows, 8, 10, 4)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i % 5) * 2.0**17, -float(i) * 2.0**10, 1.0, 0.0]) for i in range(40)]
    assert rows_of(cluster(frame(spark, rows), clusters=3, rounds=3, width=4)) == brute(rows, 3, 3, 4)
    huge = exact(np.array([[1 << 40, 0], [-(1 << 40), 5]], np.int64))
    owner, away = assign(huge, huge, vantage_tree(huge))
    assert list(owner) == [0, 1] and list(away) == [0, 0]


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_the_tree_finds_the_nearest_and_the_smaller_of_ties(monkeypatch, leaf):
    monkeypatch.setattr(clustering, "LEAF", leaf)
    random = np.random.default_rng(2)
    for n in (1, 2, 3, 9, 60):
        centres = random.integers(-4, 5, (n, 3))
        points = random.integers(-5, 6, (400, 3))
        owner, away = assign(points, centres, vantage_tree(centres))
        all_ = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (owner == all_.argmin(axis=1)).all() and (away == all_.min(axis=1)).all()


def test_far_centres_are_left_out(monkeypatch):
    random = np.random.default_rng(4)
    centres = np.concatenate([random.integers(0, 50, (40, 3)) + shift for shift in (0, 10_000, 20_000)])
    points = centres[::3] + 1
    measured = []
    real = clustering.squares
    nodes = vantage_tree(centres)
    monkeypatch.setattr(clustering, "squares", lambda p, c: measured.append(len(p)) or real(p, c))
    assign(points, centres, nodes)
    assert sum(measured) < 0.6 * len(points) * len(centres)
