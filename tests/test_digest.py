from __future__ import annotations

import random

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from tidefold.operators.capture import snapshot_diff
from tidefold.operators.digest import differing, digests
from tidefold.operators.reconcile import reconcile

DDL = "k INT, v STRING, w STRING, x DOUBLE"


def table(spark, changes=(), n=400):
    rows = {i: (i, f"v{i % 7}", None if i % 5 == 0 else "w", i / 3) for i in range(n)}
    rows[None] = (None, "n", None, None)
    rows.update(changes)
    return spark.createDataFrame([r for r in rows.values() if r is not None], DDL)


def test_equal_tables_differ_nowhere_whatever_the_order_of_their_rows(spark):
    left = table(spark)
    right = left.orderBy(F.rand(3)).repartition(5)
    assert [side.count() for side in differing(left, right, ["k"])] == [0, 0]
    assert values(digests(left, ["k"], 8)) == values(digests(right, ["k"], 8))


@pytest.mark.parametrize(
    "changes",
    [
        {3: (3, "other", "w", 1.0)},
        {3: None},
        {900: (900, "new", None, None)},
        {1: (1, "v2", "w", 1 / 3), 2: (2, "v1", "w", 2 / 3)},  # two rows have swapped a value
        {5: (5, None, "v5", 5 / 3)},  # a NULL and its neighbour have changed places
        {None: (None, "m", None, None)},
    ],
)
def test_what_differs_is_found_in_few_buckets(spark, changes):
    left, right = table(spark), table(spark, changes)
    parts = differing(left, right, ["k"], buckets=64)
    assert values(reconcile(*parts, ["k"])) == values(reconcile(left, right, ["k"])) != []
    assert max(p.count() for p in parts) < 40  # of 401 rows
    named = lambda *sides: snapshot_diff(*[x.filter("k is not null") for x in sides], ["k"])
    assert values(named(*parts).select("op", "k")) == values(named(left, right).select("op", "k"))


def test_one_changed_row_makes_one_bucket_join(spark):
    left, right = table(spark), table(spark, {3: (3, "other", "w", 1.0)})
    parts = differing(left, right, ["k"], buckets=32)
    buckets = {r.b for p in parts for r in p.select(F.pmod(F.xxhash64(F.lit(0), F.isnull("k"), "k"), F.lit(32)).alias("b")).collect()}
    assert len(buckets) == 1
    plan = plan_of(parts[0])
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_random_tables(spark):
    pick = random.Random(2)
    for _ in range(3):
        make = lambda: spark.createDataFrame(
            [(k, pick.choice(["a", "b", None]), pick.choice(["a", "b", None]), pick.choice([0.0, 1.5, None])) for k in range(60) if pick.random() < 0.9], DDL
        )
        left, right = make(), make()
        assert values(reconcile(*differing(left, right, ["k"], 16), ["k"])) == values(reconcile(left, right, ["k"]))


def test_empty_tables(spark):
    empty = table(spark).filter("false")
    assert reconcile(*differing(empty, empty, ["k"]), ["k"]).count() == 0
    assert reconcile(*differing(empty, table(spark), ["k"]), ["k"]).count() == 401
