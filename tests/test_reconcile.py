from __future__ import annotations

from conftest import plan_of, values

from tidefold.operators.reconcile import changelog_gaps, raw_counts, reconcile

DDL = "k INT, v STRING"


def test_each_kind_of_fault_is_found(spark):
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (None, "n")], DDL)
    actual = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e"), (None, "n")], DDL)
    assert values(reconcile(expected, actual, ["k"])) == [(2, "different"), (4, "missing"), (5, "stale")]
    assert reconcile(expected, expected, ["k"]).count() == 0


def test_one_join_answers_all(spark):
    df = spark.createDataFrame([(1, "a")], DDL)
    assert plan_of(reconcile(df, df, ["k"])).count("FullOuter") == 1


def test_counts_per_table_and_operation(spark):
    a = spark.createDataFrame([("c",), ("c",), ("d",)], "op STRING")
    b = spark.createDataFrame([("r",)], "op STRING")
    assert values(raw_counts({"a": a, "b": b})) == [("a", "c", 2), ("a", "d", 1), ("b", "r", 1)]


def test_unlogged_keys(spark):
    touched = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x")], DDL)
    log = spark.createDataFrame([("t", "1"), ("t", "1"), ("other", "2"), ("t", "3")], "table_name STRING, affected_keys STRING")
    assert values(changelog_gaps(touched, log, "t", ["k"])) == [("t", "2")]
