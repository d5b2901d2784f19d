from __future__ import annotations

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from tidefold.operators.merge import insert_if_absent, merge, merge_bucketed
from tidefold.plans.gold import sales_summary

DDL = "a INT, b INT, v STRING"
KEYS = ["a", "b"]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def test_matched_rows_are_replaced_and_unmatched_inserted(spark):
    target = frame(spark, (1, 1, "old"), (1, 2, "kept"))
    source = frame(spark, (1, 1, None), (2, 1, "new"))
    assert values(merge(target, source, KEYS)) == [(1, 1, None), (1, 2, "kept"), (2, 1, "new")]


def test_merging_twice_equals_merging_once(spark):
    target = frame(spark, (1, 1, "old"), (3, 3, "x"))
    source = frame(spark, (1, 1, "new"), (2, 1, "y"))
    once = merge(target, source, KEYS)
    twice = merge(once, source, KEYS)
    assert values(once) == values(twice)
    assert twice.groupBy(*KEYS).count().filter("count > 1").isEmpty()


def test_null_key_is_inserted_again_by_each_run(spark):
    source = frame(spark, (None, 1, "n"), (1, 1, "v"))
    target = frame(spark)
    for _ in range(2):
        target = merge(target, source, KEYS)
    assert values(target) == [(1, 1, "v"), (None, 1, "n"), (None, 1, "n")]


def test_null_safe_merge_matches_null_keys(spark):
    target = frame(spark, (None, 1, "old"))
    assert values(merge(target, frame(spark, (None, 1, "new")), KEYS, null_safe=True)) == [(None, 1, "new")]


def test_delete_unmatched(spark):
    target = frame(spark, (1, 1, "old"), (2, 2, "stale"))
    assert values(merge(target, frame(spark, (1, 1, "new")), KEYS, delete_unmatched=True)) == [(1, 1, "new")]


def test_cardinality(spark):
    target = frame(spark, (1, 1, "x"))
    twice = frame(spark, (1, 1, "a"), (1, 1, "b"))
    unmatched = frame(spark, (5, 5, "a"), (5, 5, "b"), (None, 1, "c"), (None, 1, "d"))
    assert merge(target, unmatched, KEYS).count() == 5
    for options in ({}, {"null_safe": True}, {"delete_unmatched": True}):
        with pytest.raises(Exception, match="several source rows match"):
            merge(target, twice, KEYS, **options).collect()
    nulls = frame(spark, (None, 1, "a"), (None, 1, "b"))
    with pytest.raises(Exception, match="several source rows match"):
        merge(frame(spark, (None, 1, "x")), nulls, KEYS, null_safe=True).collect()


def test_aggregated_source_is_shuffled_once_and_read_once(spark, layout):
    ddl = "store_id INT, product_id INT, qty INT, total_amount DECIMAL(12,2), status STRING"
    path = f"{layout.root}/sales"
    rows = [(1, i % 5, 1, None, "completed") for i in range(20)]
    spark.createDataFrame(rows, ddl).write.parquet(path)
    source = sales_summary(spark.read.schema(ddl).parquet(path))
    target_path = f"{layout.root}/target"
    source.write.parquet(target_path)
    merged = merge(spark.read.parquet(target_path), source, ["store_id", "product_id"])
    plan = plan_of(merged)
    assert sum("/sales]" in line for line in plan.splitlines()) == 1
    # one exchange for the aggregate, one for the stored side of the join
    assert plan.count("Exchange hashpartitioning") == 2
    assert merged.count() == 5


def test_insert_if_absent(spark):
    existing = frame(spark, (1, 1, "old"))
    candidates = frame(spark, (1, 1, "new"), (2, 1, "b"), (2, 1, "a"), (3, 1, "c"))
    found = insert_if_absent(existing, candidates, KEYS, ["v"])
    assert values(found) == [(1, 1, "old"), (2, 1, "a"), (3, 1, "c")]
    again = insert_if_absent(found, candidates, KEYS, ["v"])
    assert values(again) == values(found)


def test_summary_edge_cases(spark):
    ddl = "store_id INT, product_id INT, qty INT, total_amount DECIMAL(12,2), status STRING"
    rows = [(1, 1, 2, None, "completed"), (1, 1, None, None, "completed"), (1, 1, 9, None, None), (None, 1, 4, None, "completed")]
    found = sales_summary(spark.createDataFrame(rows, ddl), F.lit("2024-01-01").cast("timestamp")).drop("updated_at")
    assert values(found) == [(1, 1, 2, None, 2), (None, 1, 4, None, 1)]
    assert sales_summary(spark.createDataFrame([], ddl)).count() == 0


def test_bucketed_table_is_merged_without_a_shuffle_of_its_rows(spark, layout):
    name = "bucketed_" + layout.root.rsplit("-", 1)[1]
    first = frame(spark, *[(i, i % 3, f"old{i}") for i in range(50)], (None, 1, "null"))
    second = frame(spark, *[(i, i % 3, f"new{i}") for i in range(40, 60)], (None, 1, "another"))
    with_join(spark, -1)
    try:
        for source in (first, second):
            merge_bucketed(source, name, KEYS, 4)
        assert values(spark.table(name)) == values(merge(first, second, KEYS))
        files = len(spark.table(name).inputFiles())
        plan = plan_of(merge(spark.table(name), frame(spark, (1, 1, "x")).repartition(4, *KEYS), KEYS))
    finally:
        with_join(spark, 10 << 20)
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    # One exchange, that of the source.
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    assert files <= 4 + 1  # one for each bucket; rows with a NULL key pass by the join
    assert not spark.catalog.tableExists(f"{name}_next")


def with_join(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit))
