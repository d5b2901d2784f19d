from __future__ import annotations

import datetime
from decimal import Decimal
from itertools import combinations

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F
from records import document, records, row

from tidefold.functions.scalars import job_name, key_text, normalised_path
from tidefold.operators.envelope import decode_changelog
from tidefold.operators.impact import EPOCH, advanced_marks, impacted, next_watermark
from tidefold.plans.gold import customer_loyalty, sales_summary
from tidefold.plans.refresh import ensure_graph, refresh, seed_graph, stored_marks
from tidefold.schemas import CHANGE_LOG_DDL, CUSTOMERS, DEPENDENCY_GRAPH, ENTITIES, GRAPH_DDL, SALES_TRANSACTIONS
from tidefold.sinks.gold import read_gold
from tidefold.sinks.silver import commit_batch, read_silver
from tidefold.plans.gold import GOLD


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


def log_of(spark, *rows):
    data = [(table, 0, "1", seconds) for table, seconds in rows]
    df = spark.createDataFrame(data, "table_name STRING, snapshot_id BIGINT, affected_keys STRING, s INT")
    return df.withColumn("committed_at", F.timestamp_seconds("s")).drop("s")


TABLES = list(ENTITIES)


@pytest.mark.parametrize("changed", [c for n in range(5) for c in combinations(TABLES, n)])
def test_every_subset_of_changed_tables(spark, changed):
    found = [r.gold_table for r in impacted(log_of(spark, *[(t, 10) for t in changed]), seed_graph(spark)).collect()]
    assert found == sorted({g for g, s in DEPENDENCY_GRAPH if s in changed})


def test_change_at_the_mark_is_not_new(spark):
    log = log_of(spark, ("customers", 10), ("stores", 11))
    assert [r.gold_table for r in impacted(log, seed_graph(spark), at(10)).collect()] == ["gold.sales_summary"]
    assert impacted(log, seed_graph(spark), at(11)).count() == 0


def test_empty_log(spark):
    log = spark.createDataFrame([], CHANGE_LOG_DDL)
    assert impacted(log, seed_graph(spark)).count() == 0
    assert next_watermark(log, at(5)).select(F.unix_seconds("watermark")).first()[0] == 5


def test_watermark_is_the_newest_row_read(spark):
    log = log_of(spark, ("customers", 10), ("stores", 30))
    assert next_watermark(log, at(5)).select(F.unix_seconds("watermark")).first()[0] == 30
    assert next_watermark(log, at(40)).select(F.unix_seconds("watermark")).first()[0] == 40


def test_marks_are_batches_of_a_table(spark):
    rows = [("customers", 3, "1"), ("customers", 4, "1"), ("stores", 0, "2"), ("products", 7, "2")]
    log = spark.createDataFrame(rows, "table_name STRING, snapshot_id BIGINT, affected_keys STRING")
    found = advanced_marks(log, {"customers": 3, "products": 7})
    assert values(found) == [("customers", 4), ("stores", 0)]
    assert advanced_marks(log, {"customers": 9, "stores": 0, "products": 7}).count() == 0


def test_a_batch_committed_by_a_slow_clock_is_seen(spark, layout):
    commit(spark, layout, CUSTOMERS, 0, [{"customer_id": 1}], 20)
    assert refresh(spark, layout) == ["gold.customer_loyalty"]
    commit(spark, layout, CUSTOMERS, 1, [{"customer_id": 2}], 10)  # its driver's clock is behind
    assert refresh(spark, layout) == ["gold.customer_loyalty"]
    assert len(gold_rows(spark, layout, "customer_loyalty")) == 2


def test_a_tick_within_a_commit_loses_nothing(spark, layout, monkeypatch):
    from tidefold.sinks import silver as module

    log, ticks = module.change_log, []

    def tick_first(*args):
        ticks.append(refresh(spark, layout))
        return log(*args)

    monkeypatch.setattr(module, "change_log", tick_first)
    commit(spark, layout, CUSTOMERS, 0, [{"customer_id": 1}], 10)
    assert ticks == [[]]
    assert refresh(spark, layout) == ["gold.customer_loyalty"]
    assert len(gold_rows(spark, layout, "customer_loyalty")) == 1


def test_an_edge_without_a_builder_does_not_stop_the_tick(spark, layout):
    ensure_graph(spark, layout)
    spark.createDataFrame([("gold.unknown", "customers")], GRAPH_DDL).write.mode("append").parquet(layout.graph)
    commit(spark, layout, CUSTOMERS, 0, [{"customer_id": 1}], 10)
    with pytest.warns(UserWarning, match="gold.unknown"):
        assert refresh(spark, layout) == ["gold.customer_loyalty"]
    assert stored_marks(spark, layout) == {"customers": 0}


def test_graph_is_seeded_once(spark, layout):
    for _ in range(2):
        assert values(ensure_graph(spark, layout)) == sorted(DEPENDENCY_GRAPH)


def commit(spark, layout, entity, batch, rows, second):
    full = [{**dict.fromkeys(entity.columns), **r} for r in rows]
    docs = [document("c", None, r, batch) for r in full]
    commit_batch(spark, layout, entity, decode_changelog(records(spark, docs), entity), batch, F.timestamp_seconds(F.lit(second)))


def gold_rows(spark, layout, table):
    ddl, _ = GOLD[f"gold.{table}"]
    return values(read_gold(spark, layout, table, ddl).drop("updated_at"))


def test_only_affected_aggregates_are_rebuilt(spark, layout):
    commit(spark, layout, CUSTOMERS, 0, [{"customer_id": 1, "name": "n", "total_spend": 2.5}], 10)
    assert refresh(spark, layout) == ["gold.customer_loyalty"]
    assert gold_rows(spark, layout, "customer_loyalty") == [(1, "n", None, 2.5, 0)]
    assert refresh(spark, layout) == []

    sale = {"txn_id": 1, "store_id": 1, "product_id": 2, "customer_id": 1, "qty": 3, "total_amount": 1.25, "status": "completed"}
    commit(spark, layout, SALES_TRANSACTIONS, 0, [sale], 5)  # visible later than the newer customer batch
    assert refresh(spark, layout) == ["gold.customer_loyalty", "gold.sales_summary"]
    assert gold_rows(spark, layout, "customer_loyalty") == [(1, "n", None, 2.5, 1)]
    assert gold_rows(spark, layout, "sales_summary") == [(1, 2, 3, 1.25, 1)]

    commit(spark, layout, SALES_TRANSACTIONS, 1, [{**sale, "status": "returned"}], 20)
    assert len(refresh(spark, layout)) == 2
    assert gold_rows(spark, layout, "sales_summary") == [(1, 2, 3, 1.25, 1)]  # merge never deletes
    commit(spark, layout, SALES_TRANSACTIONS, 2, [{**sale, "txn_id": 9, "store_id": 8}], 30)
    refresh(spark, layout, delete_unmatched=True)
    assert gold_rows(spark, layout, "sales_summary") == [(8, 2, 3, 1.25, 1)]


def test_marks_stay_when_a_rebuild_fails(spark, layout, monkeypatch):
    from tidefold.plans import refresh as module

    commit(spark, layout, CUSTOMERS, 0, [{"customer_id": 1}], 10)
    with monkeypatch.context() as patch:
        patch.setattr(module, "refresh_table", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            refresh(spark, layout)
    assert stored_marks(spark, layout) == {}
    assert refresh(spark, layout) == ["gold.customer_loyalty"]


def test_loyalty_counts_sales_of_every_status_and_keeps_customers_without(spark):
    customers = spark.createDataFrame(
        [(1, "a", "gold", Decimal(1)), (2, "b", None, None)], "customer_id INT, name STRING, loyalty_tier STRING, total_spend DECIMAL(12,2)"
    )
    sales = spark.createDataFrame(
        [(1, 1, "completed"), (2, 1, "returned"), (None, 1, "completed"), (4, None, "completed"), (5, 77, "completed")],
        "txn_id INT, customer_id INT, status STRING",
    )
    found = customer_loyalty(customers, sales).drop("updated_at")
    assert values(found) == [(1, "a", "gold", 1.0, 2), (2, "b", None, None, 0)]


def test_sales_are_counted_before_they_meet_the_customers(spark):
    customers = spark.createDataFrame([(1,)], "customer_id INT").selectExpr("customer_id", "'n' name", "'t' loyalty_tier", "1.5 total_spend")
    hot = spark.range(3000).selectExpr("id txn_id", "cast(if(id % 3 = 0, 1, id) as int) customer_id")
    found = customer_loyalty(customers, hot)
    lines = plan_of(found).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    partial = next(i for i, line in enumerate(lines) if "partial_count" in line)
    assert join < partial
    assert found.first().txn_count == 1001


def test_aggregates_over_nothing(spark, layout):
    empty = read_silver(spark, layout, SALES_TRANSACTIONS)
    assert sales_summary(empty).count() == 0
    assert customer_loyalty(read_silver(spark, layout, CUSTOMERS), empty).count() == 0


def test_scalars(spark):
    one = spark.createDataFrame([("gold.sales_summary", 3, None, "file:///a/b")], "t STRING, k INT, n INT, p STRING")
    found = one.select(job_name(F.col("t")), key_text(["k"]), key_text(["k", "n"]), normalised_path(F.col("p"))).first()
    assert tuple(found) == ("sales-summary", "3", '{"k":3,"n":null}', "file:/a/b")
