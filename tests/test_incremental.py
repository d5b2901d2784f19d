from __future__ import annotations

import random

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F
from records import document, records, row

from tidefold.operators.deltas import signed_images
from tidefold.operators.envelope import decode_changelog
from tidefold.plans import incremental, refresh as refresh_module
from tidefold.plans.gold import GOLD
from tidefold.plans.refresh import build, refresh
from tidefold.schemas import CUSTOMERS, SALES_TRANSACTIONS
from tidefold.sinks.gold import read_gold
from tidefold.sinks.silver import commit_batch, read_feed

DDL = "op STRING, k INT, v STRING, ts_ms BIGINT, offset BIGINT"


def test_images_of_each_kind_of_change(spark):
    stored = spark.createDataFrame(
        [("c", 1, "a", 1, 0), ("c", 2, "b", 1, 1), ("d", 3, None, 1, 2), ("c", 4, "d", 9, 3), ("c", None, "n", 1, 4), ("c", 6, "f", 1, 5)],
        DDL,
    )
    changed = spark.createDataFrame(
        [("u", 1, "A", 2, 10), ("d", 2, None, 2, 11), ("c", 3, "C", 2, 12), ("u", 4, "late", 2, 13), ("u", None, "N", 2, 14),
         ("c", 5, "new", 2, 15), ("c", 6, "f", 1, 5), ("d", 7, None, 2, 16)],
        DDL,
    )
    found = signed_images(stored, changed, ["k"], ["ts_ms", "offset"], ["k", "v"])
    assert values(found) == [(-1, 1, "a"), (-1, 2, "b"), (-1, None, "n"), (1, 1, "A"), (1, 3, "C"), (1, 5, "new"), (1, None, "N")]


def commit(spark, layout, entity, batch, documents, start):
    found = records(spark, documents).withColumn("offset", F.col("offset") + start)
    commit_batch(spark, layout, entity, decode_changelog(found, entity), batch, F.current_timestamp(), buckets=4, with_feed=True)


def changes_of(pick, n, start):
    """Inserts, updates, deletes, moves to another group or key, NULLs, changes that arrive late."""
    out = []
    for i in range(n):
        key, at = pick.randrange(12), start + pick.randrange(-6, 6)
        new = row(
            key, store_id=pick.choice([1, 2, None]), product_id=pick.choice([7, 8]), customer_id=pick.choice([1, 2, 3, 9, None]),
            qty=pick.choice([None, 1, 2, 3]), total_amount=pick.choice([None, 0.1, 0.2, 10.35, -4]), status=pick.choice(["completed", "completed", "open"]),
        )
        kind = pick.choice("cuudm")
        if kind == "d":
            out.append(document("d", row(key), None, at))
        elif kind == "m":
            out.append(document("u", row(pick.randrange(12)), new, at))
        else:
            out.append(document(kind, row(key) if kind == "u" else None, new, at))
    return out


def people_of(pick, n, start):
    out = []
    for i in range(n):
        key = pick.choice([1, 2, 3, 4])
        person = {**dict.fromkeys(CUSTOMERS.columns), "customer_id": key, "name": f"n{pick.randrange(99)}", "total_spend": pick.choice([None, 2.5])}
        out.append(document("d", person, None, start + i) if pick.random() < 0.3 else document("u", person, person, start + i))
    return out


def assert_equal_to_recomputation(spark, layout):
    for table, (ddl, _) in GOLD.items():
        followed = read_gold(spark, layout, table.split(".")[1], ddl).drop("updated_at")
        assert values(followed) == values(build(spark, layout, table).drop("updated_at")), table


def test_aggregates_equal_a_recomputation(spark, layout):
    pick = random.Random(7)
    for batch in range(4):
        commit(spark, layout, SALES_TRANSACTIONS, batch, changes_of(pick, 15, 10 * batch), 100 * batch)
        if batch % 2:
            commit(spark, layout, CUSTOMERS, batch, people_of(pick, 5, 10 * batch), 100 * batch)
        if batch != 2:  # a tick may find several batches
            refresh(spark, layout, incremental=True)
            assert_equal_to_recomputation(spark, layout)
    gone = [document("d", row(k), None, 1000) for k in range(12)]
    commit(spark, layout, SALES_TRANSACTIONS, 9, gone, 9000)
    refresh(spark, layout, incremental=True)
    assert_equal_to_recomputation(spark, layout)
    assert read_gold(spark, layout, "sales_summary", GOLD["gold.sales_summary"][0]).count() == 0
    assert refresh(spark, layout, incremental=True) == []


@pytest.mark.parametrize("lost_at", ["aggregate", "marks"])
def test_a_repeated_tick_adds_nothing_twice(spark, layout, monkeypatch, lost_at):
    """The tick is lost after the state took the batch in, and runs again, with another batch beside it."""
    sale = row(1, store_id=1, product_id=2, qty=3, total_amount=1.5, status="completed")
    commit(spark, layout, SALES_TRANSACTIONS, 0, [document("c", None, sale, 1)], 0)
    refresh(spark, layout, incremental=True)
    commit(spark, layout, SALES_TRANSACTIONS, 1, [document("c", None, {**sale, "txn_id": 2}, 2)], 10)
    with monkeypatch.context() as patch:
        module, name = (incremental, "replace_buckets") if lost_at == "aggregate" else (refresh_module, "store_marks")
        patch.setattr(module, name, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            refresh(spark, layout, incremental=True)
    commit(spark, layout, SALES_TRANSACTIONS, 2, [document("c", None, {**sale, "txn_id": 3, "qty": None}, 3)], 20)
    assert "gold.sales_summary" in refresh(spark, layout, incremental=True)
    assert_equal_to_recomputation(spark, layout)
    found = read_gold(spark, layout, "sales_summary", GOLD["gold.sales_summary"][0]).drop("updated_at")
    assert values(found) == [(1, 2, 6, 4.5, 3)]


def test_a_tick_reads_and_writes_what_is_touched(spark, layout):
    many = [document("c", None, row(i, store_id=i, product_id=1, qty=1, total_amount=1, status="completed"), 1) for i in range(300)]
    commit(spark, layout, SALES_TRANSACTIONS, 0, many, 0)
    early = F.lit("2024-01-01").cast("timestamp")
    refresh(spark, layout, early, incremental=True)
    commit(spark, layout, SALES_TRANSACTIONS, 1, [document("u", row(5), row(5, store_id=6, product_id=1, qty=9, status="completed"), 2)], 900)
    files = lambda name: {f for f in spark.read.parquet(layout.table(name)).inputFiles()}
    before = files("state.sales_summary"), files("gold.sales_summary")
    assert refresh(spark, layout, F.lit("2024-02-02").cast("timestamp"), incremental=True)
    for old, new in zip(before, (files("state.sales_summary"), files("gold.sales_summary"))):
        assert 1 <= len(old - new) <= 2 and len(old) == len(new) > 10  # the buckets of the stores 5 and 6
    rows = read_gold(spark, layout, "sales_summary", GOLD["gold.sales_summary"][0])
    assert values(rows.filter("updated_at >= '2024-02-02'").select("store_id", "total_qty", "total_amount")) == [(6, 10, 1.0)]
    images = read_feed(spark, layout, SALES_TRANSACTIONS, 0, 1)
    assert images.count() == 2 and "snapshot_id" in plan_of(images).split("PartitionFilters")[1]
