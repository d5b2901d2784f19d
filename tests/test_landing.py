from __future__ import annotations

import datetime

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F
from records import SALES, document, records, row

from tidefold.operators.deltas import signed_images
from tidefold.operators.envelope import decode_changelog
from tidefold.plans import incremental, standins
from tidefold.schemas import ORDER, RECORD_DDL
from tidefold.session import fresh_dir
from tidefold.sinks import buckets, silver
from tidefold.sinks.silver import commit_batch


@pytest.fixture
def directory(spark):
    path = fresh_dir(spark, "tables")
    day = datetime.datetime(1995, 6, 17)
    lines = [(k % 5, k % 2 + 1, k % 3, k % 2, "RAN"[k % 3], 5.0, 10.5, "OF"[k % 2], day) for k in range(60)] + [(None,) * 9]
    spark.createDataFrame(
        lines,
        "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_returnflag STRING, l_quantity DOUBLE,"
        " l_extendedprice DOUBLE, l_linestatus STRING, l_shipdate TIMESTAMP",
    ).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey BIGINT, o_custkey BIGINT").write.parquet(f"{path}/orders.parquet")
    return path


def test_landed_records_are_all_there_and_small(spark, directory):
    path, files = standins.land_table(spark, directory, "sales_transactions", 2)
    landed = spark.read.schema(RECORD_DDL).json(path)
    sent = standins.sale_records(spark, directory)
    assert values(landed) == values(sent.select(*landed.columns)) and landed.count() == 61
    names = landed.inputFiles()
    assert names and all(n.endswith(".json.gz") for n in names) and len(names) <= 2 * files


def test_row_changes_are_dealt_and_not_their_documents(spark, directory):
    plan = plan_of(standins.table_records(spark, directory, "sales_transactions", 6)).lower()
    after, before = plan.split("roundrobinpartitioning(6)")
    assert "tojson" in after.replace("_", "") and "tojson" not in before.replace("_", "")


def test_touched_buckets_come_from_the_keys_and_not_from_the_fold(spark, layout, monkeypatch):
    seen = []
    real = buckets.bucket_of
    monkeypatch.setattr(silver, "upsert", lambda *a, **k: seen.append(k["keyed"]) or buckets.upsert(*a, **k))
    changes = decode_changelog(records(spark, [document("c", None, row(1), 1), document("c", None, row(2), 2)]), SALES)
    commit_batch(spark, layout, SALES, changes, 0, F.current_timestamp())
    plan = plan_of(seen[0].select(real(SALES.keys, 32)).distinct())
    assert "Window" not in plan
    names = silver.read_changes(spark, layout, SALES).inputFiles()
    assert names and all(".zstd." in n for n in names)


def test_images_of_many_changes_need_one_join(spark, monkeypatch):
    """Changes beyond the measure of a broadcast meet the stored rows once, and are not written aside first."""
    monkeypatch.setattr("tidefold.operators.sizing.BROADCAST_BYTES", 0)
    monkeypatch.setattr("tidefold.operators.deltas.is_small", lambda df: False)
    columns = ["op", *SALES.columns, *ORDER]
    change = lambda docs: decode_changelog(records(spark, docs), SALES).select(*columns)
    old = change([document("c", None, row(1, qty=1), 1)])
    new = change([document("u", row(1, qty=1), row(1, qty=2), 2), document("c", None, row(2, qty=3), 3)])
    images = signed_images(old, new.withColumn("offset", F.col("offset") + 10), SALES.keys, ORDER, SALES.columns)
    assert values(images.select("sign", "txn_id", "qty")) == [(-1, 1, 1), (1, 1, 2), (1, 2, 3)]
    assert plan_of(images).count("Join") == 1 and "ExistingRDD" not in plan_of(images).split("Join")[0]


def test_sales_are_counted_before_the_shuffle(spark):
    sales = [(1, 5, 7), (1, 5, 7), (-1, 5, 7), (1, 6, 7), (1, 5, 8), (1, 5, None)]
    images = spark.createDataFrame(sales, "sign INT, snapshot_id BIGINT, customer_id INT")
    assert values(incremental._sale_counts(images)) == [(5, 7, 1), (5, 8, 1), (6, 7, 1)]
