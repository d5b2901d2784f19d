from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F
from records import records

from tidefold.jobs import main
from tidefold.operators.capture import change_records, snapshot_records
from tidefold.operators.merge import merge_into_table
from tidefold.plans.gold import GOLD
from tidefold.schemas import CUSTOMERS, ENTITIES, SALES_TRANSACTIONS
from tidefold.sinks.gold import read_gold
from tidefold.sinks.silver import read_silver
from tidefold.sources.streams import kafka_records, write_records
from tidefold.sources.tables import jdbc_table


def test_all_jobs_from_landing_to_aggregate(spark, layout, capsys):
    inbox = f"{layout.root}/inbox"
    people = spark.createDataFrame([(1, "ann"), (2, "bob")], "customer_id INT, name STRING")
    write_records(snapshot_records(people, CUSTOMERS, "p.customers", F.lit(0)), path=f"{inbox}/p.customers")
    sales = spark.createDataFrame(
        [("c", 1, 7, 8, 1, 2, 1.5, "completed", 5, 0), ("d", 2, 7, 8, 1, 2, 1.5, "completed", 6, 1)],
        "op STRING, txn_id INT, store_id INT, product_id INT, customer_id INT, qty INT, total_amount DOUBLE,"
        " status STRING, ts_ms BIGINT, offset BIGINT",
    )
    write_records(change_records(sales, SALES_TRANSACTIONS, "p.sales_transactions"), path=f"{inbox}/p.sales_transactions")

    root = ["--root", layout.root]
    bus = ["--topic-prefix", "p", "--landing", inbox]
    tables = ["--tables", "customers", "sales_transactions"]
    main(["stream", *root, *bus, *tables, "--once"], spark)
    assert values(read_silver(spark, layout, CUSTOMERS).select("customer_id", "name")) == [(1, "ann"), (2, "bob")]
    assert read_silver(spark, layout, ENTITIES["sales_transactions"]).count() == 1

    main(["tick", *root], spark)
    assert capsys.readouterr().out.split() == ["gold.customer_loyalty", "gold.sales_summary"]
    loyalty = read_gold(spark, layout, "customer_loyalty", GOLD["gold.customer_loyalty"][0])
    assert values(loyalty.select("customer_id", "txn_count")) == [(1, 1), (2, 0)]
    main(["gold", *root, "--table", "gold.sales_summary"], spark)
    main(["maintain", *root, "--apply"], spark)
    main(["check", *root], spark)
    assert "different" not in capsys.readouterr().out
    assert read_gold(spark, layout, "sales_summary", GOLD["gold.sales_summary"][0]).count() == 1
    name = "catalog_" + layout.root.rsplit("-", 1)[1]
    for _ in range(2):  # created, then merged into
        main(["gold", *root, "--table", "gold.sales_summary", "--catalog-table", name, "--buckets", "4"], spark)
    assert values(spark.table(name).select("store_id", "product_id", "txn_count")) == [(7, 8, 1)]


def test_incremental_ticks_follow_the_streams(spark, layout, capsys):
    inbox = f"{layout.root}/inbox"
    schema = (
        "op STRING, txn_id INT, store_id INT, product_id INT, customer_id INT, qty INT, total_amount DOUBLE,"
        " status STRING, ts_ms BIGINT, offset BIGINT"
    )
    bus = ["--topic-prefix", "p", "--landing", inbox, "--tables", "sales_transactions", "--once", "--with-feed"]
    for op, qty, at in (("c", 2, 5), ("u", 9, 6)):
        sales = spark.createDataFrame([(op, 1, 7, 8, 1, qty, 1.5, "completed", at, at)], schema)
        write_records(change_records(sales, SALES_TRANSACTIONS, "p.sales_transactions"), path=f"{inbox}/p.sales_transactions")
        main(["stream", "--root", layout.root, *bus], spark)
        main(["tick", "--root", layout.root, "--incremental"], spark)
    assert capsys.readouterr().out.split() == ["gold.customer_loyalty", "gold.sales_summary"] * 2
    found = read_gold(spark, layout, "sales_summary", GOLD["gold.sales_summary"][0])
    assert values(found.select("store_id", "total_qty", "txn_count")) == [(7, 9, 1)]


def test_a_failing_query_ends_the_job(spark, layout):
    """The third of four queries meets a malformed record; the others are stopped."""
    inbox = f"{layout.root}/inbox"
    people = spark.createDataFrame([(1, "ann")], "customer_id INT, name STRING")
    write_records(snapshot_records(people, CUSTOMERS, "p.customers", F.lit(0)), path=f"{inbox}/p.customers")
    bad = records(spark, ["no json"]).withColumn("topic", F.lit("p.products"))
    write_records(bad, path=f"{inbox}/p.products")
    layouts = ["--root", layout.root, "--topic-prefix", "p", "--landing", inbox, "--max-files-per-batch", "1"]
    with pytest.raises(Exception, match="MALFORMED_RECORD|malformed"):
        main(["stream", *layouts, "--tables", "products", "customers"], spark)
    assert not [q for q in spark.streams.active if q.name in ("raw-products", "silver-customers", "raw-customers")]


def test_connectors_that_are_not_installed_say_so(spark):
    with pytest.raises(Exception, match="kafka"):
        kafka_records(spark, "localhost:1", ["t"])
    with pytest.raises(ValueError, match="lower_bound"):
        jdbc_table(spark, "jdbc:x:y", "t", partition_column="id")


def test_records_go_to_one_place(spark):
    with pytest.raises(ValueError):
        write_records(spark.range(1))


def test_native_merge_needs_a_table_format_with_row_level_operations(spark, layout):
    name = "plain_" + layout.root.rsplit("-", 1)[1]
    spark.sql(f"CREATE TABLE {name} (a INT, v STRING) USING parquet LOCATION '{layout.root}/t'")
    source = spark.createDataFrame([(1, "x")], "a INT, v STRING")
    with pytest.raises(Exception, match="UNSUPPORTED_FEATURE.TABLE_OPERATION|MERGE"):
        merge_into_table(source, name, ["a"])
