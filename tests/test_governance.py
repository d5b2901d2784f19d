from __future__ import annotations

import pytest
from conftest import values
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidefold.operators.governance import (
    AccessDenied,
    AuditTrail,
    columns_read,
    decide,
    governed,
    governed_view,
    read_as,
    select_as,
)
from tidefold.plans.gold import GOLD
from tidefold.sinks.gold import publish_gold, serving_view

DDL, _ = GOLD["gold.customer_loyalty"]


@pytest.fixture
def loyalty(spark):
    return spark.createDataFrame([(1, "n", "gold", 2.5, 3, None)], DDL)


def test_denied_columns_are_absent_for_the_role(loyalty):
    view = governed_view(loyalty, "analyst_readonly", "customer_loyalty")
    assert view.columns == ["customer_id", "loyalty_tier", "txn_count", "updated_at"]
    with pytest.raises(AnalysisException):
        view.select("name")
    assert governed_view(loyalty, "engineer", "customer_loyalty").columns == loyalty.columns
    assert governed_view(loyalty, "analyst_readonly", "sales_summary").columns == loyalty.columns


@pytest.mark.parametrize("columns", [["customer_id", "name"], ["*"], ["lifetime_spend"]])
def test_denied_select_fails_and_is_audited(spark, layout, loyalty, columns):
    with pytest.raises(AccessDenied):
        select_as(loyalty, "ann", "analyst_readonly", "customer_loyalty", columns, layout.audit)
    audit = spark.read.parquet(layout.audit)
    denied = {r.column_name for r in audit.filter("decision = 'denied'").collect()}
    assert denied and denied <= {"name", "lifetime_spend"}
    assert audit.filter("who <> 'ann' or requested_at is null").isEmpty()


def test_allowed_select_is_audited_too(spark, layout, loyalty):
    found = select_as(loyalty, "ann", "analyst_readonly", "customer_loyalty", ["customer_id", "txn_count"], layout.audit)
    assert values(found) == [(1, 3)]
    select_as(loyalty, "bob", "engineer", "customer_loyalty", ["name"], layout.audit)
    audit = spark.read.parquet(layout.audit)
    assert values(audit.select("who", "column_name", "decision")) == [
        ("ann", "customer_id", "allowed"),
        ("ann", "txn_count", "allowed"),
        ("bob", "name", "allowed"),
    ]


def test_decisions(spark):
    requests = spark.createDataFrame(
        [("analyst_readonly", "customer_loyalty", "name"), ("analyst_readonly", "sales_summary", "name"), (None, "customer_loyalty", "name")],
        "role STRING, table_name STRING, column_name STRING",
    )
    assert [r.decision for r in decide(requests).collect()] == ["denied", "allowed", "allowed"]


def test_serving_view_follows_the_table(spark, layout, loyalty):
    for _ in range(2):
        publish_gold(spark, layout, "customer_loyalty", loyalty)
    publish_gold(spark, layout, "customer_loyalty", loyalty.limit(0))
    serving_view(spark, layout, "customer_loyalty", DDL)
    assert spark.sql("select count(*) from customer_loyalty").first()[0] == 0


def test_serving_view_of_a_role(spark, layout, loyalty):
    publish_gold(spark, layout, "customer_loyalty", loyalty)
    serving_view(spark, layout, "customer_loyalty", DDL, role="analyst_readonly")
    assert spark.sql("select customer_id, txn_count from customer_loyalty").count() == 1
    with pytest.raises(AnalysisException):
        spark.sql("select name from customer_loyalty")


# Queries over the aggregate and the columns that they read.
QUERIES = {
    "other case": (lambda t: t.select("NAME"), ["name"]),
    "other case, second column": (lambda t: t.select("customer_id", "Lifetime_Spend"), ["customer_id", "lifetime_spend"]),
    "alias": (lambda t: t.select(F.col("name").alias("x")), ["name"]),
    "alias of an alias": (lambda t: t.select(F.col("name").alias("x")).select(F.col("x").alias("y")).filter("y is not null"), ["name"]),
    "expression": (lambda t: t.select(F.upper("name")), ["name"]),
    "column of the frame": (lambda t: t.select(t["name"]), ["name"]),
    "star": (lambda t: t.select("*"), ["customer_id", "lifetime_spend", "loyalty_tier", "name", "txn_count", "updated_at"]),
    "filter": (lambda t: t.filter("lifetime_spend > 2").select("customer_id"), ["customer_id", "lifetime_spend"]),
    "self join": (
        lambda t: t.alias("a").join(t.alias("b"), "customer_id").select("a.customer_id", F.col("b.name").alias("n")),
        ["customer_id", "name"],
    ),
    "join condition": (
        lambda t: t.alias("a").join(t.alias("b"), F.col("a.name") == F.col("b.name")).select("a.txn_count"),
        ["name", "txn_count"],
    ),
    "semi join": (lambda t: t.join(t.select(F.col("name").alias("n")), F.col("name") == F.col("n"), "left_semi").select("txn_count"), ["name", "txn_count"]),
    "group": (lambda t: t.groupBy("name").count().select("count"), ["name"]),
    "sum": (lambda t: t.groupBy("loyalty_tier").agg(F.sum("lifetime_spend")), ["lifetime_spend", "loyalty_tier"]),
    "order": (lambda t: t.orderBy("lifetime_spend").select("customer_id").limit(1), ["customer_id", "lifetime_spend"]),
    "window": (
        lambda t: t.select("customer_id", F.row_number().over(Window.orderBy("name")).alias("r")),
        ["customer_id", "name"],
    ),
    "union": (lambda t: t.select("customer_id", "loyalty_tier").union(t.select("customer_id", "name")), ["customer_id", "loyalty_tier", "name"]),
    "generator": (lambda t: t.select(F.explode(F.array("name"))), ["name"]),
    "python": (lambda t: t.select("customer_id", "name").mapInPandas(lambda p: p, "customer_id int, name string"), ["customer_id", "name"]),
    "subquery": (lambda t: subquery(t), ["customer_id", "name"]),
    "distinct and dropped": (lambda t: t.select("customer_id", "name").distinct().select("customer_id"), ["customer_id", "name"]),
    "carried and dropped": (lambda t: t.select("*").drop("name", "lifetime_spend").select("customer_id"), ["customer_id"]),
    "overwritten": (lambda t: t.withColumn("name", F.lit("x")).select("name", "txn_count"), ["txn_count"]),
    "union without": (lambda t: t.select("customer_id", "name").union(t.select("customer_id", "name")).select("customer_id"), ["customer_id"]),
    "count": (lambda t: t.agg(F.count(F.lit(1))), []),
    "allowed": (lambda t: t.filter("txn_count > 0").groupBy("loyalty_tier").count(), ["loyalty_tier", "txn_count"]),
}


def subquery(t):
    t.createOrReplaceTempView("governed_in_sql")
    return t.sparkSession.sql("select customer_id from governed_in_sql where 'n' in (select name from governed_in_sql)")


@pytest.mark.parametrize("case", QUERIES)
def test_reads_are_found_by_lineage_and_each_refusal_is_audited(spark, layout, loyalty, case):
    query, columns = QUERIES[case]
    found = query(governed(loyalty, "customer_loyalty"))
    assert columns_read(found, "customer_loyalty") == columns
    refused = [c for c in columns if c in ("name", "lifetime_spend")]
    if refused:
        with pytest.raises(AccessDenied, match=", ".join(refused)):
            read_as(found, "ann", "analyst_readonly", "customer_loyalty", layout.audit)
    else:
        assert read_as(found, "ann", "analyst_readonly", "customer_loyalty", layout.audit).count() >= 1
    read_as(found, "bob", "engineer", "customer_loyalty")
    if columns:
        audit = spark.read.parquet(layout.audit).filter("decision = 'denied'")
        assert sorted(r.column_name for r in audit.collect()) == refused


def test_another_table_is_not_governed(loyalty):
    assert columns_read(loyalty.select("name"), "customer_loyalty") == []
    assert columns_read(governed(loyalty, "other").select("name"), "customer_loyalty") == []


def test_a_trail_appends_once(spark, layout, loyalty):
    with pytest.raises(AccessDenied), AuditTrail(spark, layout.audit) as trail:
        select_as(loyalty, "ann", "analyst_readonly", "customer_loyalty", ["customer_id"], trail)
        select_as(loyalty, "ann", "analyst_readonly", "customer_loyalty", [F.upper("name")], trail)
    audit = spark.read.parquet(layout.audit)
    assert len(audit.inputFiles()) == 1
    assert values(audit.select("column_name", "decision")) == [("customer_id", "allowed"), ("name", "denied")]
