"""Builders of the aggregate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.schemas import CUSTOMER_LOYALTY_DDL, SALES_SUMMARY_DDL


def completed(transactions: DataFrame) -> DataFrame:
    """Sales that count; rows without a status drop out."""
    return transactions.filter(F.col("status") == "completed")


def sales_summary(transactions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Quantity, amount and number of completed sales per store and product.

    Sums are combined map-side, so a store that holds most of the sales sends
    one row per product and task.  Money is summed as decimal and becomes a
    double last, which makes the result independent of the order of the rows.
    """
    return (
        completed(transactions)
        .groupBy("store_id", "product_id")
        .agg(
            F.sum("qty").cast("long").alias("total_qty"),
            F.sum("total_amount").cast("double").alias("total_amount"),
            F.count(F.lit(1)).alias("txn_count"),
        )
        .withColumn("updated_at", F.current_timestamp() if as_of is None else as_of)
    )


def transaction_counts(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers (unique by key) with ``txn_count``, 0 where a customer has no sales.

    The left join of the sales is written as an aggregate below the join: a
    customer with a large share of all sales is reduced to one row per task
    before the shuffle instead of meeting the join in one partition.  Sales
    without a customer match nobody and are filtered at the scan.
    """
    counts = (
        transactions.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count("txn_id").alias("txn_count"))
    )
    return customers.join(counts, "customer_id", "left").withColumn(
        "txn_count", F.coalesce(F.col("txn_count"), F.lit(0).cast("long"))
    )


def customer_loyalty(customers: DataFrame, transactions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Spend and number of sales per customer; sales of every status count."""
    profile = customers.select(
        "customer_id", "name", "loyalty_tier", F.col("total_spend").cast("double").alias("lifetime_spend")
    )
    return transaction_counts(transactions, profile).select(
        "customer_id",
        "name",
        "loyalty_tier",
        "lifetime_spend",
        "txn_count",
        (F.current_timestamp() if as_of is None else as_of).alias("updated_at"),
    )


# Aggregate table -> (columns, key).
GOLD = {
    "gold.sales_summary": (SALES_SUMMARY_DDL, ("store_id", "product_id")),
    "gold.customer_loyalty": (CUSTOMER_LOYALTY_DDL, ("customer_id",)),
}
