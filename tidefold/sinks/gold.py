"""Aggregate tables, keyed and in buckets as the current-state tables are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators.governance import governed_view
from tidefold.operators.merge import merge
from tidefold.plans.gold import GOLD
from tidefold.sinks.buckets import BUCKETS, bucket_of, read_bucketed, upsert
from tidefold.sinks.layout import Layout

EVERY = range(BUCKETS)


def filled(rows: DataFrame, touched: Sequence[int]) -> DataFrame:
    """Rows with ``bucket``, marked ``present``, and one row beside them that keeps an emptied bucket from staying."""
    fillers = rows.sparkSession.createDataFrame([(b, False) for b in touched], "bucket INT, present BOOLEAN")
    return rows.withColumn("present", F.lit(True)).unionByName(fillers, allowMissingColumns=True).repartition("bucket")


def read_gold(spark: SparkSession, layout: Layout, table: str, ddl: str) -> DataFrame:
    """The aggregate as it was last published; empty before."""
    columns = [c.split()[0] for c in ddl.split(", ")]
    return read_bucketed(spark, layout, f"gold.{table}", f"{ddl}, present BOOLEAN").filter("present").select(*columns)


def replace_buckets(spark: SparkSession, layout: Layout, table: str, rows: DataFrame, touched: Sequence[int] = EVERY) -> None:
    """The rows become all that the touched buckets hold. They are computed once."""
    ddl, keys = GOLD[f"gold.{table}"]
    put = lambda stored, changed, touched: filled(changed, touched)
    upsert(spark, layout, f"gold.{table}", f"{ddl}, present BOOLEAN", keys, rows, put, touched=touched)


def publish_gold(spark: SparkSession, layout: Layout, table: str, rows: DataFrame) -> None:
    """The rows become the whole table."""
    replace_buckets(spark, layout, table, rows)


def merge_gold(
    spark: SparkSession, layout: Layout, table: str, source: DataFrame, null_safe: bool = False, delete_unmatched: bool = False
) -> None:
    """Merge a recomputation, which spreads over all buckets, into the table; it is computed once."""
    ddl, keys = GOLD[f"gold.{table}"]
    columns = [c.split()[0] for c in ddl.split(", ")]

    def combine(stored: DataFrame, changed: DataFrame, touched: Sequence[int]) -> DataFrame:
        merged = merge(stored.filter("present").select(*columns), changed.select(*columns), keys, null_safe, delete_unmatched)
        return filled(merged.withColumn("bucket", bucket_of(keys, BUCKETS)), touched)

    upsert(spark, layout, f"gold.{table}", f"{ddl}, present BOOLEAN", keys, source, combine, touched=EVERY)


def serving_view(
    spark: SparkSession, layout: Layout, table: str, ddl: str, role: str | None = None, view: str | None = None
) -> DataFrame:
    """Register the table under its name, or another, for SQL readers.

    With a role, the columns that the role may not read are not part of the view.
    """
    df = read_gold(spark, layout, table, ddl)
    if role is not None:
        df = governed_view(df, role, table)
    df.createOrReplaceTempView(view or table)
    return df
