"""Aggregates that follow the signed images of their inputs, batch by batch, instead of being computed anew.

Each aggregate has a state table beside it, keyed by its group. A tick adds the images of the batches since the last
one to the state of the groups that they touch, in the buckets of those groups, and copies these buckets to the
aggregate. A bucket of the state records the batches that it has taken in, in the same files, so a tick that is
repeated after a failure adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidefold.operators.deltas import signed, signed_count
from tidefold.plans.gold import GOLD
from tidefold.schemas import ENTITIES, Entity
from tidefold.sinks.buckets import read_bucketed, upsert
from tidefold.sinks.gold import replace_buckets
from tidefold.sinks.layout import Layout
from tidefold.sinks.silver import read_feed

EXACT = "DECIMAL(38,2)"


class Aggregate(NamedTuple):
    """The keys and the columns of the state, how the images of each input change it, how states of a group are united,
    which groups the aggregate has, which the state keeps, and the columns of the aggregate besides those of the state."""

    keys: tuple[str, ...]
    ddl: str
    change: Mapping[str, Callable[[DataFrame], DataFrame]]
    unite: Mapping[str, Column]
    exists: str
    stays: str
    columns: Mapping[str, Column]


def _sales_change(images: DataFrame) -> DataFrame:
    """NULL amounts count in no sum: beside each sum stands the number of values in it."""
    return images.filter("status = 'completed'").select(
        "snapshot_id", "store_id", "product_id", signed_count().alias("n_rows"),
        signed(F.col("qty")).alias("qty"), signed_count(F.col("qty").isNotNull()).alias("n_qty"),
        signed(F.col("total_amount")).alias("amount"), signed_count(F.col("total_amount").isNotNull()).alias("n_amount"),
    )


def _sale_counts(images: DataFrame) -> DataFrame:
    """Counted before the shuffle: a customer with very many sales sends a row for each task and batch."""
    counted = images.filter("customer_id is not null").groupBy("snapshot_id", "customer_id")
    return counted.agg(F.sum(signed_count()).alias("txn_count"))


def _profiles(images: DataFrame) -> DataFrame:
    """The newest new image brings the profile; old and new images count whether the customer exists."""
    profile = F.struct(F.col("snapshot_id").alias("at"), "name", "loyalty_tier", F.col("total_spend").alias("spend"))
    return images.select(
        "snapshot_id", "customer_id", signed_count().alias("n_rows"), F.when(F.col("sign") > 0, profile).alias("profile")
    )


def _sales_summary() -> Aggregate:
    return Aggregate(
        keys=("store_id", "product_id"),
        ddl=f"store_id INT, product_id INT, n_rows BIGINT, qty {EXACT}, n_qty BIGINT, amount {EXACT}, n_amount BIGINT,"
        " updated_at TIMESTAMP",
        change={"sales_transactions": _sales_change},
        unite={c: F.sum(c) for c in ("n_rows", "qty", "n_qty", "amount", "n_amount")},
        exists="n_rows <> 0",
        stays="n_rows <> 0",
        columns={
            "total_qty": F.when(F.col("n_qty") > 0, F.col("qty")).cast("long"),
            "total_amount": F.when(F.col("n_amount") > 0, F.col("amount")).cast("double"),
            "txn_count": F.col("n_rows"),
        },
    )


def _customer_loyalty() -> Aggregate:
    return Aggregate(
        keys=("customer_id",),
        ddl="customer_id INT, n_rows BIGINT, txn_count BIGINT,"
        " profile STRUCT<at: BIGINT, name: STRING, loyalty_tier: STRING, spend: DECIMAL(12,2)>, updated_at TIMESTAMP",
        change={"customers": _profiles, "sales_transactions": _sale_counts},
        unite={
            "n_rows": F.coalesce(F.sum("n_rows"), F.lit(0).cast("long")),
            "txn_count": F.coalesce(F.sum("txn_count"), F.lit(0).cast("long")),
            "profile": F.max_by("profile", "profile.at"),
        },
        exists="n_rows <> 0",
        stays="n_rows <> 0 or txn_count <> 0",  # sales may come before their customer
        columns={
            "name": F.col("profile.name"),
            "loyalty_tier": F.col("profile.loyalty_tier"),
            "lifetime_spend": F.col("profile.spend").cast("double"),
        },
    )


AGGREGATES = {"gold.sales_summary": _sales_summary, "gold.customer_loyalty": _customer_loyalty}


def _changes(
    spark: SparkSession, layout: Layout, aggregate: Aggregate, after: Mapping[str, int], until: Mapping[str, int],
    as_of: Column, entities: Mapping[str, Entity],
) -> DataFrame | None:
    """Changes of groups with their input (``source``) and batch; None if no input of the aggregate has moved."""
    found = None
    for table, change in aggregate.change.items():
        if table in until:
            images = read_feed(spark, layout, entities[table], after.get(table, -1), until[table])
            moved = change(images).withColumn("source", F.lit(table))
            found = moved if found is None else found.unionByName(moved, allowMissingColumns=True)
    return None if found is None else found.withColumn("updated_at", as_of)


def advance(
    spark: SparkSession,
    layout: Layout,
    gold_table: str,
    after: Mapping[str, int],
    until: Mapping[str, int],
    as_of: Column | None = None,
    entities: Mapping[str, Entity] = ENTITIES,
) -> list[int]:
    """Add the batches beyond ``after``, up to ``until`` (by input table), to an aggregate; returns the buckets rewritten.

    The inputs must have kept their images from their first batch on. A group whose amounts come to zero is removed, so
    the aggregate equals a recomputation. Rows that no image touches keep their ``updated_at``.
    """
    aggregate = AGGREGATES[gold_table]()
    name, keys = gold_table.split(".")[1], aggregate.keys
    moved = _changes(spark, layout, aggregate, after, until, F.current_timestamp() if as_of is None else as_of, entities)
    if moved is None:
        return []
    columns = StructType.fromDDL(aggregate.ddl).names
    fold = [c.alias(n) for n, c in aggregate.unite.items()] + [F.max("updated_at").alias("updated_at")]
    taken = F.create_map(*[x for t, b in until.items() for x in (F.lit(t), F.lit(b).cast("long"))])

    def combine(stored: DataFrame, changed: DataFrame, touched: Sequence[int]) -> DataFrame:
        # One row for each bucket says which batches it holds.
        known = F.broadcast(stored.filter("taken is not null").select("bucket", "taken"))
        fresh = changed.join(known, "bucket", "left")
        fresh = fresh.filter(F.col("snapshot_id") > F.coalesce(F.try_element_at("taken", "source"), F.lit(-1).cast("long")))
        rows = stored.filter("taken is null").select("bucket", *columns)
        united = rows.unionByName(fresh.select("bucket", *[c for c in columns if c in fresh.columns]), allowMissingColumns=True)
        united = united.groupBy("bucket", *keys).agg(*fold).filter(aggregate.stays)
        held = spark.createDataFrame([(b,) for b in touched], "bucket INT").join(known, "bucket", "left")
        others = F.map_filter(F.coalesce("taken", F.create_map().cast("map<string,bigint>")), lambda t, b: ~t.isin(*until))
        marks = held.select("bucket", F.map_concat(others, taken).alias("taken"))
        return united.unionByName(marks, allowMissingColumns=True).repartition("bucket")

    ddl = f"{aggregate.ddl}, taken MAP<STRING, BIGINT>"
    touched = upsert(spark, layout, f"state.{name}", ddl, keys, moved, combine)
    if touched:
        state = read_bucketed(spark, layout, f"state.{name}", ddl).filter(F.col("bucket").isin(touched))
        rows = state.filter("taken is null").filter(aggregate.exists).withColumns(dict(aggregate.columns))
        kept = StructType.fromDDL(GOLD[gold_table][0]).names
        replace_buckets(spark, layout, name, rows.select(*kept), touched)
    return touched
