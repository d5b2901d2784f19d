"""The engine's inputs, expressed over the benchmark tables.

The line items act as the change stream of sales (an order line repeats, so a
key has several changes), of products and of stores; customers start from a
snapshot and change by events.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.scalars import epoch_ms
from tidefold.operators.capture import change_records, snapshot_changes
from tidefold.operators.state import latest_per_key, live
from tidefold.schemas import CUSTOMERS, PRODUCTS, RECORD_DDL, SALES_TRANSACTIONS, STORES, Entity
from tidefold.session import fresh_dir, shuffles_removed
from tidefold.sources.streams import topic_of
from tidefold.sources.tables import read_table

TOPIC_PREFIX = "retail.dbo"

# Sale keys are computed from two columns and need 64 bits.
SALES = dataclasses.replace(
    SALES_TRANSACTIONS,
    fields=(("txn_id", "BIGINT"), *SALES_TRANSACTIONS.fields[1:]),
)
STANDIN_ENTITIES = {e.name: e for e in (CUSTOMERS, PRODUCTS, SALES, STORES)}


def _operation(flag: str) -> Column:
    return F.when(F.col(flag) == "R", "d").when(F.col(flag) == "A", "u").otherwise("c")


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(12,2)")


def _txn_id(order: Column, line: Column) -> Column:
    return order * 8 + line


def _sale_offset(product: Column, store: Column) -> Column:
    return product.cast("long") * F.lit(1 << 31) + store


def _status(is_completed: Column) -> Column:
    return F.when(is_completed, "completed").otherwise("pending")


def sale_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Line items as changes of sales: keys and order, other fields as they are stored."""
    product, store = F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")
    return read_table(spark, directory, "lineitem").select(
        _operation("l_returnflag").alias("op"),
        _txn_id(F.col("l_orderkey"), F.col("l_linenumber")).alias("txn_id"),
        F.col("l_orderkey").alias("order_id"),
        store.alias("store_id"),
        product.alias("product_id"),
        "l_quantity",
        "l_extendedprice",
        "l_linestatus",
        epoch_ms(F.col("l_shipdate")).alias("ts_ms"),
        _sale_offset(product, store).alias("offset"),
        F.col("l_shipdate").cast("timestamp").alias("shipped_at"),
    )


def typed_sales(lines: DataFrame) -> DataFrame:
    """The fields of a sale in their declared types."""
    return lines.withColumns(
        {
            "qty": F.col("l_quantity").cast("int"),
            "total_amount": _money("l_extendedprice"),
            "status": _status(F.col("l_linestatus") == "F"),
        }
    ).drop("l_quantity", "l_extendedprice", "l_linestatus")


def sale_changes(spark: SparkSession, directory: str) -> DataFrame:
    """Changes of sales without the customer, which the order supplies."""
    return typed_sales(sale_lines(spark, directory))


def with_customer(spark: SparkSession, directory: str, sales: DataFrame) -> DataFrame:
    orders = read_table(spark, directory, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").cast("int").alias("customer_id")
    )
    return sales.join(orders, "order_id", "left")


SALE_COLUMNS = ["txn_id", "store_id", "product_id", "qty", "total_amount", "status"]


def sales(spark: SparkSession, directory: str) -> DataFrame:
    """Current sales without the customer: a fold of the line items."""
    return typed_sales(live(latest_per_key(sale_lines(spark, directory), ["txn_id"], ["ts_ms", "offset"])))


def sales_transactions(spark: SparkSession, directory: str) -> DataFrame:
    """Current sales.  The fold runs before the order is looked up: it is the
    smaller join, and it leaves at most a few rows per order."""
    found = with_customer(spark, directory, sales(spark, directory))
    return found.select("txn_id", "store_id", "product_id", "customer_id", "qty", "total_amount", "status")


def products_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "part").select(
        F.col("p_partkey").cast("int").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        _money("p_retailprice").alias("unit_price"),
        (F.col("p_size") > 0).alias("is_active"),
    )


def stores_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    nation = read_table(spark, directory, "nation")
    region = read_table(spark, directory, "region")
    return (
        read_table(spark, directory, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("s_suppkey").cast("int").alias("store_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("region"),
        )
    )


def customers_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "customer").select(
        F.col("c_custkey").cast("int").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("loyalty_tier"),
        _money("c_acctbal").alias("total_spend"),
    )


def customer_events(spark: SparkSession, directory: str) -> DataFrame:
    """Changes of customers without the name, which does not change."""
    return read_table(spark, directory, "events").select(
        F.when(F.col("event_type") == "error", "d")
        .when(F.col("event_type") == "signup", "c")
        .otherwise("u")
        .alias("op"),
        F.col("user_id").cast("int").alias("customer_id"),
        F.col("event_type").alias("loyalty_tier"),
        _money("value").alias("total_spend"),
        epoch_ms(F.col("ts")).alias("ts_ms"),
        F.col("event_id").alias("offset"),
    )


def customers(spark: SparkSession, directory: str) -> DataFrame:
    """Current customers: the snapshot, then the events.

    Events of a key are folded before they meet the customers, so a key with
    very many events costs one row per task.
    """
    snapshot = customers_snapshot(spark, directory)
    start = snapshot.select(
        F.lit("r").alias("op"),
        "customer_id",
        "loyalty_tier",
        "total_spend",
        F.lit(0).cast("long").alias("ts_ms"),
        F.lit(-1).cast("long").alias("offset"),
    )
    changes = start.unionByName(customer_events(spark, directory))
    state = live(latest_per_key(changes, ["customer_id"], ["ts_ms", "offset"]))
    # A customer that a change created has no name here.
    return state.join(snapshot.select("customer_id", "name"), "customer_id", "left").select(
        "customer_id", "name", "loyalty_tier", "total_spend"
    )


def product_changes(spark: SparkSession, directory: str) -> DataFrame:
    """A price change per line item."""
    return read_table(spark, directory, "lineitem").select(
        F.lit("u").alias("op"),
        F.col("l_partkey").cast("int").alias("product_id"),
        _money("l_extendedprice").alias("unit_price"),
        (F.col("l_returnflag") != "R").alias("is_active"),
        epoch_ms(F.col("l_shipdate")).alias("ts_ms"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_suppkey"),
    )


def store_changes(spark: SparkSession, directory: str) -> DataFrame:
    """A change per line item; those of one line status close the store."""
    return read_table(spark, directory, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "d").otherwise("u").alias("op"),
        F.col("l_suppkey").cast("int").alias("store_id"),
        (F.col("l_returnflag") != "R").alias("is_active"),
        epoch_ms(F.col("l_shipdate")).alias("ts_ms"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
    )


def event_log(spark: SparkSession, directory: str) -> DataFrame:
    """Events as a change log: table, micro-batch (day), key, commit time."""
    table = (
        F.when(F.col("event_type") == "signup", "customers")
        .when(F.col("event_type") == "purchase", "sales_transactions")
        .when(F.col("event_type") == "view", "products")
        .when(F.col("event_type") == "click", "stores")
        .otherwise("errors")
    )
    return read_table(spark, directory, "events").select(
        table.alias("table_name"),
        F.dayofmonth("ts").cast("long").alias("snapshot_id"),
        F.col("user_id").cast("string").alias("affected_keys"),
        F.col("ts").cast("timestamp").alias("committed_at"),
    )


def _topic(entity: Entity) -> str:
    return topic_of(entity.name, TOPIC_PREFIX)


def sale_stream(spark: SparkSession, directory: str) -> DataFrame:
    """The changes of sales with their customers.

    Keys, positions and texts that follow from other fields are made after the join, so that it does not shuffle them.
    """
    line = F.col("txn_id") - _txn_id(F.col("order_id"), F.lit(0))
    fields = {"line": line, "is_completed": F.col("status") == "completed"}
    lines = sale_changes(spark, directory).withColumns(fields).drop("txn_id", "offset", "status", "shipped_at")
    made = {
        "txn_id": _txn_id(F.col("order_id"), F.col("line")),
        "offset": _sale_offset(F.col("product_id"), F.col("store_id")),
        "status": _status(F.col("is_completed")),
    }
    return with_customer(spark, directory, lines).withColumns(made)


def customer_stream(spark: SparkSession, directory: str) -> DataFrame:
    """The customer snapshot followed by the changes."""
    snapshot = customers_snapshot(spark, directory)
    named = customer_events(spark, directory).join(snapshot.select("customer_id", "name"), "customer_id", "left")
    return snapshot_changes(snapshot, F.lit(0)).unionByName(named)


# What only the position of a change is made of.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _line_offset(other: str) -> Column:
    """A position that orders the changes of a key as their columns do."""
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return place * F.lit(1 << 24) + F.col(other)


def product_stream(spark: SparkSession, directory: str) -> DataFrame:
    """The products followed by a price change per line item."""
    listed = products_snapshot(spark, directory)
    fixed = listed.select("product_id", "name", "category", "brand")
    narrow = product_changes(spark, directory).withColumn("offset", _line_offset("l_suppkey")).drop("op", *LINE)
    changes = narrow.join(fixed, "product_id", "left").withColumn("op", F.lit("u"))
    return snapshot_changes(listed, F.lit(0)).unionByName(changes, allowMissingColumns=True)


def store_stream(spark: SparkSession, directory: str) -> DataFrame:
    """The stores followed by a change per line item."""
    listed = stores_snapshot(spark, directory)
    narrow = store_changes(spark, directory).withColumns({"offset": _line_offset("l_partkey"), "closes": F.col("op") == "d"})
    changes = narrow.drop("op", *LINE).join(listed, "store_id", "left")
    changes = changes.withColumn("op", F.when(F.col("closes"), "d").otherwise("u")).drop("closes")
    return snapshot_changes(listed, F.lit(0)).unionByName(changes, allowMissingColumns=True)


STREAMS = {
    "customers": customer_stream,
    "products": product_stream,
    "sales_transactions": sale_stream,
    "stores": store_stream,
}


def table_records(spark: SparkSession, directory: str, table: str, spread: int | None = None) -> DataFrame:
    """The stream of a table as JSON envelopes, dealt evenly to ``spread`` tasks if given.

    The row changes are dealt, and the documents, several times as large, are made of them afterwards.
    """
    changes, entity = STREAMS[table](spark, directory), STANDIN_ENTITIES[table]
    return change_records(changes if spread is None else changes.repartition(spread), entity, _topic(entity))


def sale_records(spark: SparkSession, directory: str) -> DataFrame:
    return table_records(spark, directory, "sales_transactions")


def customer_records(spark: SparkSession, directory: str) -> DataFrame:
    return table_records(spark, directory, "customers")


def product_records(spark: SparkSession, directory: str) -> DataFrame:
    return table_records(spark, directory, "products")


def store_records(spark: SparkSession, directory: str) -> DataFrame:
    return table_records(spark, directory, "stores")


RECORDS = {
    "customers": customer_records,
    "products": product_records,
    "sales_transactions": sale_records,
    "stores": store_records,
}


BATCHES = 3


# Of a landed file, which is compressed and so read by one task.
RECORDS_PER_FILE = 50_000


def land(records: DataFrame, path: str) -> None:
    """Append records to a folder as JSON lines. The documents repeat the names of all fields, so they are compressed."""
    options = {"compression": "gzip", "zlib.compress.level": "BEST_COMPRESSION", "maxRecordsPerFile": RECORDS_PER_FILE}
    writer = records.write.mode("append").options(**options)
    with shuffles_removed(records.sparkSession):
        writer.json(path)


def land_table(spark: SparkSession, directory: str, table: str, batches: int = BATCHES) -> tuple[str, int]:
    """Land a table in a new folder, for a stream of about ``batches`` micro-batches.

    Returns the folder and the files of a micro-batch.  The records are written by
    the tasks that make them, without a shuffle and near others of their key, with
    which they compress well; long files are split.
    """
    path = fresh_dir(spark, table)
    land(table_records(spark, directory, table), path)
    files = len(spark.read.schema(RECORD_DDL).json(path).inputFiles())
    return path, max(1, -(-files // batches))
