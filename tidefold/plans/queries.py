"""Every operator as a query over the benchmark tables: ``name -> f(spark, directory)``."""

from __future__ import annotations

import contextlib
import datetime
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.scalars import epoch_ms, job_name
from tidefold.operators import capture, changelog, digest, governance, impact, merge, reconcile, retention
from tidefold.operators.envelope import changelog as to_changelog
from tidefold.operators.envelope import decode, decode_changelog, readable
from tidefold.operators.state import latest_per_key, live
from tidefold.plans import gold, refresh, standins
from tidefold.plans.incremental import AGGREGATES, advance
from tidefold.plans.maintenance import create_tables, run_steps
from tidefold.schemas import CUSTOMER_LOYALTY_DDL, CUSTOMERS, ORDER, RECORD_DDL, SALES_SUMMARY_DDL
from tidefold.session import fresh_dir
from tidefold.sinks.gold import publish_gold, read_gold, serving_view
from tidefold.sinks.layout import COMPRESSION, Layout, delete_path
from tidefold.sinks.silver import commit_batch, read_change_log, read_silver, store_log
from tidefold.sources.streams import file_records
from tidefold.sources.tables import read_table
from tidefold.streaming.keyed import read_keyed_live, start_keyed
from tidefold.streaming.raw import image_fields, read_raw, replayable, start_raw, start_raw_variant
from tidefold.streaming.silver import start_silver

SALES = standins.SALES
AVAILABLE_NOW = {"availableNow": True}
FIRST_RUN = "2024-01-01 00:00:00"
SECOND_RUN = "2024-02-01 00:00:00"
MARK = datetime.datetime(2024, 1, 20)


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# --- sources ---------------------------------------------------------------


@contextlib.contextmanager
def _stream(
    spark: SparkSession, d: str, table: str, batches: int = standins.BATCHES, read_once: bool = True
) -> Iterator[DataFrame]:
    """A landed table as a stream of so many micro-batches, whatever its size; its files go when they have been read."""
    path, files = standins.land_table(spark, d, table, batches)
    try:
        yield file_records(spark, path, max_files_per_trigger=files, read_once=read_once)
    finally:
        delete_path(spark, path)


# All fields that the records carry, whatever their table.
IMAGE_FIELDS = {
    "txn_id": "BIGINT", "store_id": "INT", "product_id": "INT", "customer_id": "INT", "qty": "INT",
    "unit_price": "DECIMAL(12,2)", "total_amount": "DECIMAL(12,2)", "status": "STRING", "name": "STRING",
    "loyalty_tier": "STRING", "total_spend": "DECIMAL(12,2)", "category": "STRING", "brand": "STRING",
    "is_active": "BOOLEAN", "city": "STRING", "region": "STRING",
}


def cdc_scan(spark: SparkSession, d: str, batches: int = standins.BATCHES) -> DataFrame:
    """All records of the four topics, read as a stream and stored as they come."""
    out = fresh_dir(spark, "cdc-scan")
    for table in standins.RECORDS:
        with _stream(spark, d, table, batches) as records:
            query = (
                records.writeStream.format("parquet")
                .option("path", f"{out}/{table}")
                .option("compression", COMPRESSION)
                .option("checkpointLocation", f"{out}/checkpoint-{table}")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
    parts = [spark.read.schema(RECORD_DDL).parquet(f"{out}/{table}") for table in standins.RECORDS]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    image = ", ".join(f"{name}: {kind}" for name, kind in IMAGE_FIELDS.items())
    sent = F.from_json(
        "value", f"op STRING, before STRUCT<{image}>, after STRUCT<{image}>, source STRUCT<ts_ms: BIGINT>, ts_ms BIGINT"
    )

    def told(side: str) -> Column:
        """The fields of an image as text, in order."""
        row = F.col(f"_sent.{side}")
        fields = F.concat_ws("|", *[F.coalesce(row[c].cast("string"), F.lit("~")) for c in IMAGE_FIELDS])
        return F.when(row.isNotNull(), fields).alias(f"{side}_row")

    return both.withColumn("_sent", sent).select(
        "topic",
        F.col("key").cast("long").alias("key"),
        "partition",
        "offset",
        "timestamp",
        F.col("_sent.op").alias("op"),
        told("before"),
        told("after"),
        F.col("_sent.source.ts_ms").alias("source_ts_ms"),
        F.col("_sent.ts_ms").alias("ts_ms"),
    )


def cdc_include(spark: SparkSession, d: str) -> DataFrame:
    return capture.include_tables(
        read_table(spark, d, "events"), ["click", "purchase", "signup", "view"], "event_type"
    ).select("event_type", "event_id", "user_id")


def snapshot_envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = standins.customers_snapshot(spark, d)
    return capture.snapshot_envelope(rows, F.lit(0), F.lit(-1)).select(
        "op",
        F.col("before").isNull().alias("before_is_null"),
        "after.*",
        F.col("source.ts_ms").alias("source_ts_ms"),
        "offset",
    )


def _order_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after a run that opened some, shipped some and archived others."""
    orders = read_table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority", "o_totalprice"
    )
    old = orders.filter("status <> 'O'").drop("o_orderpriority")
    new = (
        orders.filter("status <> 'P'")
        .withColumn("status", F.when(F.col("o_orderpriority") == "1-URGENT", "S").otherwise(F.col("status")))
        .drop("o_orderpriority")
    )
    return old, new


def _diff_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "op",
        "o_orderkey",
        F.col("before.status").alias("old_status"),
        F.col("after.status").alias("new_status"),
        F.col("before.o_totalprice").alias("old_price"),
        F.col("after.o_totalprice").alias("new_price"),
    )


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff_columns(capture.snapshot_diff(*_order_versions(spark, d), ["o_orderkey"]))


def snapshot_diff_digest(spark: SparkSession, d: str) -> DataFrame:
    """The same difference, joined only where the digests of both versions differ."""
    old, new = digest.differing(*_order_versions(spark, d), ["o_orderkey"])
    return _diff_columns(capture.snapshot_diff(old, new, ["o_orderkey"]))


# --- decoding --------------------------------------------------------------


def _order_records(spark: SparkSession, d: str, damaged: bool) -> DataFrame:
    """Orders as sale envelopes: updates of one status move the row to another key."""
    orders = read_table(spark, d, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "d").when(F.col("o_orderstatus") == "P", "u").otherwise("c")

    def row(key: Column) -> Column:
        known = {
            "txn_id": key,
            "customer_id": F.col("o_custkey"),
            "qty": F.lit(1),
            "total_amount": F.col("o_totalprice"),
            "status": F.col("o_orderstatus"),
        }
        return capture.wire_row(SALES, known)

    moved = F.when(F.col("o_orderpriority") == "2-HIGH", -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    records = orders.select(
        "o_orderpriority",
        *capture.envelope(
            op,
            F.when(op != "c", row(F.col("o_orderkey"))),
            F.when(op != "d", row(moved)),
            epoch_ms(F.col("o_orderdate")),
            F.col("o_orderkey"),
            f"{standins.TOPIC_PREFIX}.sales_transactions",
            F.col("o_orderkey"),
        ),
    )
    if damaged:
        broken = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("not json "), "value"))
        wrong = F.when(F.col("o_orderpriority") == "1-URGENT", F.replace("value", F.lit('"qty":1'), F.lit('"qty":"many"')))
        records = records.withColumn("value", F.coalesce(broken, wrong, "value"))
    return records.drop("o_orderpriority")


def decode_lenient(spark: SparkSession, d: str) -> DataFrame:
    row = F.coalesce("after", "before")
    return readable(decode(_order_records(spark, d, damaged=True), SALES)).select(
        "op",
        row["txn_id"].alias("txn_id"),
        row["qty"].alias("qty"),
        row["total_amount"].alias("total_amount"),
        row["status"].alias("status"),
        F.col("source.ts_ms").alias("source_ts_ms"),
    )


def decode_strict(spark: SparkSession, d: str) -> DataFrame:
    return decode_changelog(_order_records(spark, d, damaged=False), SALES).select(
        "op", "txn_id", "customer_id", "total_amount", "ts_ms", "offset"
    )


def completed_sales(spark: SparkSession, d: str) -> DataFrame:
    return gold.completed(standins.sales_transactions(spark, d))


# --- RAW and SILVER --------------------------------------------------------


def _run_raw(
    spark: SparkSession, d: str, table: str, layout: Layout, with_position: bool = True, batches: int = standins.BATCHES
) -> None:
    entity = standins.STANDIN_ENTITIES[table]
    with _stream(spark, d, table, batches) as records:
        start_raw(records, entity, layout, AVAILABLE_NOW, with_position).awaitTermination()


def _run_silver(spark: SparkSession, d: str, table: str, layout: Layout, batches: int = standins.BATCHES) -> None:
    entity = standins.STANDIN_ENTITIES[table]
    with _stream(spark, d, table, batches) as records:
        start_silver(records, entity, layout, AVAILABLE_NOW).awaitTermination()


def raw_variant(spark: SparkSession, d: str, batches: int = standins.BATCHES) -> DataFrame:
    """RAW with VARIANT images: the same fields, read without a schema."""
    layout = Layout(fresh_dir(spark, "raw-variant"))
    with _stream(spark, d, "sales_transactions", batches) as records:
        start_raw_variant(records, SALES, layout, AVAILABLE_NOW).awaitTermination()
    return spark.read.parquet(layout.raw("sales_transactions_variant")).select(
        "op",
        *image_fields("before", SALES, "txn_id"),
        *image_fields("after", SALES, "txn_id", "customer_id", "total_amount"),
        "source_ts_ms",
    )


def raw_ingest(spark: SparkSession, d: str, batches: int = standins.BATCHES) -> DataFrame:
    layout = Layout(fresh_dir(spark, "raw-ingest"))
    _run_raw(spark, d, "sales_transactions", layout, False, batches)

    def field(side: str, name: str, dtype: str) -> Column:
        return F.get_json_object(f"{side}_json", f"$.{name}").cast(dtype).alias(f"{side}_{name}")

    return read_raw(spark, layout, "sales_transactions").select(
        "op",
        field("before", "txn_id", "long"),
        field("after", "txn_id", "long"),
        field("after", "customer_id", "int"),
        field("after", "total_amount", "decimal(12,2)"),
        "source_ts_ms",
    )


def silver_customers(spark: SparkSession, d: str) -> DataFrame:
    return standins.customers(spark, d)


def silver_sales_transactions(spark: SparkSession, d: str) -> DataFrame:
    return standins.sales_transactions(spark, d)


def silver_products(spark: SparkSession, d: str) -> DataFrame:
    """Products after a price change per line item."""
    changes = standins.product_changes(spark, d)
    last = latest_per_key(changes, ["product_id"], ["ts_ms", "l_orderkey", "l_linenumber", "l_suppkey"])
    listed = standins.products_snapshot(spark, d).withColumnsRenamed({"unit_price": "_price", "is_active": "_active"})
    latest = last.select("product_id", "op", "unit_price", "is_active")
    return _open(listed.join(latest, "product_id", "full_outer")).select(
        "product_id",
        "name",
        "category",
        "brand",
        F.coalesce("unit_price", "_price").alias("unit_price"),
        F.coalesce("is_active", "_active").alias("is_active"),
    )


def _open(rows: DataFrame) -> DataFrame:
    """Rows without a change, and those whose last change is no delete."""
    return rows.filter(F.coalesce(F.col("op") != "d", F.lit(True)))


def silver_stores(spark: SparkSession, d: str) -> DataFrame:
    """Stores that are still open, each with the state of its last change if there was one."""
    changes = standins.store_changes(spark, d)
    last = latest_per_key(changes, ["store_id"], ["ts_ms", "l_orderkey", "l_linenumber", "l_partkey"])
    state = last.select("store_id", "op", "is_active")
    return _open(standins.stores_snapshot(spark, d).join(state, "store_id", "full_outer")).select(
        "store_id", "name", "city", "region", "is_active"
    )


def silver_deletes(spark: SparkSession, d: str) -> DataFrame:
    last = latest_per_key(standins.sale_lines(spark, d), ["txn_id"], ORDER)
    return last.filter("op = 'd'").select("txn_id", "ts_ms")


def silver_stream_sales(spark: SparkSession, d: str, batches: int = standins.BATCHES) -> DataFrame:
    """The sales stream folded in micro-batches."""
    layout = Layout(fresh_dir(spark, "silver-sales"))
    _run_silver(spark, d, "sales_transactions", layout, batches)
    return read_silver(spark, layout, SALES).select(*standins.SALE_COLUMNS, "customer_id")


def silver_keyed_state(spark: SparkSession, d: str, batches: int = standins.BATCHES) -> DataFrame:
    """The sales stream, its state kept in a state store and read back."""
    layout = Layout(fresh_dir(spark, "keyed-sales"))
    with _stream(spark, d, "sales_transactions", batches) as records:
        start_keyed(records, SALES, layout, AVAILABLE_NOW).awaitTermination()
    return read_keyed_live(spark, layout, SALES).select(*standins.SALE_COLUMNS, "customer_id")


def silver_stream_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Customers: the snapshot comes first, the events are folded into its buckets."""
    layout = Layout(fresh_dir(spark, "silver-customers"))
    inbox = fresh_dir(spark, "customers-inbox")
    records = standins.customer_records(spark, d).withColumn("is_snapshot", F.col("offset") < 0)
    for snapshot in (True, False):
        records.filter(F.col("is_snapshot") == snapshot).drop("is_snapshot").write.mode("append").json(inbox)
        start_silver(file_records(spark, inbox), CUSTOMERS, layout, AVAILABLE_NOW).awaitTermination()
    return read_silver(spark, layout, CUSTOMERS).select("customer_id", "name", "loyalty_tier", "total_spend")


def silver_late_changes(spark: SparkSession, d: str) -> DataFrame:
    """Sales whose newer changes, deletes among them, are stored before the older ones arrive."""
    layout = Layout(fresh_dir(spark, "silver-late"))
    inbox = fresh_dir(spark, "late-inbox")
    records = standins.sale_records(spark, d)
    # A batch takes all files at once, so they need not be dealt anew.
    records = records.withColumn("is_new", F.col("timestamp") >= F.lit("1995-06-17").cast("timestamp"))
    for newer in (True, False):
        standins.land(records.filter(F.col("is_new") == newer).drop("is_new"), inbox)
        start_silver(file_records(spark, inbox), SALES, layout, AVAILABLE_NOW).awaitTermination()
    return read_silver(spark, layout, SALES).select(*standins.SALE_COLUMNS, "customer_id")


def independent_streams(spark: SparkSession, d: str, batches: int = standins.BATCHES) -> DataFrame:
    """RAW and SILVER of all four tables, each with its own position; rows per table."""
    layout = Layout(fresh_dir(spark, "streams"))
    for table, entity in standins.STANDIN_ENTITIES.items():
        # Both read the folder, so neither may clear it.
        with _stream(spark, d, table, batches, read_once=False) as records:
            running = [start(records, entity, layout, AVAILABLE_NOW) for start in (start_raw, start_silver)]
            for query in running:
                query.awaitTermination()
    counts = None
    for table, entity in standins.STANDIN_ENTITIES.items():
        for layer, rows in (
            ("raw", read_raw(spark, layout, table)),
            ("silver", read_silver(spark, layout, entity)),
            ("change_log", read_change_log(spark, layout).filter(F.col("table_name") == table)),
        ):
            part = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(layer).alias("layer"), F.lit(table).alias("table_name"), "n_rows"
            )
            counts = part if counts is None else counts.unionByName(part)
    return counts


# --- change log ------------------------------------------------------------


def _sale_log(spark: SparkSession, d: str, changes: DataFrame | None = None) -> DataFrame:
    changes = standins.sale_lines(spark, d) if changes is None else changes
    month = F.year("shipped_at") * 100 + F.month("shipped_at")
    return changelog.change_log(changes, "sales_transactions", ["txn_id"], F.col("shipped_at"), month)


def change_log(spark: SparkSession, d: str) -> DataFrame:
    return _sale_log(spark, d)


def change_log_rollup(spark: SparkSession, d: str) -> DataFrame:
    return changelog.change_log_rollup(_sale_log(spark, d))


def change_log_rollup_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two columns, as text; those of a quarter lie in one batch."""
    lines = standins.sale_lines(spark, d).withColumn("line", F.col("txn_id") % 8)
    quarter = F.year("shipped_at") * 10 + F.quarter("shipped_at")
    return changelog.ranked_rollup(
        changelog.change_log(lines, "sales_transactions", ["order_id", "line"], F.col("shipped_at"), quarter)
    )


def change_log_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What happened to the ten largest sales since 1994, from the stored log."""
    layout = Layout(fresh_dir(spark, "log-lookup"))
    store_log(layout, _sale_log(spark, d))
    largest = standins.sale_changes(spark, d).orderBy(F.desc("total_amount"), "txn_id").limit(10)  # the feature: a top ten
    keys = sorted({str(r.txn_id) for r in largest.collect()})
    return changelog.lookup(read_change_log(spark, layout), "sales_transactions", keys, datetime.datetime(1994, 1, 1))


# --- GOLD ------------------------------------------------------------------


def sales_summary(spark: SparkSession, d: str) -> DataFrame:
    return gold.sales_summary(standins.sales(spark, d), _at(SECOND_RUN))


def customer_loyalty(spark: SparkSession, d: str) -> DataFrame:
    return gold.customer_loyalty(standins.customers(spark, d), standins.sales_transactions(spark, d), _at(SECOND_RUN))


def left_join_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pending urgent orders per customer; many customers have none."""
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    orders = read_table(spark, d, "orders").select(
        F.when(urgent, F.col("o_orderkey")).alias("txn_id"), F.col("o_custkey").cast("int").alias("customer_id")
    )
    return gold.transaction_counts(orders, standins.customers_snapshot(spark, d)).select(
        "customer_id", "name", "txn_count"
    )


def sum_types(spark: SparkSession, d: str) -> DataFrame:
    return standins.sale_changes(spark, d).groupBy("op", "status").agg(
        F.sum("qty").alias("sum_int"),
        F.sum("total_amount").alias("sum_decimal"),
        F.sum("total_amount").cast("double").alias("sum_double"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def _split_by_time(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sales as an early run saw them, and as they are now."""
    lines = standins.sale_lines(spark, d)
    early = lines.filter(F.col("shipped_at") < F.lit("1998-01-01").cast("timestamp"))
    return (
        standins.typed_sales(live(latest_per_key(early, ["txn_id"], ORDER))),
        standins.sales(spark, d),
    )


def _merge_into_stored(
    spark: SparkSession, table: str, before: DataFrame, after: DataFrame
) -> DataFrame:
    """Publish a first version of an aggregate, then merge a later result into it."""
    ddl, keys = gold.GOLD[f"gold.{table}"]
    layout = Layout(fresh_dir(spark, f"merge-{table}"))
    publish_gold(spark, layout, table, before)
    return merge.merge(read_gold(spark, layout, table, ddl), after, keys)


def merge_sales_summary(spark: SparkSession, d: str) -> DataFrame:
    early, now = _split_by_time(spark, d)
    return _merge_into_stored(
        spark, "sales_summary", gold.sales_summary(early, _at(FIRST_RUN)), gold.sales_summary(now, _at(SECOND_RUN))
    )


def merge_customer_loyalty(spark: SparkSession, d: str) -> DataFrame:
    customers = standins.customers_snapshot(spark, d)
    found = standins.sales_transactions(spark, d)
    before = gold.customer_loyalty(
        customers.filter("loyalty_tier <> 'BUILDING'"), found.filter("status = 'completed'"), _at(FIRST_RUN)
    )
    after = gold.customer_loyalty(customers.filter("loyalty_tier <> 'MACHINERY'"), found, _at(SECOND_RUN))
    return _merge_into_stored(spark, "customer_loyalty", before, after)


def merge_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The sales summary as a bucketed catalog table: created by an early run, merged into by a later one."""
    early, now = _split_by_time(spark, d)
    table = f"sales_summary_{uuid.uuid4().hex}"
    for sales, at in ((early, FIRST_RUN), (now, SECOND_RUN)):
        merge.merge_bucketed(gold.sales_summary(sales, _at(at)), table, ["store_id", "product_id"], 8)
    return spark.table(table)


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Edges between users and event types: those of small events exist already."""
    events = read_table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    small = events.filter("value < 5").groupBy("user_id", "event_type").agg(F.max("event_id").alias("edge_id"))
    candidates = events.select("user_id", "event_type", F.col("event_id").alias("edge_id"))
    return merge.insert_if_absent(small, candidates, ["user_id", "event_type"], ["edge_id"])


def gold_scan(spark: SparkSession, d: str) -> DataFrame:
    """The published aggregate, read through SQL."""
    layout = Layout(fresh_dir(spark, "gold-scan"))
    publish_gold(spark, layout, "sales_summary", sales_summary(spark, d))
    view = f"sales_summary_{uuid.uuid4().hex}"
    serving_view(spark, layout, "sales_summary", SALES_SUMMARY_DDL, view=view)
    return spark.sql(f"SELECT store_id, product_id, total_qty, total_amount, txn_count, updated_at FROM {view}")


def create_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Catalog tables created twice, filled once."""
    location = fresh_dir(spark, "catalog")
    database = "created_if_absent"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    tables = {"sales_summary": SALES_SUMMARY_DDL, "customer_loyalty": CUSTOMER_LOYALTY_DDL}
    create_tables(spark, database, location, tables)
    sales_summary(spark, d).write.insertInto(f"{database}.sales_summary")
    create_tables(spark, database, location, tables)
    return spark.table(f"{database}.sales_summary")


# --- impact ----------------------------------------------------------------


def job_names(spark: SparkSession, d: str) -> DataFrame:
    table = F.concat(F.lit("gold."), F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))), F.lit("_"), F.lower("p_type"))
    return read_table(spark, d, "part").select(
        "p_partkey", table.alias("gold_table"), job_name(table).alias("job_name")
    )


def impacted_gold(spark: SparkSession, d: str) -> DataFrame:
    return impact.impacted(standins.event_log(spark, d), refresh.seed_graph(spark), MARK)


def next_watermark(spark: SparkSession, d: str) -> DataFrame:
    return impact.next_watermark(standins.event_log(spark, d), MARK)


def selective_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Customers change first, sales later: the second tick rebuilds both aggregates."""
    layout = Layout(fresh_dir(spark, "refresh"))
    _run_silver(spark, d, "customers", layout)
    ticks = [refresh.refresh(spark, layout, entities=standins.STANDIN_ENTITIES)]
    _run_silver(spark, d, "sales_transactions", layout)
    ticks.append(refresh.refresh(spark, layout, entities=standins.STANDIN_ENTITIES))
    ticks.append(refresh.refresh(spark, layout, entities=standins.STANDIN_ENTITIES))
    result = None
    for table, (ddl, _) in gold.GOLD.items():
        part = (
            read_gold(spark, layout, table.split(".")[1], ddl)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("txn_count").alias("n_sales"))
            .select(
                F.lit(table).alias("gold_table"),
                *[F.lit(table in tick).alias(f"in_tick_{n}") for n, tick in enumerate(ticks, 1)],
                "n_rows",
                "n_sales",
            )
        )
        result = part if result is None else result.unionByName(part)
    return result


def _ticks(spark: SparkSession, d: str, table: str, batches: int) -> DataFrame:
    """The inputs of an aggregate in micro-batches; it follows their images, sometimes those of several batches."""
    layout = Layout(fresh_dir(spark, f"incremental-{table}"))
    marks: dict[str, int] = {}
    for source in AGGREGATES[f"gold.{table}"]().change:
        entity = standins.STANDIN_ENTITIES[source]
        records = standins.RECORDS[source](spark, d)
        # Later parts hold older changes of many keys, too: the order of arrival is not that of the changes.
        part = F.pmod(F.xxhash64("offset"), F.lit(batches))
        for n in range(batches):
            changes = decode_changelog(records.filter(part == n), entity).persist(StorageLevel.MEMORY_AND_DISK)
            commit_batch(spark, layout, entity, changes, n, F.current_timestamp(), with_feed=True)
            changes.unpersist()
            if n != 1:
                advance(spark, layout, f"gold.{table}", marks, {source: n}, _at(SECOND_RUN), standins.STANDIN_ENTITIES)
                marks[source] = n
    return read_gold(spark, layout, table, gold.GOLD[f"gold.{table}"][0])


def incremental_sales_summary(spark: SparkSession, d: str, batches: int = 3) -> DataFrame:
    return _ticks(spark, d, "sales_summary", batches)


def incremental_customer_loyalty(spark: SparkSession, d: str, batches: int = 3) -> DataFrame:
    return _ticks(spark, d, "customer_loyalty", batches)


# --- maintenance -----------------------------------------------------------


def expired_snapshots(spark: SparkSession, d: str) -> DataFrame:
    history = read_table(spark, d, "events").select(
        F.col("event_type").alias("table_name"),
        F.col("event_id").alias("snapshot_id"),
        F.col("ts").cast("timestamp").alias("committed_at"),
    )
    return retention.expired_snapshots(history)


def orphans(spark: SparkSession, d: str) -> DataFrame:
    listing = read_table(spark, d, "orders").select(
        F.concat(F.lit("file:///tables/part-"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderdate").cast("timestamp").alias("modified_at"),
    )
    referenced = read_table(spark, d, "lineitem").select(
        F.concat(F.lit("file:/tables/part-"), F.col("l_orderkey").cast("string")).alias("path")
    )
    return retention.orphans(listing, referenced.distinct())


def maintenance_report(spark: SparkSession, d: str) -> DataFrame:
    """Upkeep of a table for each type of event: expired snapshots, files that nothing refers to, and one failure."""
    events = read_table(spark, d, "events")

    def steps_of(table: str) -> list:
        own = events.filter(F.col("event_type") == table)
        path = F.concat(F.lit("file:/tables/part-"), F.col("event_id").cast("string")).alias("path")
        listing = own.select(path, F.col("ts").cast("timestamp").alias("modified_at"))
        history = own.select(
            F.col("event_type").alias("table_name"),
            F.col("event_id").alias("snapshot_id"),
            F.col("ts").cast("timestamp").alias("committed_at"),
        )
        return [
            (table, "expire_snapshots", lambda: retention.expired_snapshots(history).count()),
            (table, "remove_orphan_files", lambda: retention.orphans(listing, own.filter("value >= 50").select(path)).count()),
        ]

    steps = [step for table in ("click", "error", "purchase", "signup", "view") for step in steps_of(table)]
    steps.append(("lost", "expire_snapshots", lambda: retention.expired_snapshots(events).count()))
    return run_steps(spark, steps).select("table_name", "step", "status", "items")


# --- governance ------------------------------------------------------------


def governed_loyalty(spark: SparkSession, d: str) -> DataFrame:
    return governance.governed_view(customer_loyalty(spark, d), "analyst_readonly", "customer_loyalty")


def access_audit(spark: SparkSession, d: str) -> DataFrame:
    """Events as column requests, with the decision on each."""
    requests = read_table(spark, d, "events").select(
        F.col("user_id").alias("who"),
        F.when(F.col("event_type").isin("view", "click"), "analyst_readonly").otherwise("engineer").alias("role"),
        F.lit("customer_loyalty").alias("table_name"),
        F.when(F.col("value") < 10, "name").when(F.col("value") < 20, "lifetime_spend").otherwise("txn_count").alias("column_name"),
        F.col("ts").cast("timestamp").alias("requested_at"),
    )
    return governance.decide(requests)


# --- verification ----------------------------------------------------------


def raw_counts(spark: SparkSession, d: str) -> DataFrame:
    changed = standins.customer_events(spark, d).select("op")
    loaded = standins.customers_snapshot(spark, d).select(F.lit("r").alias("op"))
    return reconcile.raw_counts(
        {"customers": loaded.unionByName(changed), "sales_transactions": standins.sale_changes(spark, d)}
    )


def silver_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Replay of RAW against a SILVER table in which rows were lost, altered and kept too long."""
    layout = Layout(fresh_dir(spark, "reconcile"))
    _run_raw(spark, d, "sales_transactions", layout)
    raw = read_raw(spark, layout, "sales_transactions", with_position=True)
    replayed = latest_per_key(to_changelog(replayable(raw, SALES), SALES), SALES.keys, ORDER)
    columns = ["txn_id", "store_id", "product_id", "qty", "total_amount", "status"]
    last = standins.typed_sales(latest_per_key(standins.sale_lines(spark, d), ["txn_id"], ORDER))
    faulty = (
        last.filter("(op <> 'd' or qty = 7) and not (op <> 'd' and qty = 50)")
        .withColumn("status", F.when((F.col("op") != "d") & (F.col("qty") == 1), "unknown").otherwise(F.col("status")))
        .select(*columns)
    )
    return reconcile.reconcile(live(replayed).select(*columns), faulty, ["txn_id"])


def changelog_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Keys that only deletes touched, against a log that forgot the deletes."""
    changes = standins.sale_lines(spark, d)
    log = _sale_log(spark, d, changes.filter("op <> 'd'"))
    return reconcile.changelog_gaps(changes, log, "sales_transactions", ["txn_id"])


def gold_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """An upserted aggregate keeps rows whose sales are gone; a recomputation finds them."""
    _, now = _split_by_time(spark, d)
    recomputed = gold.sales_summary(now, _at(SECOND_RUN))
    return reconcile.reconcile(recomputed, merge_sales_summary(spark, d), ["store_id", "product_id"])


def gold_reconcile_digest(spark: SparkSession, d: str) -> DataFrame:
    """The same, joined only where the digests of aggregate and recomputation differ."""
    _, now = _split_by_time(spark, d)
    keys = ["store_id", "product_id"]
    recomputed = gold.sales_summary(now, _at(SECOND_RUN))
    return reconcile.reconcile(*digest.differing(recomputed, merge_sales_summary(spark, d), keys), keys)


QUERIES = {
    "cdc_scan": cdc_scan,
    "cdc_include": cdc_include,
    "snapshot_envelope": snapshot_envelope,
    "snapshot_diff": snapshot_diff,
    "snapshot_diff_digest": snapshot_diff_digest,
    "gold_scan": gold_scan,
    "decode_lenient": decode_lenient,
    "decode_changelog": decode_strict,
    "completed_sales": completed_sales,
    "raw_ingest": raw_ingest,
    "raw_variant": raw_variant,
    "silver_customers": silver_customers,
    "silver_products": silver_products,
    "silver_sales_transactions": silver_sales_transactions,
    "silver_stores": silver_stores,
    "silver_deletes": silver_deletes,
    "silver_stream_sales": silver_stream_sales,
    "silver_keyed_state": silver_keyed_state,
    "silver_stream_compacted": silver_stream_compacted,
    "silver_late_changes": silver_late_changes,
    "independent_streams": independent_streams,
    "merge_sales_summary": merge_sales_summary,
    "merge_customer_loyalty": merge_customer_loyalty,
    "merge_bucketed": merge_bucketed,
    "change_log": change_log,
    "change_log_rollup": change_log_rollup,
    "change_log_rollup_ranked": change_log_rollup_ranked,
    "change_log_lookup": change_log_lookup,
    "create_if_absent": create_if_absent,
    "insert_if_absent": insert_if_absent,
    "sales_summary": sales_summary,
    "customer_loyalty": customer_loyalty,
    "left_join_counts": left_join_counts,
    "sum_types": sum_types,
    "job_name": job_names,
    "impacted_gold": impacted_gold,
    "next_watermark": next_watermark,
    "selective_refresh": selective_refresh,
    "incremental_sales_summary": incremental_sales_summary,
    "incremental_customer_loyalty": incremental_customer_loyalty,
    "expired_snapshots": expired_snapshots,
    "orphans": orphans,
    "maintenance_report": maintenance_report,
    "governed_loyalty": governed_loyalty,
    "access_audit": access_audit,
    "raw_counts": raw_counts,
    "silver_reconcile": silver_reconcile,
    "changelog_gaps": changelog_gaps,
    "gold_reconcile": gold_reconcile,
    "gold_reconcile_digest": gold_reconcile_digest,
}
