"""Declared schemas of every table in the engine.

Nothing is inferred from data: the change envelopes arrive as JSON without a
schema, so the reader has to bring one.  Types are written as Spark DDL.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Entity:
    """A captured source table: its name, primary key and typed columns."""

    name: str
    keys: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]

    @property
    def columns(self) -> list[str]:
        return [name for name, _ in self.fields]

    @property
    def ddl(self) -> str:
        return ", ".join(f"{name} {dtype}" for name, dtype in self.fields)

    @property
    def struct(self) -> str:
        inner = ", ".join(f"{name}: {dtype}" for name, dtype in self.fields)
        return f"STRUCT<{inner}>"

    @property
    def envelope_ddl(self) -> str:
        return (
            f"op STRING, before {self.struct}, after {self.struct}, "
            "source STRUCT<ts_ms: BIGINT>, ts_ms BIGINT"
        )


# Column names, types and keys of the four captured tables.
CUSTOMERS = Entity(
    "customers",
    ("customer_id",),
    (
        ("customer_id", "INT"),
        ("name", "STRING"),
        ("email", "STRING"),
        ("phone", "STRING"),
        ("city", "STRING"),
        ("loyalty_tier", "STRING"),
        ("total_spend", "DECIMAL(12,2)"),
        ("registered_at", "STRING"),
        ("created_at", "STRING"),
        ("updated_at", "STRING"),
    ),
)
PRODUCTS = Entity(
    "products",
    ("product_id",),
    (
        ("product_id", "INT"),
        ("sku", "STRING"),
        ("name", "STRING"),
        ("category", "STRING"),
        ("brand", "STRING"),
        ("unit_price", "DECIMAL(12,2)"),
        ("cost_price", "DECIMAL(12,2)"),
        ("is_active", "BOOLEAN"),
        ("created_at", "STRING"),
        ("updated_at", "STRING"),
    ),
)
SALES_TRANSACTIONS = Entity(
    "sales_transactions",
    ("txn_id",),
    (
        ("txn_id", "INT"),
        ("store_id", "INT"),
        ("product_id", "INT"),
        ("customer_id", "INT"),
        ("qty", "INT"),
        ("unit_price", "DECIMAL(12,2)"),
        ("total_amount", "DECIMAL(12,2)"),
        ("status", "STRING"),
        ("txn_at", "STRING"),
        ("created_at", "STRING"),
        ("updated_at", "STRING"),
    ),
)
STORES = Entity(
    "stores",
    ("store_id",),
    (
        ("store_id", "INT"),
        ("code", "STRING"),
        ("name", "STRING"),
        ("city", "STRING"),
        ("region", "STRING"),
        ("is_active", "BOOLEAN"),
        ("opened_date", "STRING"),
        ("created_at", "STRING"),
        ("updated_at", "STRING"),
    ),
)
ENTITIES = {e.name: e for e in (CUSTOMERS, PRODUCTS, SALES_TRANSACTIONS, STORES)}

# Layout of the RAW, GOLD and control tables.
RAW_DDL = "op STRING, before_json STRING, after_json STRING, source_ts_ms BIGINT, ingested_at TIMESTAMP"
SALES_SUMMARY_DDL = (
    "store_id INT, product_id INT, total_qty BIGINT, total_amount DOUBLE, "
    "txn_count BIGINT, updated_at TIMESTAMP"
)
CUSTOMER_LOYALTY_DDL = (
    "customer_id INT, name STRING, loyalty_tier STRING, lifetime_spend DOUBLE, "
    "txn_count BIGINT, updated_at TIMESTAMP"
)
CHANGE_LOG_DDL = "table_name STRING, snapshot_id BIGINT, affected_keys STRING, committed_at TIMESTAMP"
GRAPH_DDL = "gold_table STRING, depends_on_silver_table STRING"

# Which GOLD table is rebuilt when which SILVER table changes.
DEPENDENCY_GRAPH = (
    ("gold.sales_summary", "sales_transactions"),
    ("gold.sales_summary", "products"),
    ("gold.sales_summary", "stores"),
    ("gold.customer_loyalty", "customers"),
    ("gold.customer_loyalty", "sales_transactions"),
)

# Every table that maintenance visits.
MAINTAINED_TABLES = tuple(
    [f"raw.{name}" for name in ENTITIES]
    + [f"silver.{name}" for name in ENTITIES]
    + ["gold.sales_summary", "gold.customer_loyalty"]
)

# Columns that order the changes of one key: commit time at the source, then
# the position in the topic.  Together they are a total order per key.
ORDER = ("ts_ms", "offset")

# What a stream of change records looks like, whatever it is read from.
RECORD_DDL = (
    "key STRING, value STRING, topic STRING, partition INT, "
    "offset BIGINT, timestamp TIMESTAMP"
)
