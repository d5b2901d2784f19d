"""Rebuild the aggregates that depend on changed tables, and no others."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators.impact import MARKS_DDL, advanced_marks, dependents
from tidefold.plans.gold import GOLD, customer_loyalty, sales_summary
from tidefold.plans.incremental import AGGREGATES, advance
from tidefold.schemas import DEPENDENCY_GRAPH, ENTITIES, GRAPH_DDL, Entity
from tidefold.sinks.buckets import read_bucketed, upsert
from tidefold.sinks.gold import merge_gold
from tidefold.sinks.layout import Layout
from tidefold.sinks.silver import read_change_log, read_silver
from tidefold.sources.tables import read_or_empty

MARKS = "control.marks"


def seed_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEPENDENCY_GRAPH), GRAPH_DDL)


def ensure_graph(spark: SparkSession, layout: Layout) -> DataFrame:
    """The stored dependency graph, created from the seed edges on first use."""
    stored = read_or_empty(spark, layout.graph, GRAPH_DDL)
    missing = seed_graph(spark).join(stored, ["gold_table", "depends_on_silver_table"], "left_anti")
    if missing.isEmpty():
        return stored
    missing.coalesce(1).write.mode("append").parquet(layout.graph)
    return read_or_empty(spark, layout.graph, GRAPH_DDL)


Reader = Callable[[str], DataFrame]

# How each aggregate is computed, given a reader of current-state tables. Extend it, GOLD and the graph together.
BUILDERS: dict[str, Callable[[Reader, Column | None], DataFrame]] = {
    "gold.sales_summary": lambda read, as_of: sales_summary(read("sales_transactions"), as_of),
    "gold.customer_loyalty": lambda read, as_of: customer_loyalty(read("customers"), read("sales_transactions"), as_of),
}


def unbuildable(graph: DataFrame) -> list[str]:
    """Aggregates that the graph names and nothing builds; at most one name per aggregate."""
    known = sorted(set(BUILDERS) & set(GOLD))
    return [r.gold_table for r in graph.filter(~F.col("gold_table").isin(known)).select("gold_table").distinct().collect()]


def build(
    spark: SparkSession,
    layout: Layout,
    gold_table: str,
    as_of: Column | None = None,
    entities: Mapping[str, Entity] = ENTITIES,
) -> DataFrame:
    """Full recomputation of an aggregate from the current state."""
    return BUILDERS[gold_table](lambda table: read_silver(spark, layout, entities[table]), as_of)


def refresh_table(
    spark: SparkSession,
    layout: Layout,
    gold_table: str,
    as_of: Column | None = None,
    null_safe: bool = False,
    delete_unmatched: bool = False,
    entities: Mapping[str, Entity] = ENTITIES,
) -> None:
    """Merge a recomputation into the aggregate."""
    rows = build(spark, layout, gold_table, as_of, entities)
    merge_gold(spark, layout, gold_table.split(".")[-1], rows, null_safe, delete_unmatched)


def stored_marks(spark: SparkSession, layout: Layout) -> dict[str, int]:
    """The last batch of each table that has been handled: one row per captured table."""
    return {row.table_name: row.mark for row in read_bucketed(spark, layout, MARKS, MARKS_DDL).collect()}


def store_marks(spark: SparkSession, layout: Layout, marks: Mapping[str, int]) -> None:
    rows = spark.createDataFrame(list(marks.items()), MARKS_DDL)
    upsert(spark, layout, MARKS, MARKS_DDL, ["table_name"], rows, lambda old, new, _: new.coalesce(1), buckets=1)


def refresh(
    spark: SparkSession,
    layout: Layout,
    as_of: Column | None = None,
    null_safe: bool = False,
    delete_unmatched: bool = False,
    entities: Mapping[str, Entity] = ENTITIES,
    incremental: bool = False,
) -> list[str]:
    """One tick: find the impacted aggregates, rebuild them in turn, advance the marks.

    The marks come from the rows that were read and are stored only after every
    rebuild succeeded: changes committed meanwhile, and failed rebuilds, are
    seen by the next tick.  Edges to an aggregate without a builder are warned
    of and left out, so that they do not hold up the others.

    With ``incremental`` the aggregates follow the row images that the streams
    have kept: the work is that of the changes, and groups that are gone go.
    """
    graph = ensure_graph(spark, layout)
    lacking = unbuildable(graph)
    if lacking:
        warnings.warn(f"no builder for {sorted(lacking)}", stacklevel=2)
        graph = graph.filter(~F.col("gold_table").isin(lacking))
    marks = stored_marks(spark, layout)
    # At most one row per captured table.
    moved = {r.table_name: r.mark for r in advanced_marks(read_change_log(spark, layout, marks), marks).collect()}
    if not moved:
        return []
    changed = spark.createDataFrame(list(moved.items()), MARKS_DDL)
    # At most one name per aggregate table.
    tables = [row.gold_table for row in dependents(graph, changed).collect()]
    for table in tables:
        if incremental and table in AGGREGATES:
            advance(spark, layout, table, marks, moved, as_of, entities)
        else:
            refresh_table(spark, layout, table, as_of, null_safe, delete_unmatched, entities)
    store_marks(spark, layout, {**marks, **moved})
    return tables
