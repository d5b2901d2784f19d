"""Which aggregates have to be rebuilt after a set of changes."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: where a first run starts.
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)

MARKS_DDL = "table_name STRING, mark BIGINT"


def _instant(since: datetime.datetime) -> Column:
    """A literal that does not depend on the time zone of driver or session."""
    if since.tzinfo is None:
        since = since.replace(tzinfo=datetime.timezone.utc)
    micros = (since - EPOCH) // datetime.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros).cast("long"))


def changed_since(log: DataFrame, since: datetime.datetime = EPOCH) -> DataFrame:
    """Names of the tables with a change committed after the mark."""
    return log.filter(F.col("committed_at") > _instant(since)).select("table_name").distinct()


def dependents(graph: DataFrame, changed: DataFrame) -> DataFrame:
    """Aggregates that depend on a changed table, each once, sorted by name."""
    return (
        graph.join(changed, graph.depends_on_silver_table == changed.table_name, "left_semi")
        .select("gold_table")
        .distinct()
        .orderBy("gold_table")
    )


def impacted(log: DataFrame, graph: DataFrame, since: datetime.datetime = EPOCH) -> DataFrame:
    """Aggregates to rebuild given the change log and the dependency graph."""
    return dependents(graph, changed_since(log, since))


def next_watermark(log: DataFrame, since: datetime.datetime = EPOCH) -> DataFrame:
    """The commit time of the newest row read, or the old mark when none is newer."""
    return log.filter(F.col("committed_at") > _instant(since)).agg(
        F.coalesce(F.max("committed_at").cast("timestamp"), _instant(since)).alias("watermark")
    )


def advanced_marks(log: DataFrame, marks: Mapping[str, int]) -> DataFrame:
    """Tables with changes past their own mark, and the new mark of each.

    A mark is the last batch handled of a table.  Batch ids of a table only
    grow, whatever the clocks of the drivers that commit them say, and every
    table has a mark of its own, as each is written by its own stream.
    """
    unseen = ~F.col("table_name").isin(*marks) if marks else F.lit(True)
    for table, mark in marks.items():
        unseen = unseen | ((F.col("table_name") == table) & (F.col("snapshot_id") > mark))
    return log.filter(unseen).groupBy("table_name").agg(F.max("snapshot_id").alias("mark"))
