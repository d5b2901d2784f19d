"""Snapshot retention and orphan files."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.functions.scalars import normalised_path
from tidefold.operators.sizing import small_side

# Retention keeps the newest ten snapshots; the age limit lies so
# far ahead that it never spares one.
RETAIN_LAST = 10
OLDER_THAN = datetime.datetime(2100, 1, 1)


def expired_snapshots(
    snapshots: DataFrame, retain_last: int = RETAIN_LAST, older_than: datetime.datetime = OLDER_THAN
) -> DataFrame:
    """Snapshots beyond the newest ``retain_last`` of their table and older than the cutoff.

    Input columns: ``table_name, snapshot_id, committed_at`` (others are kept).
    Ranking all snapshots would sort a whole table's history in one task.  Only
    the oldest retained snapshot per table is ranked out (a group limit prunes
    on the map side), and the history is compared with that boundary.
    """
    recent = Window.partitionBy("table_name").orderBy(F.desc("committed_at"), F.desc("snapshot_id"))
    boundary = (
        snapshots.select("table_name", "committed_at", "snapshot_id")
        .withColumn("_rank", F.row_number().over(recent))
        .filter(F.col("_rank") == retain_last)
        .select(
            F.col("table_name").alias("_table"),
            F.struct("committed_at", "snapshot_id").alias("_oldest_kept"),
        )
    )
    return (
        snapshots.filter(F.col("committed_at") < F.lit(older_than.isoformat(sep=" ")).cast("timestamp"))
        .join(small_side(boundary), F.col("table_name") == F.col("_table"))
        .filter(F.struct("committed_at", "snapshot_id") < F.col("_oldest_kept"))
        .select(*snapshots.columns)
    )


def list_files(spark: SparkSession, globs: Iterable[str]) -> DataFrame:
    """Path and modification time of the files that match; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .load(list(globs))
        .select("path", F.col("modificationTime").alias("modified_at"))
    )


def orphans(listing: DataFrame, referenced: DataFrame, modified_before: datetime.datetime | None = None) -> DataFrame:
    """Listed files that nothing refers to, optionally only those older than a time."""
    if modified_before is not None:
        listing = listing.filter(F.col("modified_at") < F.lit(modified_before.isoformat(sep=" ")).cast("timestamp"))
    known = referenced.select(normalised_path(F.col("path")).alias("_path"))
    return listing.join(known, normalised_path(listing["path"]) == known["_path"], "left_anti")
