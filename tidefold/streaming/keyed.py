"""Current state kept by the stream itself: the newest change of each key in a RocksDB state store.

An alternative to the SILVER tables where keys are many and batches small: a batch writes the keys that it changes and
no buckets. The state lies below the query's checkpoint and is read back by Spark's own ``statestore`` source.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidefold.operators.envelope import decode_changelog
from tidefold.operators.state import live
from tidefold.schemas import ORDER, Entity
from tidefold.session import settings, shuffles_removed
from tidefold.sinks.layout import Layout
from tidefold.streaming.raw import CADENCE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The state lies on the executors' disks and, in several versions, below the checkpoint.
STATE = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.compression": "zstd"}


def newest_changes(changes: DataFrame, entity: Entity) -> DataFrame:
    """The newest change of each key; combined in every task before the shuffle, so a hot key sends a row per task.

    The order columns come first in the row, which is so its own order; the state holds neither them nor the key twice.
    """
    row = F.struct(*ORDER, "op", *[c for c in entity.columns if c not in entity.keys])
    return changes.groupBy(*entity.keys).agg(F.max(row).alias("newest"))


def start_keyed(
    records: DataFrame,
    entity: Entity,
    layout: Layout,
    trigger: dict[str, Any] = CADENCE,
    each: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep the newest change of each key; ``each`` gets the keys that a batch has changed, with their newest change.

    Delete markers stay in the state: a change may arrive however late.
    """
    spark = records.sparkSession
    name = f"keyed-{entity.name}"
    writer = newest_changes(decode_changelog(records, entity), entity).writeStream.outputMode("update")
    writer = writer.format("noop") if each is None else writer.foreachBatch(each)
    writer = writer.option("checkpointLocation", layout.checkpoint(name)).queryName(name).trigger(**trigger)
    with settings(spark, STATE), shuffles_removed(spark):
        return writer.start()  # keeps the settings for its life


def read_keyed(spark: SparkSession, layout: Layout, entity: Entity) -> DataFrame:
    """The newest change of each key, delete markers and order columns included, as of the last committed batch."""
    stored = spark.read.format("statestore").load(layout.checkpoint(f"keyed-{entity.name}"))
    held = next(f.name for f in stored.schema["value"].dataType.fields if "op" in getattr(f.dataType, "names", []))
    keys = [F.col(f"key.{name}").alias(k) for name, k in zip(stored.schema["key"].dataType.names, entity.keys, strict=True)]
    return stored.select(*keys, f"value.{held}.*").select("op", *entity.columns, *ORDER)


def read_keyed_live(spark: SparkSession, layout: Layout, entity: Entity) -> DataFrame:
    """Current rows, one per key."""
    return live(read_keyed(spark, layout, entity)).select(*entity.columns)
