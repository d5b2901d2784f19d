"""Producing change envelopes from tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.schemas import Entity


def include_tables(records: DataFrame, tables: Iterable[str], column: str = "topic") -> DataFrame:
    """Keep the records of the listed tables only."""
    return records.filter(F.col(column).isin(*tables))


def envelope(
    op: Column, before: Column, after: Column, ts_ms: Column, key: Column, topic: str, offset: Column
) -> list[Column]:
    """Columns of one stream record (``key, value, topic, partition, offset, timestamp``)."""
    document = F.struct(
        op.alias("op"),
        before.alias("before"),
        after.alias("after"),
        F.struct(ts_ms.alias("ts_ms")).alias("source"),
        ts_ms.alias("ts_ms"),
    )
    return [
        key.cast("string").alias("key"),
        F.to_json(document, {"ignoreNullFields": "false"}).alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        offset.cast("long").alias("offset"),
        F.timestamp_millis(ts_ms).alias("timestamp"),
    ]


def wire_row(entity: Entity, known: Mapping[str, Column]) -> Column:
    """An entity row as it travels: money is a double, fields that are not given are NULL."""
    fields = []
    for name, dtype in entity.fields:
        wire = "double" if dtype.startswith("DECIMAL") else dtype.lower()
        fields.append(known.get(name, F.lit(None)).cast(wire).alias(name))
    return F.struct(*fields)


def change_records(changes: DataFrame, entity: Entity, topic: str) -> DataFrame:
    """Row changes (``op``, entity columns, ``ts_ms``, ``offset``) as stream records.

    An update carries its row on both sides; the previous values are not known.
    """
    row = wire_row(entity, {c: F.col(c) for c in entity.columns if c in changes.columns})
    op = F.col("op")
    return changes.select(
        *envelope(
            op,
            F.when(op.isin("d", "u"), row),
            F.when(op != "d", row),
            F.col("ts_ms"),
            F.col(entity.keys[0]) if len(entity.keys) == 1 else F.to_json(F.struct(*entity.keys)),
            topic,
            F.col("offset"),
        )
    )


def snapshot_changes(rows: DataFrame, ts_ms: Column, offset: Column | None = None) -> DataFrame:
    """Existing rows as row changes with ``op = r``.

    Every key occurs once in a snapshot, so all rows may share one offset, which
    lies before the first change.
    """
    return rows.select(
        F.lit("r").alias("op"),
        "*",
        ts_ms.cast("long").alias("ts_ms"),
        (F.lit(-1) if offset is None else offset).cast("long").alias("offset"),
    )


def snapshot_records(rows: DataFrame, entity: Entity, topic: str, ts_ms: Column, offset: Column | None = None) -> DataFrame:
    """The initial load as stream records, so that RAW and SILVER both receive it."""
    return change_records(snapshot_changes(rows, ts_ms, offset), entity, topic)


def snapshot_envelope(rows: DataFrame, ts_ms: Column, offset: Column) -> DataFrame:
    """Existing rows as envelopes with ``op = r``, ready to be united with changes."""
    after = F.struct(*rows.columns)
    return rows.select(
        F.lit("r").alias("op"),
        F.when(F.lit(False), after).alias("before"),
        after.alias("after"),
        F.struct(ts_ms.cast("long").alias("ts_ms")).alias("source"),
        ts_ms.cast("long").alias("ts_ms"),
        offset.cast("long").alias("offset"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes that lead from one version of a table to another.

    Both versions hold a key at most once, so the shuffle join on the key has
    no hot partitions.  Unchanged rows are dropped inside the join stage.
    """
    columns = new.columns
    before = old.select(*keys, F.struct(*columns).alias("before"))
    after = new.select(*keys, F.struct(*columns).alias("after"))
    return (
        before.join(after, list(keys), "full_outer")
        .filter(~F.col("before").eqNullSafe(F.col("after")))
        .select(
            F.when(F.col("before").isNull(), "c").when(F.col("after").isNull(), "d").otherwise("u").alias("op"),
            *keys,
            "before",
            "after",
        )
    )
