"""Comparing each layer with a recomputation of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions.scalars import key_text


def raw_counts(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and operation."""
    tagged = [df.select(F.lit(name).alias("table_name"), "op") for name, df in raw.items()]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("table_name", "op")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys at which two versions of a keyed table differ.

    ``missing``: expected but absent; ``stale``: present but not expected;
    ``different``: present on both sides with other values.  One join answers
    all three.  Keys are matched null-safe and rows are compared null-safe.
    """
    columns = expected.columns
    left = expected.select(*keys, F.struct(*columns).alias("_expected"))
    right = actual.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.struct(*columns).alias("_actual"))
    same_key = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return (
        left.join(right, same_key, "full_outer")
        .filter(~F.col("_expected").eqNullSafe(F.col("_actual")))
        .select(
            *[F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in keys],
            F.when(F.col("_actual").isNull(), "missing")
            .when(F.col("_expected").isNull(), "stale")
            .otherwise("different")
            .alias("status"),
        )
    )


def changelog_gaps(touched: DataFrame, log: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Touched keys of a table that its change log does not mention."""
    named = touched.select(F.lit(table).alias("table_name"), key_text(keys).alias("affected_keys")).distinct()
    logged = log.filter(F.col("table_name") == table).select("table_name", "affected_keys").distinct()
    return named.join(logged, ["table_name", "affected_keys"], "left_anti")
