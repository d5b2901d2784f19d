"""Upserts into keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    null_safe: bool = False,
    delete_unmatched: bool = False,
) -> DataFrame:
    """The target after ``MERGE``: matched rows replaced, unmatched source rows inserted.

    Keys are compared with ``=``, so a NULL key never matches and is inserted
    anew; ``null_safe`` matches NULL with NULL.  Target rows without a source
    row stay unless ``delete_unmatched`` is set.  The source is read once (it is
    usually an aggregate over a large table) and keeps its partitioning when it
    was grouped by the same keys.  Several source rows that match one target row
    raise an error when the result is computed, as a native ``MERGE`` does; they
    are counted in the partitions and the order that the join needs anyway.
    """
    columns = target.columns
    rows = F.count(F.lit(1)).over(Window.partitionBy(*[f"_n_{k}" for k in keys]))
    new = source.select(*[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    new = new.withColumn("_rows", rows)
    old = target.select(*columns, F.lit(True).alias("_old"))
    unmatchable = None
    if null_safe:
        on = _all([F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    else:
        on = _all([F.col(k) == F.col(f"_n_{k}") for k in keys])
        # Target rows with a NULL key match nothing: pass them by the shuffle,
        # where they would all meet in one partition.
        present = _all([F.col(k).isNotNull() for k in keys])
        unmatchable = target.filter(~present)
        old = old.filter(present)

    twice = F.col("_old") & F.col("_new") & (F.col("_rows") > 1)
    message = F.lit(f"several source rows match one target row on {list(keys)}")
    found = old.join(new, on, "right" if delete_unmatched else "full_outer")
    found = found.filter(F.when(twice, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    merged = found.select(*[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns])
    return merged if unmatchable is None or delete_unmatched else merged.unionByName(unmatchable)


def merge_into_table(source: DataFrame, table: str, keys: Sequence[str]) -> None:
    """Native ``MERGE`` for catalogs whose tables support row-level operations."""
    on = _all([F.col(f"{table}.{k}") == F.col(f"source.{k}") for k in keys])
    (
        source.alias("source")
        .mergeInto(table, on)
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )


def merge_bucketed(source: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Merge into a catalog table whose files are bucketed and sorted by the keys; the stored rows are not shuffled.

    For catalogs without row-level operations. The result is written as a second table of the same kind and takes the
    name of the first; a reader in between finds no table and has to try again. The table is created if it is absent.
    """
    spark = source.sparkSession
    following = f"{table}_next"
    # Dealt as the table is: the only shuffle. A task then holds whole buckets of both and writes a file for each.
    result = dealt = source.repartition(buckets, *keys)
    if spark.catalog.tableExists(table):
        result = merge(spark.table(table), dealt, keys)
    spark.sql(f"DROP TABLE IF EXISTS {following}")
    result.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(following)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {following} RENAME TO {table}")


def insert_if_absent(
    existing: DataFrame, candidates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Existing rows plus the candidates whose key is new; a repeated candidate counts once.

    With ``order`` the first candidate by those columns wins.
    """
    if order:
        first = Window.partitionBy(*keys).orderBy(*order)
        unique = candidates.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    else:
        unique = candidates.dropDuplicates(list(keys))
    fresh = unique.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))
