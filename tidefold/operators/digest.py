"""Comparing large tables by digests first, so that only what differs is joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.session import ensure_checkpoint_dir

# Of the keys; a digest is one row for each, so it stays small whatever the tables hold.
BUCKETS = 4096


def _hashed(columns: Sequence[str], seed: int) -> Column:
    """A NULL is hashed as such: it must not pass for its neighbour."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def digests(df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows and order-free digest of each bucket of keys: two sums of row hashes.

    Every row is hashed with its key, so values that two rows have swapped change both. Combined in every task before
    the shuffle, which moves one row for each task and bucket.
    """
    total = lambda seed: F.sum(_hashed(df.columns, seed).cast("decimal(38,0)"))
    bucket = F.pmod(_hashed(keys, 0), F.lit(buckets)).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"))


def differing(
    left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in the buckets of keys whose digests differ; all others hold the same rows.

    Both tables are read twice, but only rows of differing buckets are shuffled by whatever compares them then. Columns
    are compared by the order of ``left``, and need the same types.
    """
    right = right.select(*left.columns)
    sides = [digests(side, keys, buckets).select("bucket", F.struct("n", "a", "b").alias(name)) for side, name in ((left, "l"), (right, "r"))]
    unequal = sides[0].join(sides[1], "bucket", "full_outer").filter(~F.col("l").eqNullSafe(F.col("r")))
    ensure_checkpoint_dir(left.sparkSession)
    wanted = F.broadcast(unequal.select("bucket").checkpoint())  # at most ``buckets`` numbers
    number = F.pmod(_hashed(keys, 0), F.lit(buckets)).cast("int")

    def drilled(side: DataFrame) -> DataFrame:
        return side.withColumn("_bucket", number).join(wanted, F.col("_bucket") == F.col("bucket"), "left_semi").drop("_bucket")

    return drilled(left), drilled(right)
