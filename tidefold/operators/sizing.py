"""Broadcasting behind a check of the size in bytes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.session import ensure_checkpoint_dir

# Of the rows as they are stored; as a hash table about twice that.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame, columns: Sequence[str]) -> Column:
    """Size of a row's values; text counts by its length, other values eight bytes, each with a word beside it."""
    kinds = dict(df.dtypes)
    sizes = [
        F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kinds[c] in ("string", "binary") else F.lit(16) for c in columns
    ]
    return reduce(lambda a, b: a + b, sizes, F.lit(16)).cast("long")


def size_of(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df, df.columns))).first()[0] or 0


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a join side and hint a broadcast only if it is proven small.

    Beyond ``max_bytes`` the frame is returned without the hint, so the join is
    planned as a shuffle join and AQE splits its skewed partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint()
    return F.broadcast(done) if is_small(done, max_bytes) else done


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    return size_of(df) <= max_bytes
