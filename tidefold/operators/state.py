"""Folding changes into the current state of a keyed table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators.sizing import BROADCAST_BYTES, row_bytes, size_of


def latest_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last change of every key, deletes included.

    Spark plans ``row_number() = 1`` as a group limit on both sides of the
    shuffle: each task sends at most one row per key, so a key that holds a
    large share of the changes costs one row per task, not a hot partition.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        changes.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def live(changes: DataFrame) -> DataFrame:
    """Rows that still exist: everything but delete markers."""
    return changes.filter(F.col("op") != "d")


def current_state(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fold a set of changes; the result does not depend on the order of the rows."""
    return live(latest_per_key(changes, keys, order)).drop("op", *order)


def apply_delta(
    base: DataFrame,
    delta: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """State of a base (one row per key) after the changes in ``delta``.

    A base is far larger than the changes since it was written, so it is joined
    with the folded changes and never folded itself.  When the changed keys are
    proven small they are broadcast and the base is only scanned; otherwise it
    is shuffled, after the caller's filters, which reach its files either way.
    """
    newest = latest_per_key(delta, keys, order)
    changed = [*keys, *order]
    first = order[0]
    # The changes bound the changed keys; keys are measured only beyond that bound.
    size, rows, timed, oldest = delta.agg(
        F.sum(row_bytes(delta, changed)), F.count(F.lit(1)), F.count(first), F.min(first)
    ).first()
    small = (size or 0) <= max_broadcast_bytes or size_of(delta.select(*keys).distinct()) <= max_broadcast_bytes
    return _applied(base, newest, keys, order, oldest if timed == rows else None, F.broadcast if small else lambda df: df)


def _same_key(keys: Sequence[str], renamed: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(renamed + k)) for k in keys])


def _applied(
    base: DataFrame,
    newest: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    oldest: int | None,
    hint: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Base rows that no change replaces, and the changes that replace or add rows.

    Both parts keep the columns of the base as they are, so filters and column lists of the caller reach its files.
    """
    changed = newest.select(*keys, *order)
    marks = hint(changed.select(*[F.col(c).alias(f"_d_{c}") for c in changed.columns]))
    position, delta_position = F.struct(*order), F.struct(*[F.col(f"_d_{c}") for c in order])
    untouched = base.join(marks, _same_key(keys, "_d_") & (delta_position >= position), "left_anti")
    # Changes that arrived late: the base already holds a newer row for the key.
    # Only base rows at least as new as the oldest change can be such rows, and
    # file statistics rule out nearly all of the base by that bound.
    recent = base.select(*keys, *order)
    if oldest is not None:
        recent = recent.filter(F.col(order[0]) >= F.lit(oldest))
    late = recent.join(marks, _same_key(keys, "_d_") & (delta_position < position), "left_semi")
    late = hint(late.select(*[F.col(k).alias(f"_d_{k}") for k in keys]))
    applied = newest.join(late, _same_key(keys, "_d_"), "left_anti")
    return untouched.unionByName(applied.select(*base.columns))
