"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.session import ensure_checkpoint_dir

# A word is a run of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text; none for a NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once.

    A later filter or projection reads their values: it is not merged with the
    expressions, as these sit behind a generator of one row.
    """
    named = [column.alias(name) for name, column in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*named))))


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def missing(df: DataFrame, *names: str) -> None:
    """Raise for columns that the operator needs and the table lacks."""
    have = {c.lower() for c in df.columns}
    lacking = [n for n in names if n.lower() not in have]
    if lacking:
        raise ValueError(f"the table lacks the columns {lacking}")


def matched(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents, as a struct ``row``, that ``chosen`` names by ``id`` and ``mark``, a hash of the text.

    Other columns of ``chosen`` come along. Of rows with the same id and text one is returned. The texts are shuffled
    once, by id and mark, so that no group of copies meets in one task.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("own_id"), F.xxhash64(F.col(text)).alias("own_mark")
    )
    both = rows.join(chosen, (F.col("own_mark") == F.col("mark")) & F.col("own_id").eqNullSafe(F.col("id")))
    place = F.row_number().over(Window.partitionBy("own_mark", "own_id").orderBy("own_mark"))
    return both.withColumn("place", place).filter("place = 1").drop("own_id", "own_mark", "id", "mark", "place")
