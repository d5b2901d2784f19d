"""Column expressions shared by the operators (all built-in, no UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(keys: Sequence[str]) -> Column:
    """Primary key as text; a composite key becomes a JSON object."""
    if len(keys) == 1:
        return F.col(keys[0]).cast("string")
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def row_json(column: str) -> Column:
    """A struct as JSON text with NULL fields kept; a NULL struct stays NULL."""
    return F.to_json(F.col(column), {"ignoreNullFields": "false"})


def job_name(table: Column) -> Column:
    """``gold.sales_summary`` -> ``sales-summary``."""
    return F.replace(F.element_at(F.split(table, "[.]"), -1), F.lit("_"), F.lit("-"))


def normalised_path(path: Column) -> Column:
    """One spelling for local paths, which Spark reports as file:/x or file:///x."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def epoch_ms(timestamp: Column) -> Column:
    return F.unix_millis(timestamp.cast("timestamp"))
