"""Where tables live. Plain Parquet folders; the partition columns are in the names of the folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


# Of the Parquet files: row images, keys and markers repeat much, and most tables are written more often than read.
COMPRESSION = "zstd"


@dataclass(frozen=True)
class Layout:
    root: str

    def raw(self, table: str) -> str:
        return f"{self.root}/raw/{table}"

    def table(self, name: str) -> str:
        """A keyed table, named with its layer: ``silver.customers``, ``gold.sales_summary``, ``control.marks``."""
        return f"{self.root}/{name.replace('.', '/')}"

    def staged(self, name: str) -> str:
        """Buckets of a keyed table that are written and not yet in place."""
        return f"{self.root}/staged/{name}"

    def feed(self, table: str) -> str:
        """Signed row images of a current-state table, a folder for each micro-batch."""
        return f"{self.root}/feed/{table}"

    @property
    def log(self) -> str:
        return f"{self.root}/control/change_log"

    @property
    def graph(self) -> str:
        return f"{self.root}/control/gold_dependency_graph"

    @property
    def audit(self) -> str:
        return f"{self.root}/control/audit"

    def checkpoint(self, query: str) -> str:
        return f"{self.root}/checkpoints/{query}"


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _located(spark, path)
    return system.exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or a folder through the cluster's file system; an absent one is fine."""
    system, target = _located(spark, path)
    return system.delete(target, True)
