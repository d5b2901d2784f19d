"""Session set-up and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession

# SQL settings the jobs rely on.  They are applied only where the submitter
# has not chosen a value, so cluster defaults always win.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Unlike the default, these have minima and maxima in the files.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(app_name: str = "tidefold", master: str | None = None, **settings: str) -> SparkSession:
    """Create a session; ``settings`` use ``__`` for dots (``spark__ui__enabled``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    chosen = spark.sparkContext.getConf()
    for key, value in SQL_DEFAULTS.items():
        if not chosen.contains(key):
            spark.conf.set(key, value)
    if not chosen.contains("spark.sql.shuffle.partitions"):
        # Three waves of tasks; AQE merges the small ones afterwards.
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * spark.sparkContext.defaultParallelism))
    return spark


_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder stands in for it only in local mode, where the driver
    and the executors are one process.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder when running on a cluster")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tidefold-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared root."""
    return f"{shared_root(spark)}/tidefold/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for a while; those of before are put back."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes, and streams started, while this lasts remove their shuffle files at their end, unless the submitter chose.

    Otherwise the files stay until the driver happens to collect its garbage.
    """
    with settings(spark, {} if spark.conf.get(SHUFFLE_CLEANUP, None) is not None else {SHUFFLE_CLEANUP: "true"}):
        yield


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
