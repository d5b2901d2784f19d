"""Daily upkeep of every table: retention of the change log, leftovers of writers, files that nothing refers to."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators.retention import OLDER_THAN, RETAIN_LAST, expired_snapshots, list_files, orphans
from tidefold.plans.refresh import MARKS, stored_marks
from tidefold.schemas import CHANGE_LOG_DDL, MAINTAINED_TABLES
from tidefold.session import ensure_checkpoint_dir
from tidefold.sinks.layout import Layout, delete_path
from tidefold.sinks.silver import PERIOD
from tidefold.sources.tables import read_or_empty

REPORT_DDL = "table_name STRING, step STRING, status STRING, items BIGINT, message STRING"

# Files younger than this may belong to a write that is still running.
ORPHAN_AGE = datetime.timedelta(days=3)
# Steps that run at once, and the seconds after which one is stopped.
AT_ONCE, STEP_LIMIT_S = 4, 2 * 3600.0


def expire(spark: SparkSession, layout: Layout, table: str, retain_last: int = RETAIN_LAST, dry_run: bool = True) -> int:
    """Drop the log and the row images of a table's old micro-batches, a folder of PERIOD batches at a time.

    Kept are the newest ``retain_last`` batches, those that no tick has seen, and what lies in a folder with them.
    Returns the batches that go. RAW only grows, and aggregates have one state: nothing there is superseded.
    """
    layer, name = table.split(".")
    if layer != "silver":
        return 0
    log = read_or_empty(spark, layout.log, f"{CHANGE_LOG_DDL}, period INT").filter(F.col("table_name") == name)
    batches = log.groupBy("table_name", "period", "snapshot_id").agg(F.max("committed_at").alias("committed_at"))
    newest_gone = expired_snapshots(batches, retain_last, OLDER_THAN).agg(F.max("snapshot_id")).first()[0]
    if newest_gone is None:
        return 0
    marks = stored_marks(spark, layout)
    bound = min(newest_gone, marks.get(name, -1)) if marks else newest_gone
    old = (F.col("period") + 1) * PERIOD <= bound + 1
    # A row for each PERIOD batches since the last upkeep.
    gone = batches.filter(old).groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in [] if dry_run else gone:
        delete_path(spark, f"{layout.log}/table_name={name}/period={r.period}")
        delete_path(spark, f"{layout.feed(name)}/period={r.period}")
    return sum(r.n for r in gone)


def raw_orphans(
    spark: SparkSession, layout: Layout, table: str, modified_before: datetime.datetime | None = None
) -> DataFrame:
    """Files of RAW that the streaming sink has not committed.

    Loading the folder itself goes by the commit log of the sink and so yields the committed files; the glob lists all.
    """
    root = layout.raw(table)
    return orphans(list_files(spark, [f"{root}/*/*.parquet"]), list_files(spark, [root]), modified_before)


def leftovers(spark: SparkSession, layout: Layout, table: str, modified_before: datetime.datetime) -> list[str]:
    """Folders that a lost writer of a keyed table has left: one or two for each failure."""
    found = []
    for pattern in (f"{layout.table(table)}/.spark-staging-*", layout.staged(table)):
        target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        for status in target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []:
            if status.getModificationTime() < modified_before.timestamp() * 1000:
                found.append(status.getPath().toString())
    return found


def remove_orphans(
    spark: SparkSession, layout: Layout, table: str, age: datetime.timedelta = ORPHAN_AGE, dry_run: bool = True
) -> int:
    layer, name = table.split(".")
    cutoff = datetime.datetime.now(datetime.timezone.utc) - age
    if layer == "raw":
        # As many as failed attempts have left. Settled, as the listing must not change while files go.
        ensure_checkpoint_dir(spark)
        lost = raw_orphans(spark, layout, name, cutoff.replace(tzinfo=None)).select("path").checkpoint()
        if dry_run:
            return lost.count()
        return sum(delete_path(spark, r.path) for r in lost.toLocalIterator())
    found = leftovers(spark, layout, table, cutoff)
    for path in [] if dry_run else found:
        delete_path(spark, path)
    return len(found)


def maintain(
    spark: SparkSession,
    layout: Layout,
    tables: Iterable[str] = (*MAINTAINED_TABLES, MARKS),
    retain_last: int = RETAIN_LAST,
    orphan_age: datetime.timedelta = ORPHAN_AGE,
    dry_run: bool = True,
) -> DataFrame:
    """Run every step on every table; a failing step is reported and the others run.

    Returns one row per table and step.  ``skipped`` stands for a table that is
    not there yet; anything else that goes wrong is ``failed``, with its message.
    """
    steps: list[tuple[str, str, Callable[[], int | None]]] = []
    for table in tables:
        steps.append((table, "expire_snapshots", lambda table=table: expire(spark, layout, table, retain_last, dry_run)))
        steps.append(
            (table, "remove_orphan_files", lambda table=table: remove_orphans(spark, layout, table, orphan_age, dry_run))
        )
    return run_steps(spark, steps)


def run_steps(
    spark: SparkSession,
    steps: Iterable[tuple[str, str, Callable[[], int | None]]],
    limit_s: float = STEP_LIMIT_S,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Run the steps ``(table, step, job)``, some at a time, and report each; jobs return the items that they handled.

    Every step has a thread, a pool of the fair scheduler and a tag of its own. One that is not done after ``limit_s``
    has its Spark jobs cancelled by the tag and is reported as failed, while the others go on.
    """

    def run(task: tuple[int, tuple[str, str, Callable[[], int | None]]]) -> tuple:
        number, (table, step, job) = task
        tag, outcome = f"upkeep-{uuid.uuid4().hex}", []

        def work() -> None:
            spark.sparkContext.addJobTag(tag)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"upkeep-{number % at_once}")
            try:
                outcome.append(("done", job() or 0, ""))
            except Exception as error:
                absent = isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"
                outcome.append(("skipped" if absent else "failed", 0, str(error)))

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        thread.join(limit_s)
        if thread.is_alive():
            spark.sparkContext.cancelJobsWithTag(tag)
            outcome.insert(0, ("failed", 0, f"stopped after {limit_s:g} s"))
        return (table, step, *outcome[0])

    with ThreadPoolExecutor(at_once) as pool:
        report = list(pool.map(run, enumerate(steps)))
    return spark.createDataFrame(report, REPORT_DDL)


def create_tables(spark: SparkSession, database: str, location: str, tables: dict[str, str]) -> None:
    """Create a database and Parquet tables in the catalog unless they exist."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name, ddl in tables.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet LOCATION '{location}/{name}'"
        )
