from __future__ import annotations

import datetime
import json

from conftest import plan_of, values
from pyspark.sql import functions as F
from records import SALES, document, records, row

from tidefold.operators.envelope import decode_changelog
from tidefold.operators.retention import expired_snapshots, orphans
from tidefold.plans import maintenance
from tidefold.plans.maintenance import create_tables, expire, leftovers, maintain, raw_orphans, remove_orphans, run_steps
from tidefold.plans.refresh import store_marks
from tidefold.schemas import SALES_SUMMARY_DDL
from tidefold.sinks import silver as silver_module
from tidefold.sinks.gold import publish_gold, read_gold
from tidefold.sinks.layout import path_exists
from tidefold.sinks.silver import commit_batch, read_change_log, read_silver
from tidefold.sources.streams import file_records
from tidefold.streaming.raw import start_raw

NO_AGE = datetime.timedelta(days=-1)


def history(spark, counts):
    rows = [(t, i, i) for t, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "table_name STRING, snapshot_id BIGINT, s INT")
    return df.withColumn("committed_at", F.timestamp_seconds("s")).drop("s")


def test_newest_snapshots_of_each_table_are_kept(spark):
    found = expired_snapshots(history(spark, {"a": 12, "b": 10, "c": 3}))
    assert values(found.select("table_name", "snapshot_id")) == [("a", 0), ("a", 1)]


def test_cutoff_protects_young_snapshots(spark):
    cutoff = datetime.datetime(1970, 1, 1, 0, 0, 1)
    found = expired_snapshots(history(spark, {"a": 12}), older_than=cutoff)
    assert values(found.select("snapshot_id")) == [(0,)]


def test_equal_times_are_decided_by_the_id(spark):
    tied = history(spark, {"a": 5}).withColumn("committed_at", F.timestamp_seconds(F.lit(1)))
    assert values(expired_snapshots(tied, 2).select("snapshot_id")) == [(0,), (1,), (2,)]


def test_history_is_not_ranked_as_a_whole(spark):
    plan = plan_of(expired_snapshots(history(spark, {"a": 5}), 2))
    assert "Window" not in plan and "BroadcastHashJoin" in plan


def test_orphans_are_what_nothing_refers_to(spark):
    listing = spark.createDataFrame(
        [("file:///t/a", 1), ("file:///t/b", 1), ("file:///t/c", 99)], "path STRING, s INT"
    ).select("path", F.timestamp_seconds("s").alias("modified_at"))
    referenced = spark.createDataFrame([("file:/t/a",)], "path STRING")
    assert values(orphans(listing, referenced).select("path")) == [("file:///t/b",), ("file:///t/c",)]
    limited = orphans(listing, referenced, datetime.datetime(1970, 1, 1, 0, 1))
    assert values(limited.select("path")) == [("file:///t/b",)]


def commit(spark, layout, batch):
    docs = [document("c", None, row(batch, qty=batch), batch), document("u", None, row(1000, qty=batch), batch)]
    changes = decode_changelog(records(spark, docs), SALES)
    commit_batch(spark, layout, SALES, changes, batch, F.timestamp_seconds(F.lit(batch)))


def batches_of(spark, layout):
    return sorted(r.snapshot_id for r in read_change_log(spark, layout).select("snapshot_id").distinct().collect())


def test_retention_drops_folders_of_old_batches(spark, layout, monkeypatch):
    for module in (silver_module, maintenance):
        monkeypatch.setattr(module, "PERIOD", 2)
    for batch in range(7):
        commit(spark, layout, batch)
    rows = values(read_silver(spark, layout, SALES))
    name = "silver.sales_transactions"
    assert expire(spark, layout, name, retain_last=2) == 4  # dry run; the batch 4 lies with 5
    assert batches_of(spark, layout) == list(range(7))
    assert expire(spark, layout, name, retain_last=2, dry_run=False) == 4
    assert batches_of(spark, layout) == [4, 5, 6] and values(read_silver(spark, layout, SALES)) == rows
    assert expire(spark, layout, name, retain_last=2, dry_run=False) == 0
    assert expire(spark, layout, "gold.sales_summary") == expire(spark, layout, "raw.sales_transactions") == 0


def test_a_log_that_no_tick_has_read_is_kept(spark, layout, monkeypatch):
    for module in (silver_module, maintenance):
        monkeypatch.setattr(module, "PERIOD", 2)
    for batch in range(8):
        commit(spark, layout, batch)
    store_marks(spark, layout, {"sales_transactions": 2})
    assert expire(spark, layout, "silver.sales_transactions", retain_last=2, dry_run=False) == 2
    assert batches_of(spark, layout) == list(range(2, 8))


def test_planted_files_are_found_and_nothing_else(spark, layout):
    inbox = f"{layout.root}/inbox"
    records(spark, [document("c", None, row(1)), document("c", None, row(2))]).write.json(inbox)
    start_raw(file_records(spark, inbox), SALES, layout, {"availableNow": True}).awaitTermination()
    commit(spark, layout, 0)
    commit(spark, layout, 1)
    df = spark.createDataFrame([(1, 2, 3, 4.0, 5, None)], SALES_SUMMARY_DDL)
    publish_gold(spark, layout, "sales_summary", df)
    far = datetime.datetime(2100, 1, 1)
    raw, silver, gold = "raw.sales_transactions", "silver.sales_transactions", "gold.sales_summary"
    assert raw_orphans(spark, layout, "sales_transactions").count() == 0
    assert leftovers(spark, layout, silver, far) == leftovers(spark, layout, gold, far) == []

    df.write.parquet(f"{layout.raw('sales_transactions')}/ingest_date=2020-01-01")  # unknown to the sink's log
    df.write.parquet(f"{layout.table(silver)}/.spark-staging-lost")  # what a lost job leaves
    df.write.parquet(layout.staged(gold))
    for table in (raw, silver, gold):
        assert remove_orphans(spark, layout, table) == 0  # too young
        found = remove_orphans(spark, layout, table, NO_AGE)
        assert found >= 1
        assert remove_orphans(spark, layout, table, NO_AGE, dry_run=False) == found
        assert remove_orphans(spark, layout, table, NO_AGE) == 0
    assert read_silver(spark, layout, SALES).count() == 3
    assert read_gold(spark, layout, "sales_summary", SALES_SUMMARY_DDL).count() == 1
    assert spark.read.parquet(layout.raw("sales_transactions")).count() == 2


def test_a_failing_step_does_not_stop_the_others(spark, layout):
    commit(spark, layout, 0)
    report = {
        (r.table_name, r.step): (r.status, r.items)
        for r in maintain(
            spark, layout, ["raw.customers", "silver.sales_transactions"], dry_run=False, orphan_age=NO_AGE
        ).collect()
    }
    assert report == {
        ("raw.customers", "expire_snapshots"): ("done", 0),
        ("raw.customers", "remove_orphan_files"): ("skipped", 0),
        ("silver.sales_transactions", "expire_snapshots"): ("done", 0),
        ("silver.sales_transactions", "remove_orphan_files"): ("done", 0),
    }


def test_only_an_absent_table_is_skipped(spark):
    def denied():
        raise PermissionError("no access to the table\n" + "x" * 500)

    report = run_steps(spark, [("a", "s", denied), ("b", "s", lambda: None), ("c", "s", lambda: spark.read.parquet("/nowhere").count())])
    found = {r.table_name: r for r in report.collect()}
    assert (found["a"].status, found["b"].status, found["c"].status) == ("failed", "done", "skipped")
    assert found["a"].message.endswith("x" * 500)


def test_a_hanging_step_is_stopped_and_the_others_end(spark):
    import time

    def endless():
        return spark.range(0, 1 << 40, 1, 1).selectExpr("sum(id % 7)").collect()[0][0]  # one task, so that others find room

    started = time.monotonic()
    steps = [("a", "hang", endless), ("b", "quick", lambda: spark.range(5).count()), ("c", "quick", lambda: 2)]
    report = {r.table_name: r for r in run_steps(spark, steps, limit_s=12, at_once=2).collect()}
    assert time.monotonic() - started < 60
    assert (report["a"].status, report["b"].status, report["c"].status) == ("failed", "done", "done")
    assert "stopped after 12 s" in report["a"].message and report["b"].items == 5
    deadline = time.monotonic() + 30
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()  # its job is cancelled


def test_tables_are_created_once(spark, layout):
    database = "created_" + layout.root.rsplit("-", 1)[1]
    for _ in range(2):
        create_tables(spark, database, layout.root, {"sales_summary": SALES_SUMMARY_DDL})
    spark.createDataFrame([(1, 2, 3, 4.0, 5, None)], SALES_SUMMARY_DDL).write.insertInto(f"{database}.sales_summary")
    create_tables(spark, database, layout.root, {"sales_summary": SALES_SUMMARY_DDL})
    assert spark.table(f"{database}.sales_summary").count() == 1
    assert json.loads(spark.table(f"{database}.sales_summary").schema.json())["fields"][0]["name"] == "store_id"
