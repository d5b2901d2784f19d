"""Jobs for spark-submit: ``spark-submit tidefold/jobs.py <job> --root <shared folder> ...``.

stream     RAW and SILVER streams of the captured tables, until stopped
snapshot   initial load of one database table into the change stream
gold       recompute one aggregate and merge it
tick       find the aggregates whose inputs changed and rebuild those
maintain   retention of the log, leftovers, orphan files
check      compare the aggregates with a recomputation
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Sequence

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidefold.operators.capture import snapshot_records
from tidefold.operators.merge import merge_bucketed
from tidefold.operators.reconcile import reconcile
from tidefold.plans.gold import GOLD
from tidefold.plans.maintenance import maintain
from tidefold.plans.refresh import build, refresh, refresh_table
from tidefold.schemas import ENTITIES
from tidefold.session import build_session
from tidefold.sinks.gold import read_gold
from tidefold.sinks.layout import Layout
from tidefold.sources.streams import file_records, kafka_records, topic_of, write_records
from tidefold.sources.tables import jdbc_table
from tidefold.streaming.raw import CADENCE, start_raw
from tidefold.streaming.silver import start_silver


def _records(spark: SparkSession, args: argparse.Namespace, table: str) -> DataFrame:
    topic = topic_of(table, args.topic_prefix)
    if args.bootstrap_servers:
        return kafka_records(
            spark,
            args.bootstrap_servers,
            [topic],
            max_offsets_per_trigger=args.max_records_per_batch,
            min_partitions=args.min_partitions,
        )
    # One folder per topic, so that no query reads the records of another table.
    return file_records(spark, f"{args.landing}/{topic}", args.max_files_per_batch)


def run_stream(spark: SparkSession, args: argparse.Namespace) -> None:
    layout = Layout(args.root)
    trigger = {"availableNow": True} if args.once else CADENCE
    queries = []
    for table in args.tables:
        # Each query has its own checkpoint and so its own position in the topic.
        queries.append(start_raw(_records(spark, args, table), ENTITIES[table], layout, trigger, args.with_position))
        queries.append(start_silver(_records(spark, args, table), ENTITIES[table], layout, trigger, args.with_feed))
    await_all(queries)


def await_all(queries: Sequence[StreamingQuery], poll_s: float = 1.0) -> None:
    """Wait until all queries have ended; the first that fails stops the others and raises."""
    try:
        while any([not query.awaitTermination(poll_s) for query in queries]):
            pass
    except Exception:
        for query in queries:
            query.stop()
        raise


def run_snapshot(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = jdbc_table(
        spark, args.url, args.source, args.partition_column, args.lower_bound, args.upper_bound, args.num_partitions
    )
    now = F.lit(time.time_ns() // 1_000_000)
    records = snapshot_records(rows, ENTITIES[args.table], topic_of(args.table, args.topic_prefix), now)
    if args.bootstrap_servers:
        write_records(records, bootstrap_servers=args.bootstrap_servers)
    else:
        write_records(records, path=f"{args.landing}/{topic_of(args.table, args.topic_prefix)}")


def run_gold(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.catalog_table:
        rows = build(spark, Layout(args.root), args.table)
        merge_bucketed(rows, args.catalog_table, GOLD[args.table][1], args.buckets)
        return
    refresh_table(
        spark, Layout(args.root), args.table, null_safe=args.null_safe, delete_unmatched=args.delete_unmatched
    )


def run_tick(spark: SparkSession, args: argparse.Namespace) -> None:
    for table in refresh(
        spark,
        Layout(args.root),
        null_safe=args.null_safe,
        delete_unmatched=args.delete_unmatched,
        incremental=args.incremental,
    ):
        print(table)


def run_maintain(spark: SparkSession, args: argparse.Namespace) -> None:
    # One row per table and step.
    report = maintain(spark, Layout(args.root), dry_run=not args.apply).collect()
    for row in report:
        print(*row, sep="\t")
    if any(row.status == "failed" for row in report):
        raise SystemExit(1)


def run_check(spark: SparkSession, args: argparse.Namespace) -> None:
    layout = Layout(args.root)
    for table, (ddl, keys) in GOLD.items():
        actual = read_gold(spark, layout, table.split(".")[1], ddl).drop("updated_at")
        expected = build(spark, layout, table).drop("updated_at")
        print(table)
        reconcile(expected, actual, keys).groupBy("status").count().show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name, run):
        sub = jobs.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--root", required=True, help="shared folder of all tables")
        return sub

    def bus(sub):
        sub.add_argument("--topic-prefix", required=True)
        source = sub.add_mutually_exclusive_group(required=True)
        source.add_argument("--bootstrap-servers")
        source.add_argument("--landing", help="folder of JSON lines instead of Kafka, with a folder per topic")

    stream = job("stream", run_stream)
    bus(stream)
    stream.add_argument("--tables", nargs="+", choices=list(ENTITIES), default=list(ENTITIES))
    stream.add_argument("--once", action="store_true", help="process what is there, then stop")
    stream.add_argument("--with-position", action="store_true", help="keep the offset in RAW")
    stream.add_argument("--with-feed", action="store_true", help="keep old and new row images for incremental ticks")
    stream.add_argument("--max-records-per-batch", type=int, help="of a topic")
    stream.add_argument("--max-files-per-batch", type=int, help="of a landing folder")
    stream.add_argument("--min-partitions", type=int, help="tasks that a batch of a topic is split into")

    snapshot = job("snapshot", run_snapshot)
    bus(snapshot)
    snapshot.add_argument("--table", required=True, choices=list(ENTITIES))
    snapshot.add_argument("--url", required=True)
    snapshot.add_argument("--source", required=True, help="table name in the database")
    snapshot.add_argument("--partition-column")
    snapshot.add_argument("--lower-bound")
    snapshot.add_argument("--upper-bound")
    snapshot.add_argument("--num-partitions", type=int)

    for name, run in (("gold", run_gold), ("tick", run_tick)):
        sub = job(name, run)
        sub.add_argument("--null-safe", action="store_true")
        sub.add_argument("--delete-unmatched", action="store_true")
        if name == "gold":
            sub.add_argument("--table", required=True, choices=list(GOLD))
            sub.add_argument("--catalog-table", help="merge into this table of the catalog instead, bucketed by its keys")
            sub.add_argument("--buckets", type=int, default=64, help="of the catalog table")
        else:
            sub.add_argument("--incremental", action="store_true", help="by row images; streams run --with-feed from the start")

    job("maintain", run_maintain).add_argument("--apply", action="store_true", help="delete; default is a dry run")
    job("check", run_check)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    session = spark or build_session(f"tidefold-{args.job}")
    args.run(session, args)
    if spark is None:
        session.stop()


if __name__ == "__main__":
    main()
