"""Change data capture on Spark: change streams to an audit log, current state and aggregates."""

from tidefold.operators.capture import snapshot_diff, snapshot_envelope
from tidefold.operators.changelog import change_log, change_log_rollup
from tidefold.operators.envelope import decode, decode_changelog
from tidefold.operators.governance import governed_view, select_as
from tidefold.operators.impact import impacted, next_watermark
from tidefold.operators.merge import insert_if_absent, merge, merge_into_table
from tidefold.operators.reconcile import reconcile
from tidefold.operators.retention import expired_snapshots, orphans
from tidefold.operators.state import apply_delta, current_state
from tidefold.plans.gold import customer_loyalty as build_customer_loyalty
from tidefold.plans.gold import sales_summary as build_sales_summary
from tidefold.plans.maintenance import maintain
from tidefold.plans.refresh import refresh
from tidefold.session import build_session
from tidefold.sinks.layout import Layout
from tidefold.streaming.raw import start_raw as raw_ingest
from tidefold.streaming.silver import start_silver as silver_upsert

__all__ = [
    "Layout",
    "apply_delta",
    "build_customer_loyalty",
    "build_sales_summary",
    "build_session",
    "change_log",
    "change_log_rollup",
    "current_state",
    "decode",
    "decode_changelog",
    "expired_snapshots",
    "governed_view",
    "impacted",
    "insert_if_absent",
    "maintain",
    "merge",
    "merge_into_table",
    "next_watermark",
    "orphans",
    "raw_ingest",
    "reconcile",
    "refresh",
    "select_as",
    "silver_upsert",
    "snapshot_diff",
    "snapshot_envelope",
]
