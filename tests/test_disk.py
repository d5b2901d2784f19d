"""What the landed streams leave on disk."""

from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F
from records import SALES, document, records, row
from test_landing import directory  # noqa: F401
from test_streams import DOCUMENTS, NOW, expected, land

from tidefold.operators.envelope import decode_changelog
from tidefold.plans import queries, standins
from tidefold.schemas import ORDER, RECORD_DDL
from tidefold.session import SHUFFLE_CLEANUP, shuffles_removed
from tidefold.sinks.layout import path_exists
from tidefold.sources.streams import file_records
from tidefold.streaming.keyed import newest_changes, read_keyed_live, start_keyed


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_landing_needs_no_shuffle_of_its_own_and_splits_long_files(spark, directory, monkeypatch):  # noqa: F811
    landed = []
    real = standins.land
    monkeypatch.setattr(standins, "RECORDS_PER_FILE", 10)
    monkeypatch.setattr(standins, "land", lambda df, path: landed.append(df) or real(df, path))
    path, files = standins.land_table(spark, directory, "sales_transactions", 3)
    assert "Repartition" not in optimized(landed[0])
    sizes = [r["count"] for r in spark.read.schema(RECORD_DDL).json(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 61 and max(sizes) <= 10 and -(-len(sizes) // 3) <= files <= len(sizes)


def test_what_follows_from_other_fields_is_made_after_the_join(spark, directory):  # noqa: F811
    after, before = optimized(standins.sale_stream(spark, directory)).split("Join", 1)
    assert all(f"AS {name}#" in after and f"AS {name}#" not in before for name in ("txn_id", "offset", "status"))
    plain = standins.with_customer(spark, directory, standins.sale_changes(spark, directory)).drop("shipped_at")
    assert values(standins.sale_stream(spark, directory).select(*plain.columns)) == values(plain)


def test_a_landed_stream_goes_when_it_has_been_read(spark, directory, layout, monkeypatch):  # noqa: F811
    made = []
    real = standins.land_table
    monkeypatch.setattr(standins, "land_table", lambda *a: made.append(real(*a)) or made[0])
    with queries._stream(spark, directory, "sales_transactions") as stream:
        assert path_exists(spark, made[0][0])
        start_keyed(stream, standins.SALES, layout, NOW).awaitTermination()
    assert read_keyed_live(spark, layout, standins.SALES).count() > 0 and not path_exists(spark, made[0][0])


def test_files_that_are_read_once_go_batch_by_batch(spark, layout):
    inbox = land(spark, DOCUMENTS, 5)
    before = len(spark.read.json(inbox).inputFiles())
    stream = file_records(spark, inbox, max_files_per_trigger=1, read_once=True)
    start_keyed(stream, SALES, layout, NOW).awaitTermination()
    assert values(read_keyed_live(spark, layout, SALES)) == expected(spark)
    assert len(spark.read.json(inbox).inputFiles()) < before


@pytest.mark.parametrize("chosen", [None, "false"])
def test_shuffles_go_with_their_write_unless_the_submitter_chose(spark, chosen):
    if chosen:
        spark.conf.set(SHUFFLE_CLEANUP, chosen)
    try:
        with shuffles_removed(spark):
            assert spark.conf.get(SHUFFLE_CLEANUP) == (chosen or "true")
        assert spark.conf.get(SHUFFLE_CLEANUP, None) == chosen
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP)


def test_the_state_holds_key_and_order_once(spark):
    documents = [document("c", None, row(1, qty=1), 5), document("u", row(1), row(1, qty=2), 5), document("d", row(1), None, 4)]
    found = newest_changes(decode_changelog(records(spark, documents), SALES), SALES)
    assert "txn_id" not in found.schema["newest"].dataType.names
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan and [(r.newest.op, r.newest.qty) for r in found.collect()] == [("u", 2)]
    assert found.schema["newest"].dataType.names[:2] == list(ORDER)
