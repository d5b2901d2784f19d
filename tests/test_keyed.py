from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F
from records import SALES, document, records, row
from test_streams import DOCUMENTS, NOW, expected, land

from tidefold.operators.envelope import decode_changelog
from tidefold.operators.state import latest_per_key
from tidefold.schemas import ORDER
from tidefold.sources.streams import file_records
from tidefold.streaming.keyed import PROVIDER, read_keyed, read_keyed_live, start_keyed


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_state_equals_the_fold(spark, layout, batches):
    before = spark.conf.get(PROVIDER, None)
    seen = []
    inbox = land(spark, DOCUMENTS, batches)
    each = lambda changed, batch: seen.append(changed.count())
    start_keyed(file_records(spark, inbox, max_files_per_trigger=1), SALES, layout, NOW, each).awaitTermination()
    assert spark.conf.get(PROVIDER, None) == before
    assert values(read_keyed_live(spark, layout, SALES)) == expected(spark)
    # Live keys and markers, and nothing else.
    folded = latest_per_key(decode_changelog(records(spark, DOCUMENTS), SALES), SALES.keys, ORDER)
    assert values(read_keyed(spark, layout, SALES).select("op", *SALES.keys, *ORDER)) == values(folded.select("op", *SALES.keys, *ORDER))
    assert len([n for n in seen if n]) == batches


def test_state_survives_a_restart_and_late_changes(spark, layout):
    inbox = land(spark, DOCUMENTS[5:], 2)
    start_keyed(file_records(spark, inbox), SALES, layout, NOW).awaitTermination()
    records(spark, DOCUMENTS).filter(F.col("offset") < 5).withColumn("offset", F.col("offset") - 100).write.mode("append").json(inbox)
    start_keyed(file_records(spark, inbox), SALES, layout, NOW).awaitTermination()
    shifted = records(spark, DOCUMENTS[5:]).unionByName(
        records(spark, DOCUMENTS).filter(F.col("offset") < 5).withColumn("offset", F.col("offset") - 100)
    )
    folded = latest_per_key(decode_changelog(shifted, SALES), SALES.keys, ORDER)
    assert values(read_keyed(spark, layout, SALES)) == values(folded.select("op", *SALES.columns, *ORDER))
    more = records(spark, [document("d", row(30), None, 99)]).withColumn("offset", F.lit(500).cast("long"))
    more.write.mode("append").json(inbox)
    start_keyed(file_records(spark, inbox), SALES, layout, NOW).awaitTermination()
    assert read_keyed(spark, layout, SALES).filter("txn_id = 30").first().op == "d"
