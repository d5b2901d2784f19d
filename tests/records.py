"""Hand-written change records of the sales table."""

from __future__ import annotations

import json

from tidefold.schemas import RECORD_DDL, SALES_TRANSACTIONS

SALES = SALES_TRANSACTIONS


def row(txn_id, **fields):
    return {**dict.fromkeys(SALES.columns), "txn_id": txn_id, **fields}


def document(op, before=None, after=None, ts_ms=1):
    return json.dumps({"op": op, "before": before, "after": after, "source": {"ts_ms": ts_ms}, "ts_ms": ts_ms})


def records(spark, documents):
    """Stream records with offsets 0, 1, ... in the given order."""
    data = [(None, doc, "t", 0, offset, None) for offset, doc in enumerate(documents)]
    return spark.createDataFrame(data, RECORD_DDL)
