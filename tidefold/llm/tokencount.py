"""Token counts of sections, from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.bpe import Encoder, default_path
from tidefold.llm.common import missing

RULES = ("first", "last", "most", "split")
ROWS_AT_ONCE = 20_000
SCHEMA = "row {row}, section long, start long, end long, tokens double, doc_tokens long"


def line_spans(text: str) -> np.ndarray:
    """A section for each line, its line break included; none for an empty text."""
    if not text:
        return np.zeros((0, 2), np.int64)
    ends = np.cumsum([len(line) + 1 for line in text.split("\n")])
    ends[-1] -= 1
    starts = np.concatenate([[0], ends[:-1]])
    return np.stack([starts, ends], axis=1)[starts < ends]


def attribute(first: np.ndarray, last: np.ndarray, spans: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; the last number counts those outside of all sections.

    ``first`` and ``last`` are the characters that each token covers, both in ascending order, ``spans`` the start and
    end of sections that are sorted and do not overlap. A token that touches one section belongs to it. One that
    touches several goes to the first of them, the last, the one with most of its characters (ties to the earlier),
    or in proportion to the characters.
    """
    counts = np.zeros(len(spans) + 1)
    if not len(first):
        return counts
    starts, ends = spans[:, 0], spans[:, 1]
    low = np.searchsorted(ends, first, side="right")  # the first section that ends behind the token's start
    high = np.searchsorted(starts, last, side="right") - 1  # the last section that starts before its end
    outside = low > high
    counts[-1] = outside.sum()
    if rule == "first":
        chosen = low[~outside]
    elif rule == "last":
        chosen = high[~outside]
    else:
        chosen = low[~outside & (low == high)]
        for k in np.flatnonzero(low < high):
            sections = np.arange(low[k], high[k] + 1)
            shared = np.minimum(ends[sections], last[k] + 1) - np.maximum(starts[sections], first[k])
            if rule == "most":
                counts[sections[np.argmax(shared)]] += 1
            else:
                counts[sections] += shared / shared.sum()
    np.add.at(counts, chosen, 1)
    return counts


def token_counts(
    docs: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    spans: str | None = None,
    rule: str = "most",
    tokenizer: str | None = None,
) -> DataFrame:
    """Count the tokens of each section of a document.

    A document is encoded once, as a whole. Each token covers characters of the text; an interval join of these with
    the document's sections, both sorted, gives every token to a section, by ``rule`` (see ``attribute``) where it
    crosses a boundary. ``spans`` names a column of ``array<struct<start,end>>`` with character positions, sorted and
    without overlap; without it the lines are the sections. Returns ``keys``, ``section`` (from 0; NULL for tokens
    outside of all sections, if there are any), ``start``, ``end``, ``tokens`` (a fraction only under ``split``) and
    ``doc_tokens``. The tokens of a document's rows sum up to ``doc_tokens``.

    * NULL or empty text: one row with a NULL section and no tokens.
    * NULL spans count as none; empty spans get no tokens unless they lie within one.
    * A character whose bytes make several tokens counts for each of them.
    * NULL keys and repeated rows are kept. Very long texts are encoded whole; a task holds one at a time.
    * Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    missing(docs, text, *keys, *([spans] if spans else []))
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    path = tokenizer or default_path()
    sections = F.col(spans) if spans else F.lit(None)
    rows = docs.select(
        F.struct(*keys).alias("row"), F.col(text).cast("string").alias("text"),
        sections.cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
    )
    schema = SCHEMA.format(row=rows.schema["row"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            at, columns, held = [], [[], [], [], [], []], 0

            def flush(batch=batch, at=at, columns=columns):
                taken = batch.column(0).take(pa.array(np.concatenate(at), pa.int64()))
                flat = [np.concatenate(c) for c in columns]
                none = flat[0] < 0
                arrays = [pa.array(c, pa.int64(), mask=none) for c in flat[:3]]
                arrays += [pa.array(flat[3], pa.float64()), pa.array(flat[4], pa.int64())]
                return pa.RecordBatch.from_arrays([taken, *arrays], NAMES)

            for k in range(len(batch)):
                body = batch.column(1)[k].as_py() or ""
                own = line_spans(body)
                if spans:
                    given = batch.column(2)[k].as_py() or []
                    own = np.array([(s["start"], s["end"]) for s in given], np.int64).reshape(-1, 2)
                first, last = encoder.spans(body)
                counts = attribute(first, last, own, rule)
                number = np.arange(len(counts))
                number[-1] = -1
                if counts[-1] == 0 and len(own):
                    counts, number = counts[:-1], number[:-1]
                edges = np.concatenate([own, np.zeros((len(counts) - len(own), 2), np.int64)])
                at.append(np.full(len(counts), k))
                for column, values in zip(
                    columns, (number, edges[:, 0], edges[:, 1], counts, np.full(len(counts), len(first))), strict=True
                ):
                    column.append(values)
                held += len(counts)
                if held >= ROWS_AT_ONCE:
                    yield flush()
                    held = 0
                    at.clear()
                    for column in columns:
                        column.clear()
            if held:
                yield flush()

    return rows.mapInArrow(run, schema).select("row.*", "section", "start", "end", "tokens", "doc_tokens")


NAMES = ["row", "section", "start", "end", "tokens", "doc_tokens"]
