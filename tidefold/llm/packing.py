"""Packing documents into sequences of balanced attention cost."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.bpe import Encoder, default_path
from tidefold.llm.common import missing

SIZE = 1024
END_ID = 0
# Documents whose remainders are packed together: bounds the memory of a task.
GROUP = 4096
# Cost of attention within a piece of n tokens: n + n * n / QUADRATIC_AT.
QUADRATIC_AT = 6144

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cost(tokens: int) -> float:
    return tokens + tokens * tokens / QUADRATIC_AT


def capacities(tokens: int, size: int) -> list[int]:
    """Full sequences and, for what is left, powers of two: together exactly ``tokens``."""
    full, rest = divmod(tokens, size)
    tail = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    return [size] * full + tail


class Sequences:
    """Sequences with room left, and the cheapest of those that have a given room at least.

    A heap for each room holds (cost, sequence); a tree over the rooms holds the least of the heaps below each node.
    """

    NONE = (float("inf"), -1)

    def __init__(self, size: int) -> None:
        self.width = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        self.tree = [self.NONE] * (2 * self.width)

    def _lift(self, room: int) -> None:
        at = room + self.width
        self.tree[at] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while at > 1:
            at >>= 1
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def put(self, room: int, cost: float, sequence: int) -> None:
        heappush(self.heaps[room], (cost, sequence))
        self._lift(room)

    def take(self, least_room: int, rooms: list[int]) -> tuple[float, int] | None:
        """Remove the cheapest with ``least_room``; of equal costs the first. None if none has it."""
        at = least_room + self.width
        best = self.tree[at]
        while at > 1:  # the right siblings on the way up cover all larger rooms
            if not at & 1:
                best = min(best, self.tree[at + 1])
            at >>= 1
        if best is self.NONE:
            return None
        heappop(self.heaps[rooms[best[1]]])
        self._lift(rooms[best[1]])
        return best


def assign(lengths: list[int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces ``(item, start, length, sequence, offset)`` of the items, and how many sequences they fill.

    Descending items go to the sequence of the lowest cost that has room for all of the item; of equal costs the first.
    If none has, the cheapest of all is filled and the rest goes on by the same rule, so nothing is padded.
    """
    room = capacities(sum(lengths), size)
    waiting = Sequences(size)
    for s, r in enumerate(room):
        waiting.put(r, 0.0, s)
    filled, pieces = [0] * len(room), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            spent, s = waiting.take(left, room) or waiting.take(1, room)
            taken = min(left, room[s])
            pieces.append((item, start, taken, s, filled[s]))
            start, left, room[s], filled[s] = start + taken, left - taken, room[s] - taken, filled[s] + taken
            if room[s]:
                waiting.put(room[s], spent + cost(taken), s)
    return pieces, len(filled)


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, tokenizer: str | None = None
) -> DataFrame:
    """Cut the tokens of all documents into sequences of at most ``size`` tokens.

    A document is its tokens and a closing ``END_ID``. Whole stretches of ``size`` tokens are sequences of their own;
    the remainders of GROUP documents at a time are assigned, longest first, to the sequence of the lowest estimated
    attention cost (linear plus quadratic, as attention stays within a piece) with room. Sequences have ``size``
    tokens or, for the few tokens at the end of a group, a power of two; none is padded. The work stays in the task
    that reads the documents, so nothing is shuffled, and a lost task is repeated alone.

    Returns for each piece: ``doc_id``, ``start`` (tokens of the document before it), ``length``, ``ids`` (binary,
    little-endian unsigned 32 bits), ``doc_tokens``, ``sequence_id``, ``offset`` within the sequence.

    * NULL and empty texts are documents of the closing id alone. NULL ids are kept.
    * Repeated rows are packed as often as they occur. Ties are settled by the order in which rows are read.
    * Very long texts are cut like any other. Other columns are ignored, whatever their names.
    * An empty table gives no rows.
    """
    missing(docs, doc_id, text)
    path = tokenizer or default_path()
    full, end = 4 * size, END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def close() -> None:
            nonlocal sequence
            pieces, n = assign([len(ids) // 4 for _, _, ids, _ in waiting], size)
            for item, start, length, s, offset in pieces:
                name, before, ids, total = waiting[item]
                part = ids[4 * start : 4 * (start + length)]
                rows.append((name, before + start, length, part, total, sequence + s, offset))
            sequence += n
            waiting.clear()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, NAMES)

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(body.as_py() or "").tobytes() + end
                total, at = len(ids) // 4, 0
                while len(ids) - at >= full:
                    rows.append((name, at // 4, size, ids[at : at + full], total, sequence, 0))
                    sequence, at = sequence + 1, at + full
                if at < len(ids):
                    waiting.append((name, at // 4, ids[at:], total))
                if len(waiting) >= GROUP:
                    close()
                if len(rows) >= 2 * GROUP:
                    yield flush()
        close()
        if rows:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "binary": pa.binary()}[part.split()[1]] for part in SCHEMA.split(", ")]
