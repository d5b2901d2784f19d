"""Near-duplicates by SimHash, found through an inverted index of byte positions.

Two fingerprints of 64 bits that differ in at most two bits share at least six
of their eight bytes at the same positions.  A posting list of one position and
byte holds 1/256 of all fingerprints, so pairs drawn from it would grow with
the square of the input.  The index therefore posts conjunctions: the eight
positions form four blocks of two, at most two blocks can differ, so a pair
within reach shares the four bytes of some two blocks.  For each pair that
meets in a list the shared positional bytes are tallied, pairs below the
guaranteed minimum of six go, and the others are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import matched, missing, settled
from tidefold.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BLOCKS = 4
# Longer posting lists are linked by shared neighbours instead of pair by pair.
LIST_LENGTH = 64


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The hashes of all shingles of one word or more, in order; fewer than ``width`` words are one shingle."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text as a signed number; 0 without words."""
    words = (text or b"").lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    hashes = shingle_hashes(words, width)
    if len(words) <= width:
        return int(hashes.view(np.int64)[0])
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounds the memory of a very long text
        rows = hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text) and ``fp`` of every row, computed where the row is read."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), width) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "mark", "fp"])

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"),
        F.col(text).cast("binary").alias("text"),
    )
    return rows.mapInArrow(compute, "doc_id long, mark long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(0xFF))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    differing = a.bitwiseXOR(b)
    tally = F.lit(0)
    for position in range(8):
        tally = tally + (_byte(differing, position) == 0).cast("int")
    return tally


def _postings(fps: DataFrame) -> DataFrame:
    """One row for each fingerprint and pair of blocks."""
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(BLOCKS)]
    keys = [
        F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _by_neighbours(fps: DataFrame) -> DataFrame:
    """Links of fingerprints with a shared neighbour at one bit or less.

    Two fingerprints differ in at most two bits exactly if such a neighbour
    exists.  Every member of a neighbour is linked with its smallest one, which
    connects the same fingerprints as all pairs do, with 65 rows for each.
    """
    flips = [F.lit(0)] + [F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]
    near = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("spot"))
    least = near.groupBy("spot").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return near.join(least, "spot").select(F.col("fp").alias("a"), "b").filter("a != b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints at two differing bits or less.

    Every such pair is connected through links.  Lists of up to LIST_LENGTH fingerprints give their pairs, the
    members of longer ones are linked by their neighbours.
    """
    postings = _postings(fps)
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = settled(postings.join(lists, "key"))
    short = met.filter(F.col("n") <= LIST_LENGTH).select("key", "fp")
    least_shared = 8 - MAX_BITS
    pairs = short.alias("x").join(
        short.alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (shared_bytes(F.col("x.fp"), F.col("y.fp")) >= least_shared),
    )
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    verified = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    crowded = met.filter(F.col("n") > LIST_LENGTH).select("fp").distinct()
    return verified.unionByName(_by_neighbours(crowded))


def _grouped(rows: DataFrame) -> DataFrame:
    """The distinct fingerprints of ``rows`` with the ``root`` of their group, the ``least`` id that has them, and
    the ``first`` document (``last`` is true for a NULL id) in the order of ids."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(order).alias("first"))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots, distinct.fp == roots.id, "left")
    return placed.select("fp", "least", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE
) -> DataFrame:
    """The fingerprint of every row and the group of near-duplicates that it is in.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` that links at
    two differing bits or less reach.  Copies share a fingerprint and are handled once.

    * NULL, empty or blank text: fingerprint zero, linked like any other.
    * NULL ``doc_id``: the row is in the result; a group of such rows alone has a NULL ``component_id``.
    * Repeated rows give repeated rows.  Equal ids with different texts keep one row for each text.
    * Very long texts are read whole, 65536 shingles at a time.
    * Other columns are ignored, whatever their names.  An empty table gives no rows.
    """
    missing(docs, doc_id, text)
    rows = settled(fingerprints(docs, doc_id, text, width))
    placed = _grouped(rows)
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(groups, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, with all its columns.

    A NULL id comes last; of several texts with the smallest id one stays, chosen by a hash. Repeated rows are
    duplicates, too: one of them stays. Documents without words are one group. Otherwise as ``near_duplicates``.
    """
    missing(docs, doc_id, text)
    rows = settled(fingerprints(docs, doc_id, text, width))
    chosen = _grouped(rows).groupBy("root").agg(F.min("first").alias("k"))
    chosen = chosen.select(F.col("k.doc_id").alias("id"), F.col("k.mark").alias("mark"))
    return matched(docs, chosen, doc_id, text).select("row.*")
