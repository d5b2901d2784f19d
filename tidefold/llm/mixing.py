"""Mixing sources to target weights by entropy balancing.

Every source has a target of words. Among all rates that meet the targets, the
balanced ones are closest in relative entropy to taking each document once.
They tilt exponentially with a document's size, ``exp(multiplier * size)``, and
stop at the largest number of copies. The multipliers solve a convex dual
problem, whose derivative is the target less the words taken; Newton steps find
the root for all sources at once, each a distributed sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import matched, missing, settled, words_of

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
STEPS = 40
TOLERANCE = 1e-11
# Documents of one source and size are ranked in parts of about this many.
PART = 2000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT) -> DataFrame:
    """A target for each source of ``sizes`` (``source``, ``source_size``).

    Sources in the order of code points, NULL last, weigh ``weights`` in turn and share ``percent`` of all sizes. A
    target stops at MOST_COPIES times its source's size; the excess is shared again by weight until none is above.
    Sums are of whole numbers, so every run gives the same targets.
    """
    ordered = sizes.orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex()
    schema = "source string, source_size long, place long"
    ranked = sizes.sparkSession.createDataFrame(ordered.map(lambda r: (r[0][0], r[0][1], r[1])), schema)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = settled(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    limit = F.col("source_size") * MOST_COPIES
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit = None  # words for a weight of one
    while True:
        full = F.lit(False) if unit is None else unit * F.col("weight") >= limit
        held = ranked.agg(
            F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        fresh = (percent * total / 100 - (held[0] or 0)) / held[1] if held[1] else unit
        if fresh == unit or fresh is None:
            break
        unit = fresh
    share = F.lit(0.0) if unit is None else F.lit(float(unit)) * F.col("weight")
    return ranked.withColumn("target", F.least(share, limit.cast("double"))).drop("weight")


def _rate(multiplier: Column, size: Column) -> Column:
    return F.least(F.lit(float(MOST_COPIES)), F.exp(multiplier * size))


def multipliers(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tilt of each source: ``wanted`` (``source_key``, ``target``, ``source_size``) with ``multiplier``.

    ``cells`` holds how many documents ``n`` of each ``size`` a ``source_key`` has. A Newton step that leaves the
    interval known to hold the root is replaced by its middle, and so is every step after the first STEPS: the
    iteration cannot run away, and it ends only when all sources have converged.
    """
    least = cells.filter("size > 0").groupBy("source_key").agg(F.min("size").alias("least"))
    state = wanted.join(least, "source_key").filter("target > 0")
    ratio = F.log(F.col("target") / F.col("source_size")) / F.col("least")
    state = state.select(
        "source_key", "target", F.lit(0.0).alias("multiplier"), F.least(ratio, F.lit(0.0)).alias("lo"),
        (F.lit(log(MOST_COPIES)) / F.col("least")).alias("hi"),
    )
    state, steps = settled(state), 0
    while True:
        rate = _rate(F.col("multiplier"), F.col("size"))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < MOST_COPIES, words * F.col("size")).otherwise(0.0)
        sums = (
            cells.join(state, "source_key")
            .groupBy("source_key", "target", "multiplier", "lo", "hi")
            .agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        )
        high = F.col("words") > F.col("target")
        lo, hi = F.when(high, F.col("lo")).otherwise(F.col("multiplier")), F.when(high, F.col("multiplier")).otherwise(F.col("hi"))
        step = F.col("multiplier") + (F.col("target") - F.col("words")) / F.nullif("slope", F.lit(0.0))
        steps, middle = steps + 1, (lo + hi) / 2
        # After STEPS the interval is halved each time, until no number lies within it.
        inside = F.coalesce((step > lo) & (step < hi), F.lit(False)) & F.lit(steps <= STEPS)
        done = F.abs(F.col("words") - F.col("target")) <= F.lit(TOLERANCE) * F.col("target")
        done = done | (F.lit(steps > STEPS) & ((middle <= lo) | (middle >= hi)))
        state = settled(
            sums.select(
                "source_key", "target",
                F.when(done, F.col("multiplier")).when(inside, step).otherwise(middle).alias("multiplier"),
                F.when(done, F.col("lo")).otherwise(lo).alias("lo"), F.when(done, F.col("hi")).otherwise(hi).alias("hi"),
                done.alias("done"),
            )
        )
        if state.filter(~F.col("done")).isEmpty():
            return state.select("source_key", "multiplier")


def round_cells(size: np.ndarray, n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Copies for all documents of each cell together, so that the words come to those of the rates.

    Large sizes go first and hand what rounding leaves to the smaller ones. The documents of a cell get the whole
    copies below or above their rate.
    """
    taken = np.zeros(len(n), np.int64)
    carried = 0.0
    for k in np.argsort(-size, kind="stable"):
        low, high = int(np.floor(rate[k])) * n[k], int(np.ceil(rate[k])) * n[k]
        due = n[k] * rate[k] * size[k] + carried
        taken[k] = min(max(round(due / size[k]) if size[k] else n[k], low), high)
        carried = due - taken[k] * size[k]
    return taken


def _rounded(cells: DataFrame) -> DataFrame:
    """``copies`` of each cell. A group is the sizes of one source: k distinct sizes need k * k / 2 words at least."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", kind="stable")
        copies = round_cells(*(frame[c].to_numpy() for c in ("size", "n", "rate")))
        return frame[["source_key", "size"]].assign(copies=copies)

    return cells.groupBy("source_key").applyInPandas(run, "source_key string, size long, copies long")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = SHARE_PERCENT,
) -> DataFrame:
    """How often each document enters the mix: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``rate``,
    ``copies``, ``taken`` (words, repeats counted) and ``mark``, a hash of the text.

    Sizes count words. Rates come from entropy balancing; they are rounded to whole copies, at most MOST_COPIES, so
    that each source's words come to within about the smallest of its documents of the target. Which documents of one
    size get the copy more is settled by a hash of the id, so reruns agree. Documents are counted by source and size
    first, and Newton steps and rounding work on those counts.

    * NULL, empty or blank text: size 0, one copy, no words taken. NULL sources are one source, the last.
    * NULL ids and repeated rows are documents like others; rows that tie in size and id are ranked in any order.
    * A source without words has target 0. Very long texts count whole; a text longer than its source's target may
      be left out or make the source exceed it.
    * Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    missing(docs, doc_id, text, source)
    name = F.col("source")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.size(words_of(F.col(text))).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("mark"),
    )
    # One key that is never NULL: the source behind a letter.
    key = F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name))
    rows = settled(rows.withColumn("source_key", key))
    n_rows = rows.count()
    cells = settled(rows.groupBy("source_key", "size").agg(F.count("*").alias("n")))
    sizes = cells.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    own = F.when(F.col("source_key") == "0", F.lit(None)).otherwise(F.substring("source_key", 2, 1 << 30))
    wanted = targets(sizes.select(own.alias("source"), "source_size"), weights, percent)
    wanted = settled(wanted.withColumn("source_key", key))
    tilt = multipliers(cells, wanted.select("source_key", "target", "source_size"))
    rated = cells.join(tilt, "source_key", "left")
    # Digits that depend on the order of a sum are cut off, so that reruns agree.
    rate = F.round(_rate(F.coalesce("multiplier", F.lit(0.0)), F.col("size")), 6)
    rated = rated.withColumn("rate", rate).drop("multiplier")
    rated = settled(rated)
    copies = rated.join(_rounded(rated), ["source_key", "size"])

    # A cell's copies are dealt to its parts in proportion, and within a part by rank.
    parts = max(1, -(-n_rows // PART))
    drawn = F.xxhash64("doc_id", F.lit(7))
    rows = rows.withColumn("draw", drawn).withColumn("part", F.pmod("draw", F.lit(parts)))
    in_parts = rows.groupBy("source_key", "size", "part").agg(F.count("*").alias("in_part"))
    so_far = F.sum("in_part").over(
        Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    )
    dealt = in_parts.withColumn("until", so_far).join(copies, ["source_key", "size"])
    low = F.floor("rate")
    more = F.col("copies") - low * F.col("n")
    upto = lambda count: F.floor((more * count).cast("decimal(38,0)") / F.col("n"))
    dealt = dealt.select(
        "source_key", "size", "part", "rate", low.alias("low"),
        (upto(F.col("until")) - upto(F.col("until") - F.col("in_part"))).cast("long").alias("lucky"),
    )
    rank = F.row_number().over(Window.partitionBy("source_key", "size", "part").orderBy("draw", "doc_id"))
    found = rows.withColumn("rank", rank).join(dealt, ["source_key", "size", "part"])
    found = found.join(wanted.select("source_key", "source_size", "target"), "source_key")
    count = (F.col("low") + (F.col("rank") <= F.col("lucky")).cast("long")).cast("long")
    return found.select(
        "doc_id", "source", "size", "source_size", "target", "rate", count.alias("copies"),
        (count * F.col("size")).alias("taken"), "mark",
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, with all their columns, each as often as it is taken (see ``mix``).

    Repeated rows come as often as all of them together are taken.
    """
    taken = mix(docs, doc_id, text, source, **options)
    counts = taken.groupBy(F.col("doc_id").alias("id"), "mark").agg(F.sum("copies").cast("int").alias("copies"))
    found = matched(docs, counts.filter("copies > 0"), doc_id, text)
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
