"""Removal of lines that spread over many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import SPACES, missing, settled, stage

MIN_SITES = 3
# 2 ** LG_K registers; relative error about 0.83 / sqrt(2 ** LG_K) = 1.3 %.
LG_K = 12
# Lines whose estimate is within this share of the threshold (and at least one site) are counted exactly.
MARGIN = 0.2


def _key(line: Column) -> Column:
    """96 bits that stand for a line without the blanks around it."""
    trimmed = F.regexp_replace(line, rf"^{SPACES}|{SPACES}$", "")
    return F.struct(F.xxhash64(trimmed).alias("h"), F.hash(trimmed).alias("g"))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: its key, its place, and its site as a hash (NULL sites count as one site)."""
    lines = docs.select("id", "mark", "site", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    lines = lines.filter(F.length(F.regexp_replace("line", SPACES, "")) > 0)
    return lines.select("id", "mark", "site", "pos", _key(F.col("line")).alias("key"))


def widespread(occurrences: DataFrame, min_sites: int) -> DataFrame:
    """Keys on at least ``min_sites`` sites, from rows of ``key`` and ``site``.

    Sketches of each line's sites are filled in every task and merged; only a line whose estimate is near the
    threshold has its sites counted exactly.
    """
    sketched = occurrences.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    estimate = F.hll_sketch_estimate("sketch")
    margin = max(1.0, MARGIN * min_sites)
    judged = settled(
        sketched.select("key", estimate.alias("n")).filter(F.col("n") > min_sites - margin - 1)
    )
    sure = judged.filter(F.col("n") > min_sites + margin).select("key")
    near = judged.filter(F.col("n") <= min_sites + margin).select("key")
    # Reduced below the shuffle before the join, which a frequent line would otherwise bring to one task.
    pairs = occurrences.select("key", "site").distinct().join(near, "key", "left_semi")
    exact = pairs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("key")
    return sure.unionByName(exact)


def remove_widespread_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """Take lines that occur on ``min_sites`` distinct sites or more out of all documents but the first.

    Lines are compared without the ASCII blanks around them. The document with the smallest ``doc_id`` among those
    that hold such a line keeps it, so no content is lost altogether. Returns all columns of ``docs``, with ``text``
    replaced, and ``removed_lines`` (long; a column of that name in ``docs`` is replaced).

    A line that is met on one site only is set aside by the smallest and the largest hash of its sites; the sketches
    are built for the others. Only hashes and places of lines are shuffled for the search, and the texts once, to meet
    the places to remove.

    * NULL and empty texts, and lines without a word, stay as they are.
    * NULL sites are one site together. Documents of a NULL id lose their widespread lines, unless no other document
      has an id; then all of them keep the line.
    * Rows that share an id are one document for the choice of the first; repeated rows are treated alike.
    * Very long texts are split whole. Other columns are carried along, whatever their names.
    * An empty table gives no rows.
    """
    missing(docs, doc_id, text, site)
    rest = [c for c in docs.columns if c.lower() != "removed_lines"]
    rows = docs.select(
        F.struct(*rest).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"),
        F.xxhash64(F.col(text)).alias("mark"), F.xxhash64(F.col(site)).alias("site"),
    )
    lines = _lines(rows)
    spread = lines.groupBy("key").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("id").alias("first"))
    spread = spread.filter(F.col("lo") != F.col("hi")).select("key", "first")
    # Dealt anew, and not joined where they were aggregated: Spark then splits a line that a third of all rows hold.
    spread = settled(spread.repartition("first"))
    met = settled(lines.join(spread, "key"))
    doomed = met.join(widespread(met.select("key", "site"), min_sites), "key", "left_semi")
    others = doomed.filter(F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull()))
    places = others.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))
    found = rows.alias("r").join(
        places.alias("p"), (F.col("r.id").eqNullSafe(F.col("p.id"))) & (F.col("r.mark") == F.col("p.mark")), "left"
    )
    found = stage(found.select("row", "body", "gone"), parts=F.split("body", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    found = stage(found, kept=F.when(F.col("gone").isNotNull(), kept))
    joined = F.array_join(F.transform("kept", lambda i: F.get("parts", i)), "\n")
    cleaned = F.when(F.col("gone").isNull(), F.col("body")).otherwise(joined)
    return found.select(
        *[cleaned.alias(c) if c.lower() == text.lower() else F.col("row").getField(c).alias(c) for c in rest],
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"),
    )
