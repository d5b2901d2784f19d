"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Vectors are assigned to the lists of a coarse quantiser and turned by a random
rotation. Within a probed list distances grow block of columns by block; after
each block a hypothesis test drops candidates whose partial distance already
makes it all but certain that they are farther than the bound. What survives
all blocks is measured exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import missing, settled

K = 10
# Bounds of the fit: vectors that are sampled, and those of them that probing is tuned with.
SAMPLE = 20_000
TUNED_WITH = 300
RECALL = 0.97
ITERATIONS = 8
COLUMNS = 16
# A candidate is dropped if its scaled partial distance exceeds the bound by this many standard errors.
ERRORS = 2.1
# Vectors and queries that meet in one group of a list.
VECTORS_AT_ONCE, QUERIES_AT_ONCE = 4096, 256


@dataclass
class Index:
    centre: np.ndarray  # of the lists, one row each
    rotation: np.ndarray
    probes: int  # lists that a query visits
    anchors: np.ndarray  # some of the vectors: their distances bound those of the nearest ones


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _quantiser(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    centre = sample[random.choice(len(sample), lists, replace=False)]
    for _ in range(ITERATIONS):
        nearest = np.concatenate([_squares(x, centre).argmin(1) for x in np.array_split(sample, -(-len(sample) // 2048))])
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, sample)
        sizes = np.bincount(nearest, minlength=lists)
        centre = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centre)
    return centre


def _probes(sample: np.ndarray, centre: np.ndarray, k: int) -> int:
    """The fewest lists that hold RECALL of the sample's own nearest neighbours.

    Neighbours within the sample are farther away than those among all vectors, so this errs on the side of more.
    """
    queries = sample[:: max(1, len(sample) // TUNED_WITH)]
    nearest = np.argsort(_squares(queries, sample), axis=1, kind="stable")[:, : k + 1]
    home = np.concatenate([_squares(x, centre).argmin(1) for x in np.array_split(sample, -(-len(sample) // 2048))])
    order = np.argsort(_squares(queries, centre), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # rank of each list for each query
    needed = np.sort(np.take_along_axis(place, home[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1


def fit(distinct: DataFrame, k: int = K, seed: int = 11) -> Index | None:
    """Fit lists and rotation on at most about SAMPLE distinct vectors, drawn by a hash of their content.

    The number of lists is the square root of the number of vectors, as far as the sample gives each list
    30 vectors. Without vectors there is no index.
    """
    n = distinct.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30)
    rows = distinct.filter(draw < min(1.0, SAMPLE / n)).select("vector").toPandas()["vector"]
    if not len(rows):
        rows = distinct.select("vector").limit(1).toPandas()["vector"]
    sample = np.stack(rows.to_numpy()).astype(np.float64)
    sample = sample[np.lexsort(sample.T[::-1])]  # the order of arrival must not matter
    np.random.default_rng(seed).shuffle(sample)
    lists = max(1, min(int(n**0.5), len(sample) // 30))
    centre = _quantiser(sample, lists, seed)
    rotation, _ = np.linalg.qr(np.random.default_rng(seed + 1).standard_normal((sample.shape[1],) * 2))
    return Index(centre, rotation, _probes(sample, centre, k), sample[:2048])


def scan(
    queries: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, errors: float = ERRORS
) -> list[np.ndarray]:
    """For each query the positions of vectors that no test has dropped; with infinite ``errors`` there is no test, and
    only vectors that are farther than the bound go.

    ``bounds`` are squared distances that k + 1 vectors are known to keep; the scan lowers a query's bound to the
    largest distance of the k + 1 vectors that are nearest by the first block of columns.
    """
    turned, asked = vectors @ rotation, queries @ rotation
    width = turned.shape[1]
    blocks = [(at, min(at + COLUMNS, width)) for at in range(0, width, COLUMNS)]
    columns = [np.ascontiguousarray(turned[:, a:b]) for a, b in blocks]
    found = []
    for query, bound in zip(asked, bounds, strict=True):
        alive = np.arange(len(turned))
        partial = np.zeros(len(turned))
        for (a, b), block in zip(blocks, columns, strict=True):
            difference = (block if len(alive) == len(block) else block[alive]) - query[a:b]
            partial = partial + np.einsum("ij,ij->i", difference, difference)
            if a == 0 and len(alive) > k:
                best = np.argpartition(partial, k)[: k + 1]
                bound = min(bound, float(((turned[best] - query) ** 2).sum(1).max()))
            slack = 1 + 1e-9 if b == width else (1 + errors / b**0.5) ** 2
            keep = partial * (width / b) <= bound * slack if np.isfinite(slack) else np.ones(len(partial), bool)
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        found.append(alive)
    return found


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows with a vector that is neither NULL, empty, zero nor holds a NULL or non-finite component."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine & F.exists("vector", lambda x: x != 0))


def nearest(
    vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, index: Index | None = None
) -> DataFrame:
    """The ``k`` nearest other rows of each query row, by Euclidean distance.

    ``is_query`` is a condition on ``vec_id``. Equal vectors are searched once and stand for their k + 1 smallest ids,
    which is all that a result can hold, so a vector that a third of all rows share is one candidate. Lists beyond
    VECTORS_AT_ONCE vectors or QUERIES_AT_ONCE queries are dealt to several tasks. Returns ``query_id``, ``rank``
    (from 1), ``vec_id`` and ``score``, the distance in double precision on the original vectors; ties go to the
    smaller id. Where the probed lists hold fewer than ``k`` candidates, the query is compared with all vectors, in
    blocks and without the test.

    * NULL, empty and zero vectors and those with NULL or non-finite components take no part, neither do NULL ids.
    * Vectors of another length than most are compared with those of their own length.
    * Repeated rows (equal id and vector) are one candidate; equal ids with different vectors are several, none of
      which is a candidate of its own id.
    * Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    missing(vectors, vec_id, embedding)
    rows = _usable(vectors, vec_id, embedding).filter("vec_id is not null").distinct()
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("place", smallest).filter(F.col("place") <= k + 1)
    distinct = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = settled(distinct.withColumn("key", F.element_at("ids", 1)))
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    asked = settled(queries.select("vector").distinct())
    lengths = [r[0] for r in distinct.select(F.size("vector")).distinct().collect()]
    parts = []
    for length in sorted(lengths):
        same = F.size("vector") == length
        parts.append(_searched(distinct.filter(same), asked.filter(same), k, index if len(lengths) == 1 else None))
    if not parts:
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).filter(F.lit(False))
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)
    # Back to rows: each query drops its own id.
    pairs = queries.join(near, "vector").filter(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = pairs.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(order))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(distinct: DataFrame, asked: DataFrame, k: int, index: Index | None) -> DataFrame:
    """The k + 1 best ids for each distinct query vector: ``vector``, ``vec_id``, ``score``."""
    index = index or fit(distinct, k)
    session = distinct.sparkSession
    sent = session.sparkContext.broadcast(asdict(index))  # bounded by SAMPLE
    placed = settled(_placed(distinct, sent, k))
    found = _scanned(placed, settled(_probing(asked, sent, k)), sent, k)
    there = placed.select(F.size("ids").alias("n")).agg(F.sum("n")).first()[0]
    full = found.groupBy("vector").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k + 1, there))
    short = settled(asked.join(full, "vector", "left_anti"))
    if short.isEmpty():
        return found
    whole = session.sparkContext.broadcast(asdict(index) | {"probes": len(index.centre), "anchors": index.anchors[:0]})
    exact = _scanned(placed, settled(_probing(short, whole, k)), whole, k, errors=float("inf"))
    return found.join(short, "vector", "left_anti").unionByName(exact)


def _scanned(placed: DataFrame, probing: DataFrame, sent, k: int, errors: float = ERRORS) -> DataFrame:
    """Scan the lists for the queries that probe them; keep the k + 1 best ids of each query."""
    # Sizes of lists: a row for each, at most SAMPLE / 30.
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    wanted = {r["list"]: r["n"] for r in probing.groupBy("list").agg(F.count("*").alias("n")).collect()}
    shares = [(c, -(-n // VECTORS_AT_ONCE), -(-wanted.get(c, 0) // QUERIES_AT_ONCE)) for c, n in sizes.items()]
    dealt = placed.sparkSession.createDataFrame(shares, "list int, of_vectors int, of_queries int")
    ours = placed.join(F.broadcast(dealt), "list").filter("of_queries > 0")
    ours = ours.withColumn("v", F.pmod(F.xxhash64("vector"), F.col("of_vectors")).cast("int"))
    ours = ours.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("of_queries") - 1)))
    theirs = probing.join(F.broadcast(dealt), "list")
    theirs = theirs.withColumn("q", F.pmod(F.xxhash64("vector"), F.col("of_queries")).cast("int"))
    theirs = theirs.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("of_vectors") - 1)))
    keys = ["list", "v", "q"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"vector": np.zeros(0, object), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        held = np.stack(left["vector"].to_numpy())
        asking = np.stack(right["vector"].to_numpy())
        ids = left["ids"].to_numpy()
        survivors = scan(asking, right["bound"].to_numpy(), held, sent.value["rotation"], k, errors)
        out = [empty]
        for query, alive in zip(asking, survivors, strict=True):
            exact = np.sqrt(((held[alive] - query) ** 2).sum(1))
            if len(alive) > k + 1:
                chosen = exact <= np.partition(exact, k)[k]
                alive, exact = alive[chosen], exact[chosen]
            if not len(alive):
                continue
            names = np.concatenate([ids[x] for x in alive])
            scores = np.repeat(exact, [len(ids[x]) for x in alive])
            best = np.lexsort((names, scores))[: k + 1]
            out.append(pd.DataFrame({"vector": [query] * len(best), "vec_id": names[best], "score": scores[best]}))
        return pd.concat(out[1:]) if len(out) > 1 else empty

    found = (
        ours.select(*keys, "vector", "ids").groupBy(*keys)
        .cogroup(theirs.select(*keys, "vector", "bound").groupBy(*keys))
        .applyInPandas(meet, "vector array<double>, vec_id long, score double")
    )
    best = F.row_number().over(Window.partitionBy("vector").orderBy("score", "vec_id"))
    return settled(found.withColumn("place", best).filter(F.col("place") <= k + 1).drop("place"))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(len(batch), -1)


def _placed(rows: DataFrame, sent, k: int) -> DataFrame:
    """The list of each vector."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                chosen = _squares(_vectors(batch), sent.value["centre"]).argmin(1).astype(np.int32)
                columns = [batch.column(0), batch.column(1), pa.array(chosen)]
                yield pa.RecordBatch.from_arrays(columns, ["vector", "ids", "list"])

    return rows.select("vector", "ids").mapInArrow(place, "vector array<double>, ids array<long>, list int")


def _probing(rows: DataFrame, sent, k: int) -> DataFrame:
    """The lists that each query visits, and a squared distance that k + 1 vectors are known to keep."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(**sent.value)
        for batch in batches:
            if not len(batch):
                continue
            vectors = _vectors(batch)
            bound = np.full(len(batch), np.inf)
            if len(known.anchors) > k:
                bound = np.partition(_squares(vectors, known.anchors), k, axis=1)[:, k] * (1 + 1e-9)
            lists = np.argsort(_squares(vectors, known.centre), axis=1, kind="stable")[:, : known.probes]
            at = pa.array(np.repeat(np.arange(len(batch)), lists.shape[1]))
            columns = [batch.column(0).take(at), pa.array(lists.ravel().astype(np.int32)), pa.array(bound).take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["vector", "list", "bound"])

    return rows.select("vector").mapInArrow(probe, "vector array<double>, list int, bound double")
