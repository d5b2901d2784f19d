"""Clustering round integer centroids, with a vantage-point tree over the centroids.

Every round the driver builds a tree over the few centroids and broadcasts it. A node holds a vantage centroid and,
for its inner and its outer half, the range of their distances from it. A vector visits the nodes best first, by a
lower bound of its distance to anything below them, and stops when the bound exceeds its best distance; a bound that
equals it is still visited, so that ties are seen. Distances that decide are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import missing, settled

CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, 3
# Centroids in a leaf.
LEAF = 2
# Rounding of square roots never prunes a node whose bound equals the best distance.
SLACK = 1e-9
LONGEST = (1 << 63) - 1
# Sums of squares stay below 2 ** 63 for components up to this, times the square root of 64 / width.
NARROW = 1 << 27


# An inner node has a vantage centroid (a leaf: -1) and up to two parts: node, least and largest distance from the
# vantage. A leaf has members. Plain tuples, since a broadcast is read where this package may be missing.
Node = tuple[int, list[tuple[int, float, float]], list[int]]


def exact(points: np.ndarray) -> np.ndarray:
    """Integers that squares and sums of squares cannot overflow: Python's own where 64 bits may not do."""
    if points.dtype == object or not points.size:
        return points
    limit = NARROW * (64 / max(points.shape[-1], 1)) ** 0.5
    return points if max(int(points.max()), -int(points.min())) <= limit else points.astype(object)


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of all points to one centre, as exact integers."""
    difference = points - centre
    return (difference * difference).sum(axis=1)


def _roots(whole: np.ndarray) -> np.ndarray:
    return np.sqrt(whole.astype(np.float64))


def vantage_tree(centres: np.ndarray) -> list[Node]:
    """The nodes, the root first. Of the members of a node the one with the most even spread of distances is the vantage."""
    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        here = len(nodes)
        nodes.append((-1, [], members))
        if len(members) <= LEAF:
            return here
        spread = [float(np.std(_roots(squares(centres[members], centres[m])))) for m in members]
        vantage = members[int(np.argmax(spread))]
        others = [m for m in members if m != vantage]
        away = _roots(squares(centres[others], centres[vantage]))
        order = np.argsort(away, kind="stable")
        parts = []
        for half in np.array_split(order, 2):
            if len(half):
                parts.append((grow([others[i] for i in half]), float(away[half].min()), float(away[half].max())))
        nodes[here] = (vantage, parts, [])
        return here

    if len(centres):
        grow(list(range(len(centres))))
    return nodes


def assign(points: np.ndarray, centres: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centre of each point and the squared distance; ties go to the smaller number.

    Each point goes its own way through the tree; points that stand at the same node are measured together.
    """
    n = len(points)
    if max(abs(int(x)) for x in (centres.max(), centres.min())) > NARROW or points.dtype == object:
        points, centres = points.astype(object), centres.astype(object)
    best = np.full(n, -1, points.dtype)
    owner = np.full(n, -1, np.int64)
    radius = np.full(n, np.inf)
    bounds = np.full((n, len(nodes)), np.inf)
    bounds[:, 0] = 0.0

    def measure(rows: np.ndarray, number: int) -> np.ndarray:
        found = squares(points[rows], centres[number])
        nearer = (owner[rows] < 0) | (found < best[rows]) | ((found == best[rows]) & (number < owner[rows]))
        took = rows[nearer]
        best[took], owner[took] = found[nearer], number
        radius[took] = _roots(found[nearer]) * (1 + SLACK) + SLACK
        return found

    while True:
        at = bounds.argmin(axis=1)
        lowest = bounds[np.arange(n), at]
        open_ = np.isfinite(lowest) & (lowest <= radius)
        if not open_.any():
            return owner.astype(np.int32), best
        for place in np.unique(at[open_]):
            rows = np.flatnonzero(open_ & (at == place))
            (vantage, parts, members), reached = nodes[place], bounds[rows, place]
            bounds[rows, place] = np.inf
            for number in members:
                measure(rows, number)
            if vantage >= 0:
                away = _roots(measure(rows, vantage))
                for child, least, most in parts:
                    bounds[rows, child] = np.maximum(reached, np.maximum(away - most, least - away))


def _kept(vectors: DataFrame, vec_id: str, embedding: str, width: int, scale: int) -> DataFrame:
    x = F.col("embedding")
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")
    )
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = float(1 << 62)
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c * scale))).cast("long"))
    return rows.filter((F.size(x) == width) & fine).select("vec_id", whole.alias("v"))


def _start(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select("v", drawn.alias("drawn")).orderBy(F.col("drawn").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _points(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    return exact(batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))


def _totals(kept: DataFrame, sent, width: int) -> DataFrame:
    """Count and componentwise sums of each cluster; every task sends a row for each cluster and component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, nodes = sent.value
        sums = np.zeros((len(centres), width), object)
        counts = np.zeros(len(centres), np.int64)
        for batch in batches:
            if len(batch):
                points = _points(batch)
                owner, _ = assign(points, centres, nodes)
                for number in np.unique(owner):
                    mine = points[owner == number]
                    sums[number] += mine.sum(axis=0).astype(object)
                    counts[number] += len(mine)
        used = np.flatnonzero(counts)
        columns = [
            pa.array(np.repeat(used, width).astype(np.int32)),
            pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
            pa.array([Decimal(int(s)) for c in used for s in sums[c]], pa.decimal128(38, 0)),
            pa.array(np.repeat(counts[used], width)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "at", "total", "n"])

    parts = kept.select("v").mapInArrow(add, "cluster int, at int, total decimal(38,0), n long")
    return parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _assigned(kept: DataFrame, sent) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, nodes = sent.value
        for batch in batches:
            if len(batch):
                owner, away = assign(_points(batch), centres, nodes)
                away = pa.array([min(int(d), LONGEST) for d in away], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(owner), away], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(place, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """Cluster the vectors of ``width`` components, each taken as the integer ``floor(scale * x)``.

    The first centroids are the vectors whose id has the smallest SHA-256 of ``<seed>:<id>``. Each of ``rounds`` rounds
    assigns every vector to the nearest centroid (ties: the smaller number) and replaces each centroid by the
    componentwise floor of the mean of its vectors; a centroid without vectors stays. Returns for each vector
    ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia`` and ``inertia`` (the sums of ``distance`` over
    the cluster and over all), and ``centroid_sha256`` of the final centroid as decimal integers joined by commas.

    What the driver and each task hold is bounded by the centroids; a round shuffles one row for each task, cluster
    and component. The work of a vector does not depend on the size of its cluster.

    * Vectors of another length, NULL vectors and those with NULL or non-finite components take no part.
    * A NULL id takes part, but starts a centroid only where ids run out.
    * Repeated rows count as often as they occur. Equal hashes start in the order of the components.
    * Equal centroids: the smaller number takes all vectors. Fewer vectors than ``clusters`` give fewer centroids.
    * Components are limited to 2 ** 62 either way; sums beyond the range of a long are given as its largest value.
    * Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    missing(vectors, vec_id, embedding)
    kept = settled(_kept(vectors, vec_id, embedding, width, scale))
    session = kept.sparkSession
    centres = _start(kept, clusters, seed)
    if not len(centres):
        return kept.select(
            "vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
            F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
            F.lit("").alias("centroid_sha256"),
        ).filter(F.lit(False))
    for _ in range(rounds):
        sent = session.sparkContext.broadcast((centres, vantage_tree(exact(centres))))
        moved = centres.copy()
        for r in _totals(kept, sent, width).collect():  # clusters times width rows
            moved[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
        sent.unpersist()
        if (moved == centres).all():
            break
        centres = moved
    sent = session.sparkContext.broadcast((centres, vantage_tree(exact(centres))))
    placed = settled(_assigned(kept, sent))
    exactly = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(exactly.alias("d")).collect()}
    whole = min(int(sum(sums.values())), LONGEST)
    names = [sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centres]
    facts = [(int(n), min(int(d), LONGEST), whole, names[n]) for n, d in sums.items()]
    facts = session.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
