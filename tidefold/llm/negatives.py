"""Hard negatives by a multiway hyperplane tree (GNAT).

Scores are integer inner products. One more component, sqrt(top - |x|^2) with ``top`` the largest squared norm, makes
all vectors equally long, so a score and a Euclidean distance from an anchor say the same, and a window of scores is an
annulus round the anchor. Each node of the tree has several split points; a vector belongs to the nearest of them, and
each split point stores the range of its distances to the vectors below every sibling. A sibling whose range, seen from
some split point, misses the annulus is left out. The vectors of the leaves that remain are scored exactly.

The split points come from a bounded sample; every vector is placed, and the ranges are those of all vectors, so a
poor sample costs time and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import missing, settled

POSITIVES, NEGATIVES = 5, 10
# The window of a negative's score, in parts of WHOLE of the positive's.
LEAST, MOST, WHOLE = 30, 90, 100
SCALE = 256
# Bounds of the fit: vectors that are sampled, split points of a node, leaves that the sample is divided into.
SAMPLE, WAYS, LEAVES, DEPTH = 20_000, 8, 48, 12
# Components of the vectors, and anchors, that meet in one group.
COMPONENTS_AT_ONCE, ANCHORS_AT_ONCE = 1 << 20, 4096
# Rounding never leaves out a leaf: relative to the lengths of the vectors.
SLACK = 1e-6
# No score reaches these.
LOW, HIGH = -(1 << 62), 1 << 62


def lifted(points: np.ndarray, top: float, anchors: bool = False) -> np.ndarray:
    """Vectors with the component that makes them equally long; anchors with a zero there."""
    norms = np.einsum("ij,ij->i", points, points)
    return np.column_stack([points, np.zeros(len(points)) if anchors else np.sqrt(np.maximum(top - norms, 0))])


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """From differences, not from products: near points keep their digits."""
    return np.stack([np.sqrt(((points - o) ** 2).sum(axis=1)) for o in others], axis=1)


def grow(sample: np.ndarray, seed: int, leaves: int = LEAVES, ways: int = WAYS) -> dict:
    """Split points and children of each node; a child is a node, or a leaf as ``-1 - leaf``. Node 0 is the root."""
    random = np.random.default_rng(seed)
    splits: list[np.ndarray] = []
    children: list[list[int]] = []
    centres: list[np.ndarray] = []
    enough = max(2, len(sample) // leaves)

    def leaf(centre: np.ndarray) -> int:
        centres.append(centre)
        return -len(centres)

    def divide(members: np.ndarray, centre: np.ndarray, depth: int) -> int:
        points = sample[members]
        if len(members) <= enough or depth == DEPTH:
            return leaf(centre)
        parts = max(2, min(ways, round(len(members) / enough)))
        drawn = np.unique(points[random.choice(len(points), min(len(points), 3 * parts), replace=False)], axis=0)
        chosen, far = [0], distances(drawn, drawn[:1])[:, 0]
        while len(chosen) < min(parts, len(drawn)):  # each as far as possible from those before
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(drawn, drawn[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return leaf(centre)
        here, split = len(splits), drawn[chosen]
        splits.append(split)
        children.append([0] * len(split))
        home = distances(points, split).argmin(axis=1)
        for j, point in enumerate(split):
            mine = members[home == j]
            children[here][j] = divide(mine, point, depth + 1) if len(mine) else leaf(point)
        return here

    if divide(np.arange(len(sample)), sample[0], 0) < 0:
        splits, children = [sample[:1]], [[-1]]
    return {"splits": splits, "children": children, "centres": np.stack(centres)}


def route(points: np.ndarray, tree: dict, ranges: list[np.ndarray] | None = None) -> np.ndarray:
    """The leaf of each point. ``ranges``, if given, are widened to take in the points: node, split point, sibling."""
    leaf = np.zeros(len(points), np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        away = distances(points[rows], tree["splits"][node])
        home = away.argmin(axis=1)
        for j, child in enumerate(tree["children"][node]):
            mine = home == j
            if not mine.any():
                continue
            if ranges is not None:
                low, high = ranges[node][:, j, 0], ranges[node][:, j, 1]
                np.minimum(low, away[mine].min(axis=0), out=low)
                np.maximum(high, away[mine].max(axis=0), out=high)
            if child < 0:
                leaf[rows[mine]] = -1 - child
            else:
                todo.append((child, rows[mine]))
    return leaf


def no_ranges(tree: dict) -> list[np.ndarray]:
    """Ranges of an empty tree: nothing meets them."""
    return [np.tile(np.array([np.inf, -np.inf]), (len(s), len(s), 1)) for s in tree["splits"]]


def radii(norms: np.ndarray, scores: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(norms[:, None] + top - 2.0 * scores, 0))


def visited(points: np.ndarray, lows: np.ndarray, highs: np.ndarray, tree: dict, ranges: list[np.ndarray]) -> np.ndarray:
    """Which leaves can hold a vector with a score in some window of each anchor: one row for each anchor.

    ``points`` are lifted anchors; windows, both ends included, that are empty (low above high) meet no leaf.
    """
    top = tree["top"]
    norms = np.einsum("ij,ij->i", points, points)
    slack = SLACK * (np.sqrt(norms) + top**0.5 + 1)[:, None, None]
    inner, outer = radii(norms, highs, top)[:, :, None], radii(norms, lows, top)[:, :, None]
    reached = np.zeros((len(points), len(tree["centres"])), bool)
    wanted = lows <= highs
    todo = [(0, np.arange(len(points)), wanted)]
    while todo:
        node, rows, open_ = todo.pop()
        away = distances(points[rows], tree["splits"][node])[:, None, :]
        nearest, farthest, spare = away - outer[rows], away + outer[rows], slack[rows]
        for j, child in enumerate(tree["children"][node]):
            low, high = ranges[node][:, j, 0], ranges[node][:, j, 1]
            # The annulus reaches the ball shell round each split point, and does not hold it in its hole.
            meets = (low <= farthest + spare) & (high >= nearest - spare) & (high + away >= inner[rows] - spare)
            alive = open_ & meets.all(axis=2)
            some = alive.any(axis=1)
            if not some.any():
                continue
            if child < 0:
                reached[rows[some], -1 - child] = True
            else:
                todo.append((child, rows[some], alive[some]))
    return reached


def first_leaf(points: np.ndarray, highs: np.ndarray, tree: dict) -> np.ndarray:
    """The leaf whose centre is nearest to the upper end of the anchor's first window."""
    norms = np.einsum("ij,ij->i", points, points)
    inner = radii(norms, highs[:, :1], tree["top"])
    return np.abs(distances(points, tree["centres"]) - inner).argmin(axis=1).astype(np.int32)


def scores_of(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where that is exact, else in 64-bit integers."""
    a, v = anchors.astype(np.float64), vectors.astype(np.float64)
    longest = np.sqrt((a * a).sum(axis=1).max() * (v * v).sum(axis=1).max())
    return (a @ v.T).astype(np.int64) if longest < 2**52 else anchors @ vectors.T


def best_of(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of those that fit: higher scores first, ties by the smaller id."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _rows(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """Usable rows as integers, each once, with a key; shorter vectors are filled up with zeros."""
    x = F.col("embedding")
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.col(embedding).cast("array<double>").alias("embedding"),
    )
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    rows = rows.select("vec_id", "label", whole.alias("v")).distinct()
    width = rows.select(F.max(F.size("v"))).first()[0] or 0
    short = F.size("v") < width
    filled = F.when(short, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))).otherwise(F.col("v"))
    return rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", filled.alias("v"))


def fit(rows: DataFrame, seed: int = 5) -> dict | None:
    """A tree on at most about SAMPLE vectors, drawn by a hash of their content; None without vectors.

    Its ranges are still empty. With fewer than SAMPLE vectors all of them are taken.
    """
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, top = rows.agg(F.count("*"), F.max(square)).first()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.filter(draw < min(1.0, SAMPLE / n)).select("v").toArrow()
    if not drawn.num_rows:
        drawn = rows.select("v").limit(1).toArrow()
    sample = np.unique(_matrix(drawn["v"], drawn.num_rows), axis=0).astype(np.float64)
    tree = grow(lifted(sample, top), seed)
    return tree | {"top": top, "ranges": no_ranges(tree)}


def _placed(rows: DataFrame, sent) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            if len(batch):
                points = lifted(_matrix(batch.column("v"), len(batch)).astype(np.float64), tree["top"])
                leaf = pa.array(route(points, tree))
                yield pa.RecordBatch.from_arrays([*batch.columns, leaf], [*batch.schema.names, "leaf"])

    return rows.mapInArrow(place, "key long, vec_id long, label long, v array<long>, leaf int")


def _ranges(rows: DataFrame, tree: dict, sent) -> list[np.ndarray]:
    """For each node the distances of all vectors below each sibling from each split point: least and largest."""

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        ranges = no_ranges(tree)
        for batch in batches:
            if len(batch):
                route(lifted(_matrix(batch.column("v"), len(batch)).astype(np.float64), tree["top"]), tree, ranges)
        found = [(n, i, j, *r[i, j]) for n, r in enumerate(ranges) for i, j in np.ndindex(r.shape[:2]) if r[i, j, 0] <= r[i, j, 1]]
        names, kinds = ["node", "i", "j", "low", "high"], [pa.int32()] * 3 + [pa.float64()] * 2
        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        if columns:
            yield pa.RecordBatch.from_arrays(columns, names)

    parts = rows.select("v").mapInArrow(widen, "node int, i int, j int, low double, high double")
    ranges = no_ranges(tree)
    for r in parts.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        ranges[r["node"]][r["i"], r["j"]] = r["low"], r["high"]  # as many as the tree has
    return ranges


ASKED = "key long, vec_id long, label long, v array<long>, lows array<long>, highs array<long>"


def _visits(asked: DataFrame, sent, first: bool) -> DataFrame:
    """A row for each anchor and leaf: the first leaf, or all others that may hold a vector in some window."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            if not len(batch):
                continue
            points = lifted(_matrix(batch.column("v"), len(batch)).astype(np.float64), tree["top"], anchors=True)
            ends = []
            for name, empty in (("lows", 1), ("highs", 0)):  # anchors with fewer windows than others get empty ones
                lists = [np.array(x, np.int64) for x in batch.column(name).to_pylist()]
                filled = np.full((len(lists), max(len(x) for x in lists)), empty, np.int64)
                for i, x in enumerate(lists):
                    filled[i, : len(x)] = x
                ends.append(filled)
            home = first_leaf(points, ends[1], tree)
            if first:
                at, leaf = np.arange(len(batch)), home
            else:
                reached = visited(points, *ends, tree, tree["ranges"])
                reached[np.arange(len(batch)), home] = False
                at, leaf = np.nonzero(reached)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    return asked.mapInArrow(visit, f"{ASKED}, leaf int")


def _scanned(placed: DataFrame, visits: DataFrame, k: int, same_label: bool) -> DataFrame:
    """Score the vectors of the visited leaves; the first k of each group of vectors for each window of an anchor.

    A leaf is dealt to groups of a bounded number of vectors and of anchors, so neither a large leaf nor one that all
    anchors visit meets in one task.
    """
    # A row for each leaf, of which there are as many as the sample allows.
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()
    wanted = {r["leaf"]: r["n"] for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    shares = [
        (r["leaf"], -(-r["n"] // max(1, COMPONENTS_AT_ONCE // max(r["width"], 1))), -(-wanted[r["leaf"]] // ANCHORS_AT_ONCE))
        for r in sizes if r["leaf"] in wanted
    ]
    dealt = F.broadcast(placed.sparkSession.createDataFrame(shares, "leaf int, of_vectors int, of_anchors int"))
    ours = placed.join(dealt, "leaf").withColumn("p", F.pmod(F.xxhash64("key"), F.col("of_vectors")).cast("int"))
    ours = ours.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("of_anchors") - 1)))
    theirs = visits.join(dealt, "leaf").withColumn("q", F.pmod(F.xxhash64("key"), F.col("of_anchors")).cast("int"))
    theirs = theirs.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("of_vectors") - 1)))
    keys = ["leaf", "p", "q"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if left.num_rows and right.num_rows:
            ids, labels = left["vec_id"].to_numpy(), left["label"].to_numpy()
            vectors, anchors = _matrix(left["v"], left.num_rows), _matrix(right["v"], right.num_rows)
            lows, highs = right["lows"].to_pylist(), right["highs"].to_pylist()
            block = max(1, (1 << 22) // len(ids))
            for start in range(0, len(anchors), block):
                scores = scores_of(anchors[start : start + block], vectors)
                for offset, mine in enumerate(scores):
                    i = start + offset
                    agrees = labels == right["label"][i].as_py()
                    fine = (agrees if same_label else ~agrees) & (ids != right["vec_id"][i].as_py())
                    for slot, (low, high) in enumerate(zip(lows[i], highs[i], strict=True)):
                        at = best_of(mine, ids, fine & (mine >= low) & (mine <= high), k)
                        named = (np.full(len(at), right["key"][i].as_py()), np.full(len(at), slot), mine[at], ids[at])
                        for column, part in zip(out, named, strict=True):
                            column.append(part.astype(np.int64))
        columns = [np.concatenate(c) for c in out]
        return pa.table(dict(zip(["key", "slot", "score", "vec_id"], columns, strict=True)))

    return (
        ours.select(*keys, "vec_id", "label", "v").groupBy(*keys)
        .cogroup(theirs.select(*keys, "key", "vec_id", "label", "v", "lows", "highs").groupBy(*keys))
        .applyInArrow(meet, "key long, slot long, score long, vec_id long")
    )


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(placed: DataFrame, asked: DataFrame, sent, k: int, same_label: bool) -> DataFrame:
    """The first k vectors in each window (``slot``) of each anchor: ``key, slot, score, vec_id, rank``.

    A first leaf narrows the windows: what scores less than the k-th vector found there is no longer sought. Then all
    leaves that the narrowed windows meet are scored.
    """
    near = settled(_first(_scanned(placed, _visits(asked, sent, True), k, same_label), k).drop("rank"))
    kth = near.groupBy("key", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    kth = kth.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("kth"))
    narrowed = asked.join(kth, "key", "left")
    known = lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i.cast("long")), x))
    narrowed = narrowed.withColumn("lows", F.transform("lows", known)).select(*asked.columns)
    rest = _scanned(placed, _visits(settled(narrowed), sent, False), k, same_label)
    return settled(_first(near.unionByName(rest), k))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
) -> DataFrame:
    """Hard negatives of anchors: like the anchor, but less so than a positive, and of another label.

    Components are taken as ``floor(scale * x)``; the score of a row is its integer inner product with the anchor.
    Higher scores come first, ties by the smaller id. An anchor's positives are its first other rows of the same label.
    For each of them the first rows of another label are returned whose score lies between 30 and 90 hundredths of the
    positive's, both included: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``
    and ``negative_score``. A positive whose window is empty (a negative score) has no rows. The search is exact.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` may be an expression.

    * Rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part.
    * A vector shorter than others counts as filled up with zeros; an empty one scores zero with every anchor.
    * Repeated rows (equal id, label and vector) count once; equal ids with different vectors are several rows, none of
      which is a positive or negative of its own id. Equal vectors of different ids are ranked by id.
    * Scores are exact while they fit a long. Components are limited to the range of a long.
    * Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    missing(vectors, vec_id, embedding, *([label] if isinstance(label, str) else []))
    label = F.col(label) if isinstance(label, str) else label
    rows = settled(_rows(vectors, vec_id, embedding, label, scale))
    session = rows.sparkSession
    tree = fit(rows)
    if tree is None:
        none = rows.select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(1).alias("rank"))
        return none.select(
            "*", F.col("anchor_id").alias("negative_id"), F.col("anchor_id").alias("positive_score"),
            F.col("anchor_id").alias("negative_score"),
        ).filter(F.lit(False))
    sent = session.sparkContext.broadcast(tree)  # bounded by SAMPLE
    placed = settled(_placed(rows, sent))
    sent = session.sparkContext.broadcast(tree | {"ranges": _ranges(rows, tree, sent)})
    anchors = placed.filter(is_anchor).drop("leaf")
    everything = lambda score: F.array(F.lit(score).cast("long"))
    asked = anchors.select("*", everything(LOW).alias("lows"), everything(HIGH).alias("highs"))
    like = _search(placed, asked, sent, positives, same_label=True)
    like = like.select("key", (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    ordered = F.array_sort(F.collect_list(F.struct("slot", F.col("positive_score").alias("s"))))
    windows = like.groupBy("key").agg(ordered.alias("p"))  # as many as ``positives``
    # The least n with WHOLE * n >= LEAST * s, and the largest with WHOLE * n <= MOST * s, in whole numbers.
    lows = F.transform("p", lambda x: -F.floor(-F.lit(LEAST) * x["s"].cast("decimal(30,0)") / WHOLE).cast("long"))
    highs = F.transform("p", lambda x: F.floor(F.lit(MOST) * x["s"].cast("decimal(30,0)") / WHOLE).cast("long"))
    asked = settled(anchors.join(windows, "key").select("key", "vec_id", "label", "v", lows.alias("lows"), highs.alias("highs")))
    found = _search(placed, asked, sent, negatives, same_label=False)
    named = found.join(like, ["key", "slot"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
