"""Hard negatives from a multiway hyperplane tree with distance ranges (a geometric near-neighbour access tree).

Inner products become distances by one more coordinate: a row v gets sqrt(M - |v|^2), M the largest |v|^2, an
anchor gets 0; then |q - v|^2 = |q|^2 + M - 2 q.v, so a window of scores is an annulus around the anchor.

1. *Tree.* Every node has up to ``fanout`` split points; a row goes to the child of its nearest one.  Split points are fitted on
   ``sample`` rows (the smallest hashes of vec_id), every row is indexed.  Each split point stores the range of its distances
   to the rows of every sibling's subtree, over all rows.
2. *Search.* An anchor goes down with its windows.  A child is left out when for some split point the range does not
   meet the distances that the window's annulus allows.  Leaves are compared exactly.
3. *Two visits.* The nearest leaves first; the k-th score found in a window narrows its annulus, and all other leaves that
   the narrowed annulus may meet are visited next.  So results are exact: only what can't enter them is left out.
4. Positives are the best rows of the anchor's label, in a window without bounds.  The window of negatives for a positive of
   score s is low s <= 100 score <= high s, in integers.

Leaves with many rows are dealt over salts of ``task_rows``, those that many anchors visit over turns of ``task_anchors``.

Scores are whole numbers and exact: larger vectors than doubles can add up exactly are refused.  Defined cases: rows without
vec_id or label, and vectors that are null or hold null, NaN or infinite components, take no part; shorter vectors count as padded
with zeros; an anchor never meets a row of its own vec_id; ties go to the smaller vec_id; fewer rows give fewer
results; repeated vec_ids are rows of their own, a repeated anchor is searched once, with its smallest label and vector; a positive whose
window is empty has no negatives; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadline.llm.pivot_search import augmented, distances, list_array, matrix, valid
from loadline.plans.staging import stage

SLACK = 1e-6


class Node:
    """Split points, and for each the child: a node's number, or a leaf as ~number."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.children = [0] * len(points)
        self.low = np.full((len(points), len(points)), np.inf)
        self.high = np.full((len(points), len(points)), -np.inf)


def far_points(rows: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first rows, all different."""
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


class Tree:
    """Geometry (bounded by fanout ** depth) and the written leaves."""

    def __init__(self, rows: DataFrame, fanout: int = 8, depth: int = 2, sample: int = 4096) -> None:
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
        size = rows.agg(F.max(F.size("vec")), F.max(square)).first()
        self.dims, self.top = size[0] or 0, float(size[1] or 0.0)
        if self.top >= 2.0 ** 52:
            raise ValueError("vectors are too long for exact scores")
        few = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec").toArrow()
        drawn = augmented(matrix(list_array(few.column("vec")), self.dims), self.top)
        self.nodes: list[Node] = []
        self.leaves = 0
        #: For each leaf the (node, child) steps from the root.
        self.paths: list[list[tuple[int, int]]] = []
        if len(drawn):
            self.grow(drawn, fanout, depth, [])
        self.rows = stage(self.routed(rows), "gnat-leaves")
        self.measure()
        self.counts = {r[0]: r[1] for r in self.rows.groupBy("leaf").count().collect()}

    def grow(self, drawn: np.ndarray, fanout: int, depth: int, path: list[tuple[int, int]]) -> int:
        points = far_points(drawn, fanout) if depth and len(drawn) else drawn[:0]
        if len(points) < 2 and path:
            self.paths.append(path)
            self.leaves += 1
            return ~(self.leaves - 1)
        number = len(self.nodes)
        self.nodes.append(Node(points))
        near = distances(drawn, points).argmin(1)
        for j in range(len(points)):
            self.nodes[number].children[j] = self.grow(drawn[near == j], fanout, depth - 1, [*path, (number, j)])
        return number

    def routed(self, rows: DataFrame) -> DataFrame:
        nodes, dims, top = self.nodes, self.dims, self.top

        def run(batches):
            for batch in batches:
                plain = matrix(batch.column("vec"), dims)
                wide = augmented(plain, top)
                leaf = np.zeros(len(plain), np.int32)
                todo = [(0, np.arange(len(plain)))] if len(plain) else []
                while todo:
                    number, own = todo.pop()
                    near = distances(wide[own], nodes[number].points).argmin(1)
                    for j, child in enumerate(nodes[number].children):
                        if len(part := own[near == j]):
                            if child < 0:
                                leaf[part] = ~child
                            else:
                                todo.append((child, part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(leaf), pa.array([x.tobytes() for x in plain], pa.binary())],
                    ["vec_id", "label", "leaf", "packed"])

        return rows.mapInArrow(run, "vec_id long, label long, leaf int, packed binary")

    def measure(self) -> None:
        """Ranges of each split point's distances to the rows under each of its siblings."""
        nodes, paths, dims, top = self.nodes, self.paths, self.dims, self.top

        def run(batches):
            seen: dict[tuple[int, int, int], tuple[float, float]] = {}
            for batch in batches:
                packed = batch.column("packed").to_pylist()
                wide = augmented(np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dims), top)
                leaf = np.asarray(batch.column("leaf"))
                for x in np.unique(leaf):
                    own = wide[leaf == x]
                    for number, j in paths[x]:
                        gap = distances(own, nodes[number].points)
                        for i, (lo, hi) in enumerate(zip(gap.min(0), gap.max(0))):
                            was = seen.get((number, i, j), (np.inf, -np.inf))
                            seen[number, i, j] = min(was[0], lo), max(was[1], hi)
            if seen:
                keys = np.array(list(seen), np.int32)
                values = np.array(list(seen.values()))
                yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, c]) for c in range(3)), *(pa.array(values[:, c]) for c in range(2))],
                                                 ["node", "i", "j", "lo", "hi"])

        parts = self.rows.mapInArrow(run, "node int, i int, j int, lo double, hi double")
        for number, i, j, lo, hi in parts.groupBy("node", "i", "j").agg(F.min("lo"), F.max("hi")).collect():  # at most nodes x fanout x fanout
            nodes[number].low[i, j], nodes[number].high[i, j] = lo, hi


def annuli(rows: np.ndarray, top: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer radius of the scores low..high around each row; an empty window has inner > outer."""
    square = ((rows ** 2).sum(1) + top)[:, None]
    with np.errstate(invalid="ignore"):
        inner = np.sqrt(np.maximum(square - 2 * high, 0)) * (1 - SLACK) - SLACK
        outer = np.sqrt(np.maximum(square - 2 * low, 0)) * (1 + SLACK) + SLACK
    empty = ~(low <= high)
    return np.where(empty, np.inf, np.maximum(inner, 0)), np.where(empty, -np.inf, outer)


def ragged(column: pa.Array, fill: float) -> np.ndarray:
    """Rows of a list column padded with ``fill``."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.full((len(column), max(1, sizes.max(initial=0))), fill)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = np.asarray(column.flatten())
    return out


def visits(tree: Tree, asked: DataFrame, first: int, later: bool) -> DataFrame:
    """(query_id, leaf) to visit: the ``first`` nearest leaves that the windows meet, or later all others.

    ``asked`` has the windows as lists low and high of scores, and before the narrowing as wide.
    """
    nodes, leaves, dims, top = tree.nodes, tree.leaves, tree.dims, tree.top

    def reach(wide: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alive, near): leaves that a window may meet, and the least distance of their rows."""
        alive = np.zeros((len(wide), leaves), bool)
        near = np.full(alive.shape, np.inf)
        todo = [(0, np.ones(inner.shape, bool))] if leaves else []
        while todo:
            number, open_ = todo.pop()
            node = nodes[number]
            gap = distances(wide, node.points)
            for j, child in enumerate(node.children):
                some = node.low[:, j] <= node.high[:, j]  # no row there: nothing to visit
                if not some.any():
                    continue
                least = np.maximum(np.maximum(gap[:, some] - node.high[some, j], node.low[some, j] - gap[:, some]).max(1), 0)
                most = (gap[:, some] + node.high[some, j]).min(1)
                still = open_ & (least[:, None] * (1 - SLACK) - SLACK <= outer) & (most[:, None] * (1 + SLACK) + SLACK >= inner)
                if not still.any():
                    continue
                if child < 0:
                    alive[:, ~child] = still.any(1)
                    near[:, ~child] = least + gap[:, j] * 1e-3  # of equal bounds the nearer split point first
                else:
                    todo.append((child, still))
        return alive, near

    def run(batches):
        for batch in batches:
            packed = batch.column("packed").to_pylist()
            rows = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dims)
            wide = np.hstack([rows, np.zeros((len(rows), 1))])
            high = ragged(batch.column("high"), -np.inf)
            alive, near = reach(wide, *annuli(rows, top, ragged(batch.column("wide" if later else "low"), np.inf), high))
            order = np.argsort(np.where(alive, near, np.inf), axis=1, kind="stable")
            take = np.zeros(alive.shape, bool)
            np.put_along_axis(take, order[:, :first], True, 1)
            take &= alive
            if later:
                take = ~take & reach(wide, *annuli(rows, top, ragged(batch.column("low"), np.inf), high))[0]
            q, leaf = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(q)), pa.array(leaf.astype(np.int32))], ["query_id", "leaf"])

    return stage(asked.mapInArrow(run, "query_id long, leaf int"), "gnat-visits")


def compared(tree: Tree, asked: DataFrame, frontier: DataFrame, k: int, same: bool, task_rows: int, task_anchors: int) -> DataFrame:
    """(query_id, slot, vec_id, score): the k best rows of every window in every visited leaf and salt."""
    dims, spark = tree.dims, frontier.sparkSession
    asks = {r[0]: r[1] for r in frontier.groupBy("leaf").count().collect()}  # a row a leaf
    dealt = spark.createDataFrame([(int(x), 1 + n // task_rows, 1 + asks.get(x, 0) // task_anchors) for x, n in tree.counts.items()] or [(-1, 1, 1)],
                                  "leaf int, salts int, turns int")
    rows = (tree.rows.join(F.broadcast(dealt), "leaf").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("leaf", "salt", "turn", "vec_id", F.col("label").alias("own"), "packed"))
    asked = (frontier.join(asked, "query_id").join(F.broadcast(dealt), "leaf").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("leaf", "salt", "turn", "query_id", "label", F.col("packed").alias("query"), "low", "high"))

    def best(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, float]] = []
        if len(own) and len(ask):
            own = own.sort_values("vec_id")
            ids, labels = own["vec_id"].to_numpy(), own["own"].to_numpy()
            rows = np.frombuffer(b"".join(own["packed"]), np.float64).reshape(len(own), dims)
            for lo in range(0, len(ask), 64):
                part = ask.iloc[lo:lo + 64]
                scores = np.frombuffer(b"".join(part["query"]), np.float64).reshape(len(part), dims) @ rows.T
                for q, label, lows, highs, s in zip(part["query_id"], part["label"], part["low"], part["high"], scores):
                    fits = (ids != q) & ((labels == label) == same)
                    for slot, (least, most) in enumerate(zip(lows, highs)):
                        keep = np.flatnonzero(fits & (s >= least) & (s <= most))
                        if len(keep) > k:
                            keep = keep[s[keep] >= np.partition(s[keep], len(keep) - k)[len(keep) - k]]
                        keep = keep[np.lexsort((ids[keep], -s[keep]))][:k]
                        found += [(q, slot, i, v) for i, v in zip(ids[keep], s[keep])]
        return pd.DataFrame(found, columns=["query_id", "slot", "vec_id", "score"])

    return rows.groupBy("leaf", "salt", "turn").cogroup(asked.groupBy("leaf", "salt", "turn")).applyInPandas(
        best, "query_id long, slot int, vec_id long, score double")


def windowed(tree: Tree, asked: DataFrame, k: int, same: bool, first: int, task_rows: int, task_anchors: int) -> DataFrame:
    """(query_id, slot, rank, vec_id, score): the k best rows of every window of ``asked``."""
    near = stage(compared(tree, asked, visits(tree, asked, first, later=False), k, same, task_rows, task_anchors), "gnat-near")
    order = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).groupBy(F.col("query_id").alias("of")).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # at most an entry a window
    narrow = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i.cast("int")), x)))
    again = asked.join(kth, F.col("query_id") == F.col("of"), "left").select(
        "query_id", "label", "packed", F.col("low").alias("wide"), narrow.alias("low"), "high")
    both = near.union(compared(tree, again, visits(tree, again, first, later=True), k, same, task_rows, task_anchors))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, first_leaves: int = 6,
         task_rows: int = 50_000, task_anchors: int = 10_000, **options) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors`` have vec_id, label and vec, with whole numbers in vec.  Of each anchor's first ``positives`` rows of its
    label, the first ``negatives`` rows of other labels with low * positive <= 100 * score <= high * positive.
    """
    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vec").cast("array<double>"))
        return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid("vec"))

    tree = Tree(clean(vectors), **options)
    dims = tree.dims

    def pack(batches):
        for batch in batches:
            rows = matrix(batch.column("vec"), dims)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("label"), pa.array([x.tobytes() for x in rows], pa.binary())],
                                             ["query_id", "label", "packed"])

    once = clean(anchors).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "vec")).alias("row"))
    once = once.select("query_id", "row.label", F.slice("row.vec", 1, max(dims, 1)).alias("vec"))  # further components meet zeros only
    asked = stage(once.mapInArrow(pack, "query_id long, label long, packed binary"), "gnat-anchors")
    whole = asked.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    chosen = stage(windowed(tree, whole, positives, True, first_leaves, task_rows, task_anchors).select(
        "query_id", F.col("rank").cast("int"), "vec_id", F.col("score").cast("long").alias("score")), "gnat-positives")
    listed = chosen.groupBy(F.col("query_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    listed = asked.join(listed, F.col("query_id") == F.col("of")).select(
        "query_id", "label", "packed",
        F.expr(f"transform(found, p -> double(-((-{low} * p.score - pmod(-{low} * p.score, 100)) div 100)))").alias("low"),  # rounded up
        F.expr(f"transform(found, p -> double(({high} * p.score - pmod({high} * p.score, 100)) div 100))").alias("high"))  # and down
    found = windowed(tree, stage(listed, "gnat-windows"), negatives, False, first_leaves, task_rows, task_anchors)
    kept = chosen.select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("_slot"))
    return found.join(kept, (F.col("query_id") == F.col("anchor_id")) & (F.col("slot") == F.col("_slot"))).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").cast("long").alias("negative_score"))
