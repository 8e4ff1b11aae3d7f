"""Exact top-k by inner product on a pivot-distance index.

Inner products become distances by one more coordinate: a row v gets sqrt(M - |v|^2), M the
largest |v|^2 of the table, a query gets 0; then |q - v|^2 = |q|^2 + M - 2 q.v, so the nearest
rows are those of largest inner product.  Each row is keyed by its nearest pivot and its distance
to it; distances are cut into rings, so a cell (pivot, ring) is a sorted annulus whose exact
inner and outer radius are kept.  A query first visits the cells nearest to it, which bounds its k-th
distance; by the triangle inequality only annuli that reach nearer than that bound are visited
next.  The bound only leaves out what can't enter the result, so results are exact; scores are
computed in doubles, exact for integer vectors while sums of products stay below 2^53.

Pivots and ring edges are fitted on ``sample`` rows (the smallest hashes of vec_id), every row
is indexed.  Cells with many rows, and many queries, are dealt over salts of ``task_rows`` and
``task_queries``.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part;
shorter vectors count as padded with zeros; a query never meets a row of its own vec_id; ties go to
the smaller vec_id; fewer than k other rows give fewer results; repeated vec_ids are rows of their
own, a repeated query is searched once; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadline.plans.staging import stage

SLACK = 1e-6


def finite(x):
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid(column: str):
    """True where a vector takes part."""
    return F.coalesce(F.forall(column, finite), F.lit(False))


def fit_pivots(sample: np.ndarray, pivots: int, seed: int = 7) -> np.ndarray:
    """Centres of a few k-means steps from a farthest-first start."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(8):
        near = distances(sample, centres).argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = sample[near == j].mean(0)
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None] - 2 * rows @ centres.T
    return np.sqrt(np.maximum(square, 0))


def list_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    out = np.zeros((len(column), dims))
    if len(column):
        out[np.arange(dims)[None] < np.diff(np.asarray(column.offsets))[:, None]] = np.asarray(column.flatten())
    return out


def augmented(rows: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([rows, np.sqrt(np.maximum(top - (rows ** 2).sum(1), 0))[:, None]])


class Index:
    """The written index and what every task needs of it (bounded by pivots x rings)."""

    def __init__(self, vectors: DataFrame, id_column: str = "vec_id", vector: str = "vec", pivots: int = 16,
                 rings: int = 8, sample: int = 2048) -> None:
        rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
        rows = rows.filter(valid("vec"))
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
        size = rows.agg(F.max(F.size("vec")), F.max(square)).first()
        self.dims, top = size[0] or 0, float(size[1] or 0.0)
        self.top = top
        few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()
        drawn = augmented(matrix(list_array(few.column("vec")), self.dims), self.top)
        self.pivots = fit_pivots(drawn, pivots)
        self.rings = rings
        gap = distances(drawn, self.pivots) if len(drawn) else np.zeros((0, len(self.pivots)))
        near = gap.argmin(1) if len(drawn) else np.zeros(0, int)
        self.edges = np.stack([np.quantile(own, np.linspace(0, 1, rings + 1)[1:-1]) if len(own := gap[near == j, j])
                               else np.zeros(rings - 1) for j in range(len(self.pivots))])
        self.rows = stage(self.keyed(rows), "pivot-index")
        stats = self.rows.groupBy("cell").agg(F.min("dist"), F.max("dist"), F.count(F.lit(1))).collect()
        self.cells = {r[0]: (r[1], r[2], r[3]) for r in stats}

    def keyed(self, rows: DataFrame) -> DataFrame:
        pivots, edges, rings = self.pivots, self.edges, self.rings
        dims, top = self.dims, self.top

        def run(batches):
            for batch in batches:
                plain = matrix(batch.column("vec"), dims)
                gap = distances(augmented(plain, top), pivots)
                near = gap.argmin(1) if len(gap) else np.zeros(0, int)
                dist = gap[np.arange(len(gap)), near]
                ring = (dist[:, None] >= edges[near]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array((near * rings + ring).astype(np.int32)), pa.array(dist),
                     pa.array([x.tobytes() for x in plain], pa.binary())], ["vec_id", "cell", "dist", "packed"])

        return rows.mapInArrow(run, "vec_id long, cell int, dist double, packed binary")


def _frontier(index: Index, queries: DataFrame, first: int) -> DataFrame:
    """Queries with the cells to visit: the ``first`` nearest, or later all that may hold a nearer row."""
    pivots, top, dims, rings = index.pivots, index.top, index.dims, index.rings
    ids = np.array(sorted(index.cells), np.int32)
    inner = np.array([index.cells[c][0] for c in ids])
    outer = np.array([index.cells[c][1] for c in ids])
    later = "kth" in queries.columns

    def run(batches):
        for batch in batches:
            packed = batch.column("packed").to_pylist()
            rows = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dims)
            to = distances(np.hstack([rows, np.zeros((len(rows), 1))]), pivots)[:, ids // rings]
            low = np.maximum(np.maximum(to - outer, inner - to), 0)
            order = np.lexsort((np.broadcast_to(ids, low.shape), to, low), axis=1)
            take = np.zeros(low.shape, bool)
            np.put_along_axis(take, order[:, :first], True, 1)
            if later:
                kth = np.array([np.nan if x is None else x for x in batch.column("kth").to_pylist()], float)
                bound = np.sqrt(np.maximum((rows ** 2).sum(1) + top - 2 * kth, 0)) * (1 + SLACK) + SLACK
                take = ~take & ((low <= bound[:, None]) | np.isnan(kth)[:, None])
            q, c = np.nonzero(take)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(q)), pa.array(ids[c], pa.int32()), batch.column("packed").take(pa.array(q))],
                ["query_id", "cell", "query"])

    return queries.mapInArrow(run, "query_id long, cell int, query binary")


def _visit(index: Index, frontier: DataFrame, k: int, n_queries: int, task_rows: int, task_queries: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of every visited cell and salt."""
    dims = index.dims
    spark = frontier.sparkSession
    salts = spark.createDataFrame([(int(c), 1 + int(x[2]) // task_rows) for c, x in index.cells.items()] or [(0, 1)], "cell int, salts int")
    turns = 1 + n_queries // task_queries
    rows = (index.rows.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).select("cell", "salt", "turn", "vec_id", "packed"))
    asked = (frontier.join(F.broadcast(salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")).select("cell", "salt", "turn", "query_id", "query"))

    def best(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(own) and len(ask):
            own = own.sort_values("vec_id")
            ids = own["vec_id"].to_numpy()
            rows = np.frombuffer(b"".join(own["packed"]), np.float64).reshape(len(own), dims)
            for lo in range(0, len(ask), 256):
                part = ask.iloc[lo:lo + 256]
                scores = np.frombuffer(b"".join(part["query"]), np.float64).reshape(len(part), dims) @ rows.T
                for q, s in zip(part["query_id"].to_numpy(), scores):
                    s = np.where(ids == q, -np.inf, s)
                    if len(s) > k:
                        keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    else:
                        keep = np.arange(len(s))
                    keep = keep[np.isfinite(s[keep])]
                    keep = keep[np.lexsort((ids[keep], -s[keep]))][:k]
                    found += [(q, i, v) for i, v in zip(ids[keep], s[keep])]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return rows.groupBy("cell", "salt", "turn").cogroup(asked.groupBy("cell", "salt", "turn")).applyInPandas(
        best, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, first_cells: int = 6, task_rows: int = 50_000,
           task_queries: int = 20_000, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query.

    ``vectors`` and ``queries`` have vec_id and vec.
    """
    index = Index(vectors, **options)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    asked = asked.filter(valid("vec")).dropDuplicates(["query_id"])
    dims = index.dims

    def pack(batches):
        for batch in batches:
            rows = matrix(batch.column("vec"), dims)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([x.tobytes() for x in rows], pa.binary())], ["query_id", "packed"])

    asked = asked.withColumn("vec", F.slice("vec", 1, dims))  # further components meet zeros only
    asked = stage(asked.mapInArrow(pack, "query_id long, packed binary"), "queries")
    n = asked.count()
    near = stage(_visit(index, _frontier(index, asked, first_cells), k, n, task_rows, task_queries), "near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = _frontier(index, asked.join(kth, "query_id", "left"), first_cells)
    both = near.union(_visit(index, rest, k, n, task_rows, task_queries))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")
