"""Kernels between rows of vectors: scores of a query set against all rows, Nystrom features, kernel ridge cross-validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Landmarks of the Nystrom approximation: a bounded sample by hash of the id. The model's size does not grow with the data.
LANDMARKS = 128
#: Queries that are scored in one pass over the rows (what the driver broadcasts), and the sides of one block of scores (16 MB).
QUERY_ROWS, BLOCK_QUERIES, BLOCK_SIDE = 20_000, 2_048, 1_024


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column
    n = len(column)
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each row and their ids, ties to the smaller id; sorts only rows with a tie at the border."""
    if score.shape[1] <= k:
        return score, ids
    part = np.argpartition(-score, k - 1, axis=1)[:, :k]
    best, own = np.take_along_axis(score, part, 1), np.take_along_axis(ids, part, 1)
    tied = np.flatnonzero((score >= best.min(1)[:, None]).sum(1) > k)
    if len(tied):
        order = np.lexsort((ids[tied], -score[tied]), axis=1)[:, :k]
        best[tied], own[tied] = np.take_along_axis(score[tied], order, 1), np.take_along_axis(ids[tied], order, 1)
    return best, own


def nearest_by_kernel(df: DataFrame, id_col: str, vector: str, queries: DataFrame, gamma: float, k: int) -> DataFrame:
    """(query_id, id, kernel, rank): the k rows most similar to each query by the RBF kernel, ties to the smaller id.

    The query set (a stated one) is scored in blocks of QUERY_ROWS against every row: each task keeps its k best per
    query, and only those are shuffled. Queries with a null vector have no rows; rows with a null vector are no answers.
    """
    spark, out = df.sparkSession, None
    rows = queries.where(F.col(vector).isNotNull()).select(id_col, vector)
    total = rows.count()
    blocks = max(1, -(-total // QUERY_ROWS))
    for block in range(blocks):
        part = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block)).collect()
        if not part:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in part]), np.array([r[1] for r in part], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            slices = range(0, len(ids), BLOCK_QUERIES)
            best = {i: (np.zeros((len(ids[i : i + BLOCK_QUERIES]), 0)), np.zeros((len(ids[i : i + BLOCK_QUERIES]), 0), np.int64)) for i in slices}
            for b in batches:
                rows, names = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
                for j in range(0, len(names), BLOCK_SIDE):
                    own = names[j : j + BLOCK_SIDE]
                    for i in slices:
                        score = _rbf(q[i : i + BLOCK_QUERIES], rows[j : j + BLOCK_SIDE], gamma).round(9)
                        best[i] = _best(np.hstack([best[i][0], score]), np.hstack([best[i][1], np.broadcast_to(own, score.shape)]), k)
            for i in slices:
                score, own = best[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + BLOCK_QUERIES], score.shape[1]), pa.int64()), pa.array(own.ravel(), pa.int64()), pa.array(score.ravel(), pa.float64())], ["query_id", "id", "kernel"])

        found = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint"), vector).mapInArrow(run, "query_id bigint, id bigint, kernel double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, kernel double, rank int")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("kernel"), "id")  # at most k rows a task and query
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def landmarks(df: DataFrame, id_col: str, vector: str, n: int = LANDMARKS) -> np.ndarray:
    rows = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(n).select(vector).collect()
    return np.array([r[0] for r in rows], np.float64)


def ridge_cv(df: DataFrame, id_col: str, vector: str, label: str, fold: Column, folds: int, gamma: float, penalty: float = 1e-2, n: int = LANDMARKS) -> DataFrame:
    """(fold, n, accuracy): kernel ridge classification, each fold predicted by a model of the others.

    Features are the Nystrom map onto the landmarks. Every task sums its rows' moments per fold; the sums (landmarks
    squared, whatever the data) are added up on the driver, which solves one small system per fold.
    """
    spark = df.sparkSession
    marks = landmarks(df, id_col, vector, n)
    t = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(vector, F.col(label).cast("bigint").alias("label"), fold.cast("int").alias("fold"))
    classes = np.array(sorted(r[0] for r in t.select("label").distinct().limit(1001).collect()))
    if len(classes) > 1000:
        raise ValueError("more than 1,000 labels")
    if not len(marks) or not len(classes):
        return spark.createDataFrame([], "fold int, n bigint, accuracy double")
    values, vectors = np.linalg.eigh(_rbf(marks, marks, gamma))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-10))
    m, c = whiten.shape[1], len(classes)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, m, m + c))
        for b in batches:
            x = _rbf(_matrix(b.column(0)), marks, gamma) @ whiten
            y = (b.column(1).to_numpy()[:, None] == classes[None, :]) * 2.0 - 1
            f = b.column(2).to_numpy()
            for k in range(folds):
                xs = x[f == k]
                sums[k] += np.hstack([xs.T @ xs, xs.T @ y[f == k]])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x, np.float64) for b in batches for x in b.column(0).to_pylist())
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = t.mapInArrow(moments, "sums binary").coalesce(16).mapInArrow(add, "sums binary").collect()
    sums = sum(np.frombuffer(r.sums, np.float64) for r in parts).reshape(folds, m, m + c)
    whole = sums.sum(0)
    weights = np.stack([np.linalg.solve((whole - sums[k])[:, :m] + penalty * np.eye(m), (whole - sums[k])[:, m:]) for k in range(folds)])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, f = _rbf(_matrix(b.column(0)), marks, gamma) @ whiten, b.column(2).to_numpy()
            guess = classes[np.einsum("nm,nmc->nc", x, weights[f]).argmax(1)] if len(f) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array((guess == b.column(1).to_numpy()).astype(np.float64))], ["fold", "hit"])

    return t.mapInArrow(check, "fold int, hit double").groupBy("fold").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


def principal_components(df: DataFrame, id_col: str, vector: str, gamma: float, n: int = LANDMARKS) -> DataFrame:
    """(id, pc1, pc2): kernel principal components of all rows in Nystrom features; sign: largest weight positive.

    Every task sums mean and second moments of its rows' features; the driver adds them up (landmarks squared, whatever the
    data) and decomposes their covariance. The landmarks only span the features.
    """
    marks = landmarks(df, id_col, vector, n)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(vector).isNotNull()).select(id_col, vector)
    if not len(marks):
        return rows.select(id_col, F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2"))
    values, vectors = np.linalg.eigh(_rbf(marks, marks, gamma))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-10))
    m = whiten.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((m + 1, m + 1))
        for b in batches:
            x = np.hstack([_rbf(_matrix(b.column(0)), marks, gamma) @ whiten, np.ones((b.num_rows, 1))]) if b.num_rows else np.zeros((0, m + 1))
            sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x, np.float64) for b in batches for x in b.column(0).to_pylist())
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.select(vector).mapInArrow(moments, "sums binary").coalesce(16).mapInArrow(add, "sums binary").collect()
    sums = sum(np.frombuffer(r.sums, np.float64) for r in parts).reshape(m + 1, m + 1)
    centre = sums[m, :m] / sums[m, m]
    top = np.linalg.eigh(sums[:m, :m] / sums[m, m] - np.outer(centre, centre))[1][:, ::-1][:, :2]
    top = np.hstack([top, np.zeros((m, 2 - top.shape[1]))])  # one landmark has one component
    top = top * np.where(top[np.abs(top).argmax(0), range(2)] < 0, -1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pc = (_rbf(_matrix(b.column(1)), marks, gamma) @ whiten - centre) @ top if b.num_rows else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pc[:, 0]), pa.array(pc[:, 1])], [id_col, "pc1", "pc2"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, pc1 double, pc2 double")
