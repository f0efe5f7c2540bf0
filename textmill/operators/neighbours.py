"""Exact dense neighbours of a stated query set, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.rank import top_k

QUERY_BLOCK, VECTOR_BLOCK = 2000, 20_000


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a column of equally long vectors; an all-zero vector stays zero."""
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return np.divide(values, norm, out=np.zeros_like(values), where=norm > 0)


def _best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.sort_by("vec_id")
        ids = right["vec_id"].to_numpy()
        asked = left["vec_id"].to_numpy()
        scores = np.round(_rows(left["v"]) @ _rows(right["v"]).T, 6)
        scores[asked[:, None] == ids[None, :]] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(asked)), order.shape[1])
        found = order.ravel()
        keep = np.isfinite(scores[rows, found])
        return pa.table({"query_id": pa.array(asked[rows[keep]]), "neighbour": pa.array(ids[found[keep]]), "score": pa.array(scores[rows[keep], found[keep]])})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, neighbour, score (cosine, six places) and rank of the k nearest other vectors.

    Both sides have vec_id and v. Each pair of a query block and a vector block is one group of bounded size, which keeps
    its best k for each query; only these are ranked. Neither side is broadcast or gathered.
    """
    n_queries, n_vectors = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    own = lambda df, n: df.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("_own"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own(queries, n_queries).withColumnRenamed("_own", "_a").withColumn("_b", every(n_vectors))
    right = own(vectors, n_vectors).withColumnRenamed("_own", "_b").withColumn("_a", every(n_queries))
    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(_best(k), "query_id long, neighbour long, score double")
    return top_k(found, "query_id", "neighbour", "score", k)
