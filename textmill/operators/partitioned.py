"""Approximate dense neighbours by a partitioned index, with exact scores, beside the exact search of ``neighbours``.

Every vector belongs to the cell of its nearest centroid. Centroids are fitted by a few rounds of spherical k-means on
a bounded sample; every row of the table is in a cell. A query looks into the cells of its nearest centroids only, and
what it finds there is scored exactly, so a row's score is the one the exact search gives; only rows of other cells
can be missing. ``recall`` measures that against the exact search.

A cell of very many vectors is cut into parts by hash, which queries meet one by one, so no task holds a whole cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.neighbours import _best, nearest
from textmill.operators.rank import top_k

#: Rows that centroids are fitted on, at most, by the order of a hash of their ids.
SAMPLE = 20_000
ROUNDS = 8
#: Vectors in one part of a cell.
PART = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit_centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``cells`` unit centroids from at most ``sample`` vectors; deterministic."""
    rows = vectors.where(F.col("v").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    x = _unit(np.array([r["v"] for r in rows], np.float64)) if rows else np.zeros((0, 0))
    if not len(x):
        return x
    step = max(1, len(x) // cells)
    centres = x[::step][:cells].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(centres)) > 0
        centres[full] = _unit(sums[full])
    return centres


def in_cells(vectors: DataFrame, centres: np.ndarray, nearest_cells: int = 1) -> DataFrame:
    """vec_id, v, cell: each vector once for each of its ``nearest_cells`` nearest centroids (ties: the lower number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-np.round(_unit(matrix(batch.column(1))) @ centres.T, 9), axis=1, kind="stable")[:, :nearest_cells]
            row = np.repeat(np.arange(batch.num_rows), order.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(order.ravel().astype(np.int32))], ["vec_id", "v", "cell"])

    return vectors.where(F.col("v").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v array<double>, cell int")


def cell_count(n: int) -> int:
    """About the square root of the table's rows."""
    return max(1, math.isqrt(max(n, 1)))


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, neighbour, score (cosine, six places) and rank of the best k other vectors in the probed cells.

    Both sides have vec_id and v, vectors of one length. Three fifths of the cells are probed unless ``probes`` says otherwise:
    vectors without clusters need that many for nine in ten of the exact neighbours, clustered ones far fewer.
    """
    cells = cells or cell_count(vectors.count())
    centres = fit_centroids(vectors, cells)
    if not len(centres):
        return nearest(queries, vectors, k)
    probes = min(len(centres), probes or -(-3 * len(centres) // 5))
    held = in_cells(vectors, centres)
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = held.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = in_cells(queries, centres, probes).join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = asked.select("vec_id", "v", "cell", "part").groupBy("cell", "part").cogroup(dealt.select("vec_id", "v", "cell", "part").groupBy("cell", "part")).applyInArrow(_best(k), "query_id long, neighbour long, score double")
    return top_k(found, "query_id", "neighbour", "score", k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours that were found (1 where there are none)."""
    hits = exact.join(found.select("query_id", "neighbour", F.lit(1).alias("hit")), ["query_id", "neighbour"], "left")
    return hits.agg(F.coalesce(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6), F.lit(1.0)).alias("recall"))
