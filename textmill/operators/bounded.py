"""Exact BM25 top-k with bounds: most blocks of units are left out because their best possible score is too low.

Units lie in blocks of about ``BLOCK_UNITS`` of similar length, so that a block's scores are alike. Two tables are kept
beside an index, both clustered and sorted by term: impacts (a posting's part of the score) and maxima (the largest
impact of a term in a block). A search reads the maxima of its terms only; their sums bound every unit of a block.
The postings of each query's most promising blocks give the k-th best score so far, and then those of the blocks whose
bound reaches it. A block that is left out has no unit among the best k, ties included, so the rows are those of a
full scan.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textmill.operators import index as I
from textmill.operators.blockwise import foremost
from textmill.operators.rank import top_k
from textmill.operators.store import ASKED_ROWS, BUCKET_ROWS, Index, exists
from textmill.session import shared_folder

BLOCK_UNITS = 64
#: Groups of lengths that blocks are cut from, at most.
LENGTHS = 64
#: Query terms up to which the scan is told them, so that it skips row groups; beyond, the join alone decides.
NAMED_TERMS = 2000


@dataclass(frozen=True)
class Blocks:
    """impacts: term, block, unit, impact; maxima: term, block, most."""

    key: str
    impacts: DataFrame
    maxima: DataFrame


def block_of(index: Index, block_units: int = BLOCK_UNITS) -> Column:
    """The block of a unit from its length and id: the group of its length, then one of several by hash."""
    n = index.units.count()
    groups = max(1, min(LENGTHS, n // block_units))
    shares = [F.lit(i / groups) for i in range(1, groups)]
    edges = sorted(set(index.units.agg(F.percentile_approx("length", F.array(*shares), 10_000)).first()[0] or [])) if shares else []
    several = max(1, -(-n // ((len(edges) + 1) * block_units)))
    group = F.size(F.filter(F.array(*[F.lit(int(e)) for e in edges]).cast("array<long>"), lambda e: e < F.col("length")))
    return group.cast("long") * several + F.pmod(F.xxhash64(index.key), F.lit(several))


def write_blocks(index: Index, path: str, block_units: int = BLOCK_UNITS) -> None:
    """Write impacts and maxima of an index below ``path``; the mark is written last."""
    spark = index.units.sparkSession
    part = I.bm25_part(F.col("tf"), F.col("length"), F.col("df"), index.n_units, index.avg_length)
    rows = index.postings.select("term", block_of(index, block_units).alias("block"), F.col(index.key), part.alias("impact"))
    n = index.postings.count()
    dealt = rows.repartition(max(8, -(-n // BUCKET_ROWS)), "term").sortWithinPartitions("term", "block")
    dealt.write.parquet(f"{path}/impacts")
    most = spark.read.parquet(f"{path}/impacts").groupBy("term", "block").agg(F.max("impact").alias("most"))
    most.repartition(max(8, -(-n // BUCKET_ROWS)), "term").sortWithinPartitions("term", "block").write.parquet(f"{path}/maxima")
    spark.range(1).coalesce(1).write.parquet(f"{path}/whole")


_kept: dict[tuple, str] = {}


def blocks_of(index: Index, block_units: int = BLOCK_UNITS) -> Blocks:
    """The blocks of an index, written at their first use."""
    spark = index.units.sparkSession
    name = (spark.sparkContext.applicationId, index.path or index.postings.semanticHash(), block_units)
    path = _kept.get(name)
    if path is None or not exists(spark, f"{path}/whole"):
        path = f"{shared_folder(spark)}/blocks_{uuid.uuid4().hex}"
        write_blocks(index, path, block_units)
        _kept[name] = path
    return Blocks(index.key, spark.read.parquet(f"{path}/impacts"), spark.read.parquet(f"{path}/maxima"))


@dataclass(frozen=True)
class Search:
    """The rows of a bounded search, and what it scores: (query, term, block) of both rounds."""

    rows: DataFrame
    read: DataFrame


def bounded_top_k(blocks: Blocks, queries: DataFrame, query: str, k: int, first_blocks: int | None = None) -> Search:
    """query, unit, score (BM25, six places) and rank of the best k units that share a term with each query."""
    asked = I.terms(queries, query, distinct=True).distinct()
    first_blocks = first_blocks or max(2, -(-2 * k // BLOCK_UNITS) + 1)
    named = [r["term"] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    told = (lambda df: df.where(F.col("term").isin(named))) if len(named) <= NAMED_TERMS else (lambda df: df)
    met = told(blocks.maxima).join(asked, "term")
    bounds = met.groupBy(query, "block").agg(F.sum("most").alias("bound"))
    placed = bounds.withColumn("_p", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "block")))

    def scored(chosen: DataFrame) -> DataFrame:
        pairs = asked.join(chosen, query)
        return told(blocks.impacts).join(pairs, ["term", "block"]).groupBy(query, blocks.key).agg(F.round(F.sum("impact"), 6).alias("score"))

    first = placed.where(F.col("_p") <= first_blocks).select(query, "block")
    best = top_k(scored(first), query, blocks.key, "score", k)
    reached = best.groupBy(query).agg(F.max("rank").alias("_n"), F.min("score").alias("_s"))
    least = reached.select(query, F.when(F.col("_n") >= k, F.col("_s")).otherwise(F.lit(0.0)).alias("_least"))
    # a bound is a sum of doubles in another order than a score, so it is given a little room
    rest = placed.where(F.col("_p") > first_blocks).join(least, query, "left").where(F.col("bound") + 1e-5 >= F.coalesce("_least", F.lit(0.0))).select(query, "block")
    rows = top_k(best.drop("rank").unionByName(_foremost(told(blocks.impacts), asked, rest, query, blocks.key, k)), query, blocks.key, "score", k)
    return Search(rows, asked.join(first.unionByName(rest), query))


def _foremost(impacts: DataFrame, asked: DataFrame, chosen: DataFrame, query: str, unit: str, k: int) -> DataFrame:
    """query, unit and score of the best k units of each query in each group of blocks, of its chosen blocks alone.

    A group's impacts lie in order of term and block, so only the ranges of a query's terms in its blocks are added up;
    their pairs of query and unit are sums of a task, not rows.
    """
    groups = max(8, impacts.sparkSession.sparkContext.defaultParallelism, -(-impacts.count() // ASKED_ROWS))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("_group")
    of = asked.groupBy(query).agg(F.collect_list("term").alias("_terms"))
    right = chosen.groupBy(query, group).agg(F.collect_list("block").alias("_blocks")).join(of, query)
    left = impacts.select(group, F.col(unit), "term", "block", "impact")
    kinds = (asked.schema[query].dataType, impacts.schema[unit].dataType)
    out = pa.schema([(query, to_arrow_type(kinds[0])), (unit, to_arrow_type(kinds[1])), ("score", pa.float64())])
    one = lambda array: pa.concat_arrays(array.chunks) if array.num_chunks != 1 else array.chunk(0)

    def run(_: tuple, impacts: pa.Table, asked: pa.Table) -> pa.Table:
        if not impacts.num_rows or not asked.num_rows:
            return out.empty_table()
        words, units = one(impacts["term"]).dictionary_encode(), one(impacts[unit]).dictionary_encode()
        known, block = np.unique(one(impacts["block"]).to_numpy(zero_copy_only=False), return_inverse=True)
        key = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(known) + block
        order = np.argsort(key, kind="stable")
        key, row, part = key[order], units.indices.to_numpy(zero_copy_only=False)[order], one(impacts["impact"]).to_numpy(zero_copy_only=False)[order]
        n = len(units.dictionary)
        place = np.empty(n, np.int64)
        place[pc.sort_indices(units.dictionary).to_numpy()] = np.arange(n)
        found = []
        for terms, mine in zip(asked["_terms"].to_pylist(), asked["_blocks"].to_pylist(), strict=True):
            codes = pc.drop_null(pc.index_in(pa.array(terms, pa.string()), value_set=words.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            ranges = (codes[:, None] * len(known) + np.flatnonzero(np.isin(known, mine))[None, :]).ravel()
            first, last = np.searchsorted(key, ranges), np.searchsorted(key, ranges, "right")
            many = last - first
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            sums, cover = np.bincount(row[at], part[at], n), np.bincount(row[at], minlength=n)
            best = foremost(sums, cover, place, k)
            found.append((best, sums[best]))
        which = pa.array(np.repeat(np.arange(len(found)), [len(b) for b, _ in found]))
        return pa.Table.from_arrays([one(asked[query]).take(which), units.dictionary.take(pa.array(np.concatenate([b for b, _ in found]))), pa.array(np.concatenate([s for _, s in found]))], schema=out)

    ddl = f"`{query}` {kinds[0].simpleString()}, `{unit}` {kinds[1].simpleString()}, score double"
    found = left.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(run, ddl)
    return found.withColumn("score", F.round("score", 6))


def postings_read(blocks: Blocks, search: Search) -> tuple[int, int]:
    """(postings that a search scores, postings of its terms), counted for each query."""
    pairs = search.read
    query_terms = pairs.drop("block").distinct()
    return blocks.impacts.join(pairs, ["term", "block"]).count(), blocks.impacts.join(query_terms, "term").count()
