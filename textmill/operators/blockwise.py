"""Best units of each query where the postings lie: scores of all pairs are summed in a task and only the best leave it.

A block holds the postings of some units whole, and a group is a block with a part of the queries. A query's postings in
the block are added up by numpy, so of the pairs of a query and a block only the k best units (or those that ``near``
asks for) become rows: what is shuffled grows with the postings and with queries times blocks, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textmill.operators import index as I
from textmill.operators.rank import divided, top_k
from textmill.operators.store import Index

#: Queries that one group should hold about; more are dealt to several groups of each block.
GROUP_QUERIES = 100_000


def _asked(index: Index, queries: DataFrame, query: str, score: str) -> DataFrame:
    """query, q_norm, q_terms and _of (its distinct terms with their weights, by term) of each query."""
    if score == "tfidf":
        rows = I.postings(queries, query).join(index.terms, "term").select(query, "term", (F.col("tf") / F.col("length") * index.idf()).alias("weight"))
    else:
        rows = I.terms(queries, query, distinct=True).distinct().withColumn("weight", F.lit(1.0))
    return rows.where(F.col(query).isNotNull()).groupBy(query).agg(
        F.sqrt(F.sum(F.pow("weight", F.lit(2.0)))).alias("q_norm"), F.count_distinct("term").alias("q_terms"), F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_of")
    )


def foremost(sums: np.ndarray, cover: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k units with the largest sums (six places) of those that are met; ties go to the smaller place."""
    met = np.flatnonzero(cover)
    rounded = np.floor(sums[met] * 1e6 + 0.5)
    if len(met) > k:
        keep = rounded >= np.partition(rounded, len(met) - k)[len(met) - k]
        met, rounded = met[keep], rounded[keep]
    return met[np.lexsort((place[met], -rounded))[:k]]


class _Lists:
    """Postings of a block by term, the units of a term in order, each once."""

    def __init__(self, row: np.ndarray, part: np.ndarray, starts: np.ndarray, place: np.ndarray) -> None:
        self.row, self.part, self.starts, self.place = row, part, starts, place
        self.size = np.diff(starts)

    def _at(self, term: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some units a term has, and where their postings lie."""
        a, b = self.starts[term], self.starts[term + 1]
        at = np.minimum(a + np.searchsorted(self.row[a:b], units), b - 1)
        hit = self.row[at] == units
        return hit, at[hit]

    def foremost(self, terms: np.ndarray, weights: np.ndarray, scale: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k units with the largest sums over ``scale``, and these; only units near the k-th sum are rounded and ordered."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        parts = np.concatenate([self.part[s] if w == 1 else self.part[s] * w for s, w in zip(spans, weights, strict=True)])
        sums = np.bincount(np.concatenate([self.row[s] for s in spans]), parts, len(self.place))
        least = np.partition(sums, len(sums) - k)[len(sums) - k] - 2e-6 * scale if len(sums) > k else 0.0
        units = np.flatnonzero(sums >= least) if least > 0 else np.flatnonzero(sums)
        own = sums[units] / scale
        best = foremost(own, np.ones(len(own)), self.place[units], k)
        return units[best], own[best]

    def covering(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Units with that many of the terms and with one at least, and their numbers of terms.

        A unit that misses few has one of the rarest, so only those are looked up in the lists of the others.
        """
        spare = len(terms) - max(least, 1)
        if spare < 0:
            return np.zeros(0, np.int64), np.zeros(0)
        terms = terms[np.argsort(self.size[terms], kind="stable")]
        units, cover = np.unique(np.concatenate([self.row[self.starts[t] : self.starts[t + 1]] for t in terms[: spare + 1]]), return_counts=True)
        for i, t in enumerate(terms[spare + 1 :], spare + 1):
            still = cover + len(terms) - i >= least
            units, cover = units[still], cover[still]
            hit, _ = self._at(t, units)
            cover[hit] += 1
        still = cover >= least
        return units[still], cover[still].astype(np.float64)


def _one(array: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(array.chunks) if array.num_chunks != 1 else array.chunk(0)


def _kernel(score: str, k: int | None, names: tuple[str, str], out: pa.Schema) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    query, one = names[0], _one

    def found(postings: pa.Table, asked: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        units = one(postings["_unit"]).dictionary_encode()
        words = one(postings["term"]).dictionary_encode()
        code, row = (x.indices.to_numpy(zero_copy_only=False) for x in (words, units))
        order = np.lexsort((row, code))
        code, row = code[order], row[order]
        part = one(postings["part"]).to_numpy(zero_copy_only=False)[order]
        n = len(units.dictionary)
        place = np.empty(n, np.int64)
        place[pc.sort_indices(units.dictionary).to_numpy()] = np.arange(n)
        if score == "tfidf":
            norm = np.zeros(n)
            np.maximum.at(norm, row, one(postings["norm"]).to_numpy(zero_copy_only=False)[order])
            part = part / norm[row]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
        if len(first) < len(row):  # a unit that stands in several rows
            part = np.add.reduceat(part, first) if score in ("bm25", "tfidf") else part[first]
            code, row = code[first], row[first]
        lists = _Lists(row, part, np.searchsorted(code, np.arange(len(words.dictionary) + 1)), place)
        of = one(asked["_of"])
        ends, pairs = of.offsets.to_numpy(), of.values
        codes = pc.fill_null(pc.index_in(pairs.field("term"), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)
        weights = pairs.field("weight").to_numpy()
        q_norm, terms = one(asked["q_norm"]).to_numpy(), one(asked["q_terms"]).to_numpy()
        for q in range(len(of)):
            mine, weight = codes[ends[q] : ends[q + 1]], weights[ends[q] : ends[q + 1]]
            mine, weight = mine[mine >= 0], weight[mine >= 0]
            if not len(mine):
                continue
            if k is None:
                best, sums = lists.covering(mine, terms[q] - 2)
            else:
                best, sums = lists.foremost(mine, weight, {"bm25": 1.0, "tfidf": q_norm[q], "share": terms[q]}[score], k)
            yield q, best, sums

    def run(_: tuple, postings: pa.Table, asked: pa.Table) -> pa.Table:
        if not postings.num_rows or not asked.num_rows:
            return out.empty_table()
        got = list(found(postings, asked))
        if not got:
            return out.empty_table()
        of = pa.array(np.repeat([q for q, _, _ in got], [len(b) for _, b, _ in got]).astype(np.int64))
        units = one(postings["_unit"]).dictionary_encode().dictionary.take(pa.array(np.concatenate([b for _, b, _ in got])))
        sums = pa.array(np.concatenate([s for _, _, s in got]))
        return pa.Table.from_arrays([one(asked[query]).take(of), units, sums, one(asked["q_terms"]).take(of)], schema=out)

    return run


def _scored(index: Index, queries: DataFrame, query: str, score: str, k: int | None, among: DataFrame | None, unit: Column | None) -> DataFrame:
    """query, unit, score and q_terms of the units that each block chooses."""
    postings = index.postings if among is None else index.postings.join(among, index.key, "left_semi" if among.columns == [index.key] else "inner")
    part = {
        "bm25": I.bm25_part(F.col("tf"), F.col("length"), F.col("df"), index.n_units, index.avg_length),
        "tfidf": F.col("tf") / F.col("length") * index.idf(),
        "cover": F.lit(1.0),
        "share": F.lit(1.0),
    }[score]
    several = max(1, -(-queries.count() // GROUP_QUERIES))
    block = F.pmod(F.xxhash64(index.key), F.lit(index.buckets)).cast("int").alias("_block")
    norm = F.col("norm") if score == "tfidf" else F.lit(1.0)
    unit = F.col(index.key) if unit is None else unit
    groups = F.explode(F.sequence(F.lit(0), F.lit(several - 1)))
    left = postings.select(block, unit.alias("_unit"), "term", part.alias("part"), norm.alias("norm")).withColumn("_group", groups)
    asked = _asked(index, queries, query, score).withColumn("_group", F.pmod(F.xxhash64(query), F.lit(several)).cast("int"))
    right = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(index.buckets - 1))))
    kinds = (queries.schema[query].dataType, left.schema["_unit"].dataType)
    out = pa.schema([(query, to_arrow_type(kinds[0])), (index.key, to_arrow_type(kinds[1])), ("score", pa.float64()), ("q_terms", pa.int64())])
    ddl = f"`{query}` {kinds[0].simpleString()}, `{index.key}` {kinds[1].simpleString()}, score double, q_terms long"
    run = _kernel(score, k, (query, index.key), out)
    return left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInArrow(run, ddl)


def best(index: Index, queries: DataFrame, query: str, score: str, k: int, among: DataFrame | None = None, unit: Column | None = None) -> DataFrame:
    """query, unit, score (bm25 or tfidf, six places) and rank of the k best units with a common term; ties go to the smaller unit.

    The score may also be share: distinct query terms found, of all of them. ``among`` (the key and perhaps more columns,
    one row for each unit) restricts the units, ``unit`` may name another value than the key by which units are known and
    ordered.
    """
    rows = _scored(index, queries, query, score, k, among, unit).select(query, index.key, F.round("score", 6).alias("score"))
    return top_k(rows, query, index.key, "score", k)


def near(index: Index, queries: DataFrame, query: str) -> DataFrame:
    """query, unit, cover and q_terms of the pairs whose unit has all of the query's distinct terms but two."""
    return _scored(index, queries, query, "cover", None, None, None).select(query, index.key, F.col("score").cast("long").alias("cover"), "q_terms")


#: Scores of ``fused``, each with six places.
FUSED = ("keyword", "tfidf", "bm25", "dense", "metadata")


def _six(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def _scores(units: pa.Table, asked: pa.Table, query: str, key: str, fields: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of a query, places of the units that have a term of it and meet its filters, their scores by ``FUSED``)."""
    counts = _one(units["counts"])
    row, pairs = pc.list_parent_indices(counts).to_numpy(zero_copy_only=False), counts.flatten()
    words = pairs.field("term").dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(words.dictionary) + 1))
    row, tf = row[order], pairs.field("tf").to_numpy(zero_copy_only=False)[order].astype(np.float64)
    m = len(units)
    length, norm = (_one(units[c]).to_numpy(zero_copy_only=False) for c in ("length", "norm"))
    vectors = _one(units["vector"]).flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
    whole = _one(units["_whole"])
    holders, held = pc.list_parent_indices(whole).to_numpy(zero_copy_only=False), whole.flatten()
    of = _one(asked["_of"])
    ends, terms = of.offsets.to_numpy(), of.values
    codes = pc.fill_null(pc.index_in(terms.field("term"), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)
    weight, df = (terms.field(c).to_numpy(zero_copy_only=False) for c in ("weight", "df"))
    n, average, q_norm, q_terms = (_one(asked[c]).to_numpy(zero_copy_only=False) for c in ("n", "average", "q_norm", "q_terms"))
    q_vector, filters = asked["_vector"].to_pylist(), asked["_filters"].to_pylist()
    equal = {}
    for name, value in {(f["key"], f["value"]) for one in filters for f in one}:
        equal[name, value] = pc.fill_null(pc.equal(_one(units[name]), value), False).to_numpy(zero_copy_only=False) if name in fields and value is not None else np.zeros(m, bool)
    of_query = pc.index_in(held, value_set=_one(asked[query])).to_numpy(zero_copy_only=False) if len(held) else np.zeros(0)
    for q in range(len(of)):
        mine = [(c, w, d) for c, w, d in zip(codes[ends[q] : ends[q + 1]], weight[ends[q] : ends[q + 1]], df[ends[q] : ends[q + 1]], strict=True) if c >= 0]
        if not mine:
            continue
        spans = [slice(starts[c], starts[c + 1]) for c, _, _ in mine]
        rows, f = np.concatenate([row[s] for s in spans]), np.concatenate([tf[s] for s in spans])
        each = np.repeat(np.arange(len(mine)), [s.stop - s.start for s in spans])
        d, w = np.array([d for _, _, d in mine], np.float64), np.array([w for _, w, _ in mine])
        rare, idf = np.log(1 + (n[q] - d + 0.5) / (d + 0.5)), np.log((1 + n[q]) / (1 + d)) + 1
        bm25 = np.bincount(rows, rare[each] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length[rows] / average[q])), m)
        tfidf = np.bincount(rows, f / length[rows] * (idf * w)[each], m)
        share = np.bincount(rows, minlength=m) / q_terms[q]
        met = share > 0
        for one in filters[q]:
            met &= equal[one["key"], one["value"]]
        share[holders[of_query == q]] += 0.25
        met = np.flatnonzero(met)
        if not len(met):
            continue
        dense = vectors[met] @ np.array(q_vector[q]) if q_vector[q] is not None else np.zeros(len(met))
        yield q, met, np.stack([_six(np.minimum(1.0, share[met])), _six(tfidf[met] / (norm[met] * q_norm[q])), _six(bm25[met]), _six(dense), np.full(len(met), 1.0 if filters[q] else 0.0)])


def fused(units: DataFrame, terms: DataFrame, n: Column, average: Column, queries: DataFrame, query: str, key: str, filters: Column, whole: DataFrame, vectors: DataFrame, weights: dict[str, float], blocks: int, k: int) -> DataFrame:
    """query, unit, score and rank of the k best units by ``rank.fused`` of five scores, of those with a common term.

    ``units`` are those of ``store.unit_rows``, ``whole`` the pairs whose unit holds the whole query, ``vectors`` those of
    the queries; ``filters`` (a map of fields to values) leave out units that differ. A score is divided by its maximum for
    the query, so blocks are met twice: first for the maxima, then for the best k by them. No pair is a row but these.
    """
    known = I.postings(queries, query).join(terms, "term")
    q_weight = F.col("tf") / F.col("length") * I.idf(n, F.col("df"))
    of = known.withColumn("weight", q_weight).groupBy(query).agg(F.sqrt(F.sum(F.pow("weight", F.lit(2.0)))).alias("q_norm"), F.array_sort(F.collect_list(F.struct("term", "weight", "df"))).alias("_of"))
    asked = queries.where(F.col(query).isNotNull()).select(query, F.size(F.array_distinct("tokens")).alias("q_terms"), F.map_entries(filters).alias("_filters"))
    asked = asked.join(of, query).join(vectors.select(query, F.col("vector").alias("_vector")), query, "left").withColumns({"n": n, "average": average})
    several = max(1, -(-queries.count() // GROUP_QUERIES))
    held = whole.groupBy(key).agg(F.collect_set(query).alias("_whole"))
    kind, unit_kind = queries.schema[query].dataType, units.schema[key].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    left = units.join(held, key, "left").withColumn("_whole", F.coalesce("_whole", none))
    left = left.withColumns({"_block": F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), "_group": F.explode(F.sequence(F.lit(0), F.lit(several - 1)))}).groupBy("_block", "_group")
    fields = tuple(c for c in units.columns if c not in (key, "length", "norm", "counts", "vector"))

    def met(right: DataFrame, run: Callable[[tuple, pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
        dealt = right.withColumns({"_group": F.pmod(F.xxhash64(query), F.lit(several)).cast("int"), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        return left.cogroup(dealt.groupBy("_block", "_group")).applyInArrow(run, ddl)

    most = pa.schema([(query, to_arrow_type(kind)), *[(f"_{c}", pa.float64()) for c in FUSED]])
    rows = pa.schema([(query, to_arrow_type(kind)), (key, to_arrow_type(unit_kind)), *[(c, pa.float64()) for c in FUSED]])

    def maxima(_: tuple, units: pa.Table, asked: pa.Table) -> pa.Table:
        got = [(q, s.max(axis=1)) for q, _, s in _scores(units, asked, query, key, fields)] if len(units) and len(asked) else []
        if not got:
            return most.empty_table()
        return pa.Table.from_arrays([_one(asked[query]).take(pa.array([q for q, _ in got])), *[pa.array([m[i] for _, m in got]) for i in range(len(FUSED))]], schema=most)

    def foremost_of(_: tuple, units: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(units) or not len(asked):
            return rows.empty_table()
        place = np.empty(len(units), np.int64)
        place[pc.sort_indices(_one(units[key])).to_numpy()] = np.arange(len(units))
        tops = np.stack([_one(asked[f"_{c}"]).to_numpy(zero_copy_only=False) for c in FUSED])
        got = []
        for q, at, s in _scores(units, asked, query, key, fields):
            total = sum(weights[c] * s[i] / tops[i, q] if tops[i, q] > 0 else np.zeros(len(at)) for i, c in enumerate(FUSED))
            best = foremost(total / round(sum(weights.values()), 10), np.ones(len(at)), place[at], k)
            got.append((np.full(len(best), q), at[best], s[:, best]))
        if not got:
            return rows.empty_table()
        q, at, s = (np.concatenate([g[i] for g in got], axis=-1) for i in range(3))
        return pa.Table.from_arrays([_one(asked[query]).take(pa.array(q)), _one(units[key]).take(pa.array(at)), *[pa.array(x) for x in s]], schema=rows)

    ddl = lambda names: ", ".join([f"`{query}` {kind.simpleString()}", *names])
    tops = met(asked, maxima, ddl([f"_{c} double" for c in FUSED])).groupBy(query).agg(*[F.max(f"_{c}").alias(f"_{c}") for c in FUSED])
    found = met(asked.join(tops, query), foremost_of, ddl([f"`{key}` {unit_kind.simpleString()}", *[f"{c} double" for c in FUSED]]))
    return top_k(divided(found.join(tops, query), query, key, weights), query, key, "score", k)
