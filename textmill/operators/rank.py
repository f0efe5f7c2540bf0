"""Scores, fusion, top-k, diversification and confidence. Scores are rounded before they order anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators import index as I
from textmill.operators.store import Index

#: Fusion weights of the hybrid score.
WEIGHTS = {"keyword": 0.15, "tfidf": 0.25, "bm25": 0.40, "dense": 0.15, "metadata": 0.05}


def top_k(scored: DataFrame, query: str, unit: str, score: str, k: int) -> DataFrame:
    """The k best units of each query, with rank from 1; ties go to the smaller unit."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(unit))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def lexical(index: Index, queries: DataFrame, query: str) -> DataFrame:
    """query, unit, bm25, tfidf (cosine), cover (distinct query terms found) and q_terms of every pair with a common term.

    ``queries`` has the query's key, tokens and length. All three are sums over one join of the query terms with the
    postings; these are bucketed by unit, so nothing is shuffled where the query terms are few enough to be broadcast,
    which Spark decides by their size. Scores have six places; query terms that the vocabulary lacks count in lengths.
    """
    n, key = index.n_units, index.key
    asked = I.postings(queries, query).select(query, "term", F.col("tf").alias("q_tf"), F.col("length").alias("q_length"))
    known = asked.join(index.terms, "term")
    q_weight = F.col("q_tf") / F.col("q_length") * index.idf()
    of_query = known.groupBy(query).agg(F.sqrt(F.sum(F.pow(q_weight, F.lit(2.0)))).alias("q_norm"))
    sizes = queries.select(query, F.size(F.array_distinct("tokens")).alias("q_terms"))
    terms = known.drop("df").join(of_query, query).join(sizes, query)
    found = index.postings.join(terms, "term")
    part = I.bm25_part(F.col("tf"), F.col("length"), F.col("df"), n, index.avg_length)
    product = F.col("tf") / F.col("length") * index.idf() * q_weight
    return found.groupBy(query, key).agg(
        F.round(F.sum(part), 6).alias("bm25"),
        F.round(F.sum(product) / F.max(F.col("norm") * F.col("q_norm")), 6).alias("tfidf"),
        F.count("*").alias("cover"),
        F.max("q_terms").alias("q_terms"),
    )


def bm25(index: Index, queries: DataFrame, query: str) -> DataFrame:
    return lexical(index, queries, query).select(query, index.key, F.col("bm25").alias("score"))


def tfidf(index: Index, queries: DataFrame, query: str) -> DataFrame:
    return lexical(index, queries, query).select(query, index.key, F.col("tfidf").alias("score"))


def holding(pairs: DataFrame, texts: DataFrame, query_texts: DataFrame, query: str, unit: str, form) -> DataFrame:
    """The pairs of ``lexical`` whose unit's text holds the whole text of the query, both in a normal ``form``.

    Such a unit has all of the query's terms but perhaps the first and the last, which may be parts of longer words
    there; only pairs with that many terms meet the texts.
    """
    near = pairs.where(F.col("cover") >= F.col("q_terms") - 2).select(query, unit)
    with_text = near.join(texts.select(unit, F.col("text").alias("_t")), unit)  # only texts that are met are brought to the form
    both = with_text.join(query_texts.select(query, form(F.col("text")).alias("_q")), query)
    return both.where(F.contains(form(F.col("_t")), F.col("_q"))).select(query, unit)


def keyword(pairs: DataFrame, texts: DataFrame, query_texts: DataFrame, query: str, unit: str) -> DataFrame:
    """``pairs`` with keyword: share of distinct query terms found, plus 0.25 if the text holds the whole query, 1 at most."""
    whole = holding(pairs, texts, query_texts, query, unit, F.lower).select(query, unit, F.lit(0.25).alias("_more"))
    share = F.col("cover") / F.col("q_terms") + F.coalesce("_more", F.lit(0.0))
    return pairs.join(whole, [query, unit], "left").withColumn("keyword", F.round(F.least(F.lit(1.0), share), 6)).drop("_more")


def fused(parts: DataFrame, query: str, unit: str, weights: dict[str, float]) -> DataFrame:
    """query, unit, score: the weighted mean of the columns named by ``weights``, each divided by its maximum for the query.

    The maxima are aggregates that are joined, so a query's pairs never meet in one task.
    """
    best = parts.groupBy(query).agg(*[F.max(c).alias(f"_{c}") for c in weights])
    return divided(parts.join(best, query), query, unit, weights)


def divided(parts: DataFrame, query: str, unit: str, weights: dict[str, float]) -> DataFrame:
    """query, unit, score: the weighted mean of columns, each divided by its maximum (``_`` and its name); 0 where that is none."""
    total = None
    for c, w in weights.items():
        part = F.when(F.col(f"_{c}") > 0, F.lit(w) * F.col(c) / F.col(f"_{c}")).otherwise(F.lit(0.0))
        total = part if total is None else total + part
    return parts.select(query, unit, F.round(total / F.lit(round(sum(weights.values()), 10)), 6).alias("score"))


def rrf(rankings: list[DataFrame], query: str, unit: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (constant + rank)."""
    rows = rankings[0].select(query, unit, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(query, unit, "rank"))
    return rows.groupBy(query, unit).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"))


def filters_met(filters: Column, fields: Column) -> Column:
    """Share of a query's filters (a map) that a unit's fields (a map) equal; 0 without filters."""
    equal = F.size(F.filter(F.map_entries(filters), lambda e: F.try_element_at(fields, e["key"]) == e["value"]))
    return F.when(F.size(filters) > 0, F.round(equal / F.size(filters), 10)).otherwise(F.lit(0.0))


def confidence(margin: Column, agreement: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.25) + F.greatest(F.lit(0.0), margin) + 0.45 * F.least(F.lit(1.0), agreement / 3))


def diversified(ranked: DataFrame, query: str, group: str, k: int) -> DataFrame:
    """The first unit of each group keeps its place, the others follow; ranks are counted again."""
    later = F.row_number().over(Window.partitionBy(query, group).orderBy("rank"))
    moved = ranked.withColumn("_later", (later > 1).cast("int"))
    w = Window.partitionBy(query).orderBy("_later", "rank")
    return moved.withColumn("new_rank", F.row_number().over(w).cast("long")).where(F.col("new_rank") <= k).drop("_later")


def proximity(positions: Column) -> Column:
    """Found query tokens over the span of their first positions, 1 at most; 0 with fewer than two.

    ``positions`` has the first position of each query token that the text has, repeated tokens repeatedly.
    """
    span = F.array_max(positions) - F.array_min(positions) + 1
    return F.when(F.size(positions) >= 2, F.round(F.least(F.lit(1.0), F.size(positions) / span), 6)).otherwise(F.lit(0.0))


def phrase_share(grams: Column, lowered: Column) -> Column:
    """Share of the query's bigrams that the text holds."""
    n = F.size(grams)
    return F.when(n > 0, F.round(F.size(F.filter(grams, lambda g: F.contains(lowered, g))) / n, 6)).otherwise(F.lit(0.0))
