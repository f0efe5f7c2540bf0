"""Inverted index as relations: postings, term and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as X


def tokenised(df: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns, tokens and length (tokens) of each text, which is brought to NFC first (the one Arrow pass)."""
    return df.select(key, *keep, X.nfc(F.col(text)).alias("_t")).select(key, *keep, X.tokens(F.col("_t")).alias("tokens")).withColumn("length", F.size("tokens").cast("long"))


def terms(units: DataFrame, *keep: str, distinct: bool = False) -> DataFrame:
    """``keep`` columns and one row per token (or distinct token) of each text.

    The outer form is used because the inner one makes Catalyst test the token array in a filter, and so tokenise twice.
    """
    items = F.array_distinct("tokens") if distinct else F.col("tokens")
    return units.select(*keep, F.explode_outer(items).alias("term")).where(F.col("term").isNotNull())


def postings(units: DataFrame, key: str) -> DataFrame:
    """key, term, tf and length. A text's tokens meet in one task, so map-side counting leaves little to shuffle."""
    return terms(units, key, "length").groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def term_statistics(units: DataFrame) -> DataFrame:
    """term, df: units that hold each term."""
    return terms(units, distinct=True).groupBy("term").agg(F.count("*").alias("df"))


def with_corpus(df: DataFrame, units: DataFrame) -> DataFrame:
    """Adds n_units and avg_length, one scalar aggregate over all units."""
    stats = units.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("a"))).scalar()
    return df.withColumn("_s", stats).withColumns({"n_units": F.col("_s.n"), "avg_length": F.col("_s.a")}).drop("_s")


def corpus_statistics(units: DataFrame) -> DataFrame:
    """One row: units, tokens, distinct tokens, length extremes and mean."""
    distinct = terms(units).agg(F.count_distinct("term").alias("d"))
    return units.agg(
        F.count("*").alias("n_units"),
        F.sum("length").alias("n_tokens"),
        F.round(F.avg("length"), 6).alias("avg_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
    ).withColumn("n_distinct", distinct.scalar())


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def bm25_part(tf: Column, length: Column, df: Column, n: Column, average: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))
