"""Best units of each query by block: the rows of a full scan, and few rows leave a block."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import blockwise as BW
from textmill.operators import index as I
from textmill.operators import rank as R
from textmill.operators import store as ST

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def case(spark):
    """Copies (ties), an empty and a null text; queries with copies, unknown terms, none and many terms."""
    rng = random.Random(4)
    pick = lambda n: " ".join(rng.choice(WORDS[:20] if rng.random() < 0.6 else WORDS) for _ in range(n))
    docs = [(i * 7 % 1009, pick(rng.randint(1, 60))) for i in range(500)]
    docs += [(2000 + i, docs[3][1]) for i in range(40)] + [(3000, ""), (3001, None), (None, "w0 w1")]
    asked = [(i, pick(rng.randint(1, 20))) for i in range(30)] + [(40, docs[3][1]), (41, docs[3][1]), (42, "unknown w1"), (43, "unknown"), (44, ""), (None, "w0")]
    index = ST.unstored(I.tokenised(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "doc_id"), "doc_id")
    return index, I.tokenised(spark.createDataFrame(asked, "item_id long, text string"), "item_id")


def rows(df):
    return sorted(map(tuple, df.select("item_id", "doc_id", "score", "rank").collect()))


@pytest.mark.parametrize(("score", "k", "group"), [("bm25", 5, 100_000), ("tfidf", 10, 100_000), ("bm25", 3, 7)])
def test_rows_of_a_full_scan(case, monkeypatch, score, k, group):
    monkeypatch.setattr(BW, "GROUP_QUERIES", group)
    index, queries = case
    full = R.top_k(R.lexical(index, queries, "item_id").select("item_id", "doc_id", F.col(score).alias("score")), "item_id", "doc_id", "score", k)
    assert rows(BW.best(index, queries, "item_id", score, k)) == rows(full)


def test_restricted_units_and_other_order(case):
    index, queries = case
    among = index.units.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("kind"))
    named = F.concat("kind", F.lit("\0"), F.col("doc_id").cast("string"))
    found = BW.best(index, queries, "item_id", "bm25", 5, among, named).select("item_id", F.split("doc_id", "\0")[1].cast("long").alias("doc_id"), "score", "rank")
    scores = R.bm25(index, queries, "item_id").join(among, "doc_id").withColumn("_name", named)
    expected = R.top_k(scores, "item_id", "_name", "score", 5)
    assert rows(found) == rows(expected)


def test_near_pairs(case):
    index, queries = case
    found = BW.near(index, queries, "item_id").select("item_id", "doc_id", "cover", "q_terms")
    expected = R.lexical(index, queries, "item_id").where("cover >= q_terms - 2").select("item_id", "doc_id", "cover", "q_terms")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_few_rows_leave_a_block(case):
    """At most k for each query and block, where a full scan makes a row of every pair with a common term."""
    index, queries = case
    pairs = R.lexical(index, queries, "item_id").groupBy("item_id").count()
    left = BW._scored(index, queries, "item_id", "bm25", 2, None, None).groupBy("item_id").count()
    assert left.agg(F.max("count")).first()[0] <= 2 * index.buckets
    assert left.agg(F.sum("count")).first()[0] < pairs.agg(F.sum("count")).first()[0] / 5
