"""The index of query terms alone: the counts and ranks of the full index, and few rows that are shuffled or leave a task."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import blockwise as BW
from textmill.operators import bounded as BD
from textmill.operators import grams as G
from textmill.operators import index as I
from textmill.operators import store as ST

ODD = ["", None, "x-1 -x- a--b 12ab 1.5.2 1-2-a 7. .7 3-", "KK İstanbul straße ﬁn éa ١", "A1-b2 a_b don't 10mg 2.5cm", "w0 w0 w0-w1"]


def folded(t):
    return " " + re.sub(r"\s+", " ", t.lower()).strip(" ") + " "


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("asked")
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    pick = lambda n: " ".join(rng.choice(words[:15] if rng.random() < 0.4 else words) for _ in range(n))
    docs = [(i, pick(rng.randint(1, 80)), i % 2) for i in range(400)] + [(500 + i, t, 0) for i, t in enumerate(ODD)] + [(None, "w0", 1)]
    asked = [(i, pick(8)) for i in range(12)] + [(20, docs[3][1]), (21, " ".join(t or "" for t in ODD)), (22, None), (23, "none")]
    spark.createDataFrame(docs, "doc_id long, text string, kind long").repartition(3).write.parquet(f"{folder}/d")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/q")
    return spark.read.parquet(f"{folder}/d"), spark.read.parquet(f"{folder}/q")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("told", [500_000, 10])
def test_counts_and_ranks_of_the_full_index(spark, tables, monkeypatch, told):
    docs, asked = tables
    monkeypatch.setattr(ST, "TOLD_TERMS", told)
    monkeypatch.setattr(ST, "_built", {})
    part, full = ST.index_for(docs, "doc_id", asked, ("kind",)), ST.unstored(I.tokenised(docs, "doc_id"), "doc_id")
    queries = I.tokenised(asked, "item_id")
    terms = I.terms(queries, distinct=True).distinct()
    columns = ("doc_id", "term", "tf", "length", "df")
    assert rows(part.postings.where("doc_id IS NOT NULL"), *columns) == rows(full.postings.where("doc_id IS NOT NULL").join(terms, "term", "left_semi").join(part.terms.withColumnRenamed("df", "_df"), "term").withColumn("df", F.col("_df")), *columns)
    assert part.postings.count() < full.postings.count() / 3
    assert part.units.count() == docs.count() and set(part.units.columns) == {"doc_id", "kind", "length"}
    assert part.units.agg(F.sum("length")).first()[0] == I.tokenised(docs, "doc_id").agg(F.sum("length")).first()[0]
    whole = ST.unstored(I.tokenised(docs.where("doc_id IS NOT NULL"), "doc_id"), "doc_id")
    known = ST.index_for(docs.where("doc_id IS NOT NULL"), "doc_id", asked)
    best = lambda index: rows(BW.best(index, queries, "item_id", "bm25", 5), "item_id", "doc_id", "score", "rank")
    near = lambda index: rows(BW.near(index, queries, "item_id"), "item_id", "doc_id", "cover", "q_terms")
    assert best(known) == best(whole) and near(known) == near(whole)
    assert rows(BD.bounded_top_k(BD.blocks_of(known, 16), queries, "item_id", 5).rows, "item_id", "doc_id", "score", "rank") == best(whole)


def test_the_second_round_of_a_bounded_search_leaves_few_rows(spark, tables):
    """At most k for each query and group of blocks, where each pair of query and unit was a row."""
    docs, asked = tables
    index = ST.index_for(docs.where("doc_id IS NOT NULL"), "doc_id", asked)
    blocks, terms = BD.blocks_of(index, 16), I.terms(I.tokenised(asked, "item_id"), "item_id", distinct=True).distinct()
    chosen = blocks.impacts.join(terms, "term").select("item_id", "block").distinct()
    pairs = blocks.impacts.join(terms, "term").select("item_id", "doc_id").distinct().count()
    left = BD._foremost(blocks.impacts, terms, chosen, "item_id", "doc_id", 2)
    assert left.groupBy("item_id").count().agg(F.max("count")).first()[0] <= 2 * 8
    assert left.count() < pairs / 5


def test_long_texts_are_not_counted_for_short_queries(spark, monkeypatch):
    """A text too large for any query's best k is left out before its grams are matched; the rows stay those of all texts."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short = [text(60) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(short)] + [(100 + i, text(5000)) for i in range(30)]
    block = G._Block([(i, G.gram_numbers(folded(t))) for i, t in enumerate(short[:5])])
    grams = G._grams(folded(docs[-1][1]))
    assert 0.95 * len(G.gram_numbers(folded(docs[-1][1]))) < G._at_least(grams) <= len(G.gram_numbers(folded(docs[-1][1])))
    assert (block.most(len(grams)) < 0.05).all()
    assert (block.shared(block.met(grams)) == block.shared(np.unique(grams))).all()
    units = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    queries = spark.createDataFrame(list(enumerate(short[:5])), "item_id long, text string")
    found = rows(G.most_similar(units, "doc_id", "text", queries, "item_id", "text", 3), "item_id", "doc_id", "score", "rank")
    monkeypatch.setattr(G, "ROUND", 3)
    assert found == rows(G.most_similar(units, "doc_id", "text", queries, "item_id", "text", 3), "item_id", "doc_id", "score", "rank")
    expected = []
    for q, t in enumerate(short[:5]):
        a = set(G.gram_numbers(folded(t)).tolist())
        own = sorted((-round(len(a & b) / len(a | b), 6), d) for d, x in docs if a & (b := set(G.gram_numbers(folded(x)).tolist())))
        expected += [(q, d, -s, i + 1) for i, (s, d) in enumerate(own[:3])]
    assert found == sorted(expected)
