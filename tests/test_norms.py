"""Norms beside the index of query terms: the cosines of the full index, and few rows shuffled for them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import blockwise as BW
from textmill.operators import index as I
from textmill.operators import rank as R
from textmill.operators import store as ST
from textmill.plans import evaluation, retrieval, units


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of few frequent and many rare words, with copies, an empty and a null text; questions that some hold."""
    folder = tmp_path_factory.mktemp("norms")
    rng = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    pick = lambda n: " ".join(rng.choice(words[:15] if rng.random() < 0.6 else words) for _ in range(n))
    docs = [(i, pick(rng.randint(1, 120)), ("en", "de")[i % 2], f"src{i % 3}") for i in range(400)]
    docs += [(500 + i, docs[3][1], "en", "src1") for i in range(9)] + [(600, "", "en", "src0"), (601, None, "en", "src0")]
    asked = [(i, pick(8)) for i in range(10)] + [(20, docs[3][1]), (21, f"{docs[7][1]} unknown"), (22, "unknown"), (23, "w0")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stages(spark):
    jvm = spark.sparkContext._jvm
    found = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize(("weighed", "told", "first"), [(200_000, 500_000, True), (20, 500_000, False), (0, 500_000, True), (20, 5, True), (200_000, 5, False)])
def test_cosines_of_the_full_index(spark, folder, monkeypatch, weighed, told, first):
    """However many terms the tasks are told, and whether the index is made with norms or gets them later."""
    monkeypatch.setattr(ST, "WEIGHED_TERMS", weighed)
    monkeypatch.setattr(ST, "WEIGHED_ROWS", 30)
    monkeypatch.setattr(ST, "TOLD_TERMS", told)
    monkeypatch.setattr(ST, "_built", {})
    docs, asked = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    queries = I.tokenised(asked, "item_id")
    full = ST.unstored(I.tokenised(docs, "doc_id"), "doc_id")
    if not first:
        assert "norm" not in ST.index_for(docs, "doc_id", asked).postings.columns
    part = ST.index_for(docs, "doc_id", asked, norms=True)
    far = part.units.join(full.units.select("doc_id", F.col("norm").alias("x")), "doc_id").where("NOT (abs(norm - x) < 1e-12) OR (norm IS NULL) <> (x IS NULL)")
    assert far.count() == 0 and part.units.where("norm IS NOT NULL").count() == 409
    for score in ("tfidf", "bm25"):
        best = [rows(BW.best(index, queries, "item_id", score, 5), "item_id", "doc_id", "score", "rank") for index in (part, full)]
        assert best[0] == best[1] and len(best[0]) > 40


def test_a_cosine_ranking_shuffles_few_postings(spark, folder, monkeypatch):
    """Only those of the questions' terms reach the blocks; a full index shuffles every posting twice."""
    monkeypatch.setattr(ST, "_built", {})
    docs, asked = spark.read.parquet(f"{folder}/documents.parquet"), I.tokenised(spark.read.parquet(f"{folder}/benchmark.parquet"), "item_id")
    postings = ST.unstored(I.tokenised(docs, "doc_id"), "doc_id").postings
    n, met = postings.count(), postings.join(I.terms(asked, distinct=True).distinct(), "term", "left_semi").count()
    before = {s.stageId() for s in stages(spark)}
    assert retrieval.tfidf_ranked(spark, str(folder)).count() > 40
    moved = sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() not in before)
    assert moved < 1.2 * n, (moved, met, n)


def test_a_leaderboard_counts_terms_of_the_texts_once(spark, folder, monkeypatch):
    """Both configurations and their places come from one index, one run of pairs that may hold a question and no full index."""
    monkeypatch.setattr(ST, "_built", {})
    made = []
    for module, name in ((ST, "_counted"), (ST, "build"), (BW, "near"), (BW, "best")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: made.append(_n) or _f(*a, **k))
    found = evaluation.config_leaderboard(spark, str(folder))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(made) == ["_counted", "best", "best", "near"]
    assert "FlatMapCoGroupsInArrow" not in plan  # rankings are read, not made again for the places
    assert [(r["configuration"], r["place"]) for r in found.orderBy("place").collect()] in ([("bm25", 1), ("tfidf", 2)], [("tfidf", 1), ("bm25", 2)])


def test_fused_and_keyword_rankings_make_no_row_of_a_pair(spark, folder, monkeypatch):
    """The rows of a fusion of all pairs, with queries in one group and in several, and fewer rows shuffled than pairs."""
    monkeypatch.setattr(ST, "_built", {})
    docs, texts = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    queries, full = I.tokenised(texts, "item_id"), ST.unstored(I.tokenised(docs, "doc_id"), "doc_id")
    pairs = R.keyword(R.lexical(full, queries, "item_id"), docs, texts, "item_id", "doc_id").localCheckpoint()
    vectors = ST.hashed_vectors(queries, "item_id").select("item_id", F.col("vector").alias("q"))
    parts = pairs.join(full.units.select("doc_id", "vector"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").join(vectors, "item_id").where("item_id % 3 <> 1 OR lang = 'en'")
    parts = parts.withColumns({"metadata": F.when(F.col("item_id") % 3 == 1, 1.0).otherwise(0.0), "dense": F.round(I.dot(F.col("q"), F.col("vector")), 6)})
    columns = ("item_id", "doc_id", "score", "rank")
    hybrid = rows(R.top_k(R.fused(parts, "item_id", "doc_id", R.WEIGHTS), "item_id", "doc_id", "score", 5), *columns)
    keyword = rows(R.top_k(pairs.select("item_id", "doc_id", F.col("keyword").alias("score")), "item_id", "doc_id", "score", 5), *columns)
    before = {s.stageId() for s in stages(spark)}
    assert rows(retrieval.keyword_topk(spark, str(folder)), *columns) == keyword and len(keyword) > 50
    moved = sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() not in before)
    met = full.postings.join(I.terms(queries, distinct=True).distinct(), "term", "left_semi").count()
    assert pairs.count() > 2500 and moved < 3 * met, (moved, met)
    for group in (100_000, 5):
        monkeypatch.setattr(BW, "GROUP_QUERIES", group)
        assert rows(retrieval.hybrid_topk(spark, str(folder)), *columns) == hybrid


def test_units_are_searched_without_a_full_index(spark, monkeypatch):
    """BM25 needs no terms but those of the queries, nor norms and vectors."""
    made = []
    monkeypatch.setattr(ST, "_built", {})
    monkeypatch.setattr(ST, "build", lambda *a, **k: made.append(a))
    monkeypatch.setattr(ST, "open_index", lambda *a: pytest.fail("a full index was asked for"))
    assert units.unit_topk(spark, "/root/testdata/sf0.001").count() > 0 and not made


@pytest.mark.parametrize("even", [False, True])
def test_lists_look_up_few_postings(even):
    """The sums of all postings; units that have most terms are found from the rare ones, without the frequent terms' lists."""
    rng = np.random.default_rng(3)
    n, share = 3000, [0.9, 0.8, 0.7, 0.5, 0.3, 0.02, 0.01, 0.005, 0.002]
    has = [np.flatnonzero(rng.random(n) < p) for p in share]
    part = [np.ones(len(h)) if even else rng.random(len(h)) * (0.1 + np.log(1 / p)) + 1e-3 for h, p in zip(has, share, strict=True)]
    place = rng.permutation(n)
    lists = BW._Lists(np.concatenate(has), np.concatenate(part), np.cumsum([0, *map(len, has)]), place)
    looked = []
    at = lists._at
    lists._at = lambda t, u: looked.append(len(u)) or at(t, u)
    for terms in ([0, 1, 2, 3, 4, 5, 6, 7, 8], [0, 5, 8], [0], [8, 0, 1], [3, 4]):
        sums, cover = np.zeros(n), np.zeros(n)
        for t in terms:
            sums[has[t]] += part[t] * (t + 1)
            cover[has[t]] += 1
        for k in (1, 5, 50, 5000):
            best, own = lists.foremost(np.array(terms), np.array([t + 1.0 for t in terms]), 2.0, k)
            expected = BW.foremost(sums / 2, cover, place, k)
            assert np.allclose(own, sums[best] / 2) and best.tolist() == expected.tolist()
        for least in (-1, 0, 1, len(terms) - 2, len(terms), len(terms) + 1):
            best, own = lists.covering(np.array(terms), least)
            assert best.tolist() == np.flatnonzero((cover > 0) & (cover >= least)).tolist() and (own == cover[best]).all()
    looked.clear()
    lists.covering(np.arange(9), 8)
    assert looked and sum(looked) < sum(map(len, has)) / 5


def test_a_segment_is_made_in_one_pass(spark, folder, tmp_path):
    """Texts are dealt and counted where they lie; no posting is shuffled to be counted or to meet its vector."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {s.stageId() for s in stages(spark)}
    ST.write_segment(docs, "doc_id", str(tmp_path / "segment"))
    assert sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() not in before) <= 2 * docs.count()
