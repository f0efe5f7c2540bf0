"""The extraction stage's accounting, and the partitioned index against exact neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textmill.operators import corpus as C
from textmill.operators import extraction as X
from textmill.operators import partitioned as PT
from textmill.operators.neighbours import nearest
from textmill.sources import io


def test_extraction_counts_what_it_writes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "New York city, new york"), (2, "york"), (3, None), (4, "nothing")], "doc_id long, text string")
    vocabulary = spark.createDataFrame([("new york", 5), ("York", 1), ("york", 3), ("city", 1), ("", 9)], "phrase string, priority int")
    out = X.extract(docs, "doc_id", "text", vocabulary, "run", str(tmp_path / "s"))
    assert {r["metric"]: (r["expected"], r["actual"], r["status"]) for r in out.collect()} == {"candidates": (6, 6, "passed"), "written": (4, 4, "passed"), "spans_in_order": (0, 0, "passed"), "read_back": (0, 0, "passed")}
    rows = io.read_dataset(spark, str(tmp_path / "s"), "predictions")
    assert sorted((r["doc_id"], r["label"], r["start"]) for r in rows.collect()) == [(1, "city", 9), (1, "new york", 0), (1, "new york", 15), (2, "york", 0)]
    assert rows.select("prediction_id").distinct().count() == 4
    none = X.extract(docs.limit(0), "doc_id", "text", vocabulary, "run", str(tmp_path / "s"))
    assert none.where("status <> 'passed'").isEmpty() and io.read_dataset(spark, str(tmp_path / "s"), "predictions").count() == 0


def vectors_of(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(4)


def test_partitioned_index(spark, monkeypatch):
    rng = np.random.default_rng(6)
    clustered = rng.normal(size=(20, 16))[rng.integers(0, 20, 900)] + 0.2 * rng.normal(size=(900, 16))
    for x, probes in ((clustered, 4), (rng.normal(size=(900, 16)), None)):
        vectors = vectors_of(spark, x)
        asked = vectors.where("vec_id % 20 = 0")
        exact = nearest(asked, vectors, 5)
        found = PT.neighbours(asked, vectors, 5, probes=probes)
        assert PT.recall(found, exact).first()["recall"] >= 0.9
        both = found.join(exact.withColumnRenamed("score", "s"), ["query_id", "neighbour"])
        assert both.where("score <> s").isEmpty()  # scores are exact
    every = PT.neighbours(asked, vectors, 5, probes=10**6)
    assert PT.recall(every, exact).first()["recall"] == 1.0
    monkeypatch.setattr(PT, "PART", 7)  # cells cut into parts
    assert sorted(map(repr, PT.neighbours(asked, vectors, 5, probes=10**6).collect())) == sorted(map(repr, every.collect()))
    assert PT.in_cells(vectors, PT.fit_centroids(vectors, 30)).count() == 900  # every row has a cell
    assert PT.neighbours(asked.limit(0), vectors.limit(0), 5).collect() == []


def test_encoders_are_checked(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = C.encoded(texts, "doc_id", "text", lambda: lambda ts: [[len(t), 1.0] for t in ts], 2).collect()
    assert {r["doc_id"]: r["vector"] for r in rows} == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    for bad in ([[1.0]] * 2, [[float("nan"), 1.0]] * 2):
        try:
            C.encoded(texts, "doc_id", "text", lambda b=bad: lambda ts: b[: len(ts)], 2).agg(F.count("*")).collect()
        except Exception as e:
            assert "another dimension" in str(e)
        else:
            raise AssertionError("a bad vector went through")
