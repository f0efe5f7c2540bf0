from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import bytesops as B
from textmill.llm import classifier as C
from textmill.llm import hashed

SCHEMA = "doc_id long, text string"


def invented(rng, n):
    return [("".join(rng.choice("aeionrst") for _ in range(rng.randint(3, 9)))) for _ in range(n)]


def junk(rng, words):
    return rng.choice([" ".join(w + "%%%" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * len(words)), " | ".join(words)])


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(700):
        words, good = invented(rng, rng.randint(30, 150)), rng.random() < 0.75
        docs.append((i, " ".join(words) if good else junk(rng, words)))
        labels.append((i, int(good), 0))
    docs += [(1000, None), (1001, ""), (1002, " ".join(invented(rng, 30_000))), (1003, docs[3][1]), (None, docs[3][1]), (1004, " \n\t"), (1005, "é€ ¶¶")]
    labels += [(None, 0, 0), (5, None, 0), labels[4], (9999, 1, 0)]
    return docs, labels


def frames(spark, labelled):
    return spark.createDataFrame(labelled[0], SCHEMA).withColumn("Score", F.lit("old")).repartition(3), spark.createDataFrame(labelled[1], "doc_id long, quality int, toxic int")


def test_held_out_rows_nulls_and_repeats(spark, labelled):
    docs, labels = frames(spark, labelled)
    out = C.classify(docs, C.fit_classifier(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(labelled[0]) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    at = {r["doc_id"]: r for r in rows}
    held = [(at[i]["predicted"], q) for i, q, _ in labelled[1][:700] if hashed.held_out(i)]
    assert len(held) > 100 and np.mean([p == q for p, q in held]) > 0.98
    assert at[1000]["score"] == at[1001]["score"] == at[1004]["score"]
    assert at[3]["score"] == at[1003]["score"] == at[None]["score"]
    assert at[1002]["predicted"] == 1


def test_training_never_reads_held_out_labels(spark, labelled):
    docs, labels = frames(spark, labelled)
    flipped = labels.withColumn("quality", F.when(hashed.held_out_column(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = C.fit_classifier(docs, labels), C.fit_classifier(docs, flipped)
    assert a.bias == b.bias and (a.w == b.w).all() and 0 < (a.w != 0).sum() < 1 << 19


def test_terms_against_python():
    """Counts of token and pair hashes, in chunks or alone; no term reaches over the edge of a text."""
    texts = ["One two, two two!! x9 É", "", "a", "!?", "one  two", "two"]
    data, offsets = B.binary(pa.array(texts))
    doc, bucket, value = C.ngram_terms(data, offsets)
    whole = {i: list(zip(bucket[doc == i].tolist(), value[doc == i].tolist(), strict=True)) for i in range(len(texts))}
    for i, t in enumerate(texts):
        d, o = B.binary(pa.array([t]))
        of, k, v = C.ngram_terms(d, o)
        assert list(zip(k.tolist(), v.tolist(), strict=True)) == whole[i] and not of.any()
        assert not t or math.isclose(sum(x * x for x in v), 1)
    s, e, _ = C.tokens(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(s, e, strict=True)] == ["One", "two", ",", "two", "two", "!!", "x9", "É", "a", "!?", "one", "two", "two"]
    # words: 8 tokens, 6 kinds of them; pairs: 7, all different; kinds of tokens besides
    words = Counter(raw[a:b] for a, b in zip(s[:8], e[:8], strict=True))
    smallest = min(v for _, v in whole[0])
    assert max(v for _, v in whole[0]) / smallest >= max(words.values()) - 1e-9


def dense_ftrl(x, y, order, prior, alpha, beta, l1, l2):
    """The textbook update over dense rows."""
    z, n, bz, bn = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    for i in order:
        w = np.array([0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2) for a, b in zip(z, n, strict=True)])
        b = -bz / ((beta + math.sqrt(bn)) / alpha)
        p = 1 / (1 + math.exp(-(prior + b + w @ x[i])))
        g = (p - y[i]) * x[i]
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
        n += g * g
        gb = p - y[i]
        bz += gb - (math.sqrt(bn + gb * gb) - math.sqrt(bn)) / alpha * b
        bn += gb * gb
    return np.array([0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(b)) / alpha + l2) for a, b in zip(z, n, strict=True)]), prior - bz / ((beta + math.sqrt(bn)) / alpha)


def test_updates_equal_the_dense_rule():
    rng = np.random.default_rng(4)
    x = (rng.random((60, 16)) < 0.3) * rng.random((60, 16)).astype(np.float32)
    y = (rng.random(60) < 0.5).astype(float)
    starts = np.concatenate(([0], np.cumsum((x > 0).sum(axis=1))))
    share = float(y.mean())  # class weights of 1
    model = C.train_ftrl(y, starts, np.nonzero(x)[1], x[x > 0], share, bits=4, epochs=2)
    again = np.random.default_rng(23)
    order = np.concatenate([again.permutation(60), again.permutation(60)])
    w, bias = dense_ftrl(x.astype(float), y, order, math.log(share / (1 - share)), C.ALPHA, C.BETA, C.L1, C.L2)
    assert np.allclose(model.w, w, atol=1e-6) and math.isclose(model.bias, bias, abs_tol=1e-9)


def test_one_class_none_and_empty(spark, labelled):
    docs, labels = frames(spark, labelled)
    only = C.classify(docs, C.fit_classifier(docs, labels.where("quality = 1"))).select("score").distinct().collect()
    assert len(only) == 1 and only[0]["score"] > 0.99
    assert C.classify(docs, C.fit_classifier(docs, labels.limit(0))).agg(F.max("score")).first()[0] < 1e-9
    assert C.classify(docs.limit(0), C.fit_classifier(docs.limit(0), labels)).collect() == []
