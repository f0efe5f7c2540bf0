"""Character grams as numbers against sets of strings."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import grams as G


def strings(text):
    t = " " + re.sub(r"\s+", " ", (text or "").lower()).strip(" ") + " "
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


TEXTS = ["", None, "a", "ab", "Abc abc", "ABC  abc\n", "éàü ß", "aaaaaaaa", "\U0001f600 smile \U0001f600", "x y z " * 50, "\u0000\u0001\u0002"]


def test_numbers_are_as_distinct_as_strings():
    rng = random.Random(1)
    for t in [*TEXTS, "".join(rng.choice("ab é\U0001f600") for _ in range(3000))]:
        folded = " " + re.sub(r"\s+", " ", (t or "").lower()).strip(" ") + " "
        assert len(G.gram_numbers(folded)) == len(strings(t))


def test_pairs_equal_the_sets(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.round(G.pair_jaccard(F.col("a"), F.col("b")), 9).alias("j"), F.round(X.jaccard(X.char_ngrams(F.coalesce("a", F.lit(""))), X.char_ngrams(F.coalesce("b", F.lit("")))), 9).alias("k")).collect()
    assert len(rows) == len(pairs) and all(r["j"] == r["k"] == round(jaccard(strings(r["a"]), strings(r["b"])), 9) for r in rows)


def test_most_similar_of_the_whole_table(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(30)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, make(rng.randint(1, 30))) for i in range(80)] + [(90, None), (91, ""), (None, make(5))]
    docs += [(95, docs[3][1]), (96, docs[3][1])]  # ties
    queries = [(i, make(8)) for i in range(9)] + [(20, docs[3][1]), (21, None), (None, "x")]
    expected = []
    for q, t in queries:
        own = [(-round(jaccard(strings(t), strings(x)), 6), d) for d, x in docs if q is not None and d is not None and strings(t) & strings(x)]
        expected += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(own)[:4])]
    units = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(queries, "item_id int, text string")
    for block in (G.BLOCK_GRAMS, 60):  # one block, and many
        out = G.most_similar(units, "doc_id", "text", asked, "item_id", "text", 4, block)
        assert sorted(tuple(r) for r in out.collect()) == sorted(expected)
    assert G.most_similar(units.limit(0), "doc_id", "text", asked, "item_id", "text", 4).collect() == []
    assert G.most_similar(units, "doc_id", "text", asked.limit(0), "item_id", "text", 4).collect() == []
