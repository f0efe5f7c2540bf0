"""Phrases by automaton and interval joins in bins, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.operators import intervals as IV
from textmill.operators import phrases as PH
from textmill.operators import spans as S


def test_phrases_equal_one_pattern_each(spark):
    rng = random.Random(2)
    words = ["a", "b", "ab", "Ba", "é", "x_1", "no", "not", "İ", "a-b", "c++"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", ".", "", "\n"]) for _ in range(40)) for _ in range(60)] + [None, "", "a a a a"]
    phrases = ["a", "AB", "a a", "a b", "not", "é", "x_1", "c++", "a-b", "b a", "", "no not", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vocabulary = spark.createDataFrame([(p,) for p in [*phrases, None]], "phrase string")
    expected = Counter()
    for i, t in enumerate(texts):
        for p in {p.lower() for p in phrases if p}:
            for m in re.finditer(rf"(?i)(?<!\w){re.escape(p)}(?!\w)", t or ""):
                expected[i, p, m.start(), m.end()] += 1
    for part_chars in (PH.PART_CHARS, 5):  # in one part, and in several
        assert Counter(tuple(r) for r in PH.phrase_spans(docs, "doc_id", "text", vocabulary, part_chars=part_chars).collect()) == expected
    assert PH.phrase_spans(docs, "doc_id", "text", vocabulary.limit(0)).collect() == []
    assert PH.phrase_spans(docs.limit(0), "doc_id", "text", vocabulary).collect() == []


def test_one_pass_whatever_the_size_of_the_vocabulary(spark):
    """Fifty thousand phrases, one automaton: the states visited do not depend on their number."""
    text = " ".join(f"w{i % 977}" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    vocabulary = spark.range(50_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" w"), (F.col("id") + 1).cast("string")).alias("phrase"))
    rows = PH.phrase_spans(docs, "doc_id", "text", vocabulary).collect()
    assert len(rows) == 3000 - 1 - 3000 // 977 and all(text[r["start"] : r["end"]] == r["label"] for r in rows)


def brute_containing(spans, intervals):
    out = []
    for k, a, b in set(spans):
        own = [x for x in intervals if x[0] == k]
        held = [i for _, i, s, e in own if a is not None and s <= a and b <= e]
        out.append((k, a, b, min(held, default=min((i for _, i, _, _ in own), default=None)), bool(held)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [1, 7, 64])
def test_containing_equals_brute_force(spark, width):
    rng = random.Random(width)
    intervals = [(k, i, a, a + rng.choice([0, 1, 5, 40, 3000])) for k in range(4) for i, a in enumerate(rng.sample(range(500), 30))]
    spans = [(k, a, a + rng.choice([0, 1, 3, 60])) for k in range(5) for a in rng.sample(range(600), 40)] + [(0, None, None), (1, 5, 9), (1, 5, 9)]
    left, right = spark.createDataFrame(spans, "doc_id long, start long, end long"), spark.createDataFrame(intervals, "doc_id long, index long, start long, end long")
    out = IV.containing(left, right, "doc_id", width)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_containing(spans, intervals)
    assert {tuple(r)[3:] for r in IV.containing(left, right.limit(0), "doc_id").collect()} == {(None, False)}


def test_overlapping_pairs_come_once(spark):
    rng = random.Random(4)
    make = lambda n, sizes: sorted({(rng.randrange(3), a, a + rng.choice(sizes)) for a in rng.sample(range(400), n)})
    a, b = make(60, [1, 4, 90]), make(50, [1, 17, 300])
    schema = "doc_id long, start long, end long"
    pairs = IV.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["doc_id"], 8)
    expected = sorted((k, s, e, u, v) for k, s, e in a for j, u, v in b if j == k and s < v and u < e)
    assert sorted(tuple(r) for r in pairs.collect()) == expected and expected


def test_one_text_of_very_many_spans(spark):
    """10^5 spans and 10^4 intervals of one text: what is compared grows with the spans, not with their product."""
    spans = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end"))
    intervals = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("index"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 95).alias("end"))
    out = IV.containing(spans, intervals, "doc_id")
    one = out.agg(F.count("*").alias("n"), F.count_if("contained").alias("held"), F.count_if(F.col("interval_index") == F.floor(F.col("start") / 100)).alias("right")).first()
    assert one == (100_000, 100_000, 100_000)
    met = IV._asking(spans, "start", "start", IV.levels_of(intervals, "start", "end"), IV.WIDTH).join(IV._held(intervals.withColumnsRenamed({"start": "a", "end": "b"}), "a", "b", IV.WIDTH), ["doc_id", "_level", "_bin"]).count()
    assert met < 5 * 100_000


def test_relaxed_policy_meets_in_bins(spark):
    truth = [(1, "n", 0, 4, "a"), (1, "n", 10, 500, "b"), (1, "m", 0, 3, "c"), (2, "n", 5, 6, "d")]
    predicted = [(1, "n", 3, 5, "a"), (1, "n", 499, 600, "b"), (1, "n", 4, 10, "x"), (2, "n", 6, 7, "d"), (2, "n", 6, 7, "d")]
    schema = "doc_id long, label string, start long, end long, value string"
    rows = S.span_scores(spark.createDataFrame(truth, schema), spark.createDataFrame(predicted, schema), "doc_id", "relaxed").collect()
    assert {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in rows} == {"n": (2, 2, 1), "m": (0, 0, 1)}
