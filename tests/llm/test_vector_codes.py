from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from textmill.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Python integers throughout; rows of one length that ``parts`` divides."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    cut = [[[math.floor(1024 * float(x)) for x in r[1][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts]] for p in range(parts)] for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for x in cut:
                of[near(x[p], books[p])[1]].append(x[p])
            for e, xs in of.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, labels = [], defaultdict(int)
    for r, x in zip(kept, cut, strict=True):
        found = [near(x[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), r[2]))
        labels[r[2]] += out[-1][2]
    return sorted(((i, c, e, labels[lab], digest) for i, c, e, lab in out), key=repr)


def result(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = V.vector_codes(frame, **more)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect()), key=repr)


def test_equals_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    coarse = lambda: [rng.choice([-0.5, -0.25, 0.0, 0.25, 1 / 3]) for _ in range(8)]  # noqa: E731  few values: many equal distances
    rows = [(i, coarse(), rng.choice([0, 0, 0, 1, None])) for i in range(80)]
    rows += [rows[5], rows[5], (7, coarse(), 1), (None, coarse(), 2), (None, coarse(), None)]
    rows += [(200, None, 1), (201, [math.nan] * 8, 1), (202, [math.inf] + [0.0] * 7, 0), (203, [None] + [0.0] * 7, 0)]
    assert result(spark, rows, entries=20) == brute(rows, entries=20)
    assert result(spark, rows) == brute(rows)


def test_screen_never_decides_what_rounding_could_change():
    """Components far beyond 24 bits, with distances that differ by one or not at all."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 30), 1 << 30, 16)
    book = np.stack([base + rng.integers(-2, 3, 16) for _ in range(64)])
    x = base + rng.integers(-3, 4, (500, 16))
    index, distance = V.nearest(x, book)
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    far = np.array([[1 << 61, -(1 << 61)], [0, 3]])
    index, distance = V.nearest(far, np.array([[-(1 << 61), 1 << 61], [1 << 60, 0], [0, 2], [0, 4]]))
    assert index.tolist() == [1, 2] and distance.tolist() == [(1 << 120) + (1 << 122), 1]


def test_large_components_and_sums_beyond_64_bits(spark):
    rows = [(i, [float(v)] * 4, 0) for i, v in enumerate((0, 1, 2.0**40, -(2.0**40)))] + [(9, [2.0**60] * 4, 0), (10, [2.0**51] * 4, 1), (11, [-(2.0**51)] * 4, 1)]
    out = {r[0]: r for r in result(spark, rows, entries=2, rounds=1)}
    assert set(out) == {0, 1, 2, 3, 10, 11}  # 2^60 has no 64-bit integer
    assert out[10][2] is None and out[10][3] is None
    books = V.fit_codebooks(spark.createDataFrame([(i, [2.0**51] * 4) for i in range(64)], "vec_id long, embedding array<double>"), "embedding", "vec_id", 4, rounds=1)
    assert (books == 1 << 61).all()  # 64 x 2^61 passes 64 bits, the mean does not


def test_other_lengths_and_clashing_columns(spark):
    rows = [(1, [0.5, 0.5, 0.25], "a"), (2, [0.5, 0.5, 0.5], "b"), (3, [1.0], "a"), (4, [], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Code string")
    out = V.vector_codes(frame, label="none")
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert [tuple(r)[:4] for r in out.orderBy("vec_id").collect()] == [(1, "00000000", 0, 0), (2, "00000100", 0, 0)]
    keyed = frame.withColumnRenamed("Code", "_key").withColumn("_null", frame.vec_id).withColumn("label", frame.vec_id)
    assert V.vector_codes(keyed).select("_key", "_null").orderBy("_null").collect()[0] == ("a", 1)


def test_empty_and_useless_tables(spark):
    for rows in ([], [(1, None, 0), (2, [math.nan], 1)]):
        assert result(spark, rows) == []
    assert result(spark, [(1, [], 0)]) == [(1, "00000000", 0, 0, hashlib.sha256(b"").hexdigest())]


def test_refuses_codes_of_more_than_two_digits(spark):
    with pytest.raises(ValueError, match="256"):
        V.vector_codes(spark.createDataFrame([], SCHEMA), entries=300)
