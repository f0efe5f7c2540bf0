from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import bytesops as B
from textmill.llm.components import components
from textmill.llm.line_chunks import line_dedup, units
from textmill.llm.near_dedup import dart_signatures, linked, near_duplicates
from textmill.llm import suffix_dedup as suffix
from textmill.llm.suffix_dedup import suffix_dedup


def brute_strings(rows, length):
    first, out = {}, {}
    for doc_id, text in sorted((r[0], r[1] or "") for r in rows):
        raw = text.encode()
        mask = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first.setdefault(raw[i : i + length], doc_id) < doc_id:
                mask[i : i + length] = b"\1" * length
        out[doc_id] = (bytes(c for c, m in zip(raw, mask, strict=True) if not m), sum(mask), len(re.findall(b"\1+", bytes(mask))))
    return out


@pytest.mark.parametrize(("length", "trigger", "hot_groups"), [(50, 16, 512), (50, 16, 1), (20, 20, 512), (12, 5, 2), (7, 3, 4)])
def test_repeated_strings_against_brute_force(docs, corpus, length, trigger, hot_groups):
    expected = brute_strings(corpus, length)
    rows = suffix_dedup(docs, length, trigger, hot_groups=hot_groups).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        kept, removed, spans = expected[r["doc_id"]]
        assert (bytes(r["kept"]), r["n_removed"], len(r["spans"])) == (kept, removed, spans)


def test_repeated_strings_edge_rows(spark, none):
    assert suffix_dedup(none).count() == 0
    text = "z" + "q" * 70
    rows = spark.createDataFrame([(1, text, "old"), (1, text, "old"), (2, text, None), (None, text, "n")], "doc_id long, text string, kept string")
    out = suffix_dedup(rows)
    assert out.columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "spans"]
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out.collect()) == [(0, 0), (1, 0), (1, 0), (2, 71)]
    shared = "w" * 30 + "v" * 40
    zero = spark.createDataFrame([(-1, shared), (0, "u" * 60 + shared), (None, "u" * 60 + shared), (None, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in suffix_dedup(zero).collect()) == [(False, 0), (False, 70), (True, 0), (True, 0)]
    cut = spark.createDataFrame([(1, "é" * 40), (2, "a" + "é" * 40 + "b")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in suffix_dedup(cut, as_text=True).collect()} == {1: "é" * 40, 2: "ab"}


def test_a_hot_trigger_is_split(spark, tmp_path):
    """One string of 16 bytes whose hash is small stands in every document, between other words; some also share more."""
    rng = random.Random(31)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    candidates = np.frombuffer("".join(letters(16) for _ in range(20_000)).encode(), np.uint8)
    least = suffix.B.mix(suffix.B.span_hash(suffix.B.prefix_hash(candidates), np.arange(0, 320_000, 16), np.arange(16, 320_001, 16)))
    common = [candidates[i * 16 : i * 16 + 16].tobytes().decode() for i in np.argsort(least)[:40]]
    tails = [letters(40) for _ in range(5)]
    rows = []
    for i in range(1500):
        parts = [x for c in rng.sample(common, 6) for x in (letters(45), c)]
        rows.append((i, "".join(parts) + (rng.choice(tails) if i % 4 == 0 else letters(40))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.repartition(3).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    data, offsets = suffix.B.binary(pa.array([t for _, t in rows]))
    _, _, _, t, x = suffix.phrases(data, offsets, 50, 16)
    order = np.argsort(t)
    assert len(suffix._with_many(t[order], x[order]))
    expected = brute_strings(rows, 50)
    for hot_groups in (512, 3):
        found = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], len(r["spans"])) for r in suffix_dedup(stored, hot_groups=hot_groups).collect()}
        assert found == expected
    assert sum(n for _, n, _ in expected.values()) > 10_000


def test_suffix_order_of_strings():
    rng = random.Random(3)
    for length in (3, 8, 9, 20, 50, 64):
        raw = bytes(rng.choice(b"ab\xff") for _ in range(600)) + b"ab" * 100
        places = np.arange(len(raw) - length + 1)
        order, new = suffix.suffix_order(np.frombuffer(raw, np.uint8), places, length)
        cut = [raw[i : i + length] for i in order]
        assert cut == sorted(cut) and sorted(order.tolist()) == places.tolist()
        assert new.tolist() == [True, *[a != b for a, b in itertools.pairwise(cut)]]


def brute_classes(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[doc_id] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else text or ""
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            same = x == y if isinstance(x, str) or isinstance(y, str) else len(x & y) >= 0.8 * len(x | y)
            if same:
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize(("block", "leaders"), [(1000, 64), (3, 1), (2, 0)])
def test_near_duplicates_against_brute_force(docs, corpus, block, leaders):
    rows = near_duplicates(docs, block=block, leaders=leaders).collect()
    assert len(rows) == len(corpus)
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute_classes(corpus)


def test_near_duplicates_edge_rows(spark, none):
    assert near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None), (5, "")], "doc_id long, text string")
    out = near_duplicates(rows.withColumn("class_id", F.lit("x"))).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in out) == [(0, 0), (1, 1), (1, 1), (3, 1), (4, 4), (5, 4)]


def test_signatures_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    keys = B.mix(np.arange(500, dtype=np.uint64), 5)
    a, b = rng.uniform(0.1, 4, 500), rng.uniform(0.1, 4, 500)
    b[::2] = a[::2]
    a[400:], b[:50] = 0, 0
    doc = np.concatenate((np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)))
    sig = dart_signatures(doc, np.concatenate((keys[a > 0], keys[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2, 4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_links_against_all_pairs():
    rng = random.Random(9)
    for _ in range(30):
        base = [rng.sample(range(60), 30) for _ in range(4)]
        sets = [np.unique(np.array([x if rng.random() > 0.08 else rng.randrange(1000) for x in rng.choice(base)], np.uint64)) for _ in range(40)]
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if len(x & y) >= 0.8 * len(x | y) and label[i] != label[j]:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if v == old else v for v in label]
        assert linked(sets, 0.8).tolist() == label


def test_large_component_in_blocks(spark):
    """Near copies around the threshold, so that classes chain through documents of different blocks."""
    rng = random.Random(12)
    base = ["".join(rng.choice("aeionrst") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            words[rng.randrange(60)] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_classes(rows)
    assert 1 < len(set(expected.values())) < 120
    for block, leaders in ((25, 4), (10, 0)):
        assert {r["doc_id"]: r["class_id"] for r in near_duplicates(frame, block=block, leaders=leaders).collect()} == expected
    often = frame.unionByName(frame).unionByName(frame.where("doc_id = 3")).collect()
    again = near_duplicates(spark.createDataFrame(often, frame.schema), block=25, leaders=4).collect()
    assert len(again) == 241 and {r["doc_id"]: r["class_id"] for r in again} == expected


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_rounds_of_components_stay_small(spark):
    """A round's tasks follow the labels' size, not the number of shuffle partitions times the joins: the driver keeps each task."""
    sc = spark.sparkContext
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("components", "")
    try:
        found = components(links)
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["label"] for r in found.collect()} == {1}
    assert tasks < 31 * 20, tasks


def brute_lines(rows):
    """A line goes if two neighbouring lines with a word that cover it stand, with what is between them, earlier."""
    seen, out = set(), {}
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0]):
        if text is None:
            out[doc_id] = None
            continue
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for a, b in zip(at, at[1:], strict=False):
            pair = tuple(lines[a : b + 1])
            if pair in seen:
                gone.update(range(a, b + 1))
            seen.add(pair)
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_lines_against_brute_force(docs, corpus):
    rows = line_dedup(docs).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == brute_lines(corpus)
    assert sum(r["n_removed_lines"] for r in rows) > 20


def test_lines_edge_rows(spark, none):
    assert line_dedup(none).count() == 0
    text = "\n".join(f"line {i}" for i in range(30))
    rows = spark.createDataFrame([(1, text, 7), (1, text, 7), (2, text, 8), (None, "a\nb", 9)], "doc_id long, text string, N_LINES int")
    out = line_dedup(rows)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed_lines", "n_removed_runs"]
    found = {(r["doc_id"], r["text"] == text) for r in out.collect()}
    assert (1, True) in found and (2, False) in found and len(out.collect()) == 4


def test_short_passages_and_blank_lines(spark):
    """Runs of two and three lines between other neighbours go whole; one shared line, or blank ones, stay."""
    rng = random.Random(21)
    line = lambda: " ".join("".join(rng.choice("aeionrst") for _ in range(6)) for _ in range(9))
    rows, expected = [], {}
    for i in range(0, 120, 2):
        run = [line() for _ in range(2 + i % 6 // 2)]
        single = line()
        rows.append((i, "\n".join([line(), *run, "", line(), single, "", ""])))
        before, after = [line(), line()], [line(), "", line(), single, " ", ""]
        rows.append((i + 1, "\n".join([*before, *run, *after])))
        expected[i + 1] = "\n".join([*before, *after])
    rows += [(500, "\n\n\n"), (501, "\n\n\n"), (502, "same\n" * 6), (503, "a\n\nb"), (504, "a\n\nb"), (505, "a\nb")]
    expected |= {500: "\n\n\n", 501: "\n\n\n", 502: "same\n", 503: "a\n\nb", 504: "", 505: "a\nb"}
    out = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: out[i]["text"] for i in expected} == expected
    assert {r[0]: out[r[0]]["text"] for r in rows} == brute_lines(rows)
    assert all(out[i]["text"] == t for i, t in rows if i not in expected) and out[1]["n_removed_runs"] == 1


def test_chunks_have_two_lines_and_come_back_shifted(spark):
    rng = random.Random(22)
    lines = ["".join(rng.choice("aeionrst") for _ in range(20)) for _ in range(400)]
    texts = ["\n".join(lines), "\n".join(["new", "start", *lines[3:]])]
    cut = [[u for u in r["u"] if u["whole"]] for r in spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").orderBy("doc_id").select(units(F.col("text")).alias("u")).collect()]
    for chunks, n in zip(cut, (400, 399), strict=True):
        assert min(u["b"] - u["a"] + 1 for u in chunks) >= 2 and [u["a"] for u in chunks] == [0, *[u["b"] + 1 for u in chunks[:-1]]] and chunks[-1]["b"] == n - 1
    assert len({u["h"] for u in cut[0]} & {u["h"] for u in cut[1]}) >= len(cut[0]) - 3


def test_one_very_long_text(spark):
    text = "\n".join(f"line {i % 30_000}" for i in range(60_000))
    out = line_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed_lines"], r["n_removed_runs"]) for r in out} == {1: ("\n".join(f"line {i}" for i in range(30_000)), 30_000, 1), 2: ("", 60_000, 1)}
