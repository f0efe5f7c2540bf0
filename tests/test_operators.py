"""Small literal cases of the engine's operators."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textmill.functions import ids
from textmill.functions import text as X
from textmill.operators import answers as A
from textmill.operators import evaluate as E
from textmill.operators import events as O
from textmill.operators import features as Q
from textmill.operators import index as I
from textmill.operators import rank as R
from textmill.operators import rules
from textmill.operators import spans as S
from textmill.operators import store as ST
from textmill.sources import io


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double"}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("x")).first()["x"]


def test_tokens_keep_negation_numbers_and_identifiers(spark):
    assert one(spark, X.tokens(F.col("t")), t="No oxygen 98 percent SYN-DOC-123456.") == ["no", "oxygen", "98", "percent", "syn-doc-123456"]
    assert one(spark, X.tokens(F.col("t")), t="") == []


def test_ngrams(spark):
    items = F.split("t", " ")
    assert one(spark, F.concat(items, X.ngrams(items, 2)), t="no oxygen") == ["no", "oxygen", "no oxygen"]
    assert one(spark, X.ngrams(items, 3), t="no oxygen") == []


def test_hash_vectors_are_deterministic_units(spark):
    rows = spark.createDataFrame([(1, "same text here"), (2, "same text here"), (3, "other text here"), (4, "..."), (5, None)], "id long, text string")
    v = {r["id"]: r["vector"] for r in ST.hashed_vectors(I.tokenised(rows, "id"), "id").collect()}
    assert v[1] == v[2] != v[3] and len(v[1]) == 32 and set(v) == {1, 2, 3}
    assert sum(x * x for x in v[1]) == pytest.approx(1)


def test_character_jaccard(spark):
    value = X.jaccard(X.char_ngrams(F.col("a")), X.char_ngrams(F.col("b")))
    assert one(spark, value, a="computed tomography", b="CT computed tomography scan") > 0.45
    assert one(spark, value, a="", b="") == 0.0


def test_normalisation(spark):
    text = "No  value:\t36.8 \r\nSYN-DOC-000001  end  "
    assert one(spark, X.normalise(F.col("t")), t=text) == "No value:    36.8\nSYN-DOC-000001 end".replace("    36.8", " 36.8")


def test_stable_ids(spark):
    a = one(spark, ids.stable_id("U", F.col("a"), F.col("b")), a="x", b="yz")
    assert a == one(spark, ids.stable_id("U", F.col("a"), F.col("b")), a="x", b="yz")
    assert a != one(spark, ids.stable_id("U", F.col("a"), F.col("b")), a="xy", b="z")
    assert one(spark, ids.numbered_id("SYN-DOC", F.sha2("a", 256)), a="x").startswith("SYN-DOC-")


@pytest.mark.parametrize(
    ("check", "text"),
    [("nhs_number_like", "number 943 476 5919"), ("email", "write to a.b@example.org"), ("uk_phone", "call 07123 456 789"), ("postcode", "at SW1A 1AA"), ("url", "see https://x"), ("ipv4", "from 10.0.0.1")],
)
def test_privacy_patterns(spark, check, text):
    frame = spark.createDataFrame([(1, text)], "id long, text string")
    failed = {r["check_name"] for r in rules.long_checks(frame, "id", rules.pattern_checks(F.col("text"), rules.PRIVACY)).where("status = 'failed'").collect()}
    assert check in failed


def test_query_classes_in_order(spark):
    classify = lambda t: one(spark, rules.query_class(F.col("t")), t=t)
    assert classify("Emergency dosage") == "unsupported_emergency_request"
    assert classify("a summary of it") == "synthetic_summary_request"
    assert classify("compare metadata") == "synthetic_metadata_query"
    assert one(spark, rules.query_class(F.col("t"), portfolio=False), t="anything") == "out_of_scope"


def test_expansion_negation_numbers(spark):
    expanded = {r["expanded"] for r in one(spark, Q.expansions(F.col("t")), t="CT kidney plan ms")}
    assert expanded == {"computed tomography", "renal", "administrative next step", "workflow note"}
    marked = {(r["term"], r["polarity"]) for r in one(spark, Q.negation(F.col("t")), t="no fever, negative for cough")}
    assert {("fever", "negated"), ("cough", "negated"), ("fever", "affirmed")} <= marked
    assert [(r["value"], r["unit"]) for r in one(spark, Q.numbers(F.col("t")), t="5 mg and 98% or 3.5")] == [(5.0, "mg"), (98.0, "percent"), (3.5, "number")]


def test_bm25_is_not_negative_and_ranks_are_contiguous(spark):
    docs = spark.createDataFrame([(i, f"synthetic word{i} text" + " synthetic" * i) for i in range(6)] + [(9, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "synthetic word3"), (2, "nothing")], "item_id long, text string")
    ranked = R.top_k(R.bm25(ST.unstored(I.tokenised(docs, "doc_id"), "doc_id"), I.tokenised(queries, "item_id"), "item_id"), "item_id", "doc_id", "score", 4).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4]
    assert ranked[0]["doc_id"] == 3 and all(r["score"] >= 0 for r in ranked)


def test_fusion_and_confidence(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q long, u long, rank long")
    b = spark.createDataFrame([(1, 11, 1)], "q long, u long, rank long")
    best = R.rrf([a, b], "q", "u").orderBy(F.desc("score")).first()
    assert best["u"] == 11 and best["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)
    assert one(spark, R.confidence(F.col("m"), F.col("g")), m=0.5, g=3.0) == 1.0


def test_query_metrics(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "q long, u long, rank long")
    judged = spark.createDataFrame([(1, 6, 1), (1, 7, 1)], "q long, u long, grade int")
    queries = spark.createDataFrame([(1,), (2,)], "q long")
    rows = {r["q"]: r for r in E.query_metrics(ranked, judged, queries, "q", "u", 5).collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[1]["reciprocal_rank"], rows[1]["average_precision"]) == (0.2, 0.5, 0.5, 0.25)
    assert rows[2]["hit"] == 0 and rows[2]["ndcg"] == 0


def test_set_metrics_and_confusion(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "a")], "d long, label string")
    found = spark.createDataFrame([(1, "a"), (3, "a"), (1, "a")], "d long, label string")
    r = E.set_metrics(truth, found, ["d", "label"], "label").first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 1, 1, 0.5)
    rows = spark.createDataFrame([("x", "x"), ("x", None), ("y", "x")], "t string, p string")
    scores = {r["label"]: r for r in E.one_vs_rest(E.confusion(rows, "t", "p")).collect()}
    assert (scores["x"]["tp"], scores["x"]["fp"], scores["x"]["fn"]) == (1, 1, 1) and "missing" in scores


def test_sections_and_sentences(spark):
    frame = spark.createDataFrame([(1, "lost\nFindings: none seen. Size 3.5 mm\nPlan: go"), (2, "no heading"), (3, None)], "id long, text string")
    found = {(r["id"], r["label"]): r["section_text"] for r in S.sections(frame, "id").collect()}
    assert found[1, "findings"] == "none seen. Size 3.5 mm\n" and found[1, "plan"] == "go" and found[2, "unknown"] == "no heading"
    rows = S.sentences(frame, "id").where("id = 1").orderBy("sentence_index").collect()
    assert [r["sentence"] for r in rows][:4] == ["lost", "Findings: none seen.", "Size 3.", "5 mm"]
    assert rows[1]["negated"] and rows[3]["numeric"]


def test_overlaps(spark):
    spans = spark.createDataFrame([(1, 0, 5, "a", 1), (1, 0, 5, "a", 1), (1, 3, 9, "b", 2), (1, 9, 12, "c", 1)], "id long, start long, end long, label string, priority int")
    rows = S.resolve_overlaps(spans, "id").collect()
    assert {r["label"] for r in rows if r["accepted"]} == {"b", "c"} and sum(r["duplicate"] for r in rows) == 1


def test_projection(spark):
    value = S.projected(F.col("a"), F.col("b"), F.col("s"), F.col("v"))
    assert one(spark, value, a="x foo", b="x foo", s=2, v="foo").asDict() == {"status": "unchanged", "start": 2}
    assert one(spark, value, a="x foo", b="foo x", s=2, v="foo").asDict() == {"status": "projected", "start": 0}
    assert one(spark, value, a="x foo", b="foofoo", s=2, v="foo")["status"] == "unresolved"
    assert one(spark, value, a="aaa b", b="aaaa", s=0, v="aa")["status"] == "unresolved"


def test_support(spark):
    assert one(spark, A.support(F.col("a"), F.col("b")), a="renal scan", b="a renal scan was done") == 1.0
    assert one(spark, A.support(F.col("a"), F.col("b")), a="", b="") <= 1.0


def test_rate_limit_ignores_rejected_events(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=s), s) for s in (0, 1, 2, 59, 60, 61)] + [("b", start, 0)]
    out = O.admitted(spark.createDataFrame(rows, "k string, ts timestamp_ntz, n int"), "k", "ts", 2, 60).collect()
    assert {r["n"]: r["admitted"] for r in out if r["k"] == "a"} == {0: True, 1: True, 2: False, 59: False, 60: True, 61: True}


def test_nearest_rank_without_gathering(spark):
    frame = spark.createDataFrame([(v,) for v in (5.0, 1.0, 3.0, 3.0, 9.0)], "v double").withColumn("g", F.lit(1))
    assert O.exact_rank(frame, "v", 0.5, "g").first()["p"] == 3.0
    assert O.exact_rank(frame, "v", 0.95, "g").first()["p"] == 9.0


def test_table_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, v string")
    assert {(r["k"], r["change"]) for r in O.table_diff(old, new, ["k"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}


def test_sinks_and_manifests(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "k long, v string")
    for kind in ("parquet", "json", "orc"):
        io.write(frame, f"{tmp_path}/{kind}", kind)
        back = io.read(spark, f"{tmp_path}/{kind}", frame.schema, kind)
        assert io.manifest(back, "t").collect() == io.manifest(frame, "t").collect()
    with pytest.raises(Exception, match="exist"):
        io.write(frame, f"{tmp_path}/json", "json")
    (tmp_path / "lines.jsonl").write_text('{"k": 1, "v": "x"}\nnot json\n\n')
    good, bad = io.read_lenient(spark, f"{tmp_path}/lines.jsonl", frame.schema)
    assert good.count() == 1 and [r["value"] for r in bad.collect()] == ["not json"]
    assert io.folder_checksum(spark, f"{tmp_path}/parquet").first()["files"] > 0


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "textmill"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "textmill.llm" not in path.read_text(), path
