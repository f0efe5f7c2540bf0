"""Requests against ready answers, runs read back after writing, review sheets and guards."""

from __future__ import annotations

import glob
import json
import os
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from textmill.operators import readback as B
from textmill.operators import requests as S
from textmill.operators import review as V
from textmill.operators import synthesis as Y
from textmill.sources import guards as G
from textmill.sources import io

REQUEST = "request_id string, asked long, text string, filters int, demo boolean"


@pytest.fixture
def ready(spark):
    known = spark.createDataFrame([(1, "Which note?"), (2, "which  NOTE?"), (3, "Other"), (4, None)], "q long, question string")
    answers = spark.createDataFrame(
        [(1, "grounded_answer", "one", "retrieval_accepted", 0.9), (3, "retrieval_abstention", "none", "retrieval_abstained", 0.2), (5, "unanswerable_query", "five", "retrieval_accepted", 0.1), (6, "unanswerable_query", "six", "retrieval_accepted", 0.1)],
        "q long, status string, answer string, retrieval_status string, confidence double",
    )
    return known, answers


def test_requests_are_limited_refused_matched_or_fall_back(spark, ready):
    rows = [
        ("long", None, "x" * 501, 0, True),
        ("edge", None, "x" * 500, 8, True),
        ("filters", None, "which note?", 9, True),
        ("closed", None, "which note?", 0, None),
        ("unsafe", 1, "which Dosage", 0, True),
        ("match", None, " WHICH\tnote? ", None, True),
        ("named", 3, "which note?", 0, True),
        ("unknown id", 77, "which note?", 0, True),
        ("empty", None, None, 0, True),
        ("match", None, "which note?", 0, True),
    ]
    served = S.served(spark.createDataFrame(rows, REQUEST), *ready, "q", "unanswerable_query")
    got = {}
    for r in served.collect():
        got.setdefault(r["request_id"], []).append((r["error"], r["refused"], r["asked"], r["answered_by"], r["answer"]))
    assert got == {
        "long": [("query_too_large", False, None, None, None)],
        "edge": [(None, False, None, 5, "five")],
        "filters": [("too_many_metadata_filters", False, None, None, None)],
        "closed": [("portfolio_demo_mode_required", False, None, None, None)],
        "unsafe": [(None, True, 1, None, None)],
        "match": [(None, False, 1, 1, "one")] * 2,
        "named": [(None, False, 3, 3, "none")],
        "unknown id": [(None, False, 77, 5, "five")],
        "empty": [(None, False, None, 5, "five")],
    }
    left = {}
    for r in S.events(served.dropDuplicates(["request_id"])).orderBy("request_id", "place").collect():
        left.setdefault(r["request_id"], []).append(r["event_type"])
        assert "x" * 9 not in str(r) and (len(r["query_checksum"]) == 64) == (r["request_id"] != "empty")
    assert left == {
        "long": ["application_error"],
        "unsafe": ["query_refused_before_retrieval"],
        "named": ["query_accepted", "retrieval_abstained"],
        **{k: ["query_accepted", "answer_generated"] for k in ("edge", "match", "unknown id", "empty")},
    }


def test_the_fallback_ends_with_the_first_answer_of_all(spark, ready):
    known, answers = ready
    one = spark.createDataFrame([("r", None, "nothing like it", 0, True)], REQUEST)
    by = lambda a, wanted: S.served(one, known, a, "q", wanted).first()["answered_by"]
    assert by(answers, "retrieval_abstention") == 3
    assert by(answers.withColumn("status", F.when(F.col("q") == 6, "late_refusal").otherwise("other")), "absent") == 6
    assert by(answers.withColumn("status", F.lit("other")), "absent") == 1
    assert by(answers.limit(0), "absent") is None
    assert S.served(one.limit(0), known, answers, "q", "absent").count() == 0


@pytest.fixture
def sides(spark):
    truth = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "y"), (3, "b", None)], "d long, label string, value string")
    found = spark.createDataFrame([(1, "a", "x"), (2, "b", "z")], truth.schema)
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "value string")
    classes = spark.createDataFrame([("en", "en"), ("en", None), ("de", "en"), ("de", "de")], "actual string, predicted string")
    return truth, found, ["d", "label", "value"], {"label": "label"}, labels, classes


def test_an_evaluation_is_read_back(spark, sides, tmp_path):
    path = str(tmp_path / "evaluation")
    checks = {r["subject"]: (r["expected"], r["observed"], r["status"]) for r in B.write_evaluation(*sides, path).collect()}
    assert {s for _, _, s in checks.values()} == {"passed"}
    assert checks["errors"][:2] == ("3", "3") and checks["error_rows"][:2] == ("3", "3")
    assert checks["confusion_total"][:2] == ("4", "4") and checks["micro_f1"][1] == "0.400000"  # tp 1, fp 1, fn 2
    assert checks["reconciliation_status"][1] == "passed" and checks["confusion"][0] == "4"


def test_what_was_changed_after_writing_fails(spark, sides, tmp_path):
    path = str(tmp_path / "evaluation")
    B.write_evaluation(*sides, path)
    run = f"{path}/run"
    names = ("metrics", "errors", "confusion", "reconciliation", "run")
    version = io.dataset_manifest(spark, run)["version"]
    B.require_passed(B.checked(spark, run, names, B.EVALUATION))
    other = io.read_dataset(spark, run, "errors").where("error_type = 'false_positive'")
    io.write(other.coalesce(1), f"{tmp_path}/other")
    io.write(io.read(spark, f"{tmp_path}/other"), f"{run}/versions/{version}/errors", policy="overwrite")
    spark.catalog.clearCache()
    faults = {r["subject"]: (r["expected"], r["observed"]) for r in B.checked(spark, run, names, B.EVALUATION).where("status = 'failed'").collect()}
    assert faults == {"errors": ("3", "1"), "error_rows": ("3", "1")}
    io.remove(spark, f"{run}/versions/{version}/confusion")
    with pytest.raises(ValueError, match="confusion_total, error_rows, confusion, errors"):
        B.require_passed(B.checked(spark, run, names, B.EVALUATION))
    absent = B.checked(spark, str(tmp_path / "nothing"), ("run",), B.EVALUATION).collect()
    assert len(absent) == 5 and {r["status"] for r in absent} == {"failed"}
    strange = B.checked(spark, run, ("metrics", "unheard_of")).where("status = 'failed'").collect()
    assert [(r["subject"], r["expected"]) for r in strange] == [("unheard_of", None)]


def test_comparisons_answers_and_holdouts_agree(spark, tmp_path):
    gates = spark.createDataFrame([("c1", "m1", True), ("c1", "m2", False), ("c2", "m1", True)], "configuration string, metric string, passed boolean")
    decided = gates.groupBy("configuration").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    board = gates.select("configuration").distinct()
    path = str(tmp_path / "comparison")
    io.write_dataset({"gates": gates, "decisions": decided, "leaderboard": board}, path)
    B.require_passed(B.checked(spark, path, ("gates", "decisions", "leaderboard"), B.COMPARISON))
    io.write_dataset({"gates": gates.where("metric = 'm1'"), "decisions": decided, "leaderboard": board}, path)
    with pytest.raises(ValueError, match="gate_counts$"):
        B.require_passed(B.checked(spark, path, ("gates",), B.COMPARISON))

    answers = spark.createDataFrame([(1, "x"), (2, "y")], "q long, status string")
    evidence = spark.createDataFrame([(1, "E1"), (2, "E1")], "q long, label string")
    cited = spark.createDataFrame([(1, "E1"), (2, "E9")], "q long, label string")
    path = str(tmp_path / "answers")
    io.write_dataset({"answers": answers, "evidence": evidence, "citations": cited}, path)
    with pytest.raises(ValueError, match="failed: citations_of_evidence$"):
        B.require_passed(B.checked(spark, path, ("answers",), B.answer_agreements("q")))

    rows = Y.holdout(spark, 12, 7)
    path = str(tmp_path / "holdout")
    io.write_dataset({"documents": rows, "units": Y.holdout_units(rows)}, path)
    B.require_passed(B.checked(spark, path, ("documents", "units"), B.HOLDOUT))
    io.write_dataset({"documents": rows.where("record_index > 1"), "units": Y.holdout_units(rows)}, path)
    with pytest.raises(ValueError, match="documents_with_units, units_of_known_documents"):
        B.require_passed(B.checked(spark, path, ("documents", "units"), B.HOLDOUT))


def test_review_pack(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a, b", "direct", "train"), (2, 'says "c"', "direct", "holdout")], "q long, query_text string, category string, split string")
    judged = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (1, 12, 2), (2, 10, 1), (2, 11, 1), (2, 13, 1), (2, 13, 2), (1, 14, 1), (1, 15, 2)], "q long, u long, grade int")
    texts = spark.createDataFrame([(10, "same"), (11, "same"), (12, "other"), (13, "third"), (14, None), (15, None)], "u long, text string")
    path = str(tmp_path / "pack")
    written = {r["name"]: r["rows"] for r in V.write_pack(queries, judged, texts, "q", "u", path).collect()}
    assert written == {"query_review": 2, "relevance_review": 9, "ambiguous_judgments": 3, "disagreements": 0}
    sheet = io.read_dataset(spark, path, "query_review", "q long, query_text string, category string, split string, review_question string")
    assert sorted(r["query_text"] for r in sheet.collect()) == ["a, b", 'says "c"']
    unsure = io.read_dataset(spark, path, "ambiguous_judgments", "q long, u long, ambiguity_reason string")
    assert sorted(map(tuple, unsure.collect())) == [(1, 10, "equal_texts_graded_differently"), (1, 11, "equal_texts_graded_differently"), (2, 13, "unit_graded_twice")]


def test_times_need_a_zone(spark):
    assert G.now().utcoffset() == timedelta(0)
    with pytest.raises(ValueError, match="until has no time zone"):
        G.require_zone(datetime(2026, 1, 1), "until")
    zoned = spark.sql("SELECT timestamp '2026-01-01 00:00:00' AS a, 1 AS b")
    assert G.require_zoned_columns(zoned) is zoned
    with pytest.raises(TypeError, match=r"zone: x, y\.z\[\]$"):
        G.require_zoned_columns(spark.sql("SELECT timestamp_ntz '2026-01-01 00:00:00' AS x, named_struct('z', array(timestamp_ntz '2026-01-01 00:00:00')) AS y"))


def test_run_ids(spark):
    at = datetime(2026, 1, 1, 12, tzinfo=UTC)
    one = G.run_id("RUN", {"a": "1", "b": "2"}, {"k": [1, 3]}, at)
    assert one == G.run_id("RUN", {"b": "2", "a": "1"}, {"k": [1, 3]}, at.astimezone(timezone(timedelta(hours=2))))
    assert one.startswith("RUN-") and len(one) == 28
    assert len({one, G.run_id("RUN", {"a": "1", "b": "3"}, {"k": [1, 3]}, at), G.run_id("RUN", {"a": "1", "b": "2"}, {"k": [3, 1]}, at)}) == 3
    with pytest.raises(ValueError):
        G.run_id("RUN", {}, {}, datetime(2026, 1, 1))


def test_model_folders(spark, tmp_path):
    for bad in ("https://example.com/m", "owner/model", "model", "./m"):
        with pytest.raises(ValueError, match="absolute"):
            G.local_path(bad)
    folder = tmp_path / "small"
    folder.mkdir()
    with pytest.raises(FileNotFoundError):
        G.model_card(spark, str(folder))
    (folder / "config.json").write_text(json.dumps({"hidden_size": 8}))
    (folder / "weights.bin").write_bytes(b"\x00\x01")
    first = G.model_card(spark, f"{folder}/").first()
    assert (first["name"], first["dimension"], first["files"]) == ("small", 8, 2)
    (folder / "weights.bin").write_bytes(b"\x00\x02")
    assert G.model_card(spark, str(folder)).first()["folder_checksum"] != first["folder_checksum"]
    (folder / "config.json").write_text(json.dumps({"hidden_size": "8"}))
    with pytest.raises(ValueError, match="hidden_size"):
        G.model_card(spark, str(folder))
    assert not glob.glob(f"{folder}/*.tmp") and os.listdir(folder)
