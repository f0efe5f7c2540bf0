"""Registries, settings and prompt contracts from files."""

from __future__ import annotations

import json

import pytest

from textmill.operators import experiments as P
from textmill.sources import configuration as C


def _remediation(name: str, on: tuple[str, ...]) -> dict:
    many = lambda f: [f"{f}_1"] if f in on else []
    return {
        "configuration_id": name, "candidate_retrievers": ["bm25"], "character_features": many("character"), "phrase_features": many("phrase"),
        "proximity_features": many("proximity"), "entity_features": many("entity"), "synonym_expansion": "synonym" in on,
        "pseudo_relevance_feedback": "feedback" in on, "reranker": "feature_weighted" if "rerank" in on else "rrf", "diversification": "diversify" in on,
        "abstention": "abstain" in on, "description": name,
    }


def _retrieval(name: str, v: tuple) -> dict:
    strategy, provider, granularity, reranker, candidates, complexity, model = v
    return {"configuration_id": name, "active": True, "candidate_strategy": strategy, "embedding_provider": provider, "granularity_policy": granularity, "reranker": reranker, "candidate_top_k": candidates, "complexity_rank": complexity, "requires_optional_model": model, "weights": {"bm25": 1}}


def test_registries_of_files_equal_those_of_the_code(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    entries = [_remediation(n, on) for n, on in P.REMEDIATION.items()]
    (tmp_path / "a.yaml").write_text(yaml.safe_dump({"configurations": entries}))
    read = C.read_registry(spark, tmp_path / "a.yaml", C.REMEDIATION, "configurations")
    assert sorted(C.remediation_features(read).collect()) == sorted(P.configurations(spark).collect())
    assert sorted(P.configurations(spark, str(tmp_path / "a.yaml")).collect()) == sorted(P.configurations(spark).collect())
    assert P.configurations(spark, str(tmp_path / "none.yaml")).count() == len(P.REMEDIATION)
    assert C.registry_faults(read, "configuration_id").count() == 0
    entries = [_retrieval(n, v) for n, v in P.RETRIEVAL.items()]
    off = _retrieval("off", ("bm25", "none", "x", "none", 1, 9, False)) | {"active": False}
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "configurations": [*entries, off]}))
    assert sorted(P.retrieval_configurations(spark, str(tmp_path / "b.json")).collect()) == sorted(P.retrieval_configurations(spark).collect())


def test_faults_are_rows(spark, tmp_path):
    entries = [
        {"configuration_id": "a", "candidate_top_k": "ten", "weights": {"bm25": "much"}, "colour": 1},
        {"configuration_id": "a", "active": 1},
        {"candidate_top_k": 2**31},
        "text",
    ]
    (tmp_path / "r.json").write_text(json.dumps({"configurations": entries}))
    read = C.read_registry(spark, tmp_path / "r.json", C.RETRIEVAL, "configurations")
    faults = sorted((r["configuration_id"] or "", r["fault"]) for r in C.registry_faults(read, "configuration_id").collect())
    assert faults == [
        ("", "candidate_top_k: int instead of int"),
        ("", "configuration_id: missing"),
        ("", "configuration_id: missing"),
        ("", "entry 3: not a mapping"),
        ("a", "active: int instead of boolean"),
        ("a", "candidate_top_k: str instead of int"),
        ("a", "colour: unknown key"),
        ("a", "configuration_id: stands twice"),
        ("a", "weights.bm25: str instead of double"),
    ]
    (tmp_path / "empty.json").write_text('{"configurations": []}')
    assert C.read_registry(spark, tmp_path / "empty.json", C.RETRIEVAL, "configurations").count() == 0


@pytest.mark.parametrize("name, text", [("a.json", "[1]"), ("a.json", "{"), ("a.txt", "{}"), ("a.json", " " * (C.MOST_BYTES + 1))])
def test_files_that_are_refused(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(C.ConfigurationError):
        C.load_mapping(tmp_path / name)


def test_settings_in_layers(tmp_path):
    defaults = {"host": "localhost", "limit": 5, "share": 0.5, "nested": {"on": False, "any": None}}
    (tmp_path / "s.json").write_text(json.dumps({"limit": 6, "share": 1, "nested": {"any": [1]}}))
    env = {"TEXTMILL_LIMIT": "7", "TEXTMILL_NESTED__ON": "true", "TEXTMILL_HOST": "12", "OTHER": "x"}
    assert C.settings(defaults) == defaults
    assert C.settings(defaults, tmp_path / "s.json", env) == {"host": "12", "limit": 7, "share": 1.0, "nested": {"on": True, "any": [1]}}
    assert defaults["nested"]["on"] is False
    for bad in ({"TEXTMILL_LIMIT": "many"}, {"TEXTMILL_NESTED__OFF": "1"}, {"TEXTMILL_LIMIT": "true"}, {"TEXTMILL_NESTED": "1"}):
        with pytest.raises(C.ConfigurationError):
            C.settings(defaults, environment=bad)


SAFE = {"api_host": "127.0.0.1", "dashboard_host": "127.0.0.1", "allow_unsafe_local_binding": False, "allowed_origins": ["http://localhost"], "cors_enabled": False, "query_timeout_seconds": 5, "trace_timeout_seconds": 5.5, "maximum_concurrent_queries": 2, "rate_limit_requests": 3, "rate_limit_window_seconds": 60, "event_root": "out/events"}


@pytest.mark.parametrize("change, failed", [
    ({}, set()),
    ({"api_host": "0.0.0.0"}, {"localhost_default_binding"}),
    ({"api_host": "0.0.0.0", "allow_unsafe_local_binding": True}, {"unsafe_override_default_false"}),
    ({"allowed_origins": ["*"]}, {"wildcard_cors_rejected"}),
    ({"cors_enabled": True}, {"wildcard_cors_rejected"}),
    ({"trace_timeout_seconds": 0}, {"positive_timeouts"}),
    ({"maximum_concurrent_queries": -1, "rate_limit_requests": 0}, {"positive_concurrency", "rate_limit_safe"}),
    ({"event_root": "/var/events"}, {"event_root_local"}),
])
def test_setting_checks(spark, change, failed):
    rows = C.setting_checks(C.settings_rows(spark, SAFE | change)).collect()
    assert len(rows) == 7
    assert {r["check_id"] for r in rows if r["status"] == "failed"} == failed


def test_missing_settings_fail(spark):
    rows = C.setting_checks(C.settings_rows(spark, {"x": {}})).collect()
    assert {r["check_id"] for r in rows if r["status"] == "passed"} == {"unsafe_override_default_false"}


def test_answers_against_prompt_contracts(spark, tmp_path):
    contract = {"prompt_id": "p", "prompt_version": "1", "purpose": "grounded", "required_output_fields": ["answer_text", "claims"], "prohibited_content": ["Diagnosis", ""], "maximum_answer_size": 12}
    (tmp_path / "p.json").write_text(json.dumps(contract))
    (tmp_path / "q.json").write_text(json.dumps(contract | {"prompt_id": "q", "maximum_answer_size": 1}))
    (tmp_path / "README.md").write_text("no contract")
    contracts = C.read_registry(spark, tmp_path, C.PROMPT)
    assert contracts.count() == 2 and C.registry_faults(contracts, "prompt_id").count() == 0
    rows = [(1, "grounded", "short"), (2, "grounded", "a DIAGNOSIS of it"), (3, "other", "x"), (4, None, None), (5, "grounded", None)]
    answers = spark.createDataFrame(rows, "_text long, purpose string, answer_text string")
    found = sorted((r["_text"], r["violation"]) for r in C.contract_violations(answers, contracts).collect())
    lacking = "missing field: claims"
    assert found == [(1, lacking), (2, "answer too long"), (2, lacking), (2, "prohibited: Diagnosis"), (3, "no contract"), (4, "no contract"), (5, lacking)]
    assert C.contract_violations(answers.limit(0), contracts).count() == 0
