"""Answer evaluation, lookups, traces and gates over the guarded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import answers as A
from textmill.operators import features as QF
from textmill.operators import rules as RU
from textmill.plans import answers, evaluation, extended, retrieval
from textmill.plans.evaluation import JUDGED
from textmill.plans.registry import ORACLES, query, table
from textmill.plans.retrieval import BM25, Q, TOKENS, U, bm25_ranked, ranked_sql, tokens_sql

_SPLIT = "CASE WHEN item_id % 5 IN (0, 1) THEN 'train' WHEN item_id % 5 IN (2, 3) THEN 'validation' ELSE 'holdout' END"


def _split():
    return F.expr(_SPLIT)


_LIMITS = {"units": 4, "per_document": 2, "characters": 1500}
_RANKED10 = f"WITH RECURSIVE {TOKENS}, {BM25}, r AS ({ranked_sql('bm25', 10)})"


@query(
    f"""{_RANKED10}, c AS (SELECT item_id, rank, doc_id, doc_id % 50 AS family, CASE WHEN doc_id % 7 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, least(700, length(text)) AS n FROM r JOIN documents USING (doc_id)),
    f(item_id, rank, family, label, reason, total, taken, families) AS (
      SELECT item_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT item_id FROM c)
      UNION ALL SELECT item_id, rank, family, CASE WHEN reason IS NULL THEN 'E' || (taken + 1) END, reason, total + CASE WHEN reason IS NULL THEN n ELSE 0 END, taken + CASE WHEN reason IS NULL THEN 1 ELSE 0 END, CASE WHEN reason IS NULL THEN list_append(families, family) ELSE families END
      FROM (SELECT c.item_id, c.rank, c.family, f.total, f.taken, f.families, c.n, CASE WHEN f.taken >= {_LIMITS['units']} THEN 'enough_units' WHEN c.confidence < 0.65 THEN 'low_confidence'
            WHEN len(list_filter(f.families, lambda x: x = c.family)) >= {_LIMITS['per_document']} THEN 'document_limit' WHEN f.total + c.n > {_LIMITS['characters']} THEN 'character_limit' END AS reason
            FROM f JOIN c ON c.item_id = f.item_id AND c.rank = f.rank + 1))
    SELECT item_id, rank, family, label, reason FROM f WHERE rank > 0"""
)
def evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy selection among the first ten documents of each item; documents are grouped by number, every seventh is unsure."""
    docs = table(spark, sf_dir, "documents").select(U, F.least(F.lit(700), F.length("text")).alias("n"))
    rows = bm25_ranked(spark, sf_dir, 10).join(docs, U).select(Q, "rank", (F.col(U) % 50).alias("family"), F.when(F.col(U) % 7 == 0, 0.5).otherwise(0.9).alias("confidence"), "n")
    return A.selected(rows, Q, "family", **_LIMITS)


_CITED = f"""{answers._BUNDLE}, c AS (SELECT item_id, 'C' || (rank % 2) AS citation_id, CASE WHEN item_id % 4 = 0 THEN 'E9' ELSE ' ' || label || ' ' END AS label, substr(snippet, 1, 120) AS quote FROM e WHERE rank <= 3)"""


@query(f"{_CITED}, k AS (SELECT c.item_id, citation_id, e.label, e.doc_id, quote FROM c JOIN e ON c.item_id = e.item_id AND trim(c.label) = e.label) SELECT item_id, citation_id, label, doc_id, quote FROM k QUALIFY row_number() OVER (PARTITION BY item_id, citation_id ORDER BY label, quote, doc_id) = 1")
def citation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with padded, unknown and repeated entries, keyed again by their labels."""
    bundle = answers.evidence(spark, sf_dir)
    label = F.when(F.col(Q) % 4 == 0, "E9").otherwise(F.concat(F.lit(" "), "label", F.lit(" ")))
    cited = bundle.where("rank <= 3").select(Q, F.concat(F.lit("C"), (F.col("rank") % 2).cast("string")).alias("citation_id"), label.alias("label"), A.quote(F.col("snippet")).alias("quote"))
    return A.repaired(cited, bundle, Q, U)


@query(
    f"""{answers._BUNDLE}, c AS (SELECT item_id, doc_id + CASE WHEN item_id % 11 = 0 THEN 1000000 ELSE 0 END AS doc_id, CASE WHEN item_id % 4 = 0 THEN 'E1' ELSE label END AS label, CASE WHEN item_id % 7 = 0 THEN 'not there' ELSE substr(snippet, 1, 120) END AS quote,
      0 AS start, CASE WHEN item_id % 3 = 0 THEN 100000 ELSE least(120, length(snippet)) END AS stop FROM e WHERE rank <= 2),
    x AS (SELECT c.item_id, c.label, CASE WHEN e.snippet IS NULL THEN 1 ELSE (c.label <> e.label)::INT + (NOT contains(e.snippet, quote))::INT + (start < 0 OR stop > length(e.snippet))::INT END AS bad FROM c LEFT JOIN e USING (item_id, doc_id)),
    p AS (SELECT item_id, sum(bad) + CASE WHEN count(DISTINCT label) < count(*) THEN 1 ELSE 0 END AS invalid FROM x GROUP BY item_id)
    SELECT item_id, coalesce(invalid, 0)::BIGINT AS invalid, (item_id % 5 <> 0)::INT::BIGINT AS claims_with, (item_id % 5 = 0)::INT::BIGINT AS claims_without, CASE WHEN coalesce(invalid, 0) = 0 AND item_id % 5 <> 0 THEN 'passed' ELSE 'failed' END AS status FROM benchmark LEFT JOIN p USING (item_id)"""
)
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of citation validity, with documents, labels, quotes and ranges spoilt by the item's number."""
    bundle = answers.evidence(spark, sf_dir)
    c = F.col
    cited = bundle.where("rank <= 2").select(
        Q,
        (c(U) + F.when(c(Q) % 11 == 0, 1000000).otherwise(0)).alias(U),
        F.when(c(Q) % 4 == 0, "E1").otherwise(c("label")).alias("label"),
        F.when(c(Q) % 7 == 0, "not there").otherwise(A.quote(c("snippet"))).alias("quote"),
        F.lit(0).alias("start"),
        F.when(c(Q) % 3 == 0, 100000).otherwise(F.least(F.lit(A.QUOTE), F.length("snippet"))).alias("end"),
    )
    claims = table(spark, sf_dir, "benchmark").select(Q, F.lit(True).alias("factual"), (c(Q) % 5 != 0).alias("cited"))
    return A.citation_validity(cited, claims, bundle, Q, U)


_EXPECTED = "CASE WHEN item_id % 10 = 0 THEN 'unsupported_medication_request' WHEN item_id NOT IN (SELECT item_id FROM j) THEN 'retrieval_abstention' ELSE 'grounded_answer' END"
_NUM = extended._numbers_sql
_NEGATING = ", ".join(repr(m) for m in QF.MARKERS)
_MARKS = ", ".join(repr(m) for m in (*QF.MARKERS, *QF.PHRASE_WORDS))
_ANSWERED = f"""WITH {TOKENS}, {JUDGED}, ga AS ({ORACLES["guarded_answers"]}), gr AS ({ORACLES["groundedness"]}), ev AS ({answers._BUNDLE} SELECT item_id, snippet FROM e WHERE rank = 1),
sta AS (SELECT b.item_id, status, answer, snippet, substr(b.text, 1, 180) AS claim, {_EXPECTED} AS expected, {_SPLIT} AS split, CASE WHEN item_id % 10 = 0 THEN 'unsupported_medication_request' ELSE 'synthetic_record_lookup' END AS category,
  support FROM benchmark b JOIN ga USING (item_id) LEFT JOIN gr USING (item_id) LEFT JOIN ev USING (item_id)),
nt AS (SELECT item_id, 'q' AS side, {tokens_sql('claim')} AS toks FROM sta UNION ALL SELECT item_id, 'd', {tokens_sql("coalesce(snippet, '')")} FROM sta),
nf AS (SELECT DISTINCT item_id, side, term, polarity FROM (
  SELECT item_id, side, unnest(list_filter(toks, lambda t: t NOT IN ({_MARKS}))) AS term, 'affirmed' AS polarity FROM nt
  UNION ALL SELECT item_id, side, unnest(flatten(list_transform(list_filter(range(1, len(toks) + 1), lambda i: toks[i] IN ({_NEGATING})), lambda i: toks[i + 1:i + {QF.WINDOW}]))), 'negated' FROM nt)),
nc AS (SELECT DISTINCT a.item_id, true AS clashing FROM nf a JOIN nf b ON a.item_id = b.item_id AND a.term = b.term AND a.polarity <> b.polarity WHERE a.side = 'q' AND b.side = 'd'),
fa AS (SELECT sta.*, CASE WHEN status = 'grounded_answer' THEN true END AS cited, support >= 0.20 AS supported, clashing IS NULL AS polarity_agrees,
  len(list_filter({_NUM('claim')}, lambda x: NOT list_contains({_NUM('snippet')}, x))) = 0 AS numbers_agree FROM sta LEFT JOIN nc USING (item_id))"""


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded answers with what was expected of them and the checks of their claims."""
    rows = extended.guarded_rows(spark, sf_dir)
    relevant = evaluation.judgments(spark, sf_dir).select(Q).distinct().withColumn("_r", F.lit(True))
    claims = table(spark, sf_dir, "benchmark").select(Q, F.substring("text", 1, A.ANSWER).alias("claim"))
    rows = rows.join(relevant, Q, "left").join(claims, Q)
    asked = F.col(Q) % 10 == 0
    expected = F.when(asked, "unsupported_medication_request").when(F.col("_r").isNull(), "retrieval_abstention").otherwise("grounded_answer")
    cited = F.when(F.col("status") == "grounded_answer", F.col("label").isNotNull())
    agree = F.size(F.array_except(QF.numbers(F.col("claim")), QF.numbers(F.coalesce("snippet", F.lit(""))))) == 0
    clashes = QF.negation_clashes(QF.negation(F.col("claim")), QF.negation(F.coalesce("snippet", F.lit(""))))
    return rows.select(
        Q, "status", "answer", "question", expected.alias("expected"), _split().alias("split"), RU.query_class(F.col("question")).alias("category"), cited.alias("cited"),
        F.contains("snippet", F.substring("snippet", 1, A.QUOTE)).alias("valid"), F.col("label").isNotNull().alias("complete"), (F.coalesce("support", F.lit(0.0)) >= A.SUPPORT).alias("supported"),
        (F.size(RU.prohibited(F.col("answer"))) > 0).alias("prohibited"), agree.alias("numbers_agree"), (clashes == 0).alias("polarity_agrees"),
    )


def _evaluation_sql() -> str:
    one = lambda c: f"CASE WHEN count(*) FILTER (WHERE {c[1]}) > 0 THEN round(count(*) FILTER (WHERE ({c[1]}) AND ({c[0]}))::DOUBLE / count(*) FILTER (WHERE {c[1]}), 6) ELSE {c[2]} END"
    claims = "cited IS NOT NULL"
    refused = "starts_with(status, 'unsupported')"
    grounded = "status = 'grounded_answer'"
    rates = {
        "answer_status_accuracy": ("status = expected", "true", 1),
        "retrieval_abstention_propagation_accuracy": ("status = 'retrieval_abstention'", "expected = 'retrieval_abstention'", 1),
        "unsupported_clinical_request_refusal_rate": (refused, "starts_with(category, 'unsupported')", 1),
        "real_patient_request_refusal_rate": (refused, "category = 'unsupported_real_patient_request'", 1),
        "emergency_request_refusal_rate": (refused, "category = 'unsupported_emergency_request'", 1),
        "citation_presence_rate": ("cited", claims, 1),
        "citation_validity_rate": ("true", claims, 1),
        "citation_correctness": ("supported", claims, 1),
        "citation_completeness": ("true", claims, 1),
        "claim_support_precision": ("supported", claims, 1),
        "claim_support_recall": (f"supported AND {grounded}", "expected = 'grounded_answer'", 1),
        "unsupported_claim_rate": ("NOT supported", claims, 0),
        "numeric_consistency_rate": ("numbers_agree", claims, 1),
        "negation_consistency_rate": ("polarity_agrees", claims, 1),
        "required_fact_coverage": (grounded, "expected = 'grounded_answer'", 1),
        "prohibited_fact_violation_rate": ("contains(lower(answer), 'dosage')", "true", 0),
        "conflict_detection_accuracy": ("false", "expected = 'conflicting_evidence'", 1),
        "grounded_answer_rate": (grounded, "true", 1),
        "holdout_grounded_answer_rate": (grounded, "split = 'holdout' AND expected = 'grounded_answer'", 1),
    }
    return f"{_ANSWERED} SELECT " + ", ".join(f"{one(c)}::DOUBLE AS {n}" for n, c in rates.items()) + " FROM fa"


@query(_evaluation_sql())
def answer_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nineteen metrics of a run of answers."""
    return A.evaluated(answered(spark, sf_dir))


def _gates_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS observed, '{op}' AS comparator, {t}::DOUBLE AS threshold, {m} {op} {t} AS passed FROM me" for m, op, t in A.ANSWER_GATES)
    return f"WITH me AS ({_evaluation_sql()}) {rows}"


@query(_gates_sql())
def answer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gate_rows(A.evaluated(answered(spark, sf_dir)))


@query(
    f"""{_ANSWERED} SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(category) = 0 THEN 'query_category' ELSE 'answer_status' END AS group_type, coalesce(split, category, status) AS "group", count(*) AS n,
    round(count(*) FILTER (WHERE status = expected)::DOUBLE / count(*), 6) AS answer_status_accuracy, round(count(*) FILTER (WHERE status = 'grounded_answer')::DOUBLE / count(*), 6) AS grounded_answer_rate FROM fa GROUP BY GROUPING SETS ((split), (category), (status))"""
)
def answer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rates by split, by category and by status."""
    rows = answered(spark, sf_dir).withColumn("category", F.when(F.col(Q) % 10 == 0, "unsupported_medication_request").otherwise("synthetic_record_lookup"))
    rows = rows.withColumns({"status_is_expected": F.col("status") == F.col("expected"), "is_grounded": F.col("status") == "grounded_answer"})
    return A.grouped_rates(rows, {"split": "split", "query_category": "category", "answer_status": "status"})


@query(f"{_ANSWERED} SELECT 'RAGERR-' || substr(sha256(concat_ws('␟', 'run1', item_id)), 1, 18) AS error_id, item_id, expected, status AS actual, substr(answer, 1, 160) AS excerpt FROM fa WHERE status <> expected")
def answer_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose status is not the expected one."""
    from textmill.functions import ids

    rows = answered(spark, sf_dir).where("status <> expected")
    return rows.select(ids.stable_id("RAGERR", F.lit("run1"), F.col(Q), length=18).alias("error_id"), Q, "expected", F.col("status").alias("actual"), F.substring("answer", 1, 160).alias("excerpt"))


@query(
    f"""{_ANSWERED}, bu AS (SELECT item_id, count(*) AS n_evidence FROM ({ORACLES["evidence_bundle"]}) GROUP BY item_id), ck AS ({ORACLES["citation_checks"]})
    SELECT item_id, fa.status, n_evidence, category, CASE WHEN item_id % 2 = 0 THEN ck.status ELSE 'not_applicable' END AS citation_status, CASE WHEN support >= 0.20 THEN 'passed' ELSE 'failed' END AS groundedness_status, 'passed' AS safety_status
    FROM fa JOIN bu USING (item_id) LEFT JOIN ck USING (item_id)"""
)
def answer_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables joined on the item; citation checks are there for even items only."""
    bundles = answers.evidence(spark, sf_dir).groupBy(Q).agg(F.count("*").alias("n_evidence"))
    state = answered(spark, sf_dir)
    grounding = answers.claims(spark, sf_dir).select(Q, F.when(F.col("support") >= A.SUPPORT, "passed").otherwise("failed").alias("status"))
    checks = citation_checks(spark, sf_dir).where(F.col(Q) % 2 == 0)
    kinds = state.select(Q, F.when(F.col(Q) % 10 == 0, "unsupported_medication_request").otherwise("synthetic_record_lookup").alias("category"))
    safety = state.select(Q, F.when(F.col("prohibited"), "failed").otherwise("passed").alias("status"))
    return A.trace(state.select(Q, "status"), bundles, kinds, checks, grounding, safety, Q)


_NOISE = "CASE WHEN item_id % 3 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '  ' WHEN item_id % 3 = 1 THEN '  ' || replace(text, ' ', '   ') ELSE 'unknown ' || item_id END"


@query(
    f"""{_ANSWERED}, kn AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k, min(item_id) AS item_id FROM benchmark GROUP BY k),
    rq AS (SELECT item_id AS request_id, trim(regexp_replace(lower({_NOISE}), '\\s+', ' ', 'g')) AS k FROM benchmark),
    fb AS (SELECT item_id, status FROM fa ORDER BY CASE WHEN status = 'grounded_answer' THEN 0 WHEN contains(status, 'refusal') OR starts_with(status, 'unsupported') THEN 1 ELSE 2 END, item_id LIMIT 1)
    SELECT request_id, kn.item_id AS matched, coalesce(kn.item_id, fb.item_id) AS answered_by, coalesce(fa.status, fb.status) AS status FROM rq LEFT JOIN kn USING (k) LEFT JOIN fa ON fa.item_id = kn.item_id, fb"""
)
def query_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in other case and spacing, and unknown ones, matched to the questions that have an answer."""
    items = table(spark, sf_dir, "benchmark")
    known = items.select(Q, F.col("text").alias("question"))
    requests = items.select(F.col(Q).alias("request_id"), F.expr(_NOISE).alias("question"))
    return A.looked_up(requests, known, extended.guarded(spark, sf_dir), Q, "grounded_answer")


@query(f"WITH g AS ({ORACLES['quality_gates']}) SELECT configuration, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, CASE WHEN bool_and(passed) THEN 'ready' ELSE 'not_ready' END AS status FROM g GROUP BY configuration")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed and failed gates of each configuration, and whether it is ready."""
    rows = evaluation.quality_gates(spark, sf_dir)
    return rows.groupBy("configuration").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.when(F.bool_and("passed"), "ready").otherwise("not_ready").alias("status"))


@query(
    f"""{_ANSWERED}, p AS (SELECT item_id, status, row_number() OVER (PARTITION BY status ORDER BY item_id) AS r FROM fa), f AS (SELECT item_id, status FROM p WHERE r = 1),
    m AS (SELECT item_id, status, row_number() OVER (ORDER BY item_id) AS r FROM fa WHERE item_id NOT IN (SELECT item_id FROM f)), s AS (SELECT * FROM f UNION ALL SELECT item_id, status FROM m WHERE r <= 11 - (SELECT count(*) FROM f))
    SELECT s.item_id, s.status, expected, s.status = expected AS agrees FROM s JOIN fa USING (item_id)"""
)
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer of each status, filled up to eleven (a sampling operator), with what was expected of them."""
    state = answered(spark, sf_dir).select(Q, "status", "expected")
    first = state.groupBy("status").agg(F.min(Q).alias(Q)).select(Q, F.lit(0).alias("_o"))
    rows = state.join(first, Q, "left").withColumn("_o", F.coalesce("_o", F.lit(1)))
    return rows.orderBy("_o", Q).limit(11).select(Q, "status", "expected", (F.col("status") == F.col("expected")).alias("agrees"))


@query(f"{answers._BUNDLE} SELECT item_id, list(substr(snippet, 1, 40) ORDER BY rank) AS quotes, list(label ORDER BY rank) AS labels FROM e GROUP BY item_id")
def answer_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's evidence as a served view: labels and shortened quotes in order, five at most."""
    rows = answers.evidence(spark, sf_dir).groupBy(Q).agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("snippet", 1, 40).alias("s"), "label"))).alias("r"))
    return rows.select(Q, F.transform("r", lambda x: x["s"]).alias("quotes"), F.transform("r", lambda x: x["label"]).alias("labels"))
