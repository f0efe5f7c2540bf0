"""Requests served from ready answers, runs read back after writing, and review sheets."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import readback as B
from textmill.operators import requests as S
from textmill.operators import review as V
from textmill.plans import evaluation, extended, grades, rules, service
from textmill.plans.registry import ORACLES, query, table
from textmill.plans.retrieval import Q, U
from textmill.session import shared_folder

_PROBE = f"{rules._PROBE_ARRAY}[1 + (conv_id + turn) % 10]"
_REQUESTS = f"""rq AS (SELECT 'B' || item_id AS request_id, CASE WHEN item_id % 4 = 3 THEN item_id END AS given, {service._NOISE} AS text, item_id % 10 AS filters, item_id % 9 <> 0 AS demo FROM benchmark
UNION ALL SELECT 'C' || conv_id || '-' || turn, NULL, coalesce(text, '') || coalesce(' ' || {_PROBE}, ''), conv_id % 10, true FROM conversations WHERE role = 'user')"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark question in other case and spacing, some by id, and every user turn with a probe phrase."""
    c = F.col
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B"), c(Q)).alias("request_id"), F.when(c(Q) % 4 == 3, c(Q)).alias("asked"), F.expr(service._NOISE).alias("text"), (c(Q) % 10).alias("filters"), (c(Q) % 9 != 0).alias("demo"))
    probes = F.array(*[F.lit(p) for p in rules._PROBES])
    probe = F.concat(F.lit(" "), F.element_at(probes, (F.pmod(c("conv_id") + c("turn"), F.lit(10)) + 1).cast("int")))
    text = F.concat(F.coalesce("text", F.lit("")), F.coalesce(probe, F.lit("")))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat(F.lit("C"), c("conv_id"), F.lit("-"), c("turn")).alias("request_id"), F.lit(None).cast("long").alias("asked"), text.alias("text"), (c("conv_id") % 10).alias("filters"), F.lit(True).alias("demo"))
    return items.unionByName(turns)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "benchmark").select(Q, F.col("text").alias("question"))
    retrieval = F.when(F.col("status") == "retrieval_abstention", "retrieval_abstained").otherwise("retrieval_accepted")
    ready = extended.guarded_rows(spark, sf_dir).select(Q, "status", "answer", retrieval.alias("retrieval_status"), "confidence")
    return S.served(requests(spark, sf_dir), known, ready, Q, "unanswerable_query")


_KEY = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_SERVED = f"""WITH {_REQUESTS}, ju AS (SELECT *, CASE WHEN length(text) > {S.CHARACTERS} THEN 'query_too_large' WHEN filters > {S.FILTERS} THEN 'too_many_metadata_filters' WHEN NOT demo THEN 'portfolio_demo_mode_required' END AS error,
  {rules._class_sql()} AS class FROM (SELECT *, lower(text) AS t FROM rq)),
st AS (SELECT *, error IS NULL AND starts_with(class, 'unsupported') AS refused, error IS NULL AND NOT starts_with(class, 'unsupported') AS open FROM ju),
kn AS (SELECT {_KEY.format('text')} AS k, min(item_id) AS item_id FROM benchmark GROUP BY k),
ga AS (SELECT a.*, CASE WHEN status = 'retrieval_abstention' THEN 'retrieval_abstained' ELSE 'retrieval_accepted' END AS retrieval, confidence FROM ({ORACLES['guarded_answers']}) a LEFT JOIN (SELECT item_id, confidence FROM ({ORACLES['confidence_abstain']})) USING (item_id)),
fb AS (SELECT * FROM ga ORDER BY CASE WHEN status = 'unanswerable_query' THEN 0 WHEN contains(status, 'refusal') OR starts_with(status, 'unsupported') THEN 1 ELSE 2 END, item_id LIMIT 1),
na AS (SELECT st.*, coalesce(given, kn.item_id) AS asked FROM st LEFT JOIN kn ON open AND given IS NULL AND kn.k = {_KEY.format('st.text')}),
an AS (SELECT * FROM ga UNION ALL SELECT -1, * EXCLUDE (item_id) FROM fb),
re AS (SELECT na.request_id, na.asked, na.text, CASE WHEN error IS NULL THEN class END AS category, error, refused, CASE WHEN an.item_id = -1 THEN fb.item_id ELSE an.item_id END AS answered_by, CASE WHEN refused THEN '{S.REFUSED}' ELSE an.status END AS answer_status,
  an.answer, CASE WHEN refused THEN 'not_invoked' ELSE an.retrieval END AS retrieval_status, CASE WHEN refused THEN 0 ELSE an.confidence END AS confidence
  FROM na LEFT JOIN an ON open AND an.item_id = CASE WHEN asked IN (SELECT item_id FROM ga) THEN asked ELSE -1 END, fb)"""


@query(f"{_SERVED} SELECT request_id, asked, category, error, refused, answered_by, answer_status, answer, retrieval_status, confidence FROM re")
def served_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits, safety, match and lookup of every request: what it is answered."""
    return responses(spark, sf_dir).drop("text")


@query(
    f"""{_SERVED}, ev AS (SELECT request_id, text, 1 AS place, 'application_error' AS event_type, '' AS category, '' AS retrieval_status, '' AS answer_status, '' AS safety_status, error AS error_code FROM re WHERE error = 'query_too_large'
    UNION ALL SELECT request_id, text, 1, 'query_refused_before_retrieval', category, '', answer_status, 'passed', '' FROM re WHERE refused
    UNION ALL SELECT request_id, text, 1, 'query_accepted', category, retrieval_status, answer_status, 'passed', '' FROM re WHERE error IS NULL AND NOT refused
    UNION ALL SELECT request_id, text, 2, CASE WHEN retrieval_status = 'retrieval_abstained' THEN 'retrieval_abstained' ELSE 'answer_generated' END, category, retrieval_status, answer_status, '', '' FROM re WHERE error IS NULL AND NOT refused)
    SELECT request_id, place, CASE WHEN text = '' THEN '' ELSE sha256(text) END AS query_checksum, event_type, category, retrieval_status, answer_status, safety_status, error_code FROM ev"""
)
def served_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that the requests leave, with checksums in place of texts."""
    return S.events(responses(spark, sf_dir))


_CLASSES = "CASE WHEN doc_id % 10 = 0 THEN 'en' WHEN doc_id % 11 <> 0 THEN lang END"


@query(
    f"""WITH {grades._BOTH}, n AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE t <> p) AS e FROM both_), d AS (SELECT count(*) AS n FROM documents),
    m AS (SELECT 5 + count(*) AS n FROM (SELECT lang FROM both_ GROUP BY lang)), c AS (SELECT count(*) AS n FROM (SELECT lang, coalesce({_CLASSES}, 'missing') AS predicted FROM documents GROUP BY ALL)),
    f AS (SELECT (CASE WHEN 2 * tp + e > 0 THEN round(2::DOUBLE * tp / (2 * tp + e), 6) ELSE 0 END)::DECIMAL(8, 6) AS f1 FROM n),
    r AS (SELECT 'table' AS "check", 'metrics' AS subject, n::VARCHAR AS expected FROM m UNION ALL SELECT 'table', 'errors', e::VARCHAR FROM n UNION ALL SELECT 'table', 'confusion', n::VARCHAR FROM c UNION ALL SELECT 'table', 'reconciliation', '3' UNION ALL SELECT 'table', 'run', '1'
      UNION ALL SELECT 'agreement', 'error_rows', e::VARCHAR FROM n UNION ALL SELECT 'agreement', 'confusion_total', n::VARCHAR FROM d UNION ALL SELECT 'agreement', 'micro_f1', f1::VARCHAR FROM f UNION ALL SELECT 'agreement', 'reconciliation_status', 'passed')
    SELECT "check", subject, expected, expected AS observed, 'passed' AS status FROM r"""
)
def evaluation_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extraction rule sets over all documents compared, written as a run, read back and checked."""
    truth, found = (grades.entities(spark, sf_dir, p) for p in (grades._TRUTH, grades._FOUND))
    classes = table(spark, sf_dir, "documents").select(F.col("lang").alias("actual"), F.expr(_CLASSES).alias("predicted"))
    labels = spark.createDataFrame([(x,) for x in grades._LABELS], "value string")
    path = f"{shared_folder(spark)}/runs/evaluation_{zlib.crc32(sf_dir.encode()):08x}"
    return B.write_evaluation(truth, found, grades._KEY, {"label": "label", "lang": "lang"}, labels, classes, path)


@query(
    f"""WITH {grades.TOKENS}, {grades.JUDGED}, g AS (SELECT item_id, doc_id, 1 + doc_id % 3 AS grade, sha256(text) AS h FROM j JOIN documents USING (doc_id) WHERE text IS NOT NULL),
    x AS (SELECT item_id, h, count(DISTINCT doc_id) AS units FROM g GROUP BY ALL HAVING min(grade) < max(grade))
    SELECT DISTINCT item_id, doc_id, CASE WHEN units > 1 THEN 'equal_texts_graded_differently' ELSE 'unit_graded_twice' END AS ambiguity_reason FROM g JOIN x USING (item_id, h)"""
)
def ambiguous_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments that grade exact copies differently; grades are 1 to 3 by the document's number."""
    judged = evaluation.judgments(spark, sf_dir).withColumn("grade", 1 + F.col(U) % 3)
    return V.ambiguous(judged, table(spark, sf_dir, "documents").select(U, "text"), Q, U)
