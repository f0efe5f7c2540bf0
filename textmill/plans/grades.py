"""Evaluation at several depths, grains and groups, with error records and their accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import ids
from textmill.functions import text as X
from textmill.operators import evaluate as E
from textmill.plans import evaluation, retrieval
from textmill.plans.evaluation import JUDGED, MEANS, per_query_sql
from textmill.plans.registry import ORACLES, query, table
from textmill.plans.retrieval import BM25, Q, TOKENS, U, bm25_ranked, ranked_sql

KS = (1, 3, 5, 10)
_AT = ", ".join(f"r{k} AS (SELECT * FROM r10x WHERE rank <= {k}), {per_query_sql(f'r{k}', f'at{k}', k)}" for k in KS)
_HEAD = f"WITH {TOKENS}, {BM25}, {JUDGED}, r10x AS ({ranked_sql('bm25', 10)}), {_AT}"
_KINDS = "ki AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'train' WHEN 4 THEN 'holdout' ELSE 'validation' END AS split, CASE WHEN len(list_distinct(toks)) < 10 THEN 'short' WHEN len(list_distinct(toks)) < 30 THEN 'medium' ELSE 'long' END AS cohort FROM q)"
_ALL_K = "mk AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM m_at{k}" for k in KS) + ")"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, split and cohort (by the number of distinct terms)."""
    n = F.size(F.array_distinct("tokens"))
    split = F.when((F.col(Q) % 5).isin(0, 1), "train").when(F.col(Q) % 5 == 4, "holdout").otherwise("validation")
    return retrieval.items(spark, sf_dir).select(Q, split.alias("split"), F.when(n < 10, "short").when(n < 30, "medium").otherwise("long").alias("cohort"))


@query(
    f"""{_HEAD}, {_KINDS}, {_ALL_K} SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(cohort) = 0 THEN 'cohort' ELSE 'overall' END AS scope, coalesce(split, cohort, 'all') AS value, k, {MEANS}
    FROM mk JOIN ki USING (item_id) GROUP BY GROUPING SETS ((k, split), (k, cohort), (k))"""
)
def metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval metrics at four depths, overall, by split and by cohort."""
    ranked = bm25_ranked(spark, sf_dir, 10)
    rows = E.query_metrics_at(ranked, evaluation.judgments(spark, sf_dir), table(spark, sf_dir, "benchmark"), Q, U, KS)
    return E.scoped_means(rows.join(kinds(spark, sf_dir), Q), {"split": "split", "cohort": "cohort"})


_GROUPS = {"all": "true", "development": "split = 'train'", "validation": "split = 'validation'", "holdout": "split = 'holdout'", "short": "cohort = 'short'", "long": "cohort = 'long'", "unanswerable": "NOT answerable", "answerable": "answerable"}


@query(
    f"""{_HEAD}, {_KINDS}, ab AS ({ORACLES["confidence_abstain"]}), x AS (SELECT m.*, split, cohort, relevant > 0 AS answerable, coalesce(abstain, true) AS abstained FROM m_at5 m JOIN ki USING (item_id) LEFT JOIN ab USING (item_id)),
    g AS ({" UNION ALL ".join(f"SELECT '{n}' AS grp, * FROM x WHERE {c}" for n, c in _GROUPS.items())})
    SELECT grp AS "group", count(*) AS n_queries, round(avg(hit), 6) AS hit_rate, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, sum((hit = 0)::INT)::BIGINT AS zero_hits,
    CASE WHEN count(*) FILTER (WHERE NOT answerable) > 0 THEN round(count(*) FILTER (WHERE NOT answerable AND abstained)::DOUBLE / count(*) FILTER (WHERE NOT answerable), 6) ELSE 1 END AS abstention_accuracy,
    CASE WHEN count(*) FILTER (WHERE answerable) > 0 THEN round(count(*) FILTER (WHERE answerable AND NOT abstained)::DOUBLE / count(*) FILTER (WHERE answerable), 6) ELSE 1 END AS coverage FROM g GROUP BY grp"""
)
def grouped_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight overlapping groups of items with their real means; an item without a result abstains."""
    rows = evaluation.per_query(spark, sf_dir, bm25_ranked(spark, sf_dir)).join(kinds(spark, sf_dir), Q)
    sure = retrieval.confidence_abstain(spark, sf_dir).select(Q, "abstain")
    rows = rows.join(sure, Q, "left").withColumns({"answerable": F.col("relevant") > 0, "abstained": F.coalesce("abstain", F.lit(True))})
    return E.overlapping_groups(rows, {n: F.expr(c) for n, c in _GROUPS.items()})


@query(
    f"""WITH {TOKENS}, {BM25}, {JUDGED}, r AS ({ranked_sql('bm25')}), g AS (SELECT item_id, doc_id, 1 + doc_id % 3 AS grade FROM j),
    b AS (SELECT item_id, sum(grade::DOUBLE / log2(rank + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS rank FROM g) WHERE rank <= 5 GROUP BY item_id),
    got AS (SELECT item_id, sum(grade::DOUBLE / log2(rank + 1)) AS dcg FROM r JOIN g USING (item_id, doc_id) GROUP BY item_id)
    SELECT item_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM b LEFT JOIN got USING (item_id)"""
)
def linear_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG with linear gains; grades are 1 to 3 by the document's number."""
    judged = evaluation.judgments(spark, sf_dir).withColumn("grade", 1 + F.col(U) % 3)
    return E.linear_ndcg(bm25_ranked(spark, sf_dir), judged, Q, U, 5)


_TRUTH = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "number": "[0-9]{7,}"}
_FOUND = {"email": "[a-z0-9.]+@[a-z.]+", "number": "[0-9]{9,}"}
_LABELS = ("email", "number", "phone")
_KEY = [U, "label", "value", "lang"]


def entities(spark: SparkSession, sf_dir: str, patterns: dict[str, str]) -> DataFrame:
    def labelled(label: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

    found = [labelled(k, p) for k, p in patterns.items()]
    return table(spark, sf_dir, "documents").select(U, "lang", F.explode(F.concat(*found)).alias("e")).select(U, "e.label", "e.value", "lang")


def _entity_sql(patterns: dict[str, str]) -> str:
    return " UNION ".join(f"SELECT DISTINCT doc_id, '{k}' AS label, unnest(regexp_extract_all(text, '{p}')) AS value, lang FROM documents" for k, p in patterns.items())


_BOTH = f"""tr AS ({_entity_sql(_TRUTH)}), pr AS ({_entity_sql(_FOUND)}),
both_ AS (SELECT doc_id, label, value, lang, bool_or(t) AS t, bool_or(p) AS p FROM (SELECT *, true AS t, false AS p FROM tr UNION ALL SELECT *, false, true FROM pr) GROUP BY ALL)"""
_RATES = """CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) ELSE 0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN round(2::DOUBLE * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1"""


@query(
    f"""WITH {_BOTH}, g AS (SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'overall' END AS scope, coalesce(label, lang, 'micro') AS value,
      count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM both_ GROUP BY GROUPING SETS ((label), (lang), ())),
    l AS (SELECT 'label' AS scope, v AS value, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES ('email'), ('number'), ('phone')) t(v) LEFT JOIN g ON g.scope = 'label' AND g.value = v),
    s AS (SELECT *, {_RATES} FROM (SELECT * FROM g WHERE scope <> 'label' UNION ALL SELECT * FROM l))
    SELECT * FROM s UNION ALL SELECT 'overall', 'macro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6) FROM s WHERE scope = 'label'"""
)
def entity_metrics_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extraction rule sets compared in all, by label and by language, with macro means over three labels."""
    both = E.compared(entities(spark, sf_dir, _TRUTH), entities(spark, sf_dir, _FOUND), _KEY)
    labels = spark.createDataFrame([(x,) for x in _LABELS], "value string")
    return E.grains(both, {"label": "label", "lang": "lang"}, labels)


@query(
    f"""WITH {_BOTH}, e AS (SELECT *, CASE WHEN t THEN 'false_negative' ELSE 'false_positive' END AS error_type FROM both_ WHERE t <> p), x AS (SELECT e.*, text, instr(text, value) - 1 AS a FROM e JOIN documents USING (doc_id))
    SELECT 'ERR-' || substr(sha256(concat_ws('␟', doc_id, label, value, error_type)), 1, 24) AS error_id, doc_id, label, value, error_type, replace(substr(text, greatest(0, a - 20) + 1, least(length(text), a + length(value) + 20) - greatest(0, a - 20)), chr(10), ' ') AS context FROM x"""
)
def entity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives and negatives with the twenty characters around their first place."""
    both = E.compared(entities(spark, sf_dir, _TRUTH), entities(spark, sf_dir, _FOUND), _KEY)
    rows = E.errors(both).join(table(spark, sf_dir, "documents").select(U, "text"), U)
    start = F.instr(F.col("text"), F.col("value")) - 1
    name = ids.stable_id("ERR", F.col(U), F.col("label"), F.col("value"), F.col("error_type"))
    return rows.select(name.alias("error_id"), U, "label", "value", "error_type", X.context(F.col("text"), start, start + F.length("value"), 20).alias("context"))


@query(
    f"""WITH {_BOTH}, n AS (SELECT count(*) FILTER (WHERE t) AS t, count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE t <> p) AS e FROM both_)
    SELECT 'truth_accounting' AS metric, (SELECT count(*) FROM tr) AS expected, t AS actual, 'passed' AS status FROM n UNION ALL SELECT 'prediction_accounting', (SELECT count(*) FROM pr), p, 'passed' FROM n UNION ALL SELECT 'error_accounting', e, e, 'passed' FROM n"""
)
def evaluation_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = entities(spark, sf_dir, _TRUTH), entities(spark, sf_dir, _FOUND)
    both = E.compared(truth, found, _KEY)
    return E.accounting(both, truth, found, _KEY, E.errors(both))
