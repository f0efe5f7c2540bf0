"""Evaluation queries: verbatim containment is relevance; rules over documents are classified against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators import evaluate as E
from textmill.operators import rank as R
from textmill.plans.registry import query, table
from textmill.plans.retrieval import BM25, Q, TFIDF, TOKENS, U, asked, bm25_ranked, items, near, ranked_sql, run_of, tfidf_ranked

#: The retrieval gates.
GATES = {"hit": (">=", 0.70), "recall": (">=", 0.60), "ndcg": (">=", 0.50), "zero_hits": ("<=", 12.0), "reciprocal_rank": (">=", 0.40)}


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, doc_id, grade 1 where the document holds the item's text, white space folded."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", " ")
    docs, texts = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = run_of(asked(spark, sf_dir), "judged", lambda: R.holding(near(spark, sf_dir), docs, texts, Q, U, squeeze).repartition(8))
    return found.select(Q, U, F.lit(1).alias("grade"))


JUDGED = r"""
j AS (SELECT item_id, doc_id, 1 AS grade FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\s+', ' ', 'g'), regexp_replace(b.text, '\s+', ' ', 'g')))
"""


def per_query_sql(run: str, name: str, k: int = 5) -> str:
    """CTEs that give the metrics of each item for one run."""
    return f"""
g_{name} AS (SELECT r.*, coalesce(grade, 0) AS grade, sum(coalesce(grade, 0)) OVER (PARTITION BY r.item_id ORDER BY rank) AS so_far FROM {run} r LEFT JOIN j USING (item_id, doc_id)),
a_{name} AS (SELECT item_id, sum(grade) AS hits, min(rank) FILTER (WHERE grade > 0) AS first, sum(CASE WHEN grade > 0 THEN so_far::DOUBLE / rank ELSE 0 END) AS precs, sum(grade::DOUBLE / log2(rank + 1)) AS dcg FROM g_{name} GROUP BY item_id),
i_{name} AS (SELECT item_id, count(*) AS relevant, sum(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS ideal
             FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM j) GROUP BY item_id),
m_{name} AS (SELECT item_id, coalesce(relevant, 0) AS relevant, round(coalesce(hits, 0)::DOUBLE / {k}, 6) AS "precision", CASE WHEN relevant > 0 THEN round(coalesce(hits, 0)::DOUBLE / relevant, 6) ELSE 0 END AS recall,
             (coalesce(hits, 0) > 0)::INT::DOUBLE AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank,
             CASE WHEN relevant > 0 THEN round(coalesce(precs, 0) / relevant, 6) ELSE 0 END AS average_precision, CASE WHEN ideal > 0 THEN round(coalesce(dcg, 0) / ideal, 6) ELSE 0 END AS ndcg
             FROM benchmark LEFT JOIN a_{name} USING (item_id) LEFT JOIN i_{name} USING (item_id))"""


MEANS = """count(*) AS n_queries, sum((hit = 0)::INT)::BIGINT AS zero_hits, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit,
round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(average_precision), 6) AS average_precision, round(avg(ndcg), 6) AS ndcg"""
HEAD = f"WITH {TOKENS}, {BM25}, {TFIDF}, {JUDGED}, ra AS ({ranked_sql('bm25')}), rb AS ({ranked_sql('tfidf')}), {per_query_sql('ra', 'a')}, {per_query_sql('rb', 'b')}"


def per_query(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    return E.query_metrics(ranked, judgments(spark, sf_dir), table(spark, sf_dir, "benchmark"), Q, U, 5)


@query(f"{HEAD} SELECT * FROM m_a")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_query(spark, sf_dir, bm25_ranked(spark, sf_dir))


@query(f"{HEAD} SELECT CASE WHEN relevant > 0 THEN 'answerable' ELSE 'unanswerable' END AS category, {MEANS} FROM m_a GROUP BY ALL")
def retrieval_metrics_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_query(spark, sf_dir, bm25_ranked(spark, sf_dir)).withColumn("category", F.when(F.col("relevant") > 0, "answerable").otherwise("unanswerable"))
    return E.mean_metrics(rows, "category")


@query(f"{HEAD} SELECT m.item_id, relevant, t.doc_id AS top_doc, (SELECT min(doc_id) FROM j WHERE j.item_id = m.item_id) AS expected_doc FROM m_a m LEFT JOIN ra t ON t.item_id = m.item_id AND t.rank = 1 WHERE relevant > 0 AND reciprocal_rank < 1")
def retrieval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answerable items whose first document is not a relevant one, with that document and the first expected one."""
    ranked = bm25_ranked(spark, sf_dir)
    missed = per_query(spark, sf_dir, ranked).where("relevant > 0 AND reciprocal_rank < 1").select(Q, "relevant")
    top = ranked.where("rank = 1").select(Q, F.col(U).alias("top_doc"))
    expected = judgments(spark, sf_dir).groupBy(Q).agg(F.min(U).alias("expected_doc"))
    return missed.join(top, Q, "left").join(expected, Q, "left")


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cosine = tfidf_ranked(spark, sf_dir)  # first: its index serves both, with one pass over the texts
    a = E.mean_metrics(per_query(spark, sf_dir, bm25_ranked(spark, sf_dir))).withColumn("configuration", F.lit("bm25"))
    b = E.mean_metrics(per_query(spark, sf_dir, cosine)).withColumn("configuration", F.lit("tfidf"))
    return a.unionByName(b)


BOARD = f"{HEAD}, board AS (SELECT 'bm25' AS configuration, {MEANS} FROM m_a UNION ALL SELECT 'tfidf', {MEANS} FROM m_b)"


@query(f"{BOARD} SELECT *, row_number() OVER (ORDER BY ndcg DESC, zero_hits, configuration) AS place FROM board")
def config_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations by nDCG, then fewer zero hits, then name; one row each."""
    order = Window.orderBy(F.desc("ndcg"), "zero_hits", "configuration")  # a row for each configuration, so one task may hold them
    return leaderboard(spark, sf_dir).withColumn("place", F.row_number().over(order).cast("long"))


_GATES_SQL = " UNION ALL ".join(f"SELECT configuration, '{m}' AS metric, {m}::DOUBLE AS observed, {t}::DOUBLE AS threshold, {m} {op} {t} AS passed FROM board" for m, (op, t) in GATES.items())


@query(f"{BOARD} {_GATES_SQL}")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gates(leaderboard(spark, sf_dir), GATES)


@query(f"{BOARD}, g AS ({_GATES_SQL}), c AS (SELECT configuration, sum(passed::INT)::BIGINT AS passed, sum((NOT passed)::INT)::BIGINT AS failed FROM g GROUP BY configuration) SELECT *, CASE WHEN failed = 0 THEN 'approved' WHEN passed >= 5 THEN 'conditional' ELSE 'not_approved' END AS decision FROM c")
def approval_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.decision(E.gates(leaderboard(spark, sf_dir), GATES), "configuration")


@query(
    f"""{HEAD} SELECT CASE WHEN relevant = 0 THEN 'unanswerable' WHEN hit = 0 THEN 'missed' WHEN reciprocal_rank < 1 THEN 'ranked_low' ELSE 'first' END AS outcome,
    CASE WHEN q_terms < 10 THEN 'short' WHEN q_terms < 30 THEN 'medium' ELSE 'long' END AS cohort, count(*) AS n FROM m_a JOIN (SELECT item_id, len(list_distinct(toks)) AS q_terms FROM q) USING (item_id) GROUP BY ALL"""
)
def failure_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = items(spark, sf_dir).select(Q, F.size(F.array_distinct("tokens")).alias("n_terms"))
    rows = per_query(spark, sf_dir, bm25_ranked(spark, sf_dir)).join(sizes, Q)
    outcome = F.when(F.col("relevant") == 0, "unanswerable").when(F.col("hit") == 0, "missed").when(F.col("reciprocal_rank") < 1, "ranked_low").otherwise("first")
    cohort = F.when(F.col("n_terms") < 10, "short").when(F.col("n_terms") < 30, "medium").otherwise("long")
    return rows.groupBy(outcome.alias("outcome"), cohort.alias("cohort")).agg(F.count("*").alias("n"))


_PREDICTED = "CASE WHEN length(regexp_replace(text, '[^#*$%&|<>!]', '', 'g')) * 50 > length(text) THEN 'low' WHEN length(text) < 5 THEN NULL ELSE 'high' END"
_LABELLED = f"x AS (SELECT CASE quality WHEN 1 THEN 'high' ELSE 'low' END AS actual, coalesce({_PREDICTED}, 'missing') AS predicted FROM labels JOIN documents USING (doc_id)), cm AS (SELECT actual, predicted, count(*) AS n FROM x GROUP BY ALL)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a rule on the share of symbols."""
    symbols = F.length(F.regexp_replace("text", "[^#*$%&|<>!]", ""))
    rule = F.when(symbols * 50 > F.length("text"), "low").when(F.length("text") < 5, F.lit(None)).otherwise("high")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select(U, "text"), U)
    return E.confusion(rows.select(F.when(F.col("quality") == 1, "high").otherwise("low").alias("t"), rule.alias("p")), "t", "p")


@query(f"WITH {_LABELLED} SELECT * FROM cm")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)


_OVR = """s AS (SELECT actual AS label, n, 'a' AS side, actual = predicted AS same FROM cm UNION ALL SELECT predicted, n, 'p', actual = predicted FROM cm),
c AS (SELECT label, coalesce(sum(n) FILTER (WHERE side = 'a' AND same), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE side = 'p' AND NOT same), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (WHERE side = 'a' AND NOT same), 0)::BIGINT AS fn FROM s GROUP BY label)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) ELSE 0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN round(2::DOUBLE * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM c"""


@query(f"WITH {_LABELLED}, {_OVR}")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.one_vs_rest(_labelled(spark, sf_dir))


@query(
    r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS value, 'email' AS label FROM documents
      UNION SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{7,}')), 'number' FROM documents),
    p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z.]+')) AS value, 'email' AS label FROM documents
      UNION SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{9,}')), 'number' FROM documents),
    b AS (SELECT doc_id, label, value, max(t) AS t, max(p) AS p FROM (SELECT *, 1 AS t, 0 AS p FROM t UNION ALL SELECT doc_id, value, label, 0, 1 FROM p) GROUP BY ALL),
    c AS (SELECT label, sum(t * p)::BIGINT AS tp, sum((1 - t) * p)::BIGINT AS fp, sum(t * (1 - p))::BIGINT AS fn FROM b GROUP BY label)
    SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) ELSE 0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN round(2::DOUBLE * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM c"""
)
def entity_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extraction rule sets compared as sets of (document, label, value)."""
    docs = table(spark, sf_dir, "documents")

    def spans(rules: dict[str, str]) -> DataFrame:
        def labelled(label: str, pattern: str):
            return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

        found = [labelled(k, p) for k, p in rules.items()]
        return docs.select(U, F.explode(F.concat(*found)).alias("e")).select(U, "e.label", "e.value")

    truth = spans({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "number": "[0-9]{7,}"})
    predicted = spans({"email": "[a-z0-9.]+@[a-z.]+", "number": "[0-9]{9,}"})
    return E.set_metrics(truth, predicted, [U, "label", "value"], "label")
