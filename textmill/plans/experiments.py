"""Experiments with every configuration at once, failure analysis and remediation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import answers as A
from textmill.operators import evaluate as E
from textmill.operators import experiments as P
from textmill.operators import features as QF
from textmill.operators import grams as G
from textmill.operators import rank as R
from textmill.plans import evaluation, extended, grades, retrieval, synthesis
from textmill.plans.evaluation import JUDGED
from textmill.plans.registry import ORACLES, query, table
from textmill.plans.retrieval import BM25, BLOCKED, Q, TOKENS, U, ranked_sql

K = 3


def _values(rows) -> str:
    plain = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(plain(v) for v in r) + ")" for r in rows)


_CONFIGS = f"cf(configuration_id, complexity, {', '.join(P.FEATURES)}) AS (VALUES {_values([(n, i, *[f in on for f in P.FEATURES]) for i, (n, on) in enumerate(P.REMEDIATION.items(), start=1)])})"


@query(f"WITH {_CONFIGS} SELECT * FROM cf")
def configuration_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten remediation configurations."""
    return P.configurations(spark)


@query(f"SELECT * FROM (VALUES {_values([(n, *v) for n, v in P.RETRIEVAL.items()])}) t(configuration_id, strategy, provider, granularity, reranker, candidates, complexity, needs_model)")
def retrieval_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six retrieval configurations."""
    return P.retrieval_configurations(spark)


_KINDS = ("direct", *P.FAILURES)
_KIND = f"([{', '.join(repr(k) for k in _KINDS)}])[1 + item_id % {len(_KINDS)}]"


def category():
    return F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.pmod(F.col(Q), F.lit(len(_KINDS))) + 1).cast("int"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of each item's candidates: the best five of the whole corpus by BM25, and by character grams.

    Nothing in them reads a judgment.
    """
    langs = table(spark, sf_dir, "documents").select(U, "lang", "source")
    candidates = retrieval.bm25_ranked(spark, sf_dir).select(Q, U).union(retrieval.char_ranked(spark, sf_dir).select(Q, U)).distinct()
    p = retrieval.with_texts(spark, sf_dir, candidates).join(langs, U)
    q, d = F.array_distinct("q_toks"), F.array_distinct("d_toks")
    positions = F.filter(F.transform("q_toks", lambda t: F.array_position("d_toks", t)), lambda i: i > 0)
    fresh = F.filter(d, lambda t: ~F.array_contains("q_toks", t) & ~t.rlike("^[0-9]+$") & ~t.isin(*BLOCKED))
    rows = p.select(
        Q, U, "d_text", "source",
        F.round(F.size(F.array_intersect(q, d)) / F.size(q), 6).alias("lexical"),
        F.round(G.pair_jaccard(F.col("q_text"), F.col("d_text")), 6).alias("character"),
        R.phrase_share(X.ngrams(F.col("q_toks"), 2), F.lower("d_text")).alias("phrase"),
        positions.alias("_p"),
        F.arrays_overlap(QF.graph_terms(F.col("q_text"), extended._GRAPH), F.col("d_toks")).cast("int").alias("synonym"),
        F.least(F.lit(6), F.size(fresh)).alias("feedback"),
        ((F.col(Q) % 3 == 1) & (F.col("lang") == "en")).cast("int").alias("entity"),
    )
    boost = P.boost(category(), F.col("d_text"), F.col("lexical") > 0, F.lit(True))
    return rows.withColumns({"proximity": R.proximity(F.col("_p")), "boost": boost, "synonym": F.coalesce("synonym", F.lit(0))}).drop("_p", "d_text")


_EDGES = ", ".join(f"('{k}', '{e}')" for k, v in extended._GRAPH.items() for e in v)
_FEATURES = f"""{TOKENS}, {BM25}, {retrieval.CHARS}, {_CONFIGS}, ge(term, added) AS (VALUES {_EDGES}), sy AS (SELECT item_id, list(DISTINCT added) AS adds FROM qt JOIN ge USING (term) GROUP BY item_id),
r AS (SELECT item_id, doc_id FROM ({ranked_sql('bm25')}) UNION SELECT item_id, doc_id FROM ({ranked_sql('chars')})),
p AS (SELECT r.item_id, r.doc_id, q.text AS q_text, d.text AS d_text, q.toks AS q_toks, d.toks AS d_toks FROM r JOIN q USING (item_id) JOIN d USING (doc_id)),
pb AS (SELECT item_id, doc_id, lower(d_text) AS t, list_transform(range(1, len(q_toks)), lambda i: q_toks[i] || ' ' || q_toks[i + 1]) AS bg, list_filter(list_transform(q_toks, lambda t: list_position(d_toks, t)), lambda i: i > 0) AS pos FROM p),
px AS (SELECT item_id, doc_id, CASE WHEN len(bg) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(bg, lambda g: contains(t, g)))::DOUBLE / len(bg), 6) END AS phrase_score,
  CASE WHEN len(pos) < 2 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, len(pos)::DOUBLE / (list_max(pos) - list_min(pos) + 1)), 6) END AS proximity FROM pb),
ft AS (SELECT p.item_id, p.doc_id, source, round(len(list_intersect(list_distinct(q_toks), list_distinct(d_toks)))::DOUBLE / len(list_distinct(q_toks)), 6) AS lexical, coalesce(chars.score, 0) AS c, phrase_score AS f, proximity AS x,
  CASE WHEN list_has_any(d_toks, coalesce(adds, [])) THEN 1 ELSE 0 END AS s, least(6, len(list_filter(list_distinct(d_toks), lambda t: NOT list_contains(q_toks, t) AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({', '.join(repr(b) for b in BLOCKED)})))) AS fb,
  CASE WHEN item_id % 3 = 1 AND lang = 'en' THEN 1 ELSE 0 END AS e, {_KIND} AS kind, lower(d_text) AS lt FROM p JOIN px USING (item_id, doc_id) LEFT JOIN chars USING (item_id, doc_id) LEFT JOIN sy USING (item_id) JOIN documents USING (doc_id)),
bo AS (SELECT *, CASE WHEN kind = 'negation_sensitive' AND (contains(lt, 'no ') OR contains(lt, 'without') OR contains(lt, 'negative')) THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN kind = 'numeric_detail' AND lexical > 0 THEN 0.20::DOUBLE ELSE 0 END + 0.12::DOUBLE AS boost FROM ft),
sx AS (SELECT configuration_id, complexity, item_id, doc_id, kind, source, diversify, abstain, round(lexical + (CASE WHEN "character" THEN 0.22::DOUBLE * c ELSE 0 END + CASE WHEN phrase THEN 0.20::DOUBLE * f ELSE 0 END + CASE WHEN proximity THEN 0.15::DOUBLE * x ELSE 0 END + CASE WHEN synonym THEN 0.20::DOUBLE * s ELSE 0 END
  + CASE WHEN feedback THEN 0.03::DOUBLE * fb ELSE 0 END + CASE WHEN entity THEN 0.18::DOUBLE * e ELSE 0 END) + CASE WHEN rerank THEN boost ELSE 0 END, 8) AS score FROM bo, cf),
so AS (SELECT *, row_number() OVER (PARTITION BY configuration_id, item_id ORDER BY score DESC, doc_id) AS place FROM sx),
sd AS (SELECT *, diversify AND row_number() OVER (PARTITION BY configuration_id, item_id, source ORDER BY place) > 1 AS later, max(score) OVER w AS s1, coalesce(max(score) FILTER (WHERE place = 2) OVER w, 0) AS s2 FROM so WINDOW w AS (PARTITION BY configuration_id, item_id)),
sa AS (SELECT *, abstain AND round(least(1.0::DOUBLE, 0.25::DOUBLE + greatest(0.0::DOUBLE, CASE WHEN s1 > 0 THEN (s1 - s2) / s1 ELSE 0 END) + 0.45::DOUBLE / 3), 6) < {A.CONFIDENCE} AS abstained FROM sd),
ra AS (SELECT *, row_number() OVER (PARTITION BY configuration_id, item_id ORDER BY later, place) AS rank FROM sa QUALIFY rank <= {K}),
rk AS (SELECT * FROM ra WHERE NOT abstained)"""


def every_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ranked(P.scored(features(spark, sf_dir), P.configurations(spark)), Q, U, K, "source", A.CONFIDENCE)


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks that count: a configuration that abstains has none."""
    return every_rank(spark, sf_dir).where("NOT abstained")


@query(f"WITH {_FEATURES} SELECT configuration_id, item_id, doc_id, score, rank, abstained FROM ra")
def experiment_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three of each item's candidates under every configuration, diversified and abstained from where it says so."""
    return every_rank(spark, sf_dir).select("configuration_id", Q, U, "score", "rank", "abstained")


_BOARD = f"""{_FEATURES}, {JUDGED}, idl AS (SELECT item_id, count(*) AS relevant, sum(CASE WHEN r <= {K} THEN 1.0::DOUBLE / log2(r + 1) ELSE 0 END) AS ideal FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS r FROM j) GROUP BY item_id),
got AS (SELECT configuration_id, item_id, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg, count(*) AS hits FROM rk JOIN j USING (item_id, doc_id) GROUP BY configuration_id, item_id),
pq AS (SELECT configuration_id, complexity, item_id, {_KIND} AS kind, coalesce(hits, 0) > 0 AS hit, CASE WHEN ideal > 0 THEN round(coalesce(dcg, 0) / ideal, 6) ELSE 0 END AS ndcg FROM cf CROSS JOIN benchmark LEFT JOIN idl USING (item_id) LEFT JOIN got USING (configuration_id, item_id)),
bd AS (SELECT configuration_id, complexity, round(avg(ndcg), 6) AS ndcg, coalesce(round(avg(hit::INT) FILTER (WHERE kind = 'negation_sensitive'), 6), 0) AS negation_hit, count(*) FILTER (WHERE NOT hit) AS zero_hits FROM pq GROUP BY ALL)"""


@query(f"WITH {_BOARD} SELECT *, row_number() OVER (ORDER BY ndcg DESC, negation_hit DESC, zero_hits, complexity, configuration_id) AS place FROM bd")
def experiment_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All configurations ordered by nDCG, negation hits, zero hits and complexity, from one scored table."""
    configs = P.configurations(spark).select("configuration_id", "complexity")
    key = F.concat_ws("|", "configuration_id", F.col(Q).cast("string"))
    items = table(spark, sf_dir, "benchmark").select(Q)
    ids = list(P.REMEDIATION)
    each = lambda df: df.withColumn("configuration_id", F.explode(F.array(*[F.lit(i) for i in ids]))).withColumn("_k", key)
    rows = E.query_metrics(experiment(spark, sf_dir).withColumn("_k", key), each(evaluation.judgments(spark, sf_dir)), each(items), "_k", U, K)
    named = each(items).select("_k", "configuration_id", category().alias("category")).join(rows, "_k")
    means = named.groupBy("configuration_id").agg(
        F.round(F.avg("ndcg"), 6).alias("ndcg"), F.coalesce(F.round(F.avg(F.when(F.col("category") == "negation_sensitive", F.col("hit"))), 6), F.lit(0.0)).alias("negation_hit"), F.count_if(F.col("hit") == 0).alias("zero_hits")
    )
    return P.leaderboard(means.join(configs, "configuration_id").select("configuration_id", "complexity", "ndcg", "negation_hit", "zero_hits"))


_MAP = lambda t, other: "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + f" ELSE '{other}' END"
_FAILED = f"""{_BOARD}, fl AS (SELECT item_id, kind, hit, CASE WHEN hit THEN 'successful' ELSE {_MAP(P.FAILURES, P.OTHER_FAILURE).format('kind')} END AS failure FROM pq WHERE configuration_id = 'char_tfidf_v1')"""


@query(f"WITH {_FAILED} SELECT item_id, kind AS category, failure AS failure_type, CASE WHEN hit THEN 'relevant unit retrieved within top five' ELSE failure || ' observed for ' || kind || ' query' END AS root_cause, {_MAP(P.REMEDIES, P.OTHER_REMEDY).format('failure')} AS remediation FROM fl")
def failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every item under the first configuration, with the type of failure, its cause and a remedy."""
    first = experiment(spark, sf_dir).where("configuration_id = 'char_tfidf_v1'")
    rows = E.query_metrics(first, evaluation.judgments(spark, sf_dir), table(spark, sf_dir, "benchmark"), Q, U, K)
    named = rows.select(Q, category().alias("category"), (F.col("hit") > 0).alias("_hit"))
    named = named.withColumn("failure_type", F.when(F.col("_hit"), "successful").otherwise(P.failure_type(F.col("category"))))
    return named.select(Q, "category", "failure_type", P.root_cause(F.col("category"), F.col("failure_type")).alias("root_cause"), P.remedy(F.col("failure_type")).alias("remediation"))


def _gates_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{g}_{m}' AS gate, (SELECT {m}::DOUBLE FROM go WHERE \"group\" = '{g}') AS observed, {t}::DOUBLE AS threshold, coalesce((SELECT {m} {op} {t} FROM go WHERE \"group\" = '{g}'), false) AS passed" for g, m, op, t in P.GATES)
    return f"WITH go AS ({ORACLES['grouped_outcomes']}) {rows}"


@query(_gates_sql())
def remediation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight gates over the metrics of overlapping groups."""
    return P.gate_rows(grades.grouped_outcomes(spark, sf_dir))


@query(f"WITH g AS ({_gates_sql()}) SELECT count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, CASE WHEN count(*) FILTER (WHERE NOT passed) = 0 THEN 'approved' WHEN count(*) FILTER (WHERE passed) >= 5 THEN 'conditional' ELSE 'not_approved' END AS decision FROM g")
def remediation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.decision(remediation_gates(spark, sf_dir))


_BENCHED = f"WITH {synthesis._BENCH}, jd AS ({ORACLES['generated_judgments']})"


@query(f"{_BENCHED} SELECT query_id, category, count(unit_id) AS relevant, CASE WHEN category = 'unanswerable' THEN 'unanswerable_documented' ELSE 'accepted' END AS audit_status, 'retain' AS proposed_action FROM (SELECT bj.query_id, category, jd.unit_id FROM bj LEFT JOIN jd USING (query_id)) GROUP BY query_id, category")
def judgment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.audited(synthesis.generated_queries(spark, sf_dir), synthesis.generated_judgments(spark, sf_dir), "query_id")


@query(f"WITH {synthesis._BENCH} SELECT query_id, category, '2.1.0' AS version FROM bj WHERE number % 9 <> 0")
def benchmark_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version of the generated queries without those that an adjudication retires (every ninth)."""
    queries = synthesis.generated_queries(spark, sf_dir)
    retired = queries.where("number % 9 = 0").select("query_id", F.lit("retire").alias("decision"))
    return P.upgraded(queries, "2.1.0", retired, "query_id").select("query_id", "category", "version")
