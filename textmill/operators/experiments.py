"""Configurations of retrieval experiments, and scores of candidate pairs under all of them at once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators.rank import confidence
from textmill.sources import configuration as C

#: The remediation configurations, as the features that each turns on, in order of complexity.
REMEDIATION = {
    "char_tfidf_v1": ("character",),
    "word_char_hybrid_v1": ("character",),
    "phrase_proximity_bm25_v1": ("phrase", "proximity"),
    "field_aware_bm25_v1": ("entity",),
    "entity_enriched_hybrid_v1": ("synonym", "entity"),
    "pseudo_feedback_bm25_v1": ("synonym", "feedback"),
    "multi_retriever_rrf_v1": ("character", "phrase", "proximity", "synonym", "entity"),
    "advanced_feature_reranked_v1": ("character", "phrase", "proximity", "synonym", "feedback", "entity", "rerank"),
    "diversified_ensemble_v1": ("character", "phrase", "proximity", "synonym", "feedback", "entity", "rerank", "diversify"),
    "abstaining_ensemble_v1": ("character", "phrase", "proximity", "synonym", "feedback", "entity", "rerank", "diversify", "abstain"),
}
FEATURES = ("character", "phrase", "proximity", "synonym", "feedback", "entity", "rerank", "diversify", "abstain")
#: What each feature adds to the lexical coverage (feedback: for each of at most six terms).
ADDED = {"character": 0.22, "phrase": 0.20, "proximity": 0.15, "synonym": 0.20, "feedback": 0.03, "entity": 0.18}
#: Boosts of the reranker for polarity, numbers and the asked kind of unit.
BOOSTS = {"polarity": 0.22, "number": 0.20, "unit_type": 0.12}
#: The retrieval configurations as (strategy, provider, granularity, reranker, candidates, complexity, needs a model).
RETRIEVAL = {
    "bm25_v2": ("bm25", "none", "single_granularity", "none", 10, 1, False),
    "query_expanded_bm25_v1": ("bm25", "none", "single_granularity", "none", 10, 2, False),
    "negation_numeric_bm25_v1": ("bm25", "none", "single_granularity", "metadata_aware", 10, 3, False),
    "cross_granularity_hybrid_v1": ("hybrid", "deterministic_hash", "parallel_granularity", "metadata_aware", 12, 4, False),
    "feature_reranked_hybrid_v1": ("hybrid", "deterministic_hash", "hierarchical", "feature_weighted", 15, 5, False),
    "local_sentence_transformer_hybrid_v1": ("hybrid", "sentence_transformer", "parallel_granularity", "feature_weighted", 15, 6, True),
}
#: Failure types by query category, and what is recommended for each.
FAILURES = {
    "paraphrased": "synonym_gap",
    "abbreviation": "abbreviation_gap",
    "section_alias": "phrase_gap",
    "negation_sensitive": "negation_conflict",
    "numeric_detail": "numeric_conflict",
    "cross_granularity": "granularity_conflict",
    "multi_relevant": "granularity_conflict",
    "unanswerable": "judgment_ambiguity",
}
REMEDIES = {
    "synonym_gap": "synonym graph and character hybrid retrieval",
    "abbreviation_gap": "abbreviation expansion and entity features",
    "phrase_gap": "phrase and proximity scoring",
    "negation_conflict": "negation-aware reranking",
    "numeric_conflict": "numeric compatibility scoring",
    "granularity_conflict": "field-aware retrieval and diversification",
    "judgment_ambiguity": "adjudication and abstention",
}
OTHER_FAILURE, OTHER_REMEDY = "lexical_gap", "character and lexical ensemble"
#: The remediation gates, (group, metric, comparator, threshold).
GATES = (
    ("validation", "hit_rate", ">=", 0.70),
    ("validation", "recall", ">=", 0.60),
    ("validation", "ndcg", ">=", 0.50),
    ("short", "hit_rate", ">=", 0.60),
    ("long", "hit_rate", ">=", 0.50),
    ("validation", "zero_hits", "<=", 12.0),
    ("unanswerable", "abstention_accuracy", ">=", 0.80),
    ("answerable", "coverage", ">=", 0.95),
)


def configurations(spark: SparkSession, path: str | None = None) -> DataFrame:
    """configuration_id, complexity and a boolean for each feature; of the registry at ``path`` if that file exists."""
    if path is not None and Path(path).exists():
        return C.remediation_features(C.read_registry(spark, path, C.REMEDIATION, "configurations"))
    rows = [(name, i, *[f in on for f in FEATURES]) for i, (name, on) in enumerate(REMEDIATION.items(), start=1)]
    return spark.createDataFrame(rows, "configuration_id string, complexity int, " + ", ".join(f"{f} boolean" for f in FEATURES))


def retrieval_configurations(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The active configurations; of the registry at ``path`` if that file exists."""
    if path is not None and Path(path).exists():
        return C.retrieval_settings(C.read_registry(spark, path, C.RETRIEVAL, "configurations"))
    rows = [(name, *v) for name, v in RETRIEVAL.items()]
    return spark.createDataFrame(rows, "configuration_id string, strategy string, provider string, granularity string, reranker string, candidates int, complexity int, needs_model boolean")


def boost(category: Column, text: Column, shares_terms: Column, same_type: Column) -> Column:
    """The reranker's boost: polarity words for negation queries, common terms for numeric ones, the asked kind of unit."""
    lowered = F.lower(text)
    polar = F.contains(lowered, F.lit("no ")) | F.contains(lowered, F.lit("without")) | F.contains(lowered, F.lit("negative"))
    part = lambda condition, name: F.when(condition, BOOSTS[name]).otherwise(0.0)
    return part((category == "negation_sensitive") & polar, "polarity") + part((category == "numeric_detail") & shares_terms, "number") + part(same_type, "unit_type")


def scored(pairs: DataFrame, configs: DataFrame) -> DataFrame:
    """Every pair's score under every configuration, which is a column: pairs are read once and their features made once.

    ``pairs`` has lexical and the features as numbers (synonym and entity 0 or 1, feedback the number of terms) and boost.
    """
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(configs.columns, r, strict=True)]) for r in configs.collect()]  # the parameter's few rows
    each = pairs.withColumn("_c", F.explode(F.array(*rows)))
    score = F.col("lexical") + sum((F.when(F.col(f"_c.{f}"), w * F.col(f)).otherwise(0.0) for f, w in ADDED.items()), F.lit(0.0))
    score = score + F.when(F.col("_c.rerank"), F.col("boost")).otherwise(0.0)
    return each.withColumn("score", F.round(score, 8)).withColumns({"configuration_id": F.col("_c.configuration_id"), "complexity": F.col("_c.complexity"), "diversify": F.col("_c.diversify"), "abstain": F.col("_c.abstain")}).drop("_c")


def ranked(rows: DataFrame, query: str, unit: str, k: int, group: str | None = None, least_confidence: float = 0.0) -> DataFrame:
    """The best k of each query under each configuration, with rank and abstained.

    Where a configuration diversifies, the first unit of each ``group`` keeps its place and the others follow. Where it
    abstains, a query whose margin between the first two scores gives less than ``least_confidence`` is marked.
    """
    w = Window.partitionBy("configuration_id", query)
    placed = rows.withColumn("_place", F.row_number().over(w.orderBy(F.desc("score"), unit)))
    later = F.lit(False)
    if group is not None:
        later = F.col("diversify") & (F.row_number().over(Window.partitionBy("configuration_id", query, group).orderBy("_place")) > 1)
    first, second = F.max("score").over(w), F.coalesce(F.max(F.when(F.col("_place") == 2, F.col("score"))).over(w), F.lit(0.0))
    margin = F.when(F.col("_first") > 0, (F.col("_first") - F.col("_second")) / F.col("_first")).otherwise(F.lit(0.0))
    known = placed.withColumns({"_later": later, "_first": first, "_second": second})
    known = known.withColumn("abstained", F.col("abstain") & (F.round(confidence(margin, F.lit(1.0)), 6) < least_confidence))
    return known.withColumn("rank", F.row_number().over(w.orderBy("_later", "_place")).cast("long")).where(F.col("rank") <= k).drop("_place", "_later", "_first", "_second")


def leaderboard(means: DataFrame) -> DataFrame:
    """Configurations by nDCG, hit rate of negation queries, fewer zero hits, complexity and name; few rows."""
    w = Window.orderBy(F.desc("ndcg"), F.desc("negation_hit"), "zero_hits", "complexity", "configuration_id")
    return means.withColumn("place", F.row_number().over(w).cast("long"))


def _mapped(column: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column), F.lit(other))


def failure_type(category: Column) -> Column:
    return _mapped(category, FAILURES, OTHER_FAILURE)


def remedy(failure: Column) -> Column:
    return _mapped(failure, REMEDIES, OTHER_REMEDY)


def root_cause(category: Column, failure: Column) -> Column:
    return F.when(failure == "successful", "relevant unit retrieved within top five").otherwise(F.concat(failure, F.lit(" observed for "), category, F.lit(" query")))


def gate_rows(groups: DataFrame) -> DataFrame:
    """gate, observed, passed: the fixed gates joined to the metric of their group (few rows); a missing group fails."""
    spark = groups.sparkSession
    gates = spark.createDataFrame([(g, m, op, t) for g, m, op, t in GATES], "group string, metric string, comparator string, threshold double")
    names = sorted({m for _, m, _, _ in GATES})
    long = groups.select("group", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("observed")) for n in names])).alias("m")).select("group", "m.*")
    joined = gates.join(long, ["group", "metric"], "left")
    passed = F.when(F.col("comparator") == ">=", F.col("observed") >= F.col("threshold")).otherwise(F.col("observed") <= F.col("threshold"))
    return joined.select(F.concat_ws("_", "group", "metric").alias("gate"), "observed", "threshold", F.coalesce(passed, F.lit(False)).alias("passed"))


def metric_cell(groups: DataFrame, group: str, metric: str) -> float | None:
    """One metric of one group."""
    row = groups.where(F.col("group") == group).select(F.col(metric).cast("double").alias("x")).first()
    return None if row is None else row["x"]


def audited(queries: DataFrame, judgments: DataFrame, query: str) -> DataFrame:
    """query, category, relevant, audit_status and proposed_action of every query."""
    counts = judgments.groupBy(query).agg(F.count("*").alias("relevant"))
    status = F.when(F.col("category") == "unanswerable", "unanswerable_documented").otherwise("accepted")
    return queries.join(counts, query, "left").select(query, "category", F.coalesce("relevant", F.lit(0)).alias("relevant"), status.alias("audit_status"), F.lit("retain").alias("proposed_action"))


def upgraded(queries: DataFrame, version: str, adjudications: DataFrame, query: str) -> DataFrame:
    """A new version of queries; those that an adjudication (query, decision) retires are left out, the old table stays."""
    retired = adjudications.where("decision = 'retire'").select(query)
    return queries.join(retired, query, "left_anti").withColumn("version", F.lit(version))
