"""Evaluation: retrieval metrics, set metrics, confusion matrices, gates and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import ratio


def graded(ranked: DataFrame, judgments: DataFrame, query: str, unit: str) -> DataFrame:
    """Ranked rows with the judged grade, 0 where there is none."""
    return ranked.join(judgments.select(query, unit, "grade"), [query, unit], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def query_metrics(ranked: DataFrame, judgments: DataFrame, queries: DataFrame, query: str, unit: str, k: int) -> DataFrame:
    """Precision, recall, hit, reciprocal rank, average precision and nDCG at k of every query, also those without judgments.

    Gains are 2 ** grade - 1, discounts log2(rank + 1); the ideal order is that of the judgments, cut at k.
    """
    rows = graded(ranked.where(F.col("rank") <= k), judgments, query, unit)
    w = Window.partitionBy(query).orderBy("rank")
    seen = rows.withColumn("_r", (F.col("grade") > 0).cast("int")).withColumn("_so_far", F.sum("_r").over(w))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    got = seen.groupBy(query).agg(
        F.sum("_r").alias("_hits"),
        F.min(F.when(F.col("_r") == 1, F.col("rank"))).alias("_first"),
        F.sum(F.when(F.col("_r") == 1, F.col("_so_far") / F.col("rank")).otherwise(0.0)).alias("_precisions"),
        F.sum(gain).alias("_dcg"),
    )
    best = judgments.where("grade > 0").withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), unit)))
    ideal = best.groupBy(query).agg(F.count("*").alias("_relevant"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("_ideal"))
    all_ = queries.select(query).join(ideal, query, "left").join(got, query, "left").fillna(0, ["_relevant", "_hits"]).fillna(0.0, ["_precisions", "_dcg", "_ideal"])
    return all_.select(
        query,
        F.col("_relevant").alias("relevant"),
        F.round(F.col("_hits") / k, 6).alias("precision"),
        ratio(F.col("_hits"), F.col("_relevant")).alias("recall"),
        (F.col("_hits") > 0).cast("double").alias("hit"),
        F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        ratio(F.col("_precisions"), F.col("_relevant")).alias("average_precision"),
        ratio(F.col("_dcg"), F.col("_ideal")).alias("ndcg"),
    )


def query_metrics_at(ranked: DataFrame, judgments: DataFrame, queries: DataFrame, query: str, unit: str, ks: tuple[int, ...]) -> DataFrame:
    """``query_metrics`` for several k from one pass: a row for each query and k."""
    each = lambda df: df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    w = Window.partitionBy(query).orderBy("rank")
    seen = graded(ranked, judgments, query, unit).withColumn("_r", (F.col("grade") > 0).cast("int")).withColumn("_so_far", F.sum("_r").over(w))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    got = each(seen).where("rank <= k").groupBy(query, "k").agg(
        F.sum("_r").alias("_hits"),
        F.min(F.when(F.col("_r") == 1, F.col("rank"))).alias("_first"),
        F.sum(F.when(F.col("_r") == 1, F.col("_so_far") / F.col("rank")).otherwise(0.0)).alias("_precisions"),
        F.sum(gain).alias("_dcg"),
    )
    best = judgments.where("grade > 0").withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), unit)))
    ideal = each(best).groupBy(query, "k").agg(F.count("*").alias("_relevant"), F.sum(F.when(F.col("rank") <= F.col("k"), gain).otherwise(0.0)).alias("_ideal"))
    rows = each(queries.select(query)).join(ideal, [query, "k"], "left").join(got, [query, "k"], "left").fillna(0, ["_relevant", "_hits"]).fillna(0.0, ["_precisions", "_dcg", "_ideal"])
    return rows.select(
        query,
        "k",
        F.col("_relevant").alias("relevant"),
        F.round(F.col("_hits") / F.col("k"), 6).alias("precision"),
        ratio(F.col("_hits"), F.col("_relevant")).alias("recall"),
        (F.col("_hits") > 0).cast("double").alias("hit"),
        F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        ratio(F.col("_precisions"), F.col("_relevant")).alias("average_precision"),
        ratio(F.col("_dcg"), F.col("_ideal")).alias("ndcg"),
    )


def scoped_means(per_query: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """scope, value, k and means of metrics: overall and by each scope's column, as grouping sets of one pass."""
    columns = list(scopes.values())
    sets = per_query.groupingSets([["k", c] for c in columns] + [["k"]], "k", *columns).agg(
        F.count("*").alias("n_queries"), F.sum((F.col("hit") == 0).cast("long")).alias("zero_hits"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS], *[F.grouping(c).alias(f"_{c}") for c in columns]
    )
    scope, value = F.lit("overall"), F.lit("all")
    for name, c in scopes.items():
        scope, value = F.when(F.col(f"_{c}") == 0, name).otherwise(scope), F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(value)
    return sets.select(scope.alias("scope"), value.alias("value"), "k", "n_queries", "zero_hits", *METRICS)


def overlapping_groups(per_query: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Means over groups that may overlap (name to condition), with abstention accuracy and coverage.

    ``per_query`` has hit, recall, reciprocal_rank, ndcg, answerable and abstained. Accuracy is the share of queries
    without an answer that abstained, coverage that of the others that did not; both are 1 where there is none.
    """
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))
    rows = per_query.withColumn("group", F.explode(names))
    none, some = ~F.col("answerable"), F.col("answerable")
    return rows.groupBy("group").agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg("hit"), 6).alias("hit_rate"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg("ndcg"), 6).alias("ndcg"),
        F.sum((F.col("hit") == 0).cast("long")).alias("zero_hits"),
        ratio(F.count_if(none & F.col("abstained")), F.count_if(none), 1.0).alias("abstention_accuracy"),
        ratio(F.count_if(some & ~F.col("abstained")), F.count_if(some), 1.0).alias("coverage"),
    )


def linear_ndcg(ranked: DataFrame, judgments: DataFrame, query: str, unit: str, k: int) -> DataFrame:
    """query, ndcg at k with the grade itself as gain; queries with a relevant unit only."""
    gain = F.col("grade") / F.log2(F.col("rank") + 1)
    got = graded(ranked.where(F.col("rank") <= k), judgments, query, unit).groupBy(query).agg(F.sum(gain).alias("_dcg"))
    best = judgments.where("grade > 0").withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), unit))).where(F.col("rank") <= k)
    ideal = best.groupBy(query).agg(F.sum(gain).alias("_ideal"))
    return ideal.join(got, query, "left").select(query, ratio(F.coalesce("_dcg", F.lit(0.0)), F.col("_ideal")).alias("ndcg"))


METRICS = ("precision", "recall", "hit", "reciprocal_rank", "average_precision", "ndcg")


def mean_metrics(per_query: DataFrame, *groups: str) -> DataFrame:
    """Means over queries, zero-hit queries and the number of queries, for each group or overall."""
    return per_query.groupBy(*groups).agg(
        F.count("*").alias("n_queries"),
        F.sum((F.col("hit") == 0).cast("long")).alias("zero_hits"),
        *[F.round(F.avg(m), 6).alias(m) for m in METRICS],
    )


def set_metrics(truth: DataFrame, predicted: DataFrame, key: list[str], *groups: str) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 of two sets of rows compared by ``key``, for each group."""
    marked = truth.select(*key).distinct().withColumns({"_t": F.lit(1), "_p": F.lit(0)}).unionByName(predicted.select(*key).distinct().withColumns({"_t": F.lit(0), "_p": F.lit(1)}))
    both = marked.groupBy(*key).agg(F.max("_t").alias("_t"), F.max("_p").alias("_p"))
    counts = both.groupBy(*groups).agg(
        F.sum((F.col("_t") * F.col("_p")).cast("long")).alias("tp"),
        F.sum(((1 - F.col("_t")) * F.col("_p")).cast("long")).alias("fp"),
        F.sum((F.col("_t") * (1 - F.col("_p"))).cast("long")).alias("fn"),
    )
    return with_scores(counts)


def compared(truth: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """key, in_truth and in_predicted of every distinct key of either side."""
    marked = truth.select(*key).distinct().withColumns({"t": F.lit(True), "p": F.lit(False)}).unionByName(predicted.select(*key).distinct().withColumns({"t": F.lit(False), "p": F.lit(True)}))
    return marked.groupBy(*key).agg(F.bool_or("t").alias("in_truth"), F.bool_or("p").alias("in_predicted"))


def grains(both: DataFrame, columns: dict[str, str], labels: DataFrame) -> DataFrame:
    """scope, value, tp, fp, fn and scores of compared keys: in all ('micro'), by each column, and macro means over labels.

    ``columns`` maps a scope to its column; ``labels`` (value) names every label, also those that neither side has, which
    count as 0 in the macro means.
    """
    names = list(columns.values())
    counts = {"tp": F.col("in_truth") & F.col("in_predicted"), "fp": ~F.col("in_truth") & F.col("in_predicted"), "fn": F.col("in_truth") & ~F.col("in_predicted")}
    sets = both.groupingSets([[c] for c in names] + [[]], *names).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], *[F.grouping(c).alias(f"_{c}") for c in names])
    scope, value = F.lit("overall"), F.lit("micro")
    for s, c in columns.items():
        scope, value = F.when(F.col(f"_{c}") == 0, s).otherwise(scope), F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(value)
    rows = with_scores(sets.select(scope.alias("scope"), value.alias("value"), "tp", "fp", "fn"))
    by_label = labels.join(rows.where("scope = 'label'"), "value", "left").fillna(0, ["tp", "fp", "fn"]).fillna(0.0).withColumn("scope", F.lit("label"))
    macro = by_label.agg(F.lit("overall").alias("scope"), F.lit("macro").alias("value"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])
    return rows.where("scope <> 'label'").unionByName(by_label.select(*rows.columns)).unionByName(macro)


def errors(both: DataFrame) -> DataFrame:
    """Keys that only one side has, with error_type."""
    kind = F.when(~F.col("in_truth"), "false_positive").otherwise("false_negative")
    return both.where("in_truth <> in_predicted").withColumn("error_type", kind).drop("in_truth", "in_predicted")


def accounting(both: DataFrame, truth: DataFrame, predicted: DataFrame, key: list[str], error_rows: DataFrame) -> DataFrame:
    """metric, expected, actual, status: truth = TP + FN, predictions = TP + FP, errors = FP + FN."""
    from textmill.operators.rules import reconcile

    one = both.agg(F.count_if(F.col("in_truth")).alias("t"), F.count_if(F.col("in_predicted")).alias("p"), F.count_if(F.col("in_truth") != F.col("in_predicted")).alias("e"))
    count = lambda df: df.agg(F.count("*")).scalar()
    one = one.withColumns({"truth": count(truth.select(*key).distinct()), "predicted": count(predicted.select(*key).distinct()), "errors": count(error_rows)})
    c = F.col
    rows = [reconcile("truth_accounting", c("truth"), c("t")), reconcile("prediction_accounting", c("predicted"), c("p")), reconcile("error_accounting", c("e"), c("errors"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 beside tp, fp and fn; 0 where a denominator is 0."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def confusion(labelled: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Count of each pair of classes; a missing prediction is the class 'missing'."""
    return labelled.groupBy(F.col(truth).alias("actual"), F.coalesce(predicted, F.lit("missing")).alias("predicted")).agg(F.count("*").alias("n"))


def one_vs_rest(matrix: DataFrame) -> DataFrame:
    """tp, fp, fn and scores of each class of a confusion matrix."""
    sides = matrix.select(F.col("actual").alias("label"), "n", F.lit("a").alias("side"), (F.col("actual") == F.col("predicted")).alias("same")).unionByName(
        matrix.select(F.col("predicted").alias("label"), "n", F.lit("p").alias("side"), (F.col("actual") == F.col("predicted")).alias("same"))
    )
    counted = lambda side, same: F.sum(F.when((F.col("side") == side) & (F.col("same") == same), F.col("n")).otherwise(0))
    return with_scores(sides.groupBy("label").agg(counted("a", True).alias("tp"), counted("p", False).alias("fp"), counted("a", False).alias("fn")))


def gates(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per gate: metric, observed, threshold, passed. ``thresholds`` maps a metric to ('>=' or '<=', limit)."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("observed"), F.lit(float(t)).alias("threshold"), ((F.col(m) >= t) if op == ">=" else (F.col(m) <= t)).alias("passed")) for m, (op, t) in thresholds.items()]
    others = [c for c in metrics.columns if c not in thresholds]
    return metrics.select(*[c for c in others if c == "configuration"], F.explode(F.array(*rows)).alias("g")).select(*[c for c in others if c == "configuration"], "g.*")


def decision(gate_rows: DataFrame, *groups: str) -> DataFrame:
    """approved if no gate fails, conditional from five passed, else not approved."""
    counts = gate_rows.groupBy(*groups).agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.sum((~F.col("passed")).cast("long")).alias("failed"))
    return counts.withColumn("decision", F.when(F.col("failed") == 0, "approved").when(F.col("passed") >= 5, "conditional").otherwise("not_approved"))
