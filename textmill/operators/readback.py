"""Runs written as datasets, and checks of them after writing: their tables, checksums, and numbers that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import evaluate as E
from textmill.sources import io


@dataclass(frozen=True)
class Agreement:
    """Two numbers or words of a written run that must be equal; ``sides`` makes them from the named tables, in order."""

    name: str
    tables: tuple[str, ...]
    sides: Callable[..., tuple[Column, Column]]


def _n(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def _one(df: DataFrame, column: str) -> Column:
    return df.agg(F.max(column)).scalar()


def _worst(df: DataFrame, column: str = "status") -> Column:
    grade = F.max(F.when(F.col(column) == "failed", 2).when(F.col(column) == "warning", 1).otherwise(0))
    return df.agg(F.element_at(F.array(F.lit("passed"), F.lit("warning"), F.lit("failed")), F.coalesce(grade, F.lit(0)) + 1)).scalar()


def _micro(metrics: DataFrame) -> Column:
    return metrics.where("scope = 'overall' AND value = 'micro'").agg(F.max(F.col("f1").cast("decimal(8,6)"))).scalar()


#: What must agree in a written evaluation, comparison, run of answers and holdout corpus.
EVALUATION = (
    Agreement("error_rows", ("run", "errors"), lambda run, errors: (_one(run, "errors"), _n(errors))),
    Agreement("confusion_total", ("run", "confusion"), lambda run, confusion: (_one(run, "documents"), confusion.agg(F.sum("n")).scalar())),
    Agreement("micro_f1", ("run", "metrics"), lambda run, metrics: (_one(run, "micro_f1"), _micro(metrics))),
    Agreement("reconciliation_status", ("run", "reconciliation"), lambda run, rows: (_one(run, "status"), _worst(rows))),
)
COMPARISON = (
    Agreement("gate_counts", ("decisions", "gates"), lambda decisions, gates: (decisions.agg(F.sum(F.col("passed") + F.col("failed"))).scalar(), _n(gates))),
    Agreement("gates_passed", ("decisions", "gates"), lambda decisions, gates: (decisions.agg(F.sum("passed")).scalar(), gates.agg(F.count_if("passed")).scalar())),
    Agreement("configurations", ("leaderboard", "decisions"), lambda board, decisions: (_n(board), _n(decisions))),
)
HOLDOUT = (
    Agreement("units_of_known_documents", ("documents", "units"), lambda documents, units: (F.lit(0), _n(units.join(documents.select("document_id"), "document_id", "left_anti")))),
    Agreement("documents_with_units", ("documents", "units"), lambda documents, units: (_n(documents), units.agg(F.count_distinct("document_id")).scalar())),
    Agreement("unit_ids", ("units",), lambda units: (_n(units), units.agg(F.count_distinct("unit_id")).scalar())),
)


def answer_agreements(query: str) -> tuple[Agreement, ...]:
    """What must agree in a run of answers (answers, evidence, citations), whose queries are named by a column."""
    return (
        Agreement("answers_once", ("answers",), lambda answers: (_n(answers), answers.agg(F.count_distinct(query)).scalar())),
        Agreement("evidence_of_answers", ("answers", "evidence"), lambda answers, evidence: (F.lit(0), _n(evidence.join(answers.select(query), query, "left_anti")))),
        Agreement("citations_of_evidence", ("citations", "evidence"), lambda citations, evidence: (F.lit(0), _n(citations.join(evidence.select(query, "label"), [query, "label"], "left_anti")))),
    )


def checked(spark: SparkSession, path: str, required: tuple[str, ...], agreements: tuple[Agreement, ...] = ()) -> DataFrame:
    """check, subject, expected, observed, status of a dataset: every required table, then every agreement.

    A table passes if it is stated in the manifest, is there, and is read back with the stated number of rows, columns and
    checksum; expected and observed are its rows. An agreement fails if one of its tables is missing; null agrees with null.
    Everything is one plan of aggregates; no table is brought to the driver. A file that is no longer Parquet raises.
    """
    stated = io.dataset_manifest(spark, path)
    known = {t["name"]: t for t in stated["tables"]} if stated else {}
    there = {n: io.read_dataset(spark, path, n) for n in known if io.holds(spark, path, n)}
    rows: list[DataFrame] = []

    def row(check: str, subject: str, expected: Column, observed: Column, passed: Column) -> list[Column]:
        return [F.lit(check).alias("check"), F.lit(subject).alias("subject"), expected.cast("string").alias("expected"), observed.cast("string").alias("observed"), F.when(passed, "passed").otherwise("failed").alias("status")]

    single = spark.range(1)
    for name in required:
        if name not in there:
            n = known[name]["rows"] if name in known else None
            rows.append(single.select(*row("table", name, F.lit(n), F.lit(None), F.lit(False))))
            continue
        same = F.lit(True)
        for key in ("rows", "columns", "checksum"):
            same = same & (F.col(key) == F.lit(known[name][key]))
        rows.append(io.manifest(there[name], name).select(*row("table", name, F.lit(known[name]["rows"]), F.col("rows"), same)))
    for a in agreements:
        if all(t in there for t in a.tables):
            left, right = a.sides(*[there[t] for t in a.tables])
            both = single.select(left.cast("string").alias("l"), right.cast("string").alias("r"))
            rows.append(both.select(*row("agreement", a.name, F.col("l"), F.col("r"), F.col("l").eqNullSafe(F.col("r")))))
        else:
            missing = ", ".join(t for t in a.tables if t not in there)
            rows.append(single.select(*row("agreement", a.name, F.lit(None), F.lit(f"without {missing}"), F.lit(False))))
    return reduce(DataFrame.unionByName, rows)


def require_passed(checks: DataFrame) -> None:
    """Raise with the subjects of checks that did not pass (of which there are as many as tables and agreements)."""
    failed = [r["subject"] for r in checks.where("status <> 'passed'").orderBy("check", "subject").collect()]
    if failed:
        raise ValueError(f"checks failed: {', '.join(failed)}")


def write_evaluation(truth: DataFrame, predicted: DataFrame, key: list[str], grains: dict[str, str], labels: DataFrame, classes: DataFrame, path: str) -> DataFrame:
    """Compare extracted keys and classes (actual, predicted), write the run below ``path``, and return its checks.

    Both sides are written first, then their comparison (``path``/sides, ``path``/compared), and everything else reads
    these, so each extraction runs once. ``path``/run holds metrics, errors, confusion, reconciliation and run: the counts that the run
    states, taken from the comparison and the classes themselves and not from the other tables.
    """
    spark = truth.sparkSession
    io.write_dataset({"truth": truth.select(*key).distinct(), "predicted": predicted.select(*key).distinct()}, f"{path}/sides")
    of_truth, of_predicted = (io.read_dataset(spark, f"{path}/sides", n) for n in ("truth", "predicted"))
    io.write_dataset({"compared": E.compared(of_truth, of_predicted, key)}, f"{path}/compared")
    both = io.read_dataset(spark, f"{path}/compared", "compared")
    tp, wrong = F.count_if(F.col("in_truth") & F.col("in_predicted")), F.count_if(F.col("in_truth") != F.col("in_predicted"))
    f1 = F.when(2 * tp + wrong > 0, F.round(2 * tp / (2 * tp + wrong), 6)).otherwise(F.lit(0.0))
    errors = E.errors(both)
    reconciliation = E.accounting(both, of_truth, of_predicted, key, errors)
    failed = F.count_if(F.col("status") == "failed")
    status = reconciliation.agg(F.when(failed > 0, "failed").otherwise("passed")).scalar()
    run = both.agg(wrong.alias("errors"), f1.cast("decimal(8,6)").alias("micro_f1")).withColumns({"documents": _n(classes), "status": status})
    tables = {"metrics": E.grains(both, grains, labels), "errors": errors, "confusion": E.confusion(classes, "actual", "predicted"), "reconciliation": reconciliation, "run": run}
    io.write_dataset(tables, f"{path}/run")
    return checked(spark, f"{path}/run", tuple(tables), EVALUATION)
