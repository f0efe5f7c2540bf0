"""Packs for people to review a benchmark: its queries, its judgments, and sheets to fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.sources import io

#: The questions put to reviewers, and who judged so far.
QUERY_QUESTION = "Is the query clear for the synthetic benchmark?"
JUDGMENT_QUESTION = "Confirm relevance grade or record disagreement."
AUTHOR = "synthetic_benchmark_author"


def queries(rows: DataFrame, query: str) -> DataFrame:
    """query, query_text, category, split and the question put to the reviewer."""
    return rows.select(query, "query_text", "category", "split", F.lit(QUERY_QUESTION).alias("review_question"))


def judgments(rows: DataFrame, query: str, unit: str) -> DataFrame:
    """query, unit, grade, who judged and what the reviewer is asked to do."""
    return rows.select(query, unit, "grade", F.lit(AUTHOR).alias("reviewer_role"), F.lit(JUDGMENT_QUESTION).alias("review_prompt"))


def ambiguous(rows: DataFrame, texts: DataFrame, query: str, unit: str) -> DataFrame:
    """query, unit and reason: judgments that grade equal texts differently for one query, or one unit twice.

    Units are brought together by the digest of their text (null texts are left out), extremes of grades are taken before
    anything is joined.
    """
    named = rows.join(texts.where("text IS NOT NULL").select(unit, F.sha2("text", 256).alias("_h")), unit)
    least, most = F.min("grade"), F.max("grade")
    of_text = named.groupBy(query, "_h").agg(least.alias("_least"), most.alias("_most"), F.count_distinct(unit).alias("_units")).where("_least < _most")
    reason = F.when(F.col("_units") > 1, "equal_texts_graded_differently").otherwise("unit_graded_twice")
    return named.select(query, unit, "_h").distinct().join(of_text.select(query, "_h", reason.alias("ambiguity_reason")), [query, "_h"]).select(query, unit, "ambiguity_reason")


def write_pack(query_rows: DataFrame, judgment_rows: DataFrame, texts: DataFrame, query: str, unit: str, path: str) -> DataFrame:
    """Write the sheets as one dataset of CSV, with an empty one for disagreements, and return their manifest."""
    blank = query_rows.sparkSession.createDataFrame([], "judgment_id string, reviewer_role string, proposed_grade int, reason string, reviewed_at string")
    sheets = {
        "query_review": queries(query_rows, query),
        "relevance_review": judgments(judgment_rows, query, unit),
        "ambiguous_judgments": ambiguous(judgment_rows, texts, query, unit),
        "disagreements": blank,
    }
    return io.write_dataset(sheets, path, "csv")
