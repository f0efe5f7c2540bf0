"""Rule tables: privacy and safety patterns, query classes, quality checks, quarantine and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Privacy patterns by name.
PRIVACY = {
    "nhs_number_like": r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "uk_phone": r"\b(?:\+44\s?7\d{3}|07\d{3})\s?\d{3}\s?\d{3}\b",
    "postcode": r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b",
    "url": r"(?i)https?://|www\.",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "credit_card_like": r"\b(?:\d[ -]*?){13,16}\b",
    "national_insurance_like": r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b",
    "long_unapproved_number": r"\b(?!SYN-)\d{7,}\b",
}
#: Query classes in the order they are tried, with their phrases.
UNSUPPORTED = (
    ("unsupported_emergency_request", ("emergency", "urgent care", "911", "life threatening")),
    ("unsupported_real_patient_request", ("my patient", "real patient", "actual patient")),
    ("unsupported_medication_request", ("medication", "prescribe", "dosage", "take aspirin")),
    ("unsupported_treatment_request", ("treatment", "therapy", "what should", "should i")),
    ("unsupported_diagnosis_request", ("diagnose", "diagnosis", "do i have")),
    ("unsupported_clinical_advice", ("clinical advice", "medical advice", "recommend")),
)
#: Phrases that an answer must not hold.
PROHIBITED = (
    "you should take",
    "start taking",
    "stop taking",
    "recommended treatment",
    "diagnosis confirmed",
    "urgent treatment required",
    "seek emergency care",
    "medical advice",
    "prescribe",
    "dosage",
)


def pattern_checks(text: Column, patterns: dict[str, str]) -> Column:
    """Array of struct(check_name, passed): a check passes if its pattern is absent."""
    return F.array(*[F.struct(F.lit(n).alias("check_name"), (~text.rlike(p)).alias("passed")) for n, p in patterns.items()])


def long_checks(df: DataFrame, key: str, checks: Column) -> DataFrame:
    """key, check_name, status: one row per check."""
    rows = df.select(key, F.explode(checks).alias("c"))
    return rows.select(key, F.col("c.check_name").alias("check_name"), F.when(F.col("c.passed"), "passed").otherwise("failed").alias("status"))


def contains_any(lowered: Column, phrases: tuple[str, ...]) -> Column:
    out = F.contains(lowered, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(lowered, F.lit(p))
    return out


def query_class(text: Column, portfolio: bool = True) -> Column:
    """The first class of which a phrase is found; else the kind of supported request."""
    lowered = F.lower(text)
    supported = F.when(F.contains(lowered, F.lit("metadata")), "synthetic_metadata_query").when(F.contains(lowered, F.lit("compare")), "synthetic_comparison").when(F.contains(lowered, F.lit("summary")), "synthetic_summary_request").otherwise("synthetic_record_lookup")
    other = supported if portfolio else F.when(F.contains(lowered, F.lit("synthetic")), supported).otherwise("out_of_scope")
    out = None
    for name, phrases in UNSUPPORTED:
        out = F.when(contains_any(lowered, phrases), name) if out is None else out.when(contains_any(lowered, phrases), name)
    return out.otherwise(other)


def prohibited(text: Column) -> Column:
    """The prohibited phrases that a text holds, in their fixed order."""
    lowered = F.lower(text)
    return F.filter(F.array(*[F.lit(p) for p in PROHIBITED]), lambda p: F.contains(lowered, p))


def quarantine(df: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, failing rows with ``reasons``) by an array of failed check names."""
    marked = df.withColumn("reasons", failed)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def reconcile(name: str, expected: Column, actual: Column) -> Column:
    """struct(metric, expected, actual, status) of one comparison."""
    e, a = expected.cast("long"), actual.cast("long")
    return F.struct(F.lit(name).alias("metric"), e.alias("expected"), a.alias("actual"), F.when(e.eqNullSafe(a), "passed").otherwise("failed").alias("status"))


def overall(statuses: DataFrame, column: str = "status") -> DataFrame:
    """failed before warning before passed."""
    return statuses.agg(F.when(F.bool_or(F.col(column) == "failed"), "failed").when(F.bool_or(F.col(column) == "warning"), "warning").otherwise("passed").alias(column))
