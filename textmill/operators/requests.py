"""Requests against answers that stand ready: limits, safety, match, lookup, and the events that each request leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions import ids
from textmill.functions import text as X
from textmill.operators import rules as R

#: Limits of a request, and the status of a request that is refused before any lookup.
CHARACTERS, FILTERS = 500, 8
REFUSED = "unsupported_request_refusal"


def judged(requests: DataFrame, characters: int = CHARACTERS, filters: int = FILTERS) -> DataFrame:
    """Requests (request_id, asked, text, filters, demo) with error, the first limit that is broken, and category.

    A null text is empty, a null number of filters is 0, a null demo flag is false.
    """
    text = F.coalesce("text", F.lit(""))
    error = (
        F.when(F.length(text) > characters, "query_too_large")
        .when(F.coalesce("filters", F.lit(0)) > filters, "too_many_metadata_filters")
        .when(~F.coalesce("demo", F.lit(False)), "portfolio_demo_mode_required")
    )
    return requests.withColumns({"text": text, "error": error, "category": R.query_class(text)})


def served(requests: DataFrame, known: DataFrame, answers: DataFrame, query: str, wanted: str, characters: int = CHARACTERS, filters: int = FILTERS) -> DataFrame:
    """One response for each request: request_id, asked, text, category, error, refused, answered_by, answer_status,
    answer, retrieval_status and confidence.

    requests: request_id, asked (a query's id or null), text, filters, demo; known: query, question; answers: query (once
    each), status, answer, retrieval_status, confidence. ``asked`` names the query, else the known query of the smallest id
    with the same text but for case and spacing does. A request over a limit has an error and nothing else; one of an
    unsupported class is refused without a lookup; one without an answer gets the first answer with the status ``wanted``,
    then the first that refuses, then the first of all. Only requests that get that far are joined.
    """
    rows = judged(requests, characters, filters)
    refused = F.col("error").isNull() & F.startswith("category", F.lit("unsupported"))
    rows = rows.withColumn("refused", refused).withColumn("_open", F.col("error").isNull() & ~F.col("refused"))
    keyed = known.groupBy(X.lookup_key(F.col("question")).alias("_k")).agg(F.min(query).alias("_match"))
    found = rows.withColumn("_k", F.when(F.col("_open") & F.col("asked").isNull(), X.lookup_key(F.col("text")))).join(keyed, "_k", "left")
    named = found.withColumn("asked", F.coalesce("asked", "_match")).withColumn("_q", F.when(F.col("_open"), F.col("asked")))
    one = F.struct(F.col(query).alias("query"), "status", "answer", "retrieval_status", "confidence")
    order = F.when(F.col("status") == wanted, 0).when(F.contains("status", F.lit("refusal")) | F.startswith("status", F.lit("unsupported")), 1).otherwise(2)
    fallback = answers.agg(F.min_by(one, F.struct(order, F.col(query)))).scalar()
    joined = named.join(answers.select(F.col(query).alias("_q"), one.alias("_a")), "_q", "left")
    given = joined.withColumn("_a", F.when(F.col("_open"), F.coalesce("_a", fallback)))
    status = F.when(F.col("refused"), REFUSED).otherwise(F.col("_a.status"))
    retrieval = F.when(F.col("refused"), "not_invoked").otherwise(F.col("_a.retrieval_status"))
    sure = F.when(F.col("refused"), 0.0).otherwise(F.col("_a.confidence"))
    kind = F.when(F.col("error").isNull(), F.col("category"))
    return given.select(
        "request_id", "asked", "text", kind.alias("category"), "error", "refused", F.col("_a.query").alias("answered_by"),
        status.alias("answer_status"), F.col("_a.answer").alias("answer"), retrieval.alias("retrieval_status"), sure.alias("confidence"),
    )


def events(responses: DataFrame) -> DataFrame:
    """request_id, place, event_type, query_checksum and the statuses of the events of ``served`` requests.

    A request that is too large leaves an error, other broken limits leave nothing; a refusal leaves one event, an answer
    two: that it was accepted, and whether it was answered or abstained from. Texts are replaced by checksums.
    """
    event = lambda name, *, category=None, retrieval=None, answer=None, safety=None, error=None: F.struct(
        F.lit(name).alias("event_type") if isinstance(name, str) else name.alias("event_type"),
        *[(F.lit("") if v is None else F.coalesce(v, F.lit(""))).alias(k) for k, v in (("category", category), ("retrieval_status", retrieval), ("answer_status", answer), ("safety_status", safety), ("error_code", error))],
    )
    c = F.col
    outcome = F.when(c("retrieval_status") == "retrieval_abstained", "retrieval_abstained").otherwise("answer_generated")
    accepted = event("query_accepted", category=c("category"), retrieval=c("retrieval_status"), answer=c("answer_status"), safety=F.lit("passed"))
    made = event(outcome, category=c("category"), retrieval=c("retrieval_status"), answer=c("answer_status"))
    refusal = event("query_refused_before_retrieval", category=c("category"), answer=c("answer_status"), safety=F.lit("passed"))
    of = (
        F.when(c("error") == "query_too_large", F.array(event("application_error", error=c("error"))))
        .when(c("error").isNotNull(), F.slice(F.array(made), 1, 0))
        .when(c("refused"), F.array(refusal))
        .otherwise(F.array(accepted, made))
    )
    checksum = F.when(c("text") == "", "").otherwise(ids.checksum_text(c("text")))
    return responses.select("request_id", checksum.alias("query_checksum"), F.posexplode(of).alias("place", "e")).select("request_id", (c("place") + 1).alias("place"), "query_checksum", "e.*")
