"""The extraction stage: vocabulary phrases to accepted spans, written as one dataset, with its accounting from the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textmill.operators.corpus import predictions
from textmill.operators.phrases import phrase_spans
from textmill.operators.spans import resolve_overlaps
from textmill.sources import io


def candidates(documents: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """key, label, start, end, priority of every phrase found; a phrase that stands in several entries has its greatest priority."""
    entries = vocabulary.where(F.length("phrase") > 0).groupBy(F.lower("phrase").alias("label")).agg(F.max("priority").alias("priority"))
    return phrase_spans(documents, key, text, vocabulary).join(entries, "label").select(key, "label", "start", "end", "priority")


def extract(documents: DataFrame, key: str, text: str, vocabulary: DataFrame, run_id: str, path: str) -> DataFrame:
    """Write the accepted spans of ``documents`` with their identifiers below ``path`` and return the stage's accounting.

    ``vocabulary`` has phrase and priority. Candidates, accepted, suppressed and duplicate spans are observed while the
    rows are written, so the texts are read once; what the manifest says was written must equal what was accepted.
    The dataset becomes visible as a whole, and is read back before the accounting is returned.
    """
    spark = documents.sparkSession
    seen = Observation()
    rows = resolve_overlaps(candidates(documents, key, text, vocabulary), key)
    watched = rows.observe(seen, F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), F.count_if("duplicate").alias("duplicates"), F.count_if(~F.col("accepted") & ~F.col("duplicate")).alias("suppressed"), F.count_if((F.col("start") < 0) | (F.col("end") <= F.col("start"))).alias("outside"))
    kept = predictions(watched.where("accepted").select(key, "label", "start", "end", F.col("label").alias("value")), key, run_id)
    written = io.write_dataset({"predictions": kept}, path)
    faults = io.validate_dataset(spark, path, written, {"predictions": kept.schema})
    n = seen.get
    stated = written.first()["rows"]
    checks = [
        ("candidates", n["candidates"], n["accepted"] + n["suppressed"] + n["duplicates"]),
        ("written", n["accepted"], stated),
        ("spans_in_order", 0, n["outside"]),
        ("read_back", 0, faults.count()),
    ]
    return spark.createDataFrame([(m, int(e), int(a), "passed" if e == a else "failed") for m, e, a in checks], "metric string, expected long, actual long, status string")
