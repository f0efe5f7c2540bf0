"""Row generation without a random state: every choice is a hash of the seed, the row and the field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small vocabularies of the generated documents, by field.
VALUES = {
    "concern": ["headache", "cough", "knee pain", "fatigue", "rash"],
    "investigation": ["blood count", "chest film", "scan", "urine test"],
    "site": ["left knee", "chest", "abdomen", "head"],
    "status": ["booked", "waiting", "closed"],
}
TYPES = ("clinical_note", "discharge_summary", "pathology_report", "radiology_report", "referral_letter")


def pick(values: list[str], seed: int, row: Column, field: str) -> Column:
    """A value by the hash of seed, row and field."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(field)), 256)
    place = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(len(values)))
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))


def documents(spark: SparkSession, count: int, seed: int, start: str = "2026-01-01 08:00:00") -> DataFrame:
    """``count`` documents: type in turn, fields by hash, times three hours apart, one line per heading."""
    i = F.col("id")
    rows = spark.range(1, count + 1).select(
        i.alias("record_index"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod(i - 1, F.lit(len(TYPES))) + 1).cast("int")).alias("document_type"),
        *[pick(v, seed, i, k).alias(k) for k, v in VALUES.items()],
        (F.lit(start).cast("timestamp") + F.make_dt_interval(hours=(i * 3).cast("int"))).cast("timestamp_ntz").alias("created_at"),
    )
    text = F.concat_ws("\n", F.concat(F.lit("Reason: "), "concern"), F.concat(F.lit("Test: "), "investigation", F.lit(" of "), "site"), F.concat(F.lit("Status: "), "status"))
    return rows.withColumn("text", text)


def span_of(text: Column, value: Column) -> Column:
    """struct(start, end) of the first exact occurrence; null if there is none."""
    at = F.instr(text, value)
    return F.when(at > 0, F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(value)).cast("long").alias("end")))


def capped(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group: a sample by position."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
