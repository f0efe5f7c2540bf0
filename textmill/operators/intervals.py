"""Joins of intervals by place, in bins, so that long texts do not meet all their spans with all their intervals.

An interval belongs to the level whose bins are the first as wide as itself, so it lies in two bins at most, however
long it is. What looks for it asks one bin (a place) or a run of bins (a range) of every level there is; levels are
powers of four, so there are few. Rows meet by key, level and bin, and a predicate decides. One key with very many
rows is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the bins of level 0, in characters; level l has bins 4^l times as wide.
WIDTH = 64


def _bins(level: Column, width: int) -> Column:
    return F.lit(width) * F.pow(F.lit(4), level).cast("long")


def _level(length: Column, width: int) -> Column:
    """The first level whose bins are as wide as the length."""
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(length, F.lit(1)) / F.lit(float(width))) - F.lit(1e-9))).cast("int")


def _held(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Each interval once for each of its bins (two at most); both ends belong to it here, predicates refine."""
    level = _level(F.col(end) - F.col(start), width)
    placed = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_level", level)
    w = _bins(F.col("_level"), width)
    return placed.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / w), F.floor(F.col(end) / w))))


def _asking(df: DataFrame, start: str, end: str, levels: list[int], width: int) -> DataFrame:
    """Each row once for each level and bin that its range meets."""
    level = F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))
    placed = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_level", level)
    w = _bins(F.col("_level"), width)
    return placed.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / w), F.floor(F.col(end) / w))))


def levels_of(intervals: DataFrame, start: str, end: str, width: int = WIDTH) -> list[int]:
    """The levels that occur, a dozen or so for any text."""
    rows = intervals.select(_level(F.col(end) - F.col(start), width).alias("l")).where("l IS NOT NULL").distinct().collect()
    return sorted(r["l"] for r in rows)


def containing(spans: DataFrame, intervals: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Each span (key, start, end and others) with interval_index and contained.

    ``intervals`` has key, index, start, end. The index is that of the first interval of the text that holds the span; if
    none does, it is the text's first one, and ``contained`` is false; null without any. Repeated spans are one row.
    """
    spans = spans.distinct()
    levels = levels_of(intervals, "start", "end", width)
    first = intervals.groupBy(key).agg(F.min("index").alias("_first"))
    if not levels:
        return spans.withColumns({"interval_index": F.lit(None).cast(intervals.schema["index"].dataType), "contained": F.lit(False)})
    inner = _held(intervals.select(key, F.col("index").alias("_i"), F.col("start").alias("_a"), F.col("end").alias("_b")), "_a", "_b", width)
    asked = _asking(spans.withColumn("_at", F.col("start")), "start", "_at", levels, width).drop("_at")
    holds = (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b"))
    best = asked.join(inner, [key, "_level", "_bin"]).where(holds).groupBy(*spans.columns).agg(F.min("_i").alias("_best"))
    same = [F.col(f"s.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) if c != key else F.col(f"s.`{c}`") == F.col(f"b.`{c}`") for c in spans.columns]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = spans.alias("s").join(best.alias("b"), condition, "left").select("s.*", "b._best").join(first, key, "left")
    return joined.select(*spans.columns, F.coalesce("_best", "_first").alias("interval_index"), F.col("_best").isNotNull().alias("contained"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Pairs of ranges (half-open) that share a place, once each: the columns of ``left``, then ``right_start``, ``right_end``.

    Both sides have the keys, start and end. A pair that meets in two bins counts in the one of its later start. A left
    range asks as many bins as it is long in those of the right side's level, so the longer ranges belong on the right.
    """
    levels = levels_of(right, "start", "end", width)
    if not levels:
        return left.withColumns({"right_start": F.lit(None).cast("long"), "right_end": F.lit(None).cast("long")}).where(F.lit(False))
    held = _held(right.select(*keys, F.col("start").alias("right_start"), F.col("end").alias("right_end")), "right_start", "right_end", width)
    asked = _asking(left, "start", "end", levels, width)
    joined = asked.join(held, [*keys, "_level", "_bin"]).where((F.col("start") < F.col("right_end")) & (F.col("right_start") < F.col("end")))
    later = F.floor(F.greatest("start", "right_start") / _bins(F.col("_level"), width))
    return joined.where(F.col("_bin") == later).select(*left.columns, "right_start", "right_end")
