"""Operational events: summaries, deduplication, admission control and table differences."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deduplicated(events: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first event of each key in the given order; one shuffle by key, partial minima before it."""
    first = F.min(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*[F.col(c) for c in events.columns if c != key]).alias("_row")))
    return events.groupBy(key).agg(first.alias("_f")).select(key, "_f._row.*")


def nearest_rank(values: Column, share: float) -> Column:
    """Entry at round((n - 1) x share) of a sorted array, halves to the even place."""
    return F.element_at(values, (F.bround((F.size(values) - 1) * F.lit(share), 0) + 1).cast("int"))


BUCKETS = 1024


def exact_rank(df: DataFrame, value: str, share: float, *groups: str) -> DataFrame:
    """(groups, p) with the value at place round((n - 1) x share) of each group, without gathering a group.

    Values are counted by one of BUCKETS equal steps between a group's extremes, running counts over these few rows
    find the step that holds the place, and only that step's distinct values are ordered. Null values are left out.
    """
    known = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    ends = known.groupBy(*groups).agg(F.min("_v").cast("double").alias("_min"), F.max("_v").cast("double").alias("_max"), F.count("*").alias("_all"))
    step = F.when(F.col("_max") > F.col("_min"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("_min")) / (F.col("_max") - F.col("_min")) * BUCKETS))).otherwise(F.lit(0)).cast("int")
    stepped = (known.join(ends, list(groups)) if groups else known.crossJoin(F.broadcast(ends))).withColumns({"_step": step, "_at": F.bround((F.col("_all") - 1) * F.lit(share), 0)})
    w = Window.partitionBy(*groups).orderBy("_step")
    counted = stepped.groupBy(*groups, "_step", "_at").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    held = counted.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n"))).select(*groups, "_step", "_before")
    inner = stepped.join(F.broadcast(held) if not groups else held, [*groups, "_step"]).groupBy(*groups, "_v", "_at", "_before").agg(F.count("*").alias("_n"))
    placed = inner.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*groups).orderBy("_v")))
    return placed.where((F.col("_to") > F.col("_at")) & (F.col("_to") - F.col("_n") <= F.col("_at"))).select(*groups, F.col("_v").alias("p"))


def admitted(events: DataFrame, key: str, at: str, limit: int, seconds: int) -> DataFrame:
    """Adds admitted: at most ``limit`` admitted events of a key in the last ``seconds``; rejected ones do not count.

    Rows are dealt by key, sorted by time and streamed, so a worker holds ``limit`` times of one key, however many events
    it has. The rule is sequential, so one key's events are one task's. An event without a time is not admitted and does
    not count; a null key is a key of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.BooleanType())])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = object(), deque()
        span = timedelta(seconds=seconds)
        for batch in batches:
            out = []
            for k, t in zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index(at)).to_pylist(), strict=True):
                if k != current:
                    current, kept = k, deque()
                if t is None:
                    out.append(False)
                    continue
                while kept and kept[0] <= t - span:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], schema=arrow)

    order = [c for c in (at, *[c for c in events.columns if c not in (at, key)])]
    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


#: Numbers in one block of ``gaps``.
BLOCK = 1 << 16


def gaps(rows: DataFrame, key: str, number: str, block: int = BLOCK) -> DataFrame:
    """key, first_missing, last_missing: the ranges of numbers between a key's least and greatest that it does not have.

    A key's numbers are dealt in blocks, so a key of very many is spread; inside a block neighbours are compared, and
    between blocks their ends, one row for each block. Repeated and null numbers make no gap.
    """
    n = F.col(number)
    known = rows.where(n.isNotNull()).select(key, n.cast("long").alias("_n")).distinct().withColumn("_b", F.floor(F.col("_n") / block))
    inside = known.withColumn("_before", F.lag("_n").over(Window.partitionBy(key, "_b").orderBy("_n")))
    ends = known.groupBy(key, "_b").agg(F.min("_n").alias("_n"), F.max("_n").alias("_last"))
    between = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_b")))
    both = inside.select(key, "_before", "_n").unionByName(between.select(key, "_before", "_n"))
    return both.where("_before + 1 < _n").select(key, (F.col("_before") + 1).alias("first_missing"), (F.col("_n") - 1).alias("last_missing"))


def table_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key and change: added, removed or changed rows between two versions of a table."""
    mark = lambda df, side: df.select(*key, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256).alias("h"), F.lit(side).alias("side"))
    both = mark(old, "old").unionByName(mark(new, "new")).groupBy(*key).agg(F.max(F.when(F.col("side") == "old", F.col("h"))).alias("o"), F.max(F.when(F.col("side") == "new", F.col("h"))).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")
