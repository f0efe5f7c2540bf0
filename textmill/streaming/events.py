"""Structured Streaming over event files: windows with a watermark, sessions, admission, deduplication, and a sink that repeats nothing.

A batch is written below its own number, which replaces what a failed attempt of the same batch has left; a table
lists the batches that are whole. So a stream that is killed and started again gives each row once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textmill.session import shared_folder
from textmill.sources import io


def read_events(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files with a known schema; ``path`` may be a glob. Files come in the order of their change."""
    reader = spark.readStream.schema(like.schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and tumbling window; state older than the watermark is dropped."""
    held = events.withWatermark("ts", late)
    grouped = held.groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """key, session_start, session_end (last event and the gap), n and total; on a stream ``late`` is the watermark's delay."""
    held = events.withWatermark("ts", late) if late else events
    grouped = held.groupBy(key, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def admitted_stream(events: DataFrame, key: str, at: str, order: list[str], limit: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """``operators.events.admitted`` on a stream: adds admitted, and late for events that came after their turn.

    A key's state is the times of at most ``limit`` admitted events and the last event seen, as integers; a timer drops it
    once the watermark has passed the time after which no admitted event counts. Within a batch a key's events are taken
    by time and ``order``. An event before one already judged cannot be judged any more: it is kept with late, not
    admitted, and does not count (events behind the watermark Spark drops before; ``drain`` counts them). Events without a time are not admitted; a null key is a key of its own.
    """
    names = [*events.columns, "admitted", "late"]
    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("late", T.BooleanType())])
    span = seconds * 1_000_000

    def judge(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, last = (list(x) for x in state.get) if state.exists else ([], [])
        last_seen = tuple(last[0]) if last else None
        rows = pd.concat(list(frames), ignore_index=True)
        rows = rows.sort_values([at, *order], kind="stable", na_position="last").reset_index(drop=True)
        micros = rows[at].to_numpy().astype("datetime64[us]").astype("int64")
        known = rows[at].notna().to_numpy()
        admitted, late_rows = [], []
        for t, ok, turn in zip(micros.tolist(), known, rows[order].astype("int64").itertuples(index=False), strict=True):
            now = (t, *turn)
            behind = bool(ok and last_seen is not None and now < last_seen)
            if not ok or behind:
                admitted.append(False)
                late_rows.append(behind)
                continue
            last_seen = now
            kept = [k for k in kept if k > t - span]
            admitted.append(len(kept) < limit)
            late_rows.append(False)
            if admitted[-1]:
                kept.append(t)
        if last_seen is not None:
            state.update((kept, [list(last_seen)]))
            wake = max([*kept, last_seen[0]]) // 1000 + seconds * 1000
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(admitted=admitted, late=late_rows)[names]

    return (
        events.withWatermark(at, late)
        .groupBy(key)
        .applyInPandasWithState(judge, schema, "kept array<long>, last array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def save_batch(path: str, replace: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows below the batch's number, then its mark. Without rows nothing is written but the mark."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        spark = batch.sparkSession
        spark.createDataFrame([(number, replace)], "number long, whole boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/mark={number}")

    return save


def saved(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the marked batches: all of them, or those of the last one where each batch holds the whole result."""
    if not io.exists(spark, f"{path}/marks"):
        return spark.createDataFrame([], schema)
    marks = spark.read.schema("number long, whole boolean").parquet(*[f"{path}/marks/{n}" for n in io.names(spark, f"{path}/marks")]).collect()  # one row for each batch
    numbers = [max(m["number"] for m in marks)] if any(m["whole"] for m in marks) else [m["number"] for m in marks]
    return spark.read.schema(schema).parquet(*[f"{path}/rows/batch={n}" for n in sorted(numbers)])


def run_once(frame: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """Drain what is there now into a table in the shared folder and read it back; nothing gathers in the driver.

    In complete mode each batch holds the whole result, in append mode its new rows. Called again with the same
    ``checkpoint`` the stream goes on where it stopped, also in the middle of a batch that failed.
    """
    spark = frame.sparkSession
    folder = checkpoint or f"{shared_folder(spark)}/stream_{name}"
    drain(frame, folder, mode)
    return saved(spark, f"{folder}/table", frame.schema)


def drain(frame: DataFrame, folder: str, mode: str) -> int:
    """Run the stream over what is there now; returns how many rows came after the watermark had passed them."""
    stream = frame.writeStream.outputMode(mode).foreachBatch(save_batch(f"{folder}/table", mode == "complete")).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    try:
        stream.awaitTermination()
        return sum(o.numRowsDroppedByWatermark for p in stream.recentProgress for o in p.stateOperators)
    finally:
        stream.stop()


def parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Text lines with ``_metadata`` as _file, _malformed (the line, if it is not one JSON object of the schema) and the fields."""
    wide = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    parsed = lines.where(F.length(F.trim("value")) > 0).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"), "value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}).alias("r"))
    known = [F.col(f"r.`{f.name}`").isNotNull() for f in schema.fields]
    some = known[0]
    for k in known[1:]:
        some = some | k
    bad = F.when(F.col("r._malformed").isNotNull() | ~F.coalesce(some, F.lit(False)), F.col("value"))
    return parsed.select("_file", bad.alias("_malformed"), *[F.col(f"r.`{f.name}`") for f in schema.fields])


def collect_log(spark: SparkSession, path: str, schema: T.StructType, key: str, sequence: str, into: str, files_a_batch: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drain JSON-lines event files into ``into``: (events, quarantine, gaps).

    events: the first of each key across all files, by file name and then by the file's sequence; quarantine: file and
    checksum of each malformed line, never its text; gaps: file, first and last missing number between a file's
    numbers. Batches are saved under their numbers, so a run after a failure adds nothing twice; what counts as first
    is decided when reading, so it does not depend on how files came in batches.
    """
    from textmill.operators.events import deduplicated, gaps

    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path).select("value", "_metadata")
    rows = run_once(parsed_lines(lines, schema), "log", into, "append")
    malformed = F.col("_malformed").isNotNull()
    good = rows.where(~malformed).drop("_malformed")
    quarantine = rows.where(malformed).select(F.col("_file").alias("file"), F.sha2("_malformed", 256).alias("checksum"))
    numbered = good.where(F.col(sequence).isNotNull()).select(F.col("_file").alias("file"), F.col(sequence).cast("long").alias("n"))
    return deduplicated(good, key, "_file", sequence), quarantine, gaps(numbered, "file", "n")
