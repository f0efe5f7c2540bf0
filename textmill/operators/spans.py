"""Segmentation with exact offsets, vocabulary matching, projection and overlap resolution."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.intervals import overlapping

#: A heading, a sentence and the negation words that flag one.
HEADING = r"(?m)^([^:\n]{2,80}):\s*"
SENTENCE = r"[^.!?\n]+(?:[.!?]+|\n|$)"
IDENTIFIER = r"\bSYN-[A-Z]+-\d+\b"
NEGATION = r"(?i)\b(no|not|without|denies|none)\b"
#: Headings that mark a document type.
DOCUMENT_TYPES = {
    "clinical_note": ["reason for attendance", "observations", "assessment summary"],
    "discharge_summary": ["admission reason", "discharge status", "follow up placeholder"],
    "pathology_report": ["specimen type", "macroscopic description", "microscopic description", "synthetic interpretation label"],
    "radiology_report": ["study", "synthetic indication", "findings", "impression"],
    "referral_letter": ["referral reason", "requested review", "administrative priority label"],
}


def matches(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, index, start, end, matched, group: regex matches with character offsets, which Spark's functions do not give.

    Texts are matched in Arrow batches; offsets count code points, as Spark's string functions do.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "index", "start", "end", "matched", "group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [(k, i, m.start(), m.end(), m[0], m[1] if m.re.groups else None) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, m in enumerate(compiled.finditer(t or ""))]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema.field(0).type), *[pa.array(c, pa.int64()) for c in cols[1:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], names)

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, index long, start long, end long, matched string, group string")


def matches_each(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, label, start, end of the matches of each pattern on its own, so that they may overlap; one pass over the texts."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "label", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {label: re.compile(p) for label, p in patterns.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [(k, label, m.start(), m.end()) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for label, p in compiled.items() for m in p.finditer(t or "")]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema.field(0).type), pa.array(cols[1], pa.string()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names)

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, label string, start long, end long")


def sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section_index, label, content_start, content_end, section_text. Text before the first heading is dropped; no heading makes one 'unknown' section."""
    heads = matches(df, key, text, HEADING)
    w = Window.partitionBy(key).orderBy("start")
    cut = heads.withColumn("next", F.lead("start").over(w)).join(df.select(key, F.col(text).alias("_t")), key)
    stop = F.coalesce("next", F.length("_t").cast("long"))
    found = cut.select(key, F.col("index").alias("section_index"), F.lower(F.translate(F.trim("group"), "-", " ")).alias("label"), F.col("end").alias("content_start"), stop.alias("content_end"), F.substring("_t", (F.col("end") + 1).cast("int"), (stop - F.col("end")).cast("int")).alias("section_text"))
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rest = df.join(heads.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("section_index"), F.lit("unknown").alias("label"), F.lit(0).cast("long").alias("content_start"), n.alias("content_end"), F.col(text).alias("section_text"))
    return found.unionByName(rest)


def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, sentence_index, start, end, sentence and flags; sentences are trimmed, empty ones skipped. Decimals are split."""
    raw = matches(df, key, text, SENTENCE)
    body = F.regexp_replace("matched", r"^\s+|\s+$", "")
    lead = F.length("matched") - F.length(F.regexp_replace("matched", r"^\s+", ""))
    kept = raw.select(key, "start", body.alias("sentence"), lead.alias("_lead")).where(F.length("sentence") > 0)
    w = Window.partitionBy(key).orderBy("start")
    begin = (F.col("start") + F.col("_lead")).cast("long")
    return kept.select(
        key,
        (F.row_number().over(w) - 1).cast("long").alias("sentence_index"),
        begin.alias("start"),
        (begin + F.length("sentence")).alias("end"),
        "sentence",
        F.col("sentence").rlike(NEGATION).alias("negated"),
        F.col("sentence").rlike(r"\d").alias("numeric"),
        F.col("sentence").rlike(IDENTIFIER).alias("identifier"),
    )


def vocabulary_pattern(words: list[str]) -> str:
    """One alternation of escaped phrases at word boundaries, longest first."""
    return r"(?i)(?<!\w)(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?!\w)"


def resolve_overlaps(spans: DataFrame, key: str) -> DataFrame:
    """Greedy selection of spans that do not overlap: priority, then length, then place. Adds accepted (boolean) and duplicate.

    Each document's spans are folded in order on their own; a document's spans are the unit that must meet.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema) + ", accepted boolean, duplicate boolean"

    def fold(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (-rows[i]["priority"], rows[i]["start"] - rows[i]["end"], rows[i]["start"], rows[i]["label"]))
        taken: list[tuple[int, int]] = []  # sorted; they do not overlap, so only neighbours can meet a new one
        seen: set[tuple] = set()
        accepted, duplicate = [False] * len(rows), [False] * len(rows)
        for i in order:
            r = rows[i]
            same = (r["start"], r["end"], r["label"])
            duplicate[i] = same in seen
            seen.add(same)
            if duplicate[i]:
                continue
            at = bisect.bisect_left(taken, (r["start"], r["end"]))
            if (at == 0 or taken[at - 1][1] <= r["start"]) and (at == len(taken) or r["end"] <= taken[at][0]):
                accepted[i] = True
                taken.insert(at, (r["start"], r["end"]))
        return table.append_column("accepted", pa.array(accepted, pa.bool_())).append_column("duplicate", pa.array(duplicate, pa.bool_()))

    return spans.groupBy(key).applyInArrow(fold, schema)


def projected(before: Column, after: Column, start: Column, value: Column) -> Column:
    """struct(status, start) of a span after its text was changed: unchanged, projected if it occurs once, else unresolved."""
    n = F.length(value)
    same = (before == after) & (F.substring(before, (start + 1).cast("int"), n) == value)
    first = F.instr(after, value)
    again = F.instr(F.substring(after, first + 1, F.length(after)), value)
    once = (first > 0) & (again == 0)
    status = F.when(same, "unchanged").when(once, "projected").otherwise("unresolved")
    return F.struct(status.alias("status"), F.when(same, start).when(once, (first - 1).cast("long")).alias("start"))


def document_types(section_rows: DataFrame, key: str) -> DataFrame:
    """key, predicted, score, confidence: the type of which most headings are found; ties go to the first name."""
    spark = section_rows.sparkSession
    rules = spark.createDataFrame([(t, h, len(hs)) for t, hs in DOCUMENT_TYPES.items() for h in hs], "type string, label string, required int")
    hits = section_rows.select(key, "label").distinct().join(F.broadcast(rules), "label").groupBy(key, "type", "required").agg(F.count("*").alias("score"))
    best = hits.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "type", "required")).alias("b"))
    score = -F.col("b.s")
    return best.select(key, F.col("b.type").alias("predicted"), score.alias("score"), F.round(F.least(F.lit(1.0), 0.55 + score / F.col("b.required") * 0.45), 6).alias("confidence"))


def span_scores(truth: DataFrame, predicted: DataFrame, key: str, policy: str) -> DataFrame:
    """tp, fp, fn of spans (key, label, start, end, value) under a matching policy.

    exact: same place; normalised: same lower-cased value anywhere in the text; relaxed: overlapping places, which meet
    in bins of places.
    """
    truth, predicted = truth.distinct(), predicted.distinct()
    t, p = truth.alias("t"), predicted.alias("p")
    same = (F.col(f"t.{key}") == F.col(f"p.{key}")) & (F.col("t.label") == F.col("p.label"))
    rules = {
        "exact": same & (F.col("t.start") == F.col("p.start")) & (F.col("t.end") == F.col("p.end")),
        "normalised": same & (F.lower("t.value") == F.lower("p.value")),
    }
    if policy == "relaxed":
        places = [key, "label", "start", "end"]
        alone = lambda a, b: a.join(overlapping(a.select(*places).distinct(), b.select(*places).distinct(), [key, "label"]).select(*places).distinct(), places, "left_anti")
        unmatched, unfound = alone(truth, predicted), alone(predicted, truth)
    else:
        unmatched, unfound = t.join(p, rules[policy], "left_anti"), p.join(t, rules[policy], "left_anti")
    missed = unmatched.groupBy("label").agg(F.count("*").alias("fn"))
    wrong = unfound.groupBy("label").agg(F.count("*").alias("fp"))
    total = truth.groupBy("label").agg(F.count("*").alias("n"))
    labels = total.select("label").union(predicted.select("label")).distinct()
    rows = labels.join(total, "label", "left").join(missed, "label", "left").join(wrong, "label", "left").fillna(0)
    return rows.select("label", (F.col("n") - F.col("fn")).alias("tp"), "fp", "fn")
