"""Ingestion: nested documents to flat tables, the one-to-one join, checks with severities, and the stage as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.rules import overall, reconcile
from textmill.sources import io


def exploded(df: DataFrame, key: str, entities: str, level: str) -> DataFrame:
    """key, kind, index, name, value: the entities (an array of name and value) from 1, then the sorted map, counting on.

    Both parts are exploded from one array, so the table is read once.
    """
    spans = F.transform(F.coalesce(F.col(entities), F.expr(f"slice({entities}, 1, 0)")), lambda e: F.struct(F.lit("span").alias("kind"), e["name"].alias("name"), e["value"].alias("value")))
    held = F.array_sort(F.map_entries(F.coalesce(F.col(level), F.create_map().cast("map<string,string>"))))
    fields = F.transform(held, lambda e: F.struct(F.lit("document_level").alias("kind"), e["key"].alias("name"), e["value"].alias("value")))
    rows = df.select(key, F.posexplode(F.concat(F.coalesce(spans, F.expr("cast(array() as array<struct<kind:string,name:string,value:string>>)")), fields)).alias("_at", "e"))
    return rows.select(key, "e.kind", (F.col("_at") + 1).cast("long").alias("index"), "e.name", "e.value")


def annotation_count(df: DataFrame, entities: str, level: str) -> DataFrame:
    """One row: entities and map entries in all."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return df.agg(F.coalesce(F.sum((size(entities) + size(level)).cast("long")), F.lit(0)).cast("long").alias("annotations"))


def one_to_one(documents: DataFrame, annotations: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(joined rows, documents without an annotation); of several annotations of a key the last in order counts."""
    others = [c for c in annotations.columns if c != key]
    last = annotations.groupBy(key).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
    return documents.join(last, key), documents.join(last, key, "left_anti")


def graded_check(name: str, passed: Column, observed: Column, threshold: str, warning: bool = False) -> Column:
    """struct(check_name, status, observed, threshold); a check that is a warning never fails."""
    status = F.when(passed, "passed").otherwise("warning" if warning else "failed")
    return F.struct(F.lit(name).alias("check_name"), status.alias("status"), observed.cast("string").alias("observed"), F.lit(threshold).alias("threshold"))


def quality_checks(text: Column, sections: Column, longest: Column, unresolved: Column, least: int = 80, most: int = 500) -> Column:
    """The six checks of a document: empty, short, replacement character, sections, longest sentence, projection."""
    n = F.length(text)
    replaced = n - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.array(
        graded_check("empty_text", F.length(F.trim(text)) > 0, F.length(F.trim(text)), ">0"),
        graded_check("very_short_text", n >= least, n, str(least), True),
        graded_check("unicode_replacement_character", replaced == 0, replaced, "0"),
        graded_check("section_coverage", sections > 0, sections, ">0", True),
        graded_check("extremely_long_sentence", longest <= most, longest, str(most), True),
        graded_check("annotation_projection_success", unresolved == 0, unresolved, "0", True),
    )


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count("*").alias("n"))


def reconciled(documents: DataFrame, annotations: DataFrame, canonical: DataFrame, exploded_rows: DataFrame, quarantined: DataFrame, key: str, kind: str, label: str) -> DataFrame:
    """Eight checks of a stage: both counts, quarantine, duplicates of both, orphans, and two equal distributions.

    Distributions are compared by the number of values whose counts differ, never gathered.
    """
    n = lambda df: df.agg(F.count("*")).scalar()
    repeated = lambda df, *k: n(df.groupBy(*k).count().where("count > 1"))

    def differing(a: DataFrame, b: DataFrame, column: str):
        both = a.groupBy(column).agg(F.count("*").alias("_n")).unionByName(b.groupBy(column).agg((-F.count("*")).alias("_n")))
        return n(both.groupBy(column).agg(F.sum("_n").alias("_d")).where("_d <> 0"))

    values = {
        "documents": (n(documents), n(canonical)),
        "annotations": (n(annotations), n(exploded_rows)),
        "quarantined": (F.lit(0), n(quarantined)),
        "duplicate_documents": (F.lit(0), repeated(canonical, key)),
        "duplicate_annotations": (F.lit(0), repeated(exploded_rows, key, "index")),
        "orphan_annotations": (F.lit(0), n(exploded_rows.join(canonical, key, "left_anti"))),
        "kinds_equal": (F.lit(0), differing(documents, canonical, kind)),
        "labels_equal": (F.lit(0), differing(annotations, exploded_rows, label)),
    }
    one = documents.sparkSession.range(1).select(*[F.struct(e.cast("long").alias("e"), a.cast("long").alias("a")).alias(m) for m, (e, a) in values.items()])
    return one.select(F.explode(F.array(*[reconcile(m, F.col(f"{m}.e"), F.col(f"{m}.a")) for m in values])).alias("r")).select("r.*")


def require_source(manifest: DataFrame, flags: tuple[str, ...]) -> None:
    """Raise unless the source passed its validation and carries every governance flag."""
    one = manifest.first()
    missing = [f for f in flags if not one[f]]
    if one["status"] != "passed" or missing:
        raise PermissionError(f"the source is {one['status']}" + (f" and lacks {', '.join(missing)}" if missing else ""))


def run(documents: DataFrame, annotations: DataFrame, key: str, order: str, failed: Column, path: str) -> DataFrame:
    """The stage: quarantine, one-to-one join, tables, read-back; returns the manifest of what was written.

    ``failed`` is the array of a document's failed checks. Documents, annotations and quarantine become visible below
    ``path`` together; a stage that fails leaves what was there.
    """
    from textmill.operators.rules import quarantine

    valid, failing = quarantine(documents, failed)
    joined, missing = one_to_one(valid, annotations, key, order)
    if not missing.isEmpty():
        raise KeyError(f"documents without an annotation, such as {missing.first()[key]}")
    kept = annotations.join(valid.select(key), key, "left_semi")
    tables = {"documents": joined, "annotations": kept, "quarantine": io.quarantined(failing, key)}
    written = io.write_dataset(tables, path)
    faults = io.validate_dataset(documents.sparkSession, path, written, {n: t.schema for n, t in tables.items()})
    if not faults.isEmpty():
        raise OSError("a table does not read back as written")
    return written


__all__ = ["annotation_count", "exploded", "graded_check", "one_to_one", "overall", "quality_checks", "reconciled", "require_source", "run", "status_counts"]
