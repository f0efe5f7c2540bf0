"""Datasets that appear whole, the ingestion stage, and sources and sinks of files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from textmill.operators import ingest as N
from textmill.sources import io


@pytest.fixture
def frames(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "doc_id long, text string")
    notes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")], "doc_id long, version int, label string")
    return docs, notes


def fails(frame):
    """A table whose rows cannot be computed."""
    return frame.withColumn("doc_id", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("no row"))).otherwise(F.col("doc_id")).cast("long"))


def test_tables_appear_together_or_not_at_all(spark, frames, tmp_path):
    docs, notes = frames
    path = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        io.read_dataset(spark, path, "docs")
    with pytest.raises(Exception, match="no row"):
        io.write_dataset({"docs": docs, "notes": fails(notes)}, path)
    assert io.dataset_manifest(spark, path) is None  # the first table was staged, but nothing is visible
    written = io.write_dataset({"docs": docs, "notes": notes}, path)
    assert {r["name"]: r["rows"] for r in written.collect()} == {"docs": 3, "notes": 4}
    with pytest.raises(Exception, match="no row"):
        io.write_dataset({"docs": docs.limit(1), "notes": fails(notes)}, path)
    assert io.read_dataset(spark, path, "docs").count() == 3
    schemas = {"docs": docs.schema, "notes": notes.schema}
    assert io.validate_dataset(spark, path, written, schemas).isEmpty()
    for n in (2, 1):
        io.write_dataset({"docs": docs.limit(n), "notes": notes}, path)
    assert io.read_dataset(spark, path, "docs").count() == 1
    assert len(io.names(spark, f"{path}/manifests")) == 2  # the newest two stay
    faults = io.validate_dataset(spark, path, written, schemas)
    assert [r["name"] for r in faults.collect()] == ["docs"]
    (tmp_path / "set" / "stranger.txt").write_text("x")
    with pytest.raises(FileExistsError, match="stranger"):
        io.write_dataset({"docs": docs}, path)


def test_a_published_file_is_never_replaced(spark, tmp_path):
    path = str(tmp_path / "one.json")
    io.publish(spark, path, "first")
    with pytest.raises(FileExistsError):
        io.publish(spark, path, "second")
    assert open(path).read() == "first" and len(io.names(spark, str(tmp_path))) == 1


def test_ingestion_stage(spark, frames, tmp_path):
    docs, notes = frames
    path = str(tmp_path / "stage")
    failed = F.when(F.col("text").isNull(), F.array(F.lit("empty_text"))).otherwise(F.array().cast("array<string>"))
    written = N.run(docs, notes, "doc_id", "version", failed, path)
    assert {r["name"]: r["rows"] for r in written.collect()} == {"documents": 2, "annotations": 3, "quarantine": 1}
    assert sorted((r["doc_id"], r["label"]) for r in io.read_dataset(spark, path, "documents").collect()) == [(1, "b"), (2, "c")]
    one = io.read_dataset(spark, path, "quarantine").first()
    assert one["reasons"] == ["empty_text"] and len(one["payload_checksum"]) == 64 and "text" not in one.asDict()
    with pytest.raises(KeyError, match="4"):
        N.run(docs.union(spark.createDataFrame([(4, "four")], docs.schema)), notes, "doc_id", "version", failed, path)
    with pytest.raises(Exception, match="no row"):
        N.run(docs, notes.withColumn("label", F.when(F.col("version") == 2, F.raise_error(F.lit("no row"))).otherwise(F.col("label"))), "doc_id", "version", failed, path)
    assert io.read_dataset(spark, path, "documents").count() == 2
    flags = spark.createDataFrame([("passed", True, False)], "status string, synthetic boolean, reviewed boolean")
    N.require_source(flags, ("synthetic",))
    with pytest.raises(PermissionError, match="reviewed"):
        N.require_source(flags, ("synthetic", "reviewed"))


def test_policies_and_formats(spark, frames, tmp_path):
    docs, _ = frames
    path = str(tmp_path / "t")
    io.write(docs, path)
    with pytest.raises(Exception, match="exist"):
        io.write(docs, path)
    io.write(docs.orderBy(F.desc("doc_id")), path, policy="identical")
    with pytest.raises(FileExistsError):
        io.write(docs.limit(2), path, policy="identical")
    for codec in ("zstd", "snappy", "none"):
        io.write(docs, f"{path}_{codec}", compression=codec)
        assert io.row_count(spark, f"{path}_{codec}") == 3
    assert io.column_names(spark, path) == ["doc_id", "text"]
    io.write(docs, f"{path}.csv", "csv", nullValue="NULL")
    text = "".join(open(f"{path}.csv/{f}").read() for f in sorted(os.listdir(f"{path}.csv")) if f.endswith(".csv"))
    assert "3,NULL\n" in text and "\r" not in text
    assert io.read_preferred(spark, [f"{path}_missing", f"{path}_zstd", path]).count() == 3
    with pytest.raises(FileNotFoundError):
        io.read_preferred(spark, [f"{path}_missing"])


def test_lines_in_order(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "b.jsonl").write_text('{"id": 3}\n')
    (folder / "a.jsonl").write_text('{"id": 1}\nnonsense\n\n{"other": 5}\n{"id": 2}\n[1]\n')
    rows, malformed = io.read_in_order(spark, str(folder), spark.createDataFrame([], "id long").schema)
    assert [r["id"] for r in rows.orderBy("_file", "_part", "_line").collect()] == [1, 2, 3]
    assert sorted(r["value"] for r in malformed.collect()) == ["[1]", "nonsense", '{"other": 5}']
    (folder / "c.jsonl").write_text('{"id": 4, "SSN": 1}\r\n')
    assert {(r["file"], r["fault"]) for r in io.line_faults(spark, str(folder), ("ssn",)).collect()} == {("c.jsonl", "line ends with CR LF"), ("c.jsonl", "forbidden field ssn")}
    assert [r["path"].rsplit("/", 1)[1] for r in io.large_files(spark, str(folder), 30).collect()] == ["a.jsonl"]


def test_inventory_events_and_quarantine(spark, frames, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("x.json", "y.json"):
        (folder / name).write_text(name)
    assert [r["name"] for r in io.inventory(spark, str(folder), ["y.json", "x.json"]).collect()] == ["x.json", "y.json"]
    with pytest.raises(FileNotFoundError):
        io.inventory(spark, str(folder), ["z.json"])
    log = str(tmp_path / "log")
    for n in range(4):
        io.append_events(spark.createDataFrame([(n, "e")], "id int, kind string").coalesce(1), log, keep=3)
    assert sorted(r["id"] for r in io.read(spark, log, "id int, kind string", "json").collect()) == [1, 2, 3]
    failing = frames[0].withColumn("reasons", F.array(F.lit("short")))
    io.write_quarantine(failing, str(tmp_path / "q"), "doc_id")
    text = "".join(open(f"{tmp_path}/q/records/{f}").read() for f in os.listdir(f"{tmp_path}/q/records") if f.endswith(".json"))
    assert "two" not in text and len([json.loads(x) for x in text.splitlines()]) == 3
    summary = io.read(spark, f"{tmp_path}/q/summary", "quarantine_count long, contains_full_text boolean", "json").first()
    assert tuple(summary) == (3, False)
