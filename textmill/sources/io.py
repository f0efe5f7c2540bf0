"""Typed readers, sinks with an overwrite policy, manifests and file checksums."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLICIES = {"fail": "errorifexists", "overwrite": "overwrite", "append": "append", "ignore": "ignore"}
FORMATS = ("parquet", "json", "csv", "orc")


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    """A table in one of the formats; JSON lines and CSV need a schema, so that no pass over the data infers one."""
    if kind not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    if kind in ("json", "csv") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def read_lenient(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of JSON lines; nothing is dropped silently."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    bad = "_malformed"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    good = parsed.where(F.col(f"r.{bad}").isNull()).select(*[F.col(f"r.`{f.name}`") for f in schema.fields])
    return good, parsed.where(F.col(f"r.{bad}").isNotNull()).select("value")


def read_preferred(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    """The first of several versions of a table that exists."""
    for path in paths:
        if exists(spark, path):
            return read(spark, path, schema, kind)
    raise FileNotFoundError(", ".join(paths))


def read_in_order(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of all JSON-lines files of a folder, with ``_file``, ``_part`` and ``_line``, which give the order of reading.

    A line's place is the part of the file it was read in (where the part starts) and its number there, so files are read
    in parallel, a long one by several tasks. Malformed are lines that are not JSON objects or have none of the fields.
    """
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"), F.col("_metadata.file_block_start").alias("_part"), place.alias("_line"))
    bad = "_malformed"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = lines.where(F.length(F.trim("value")) > 0).withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    some = F.array_contains(F.array(*[F.col(f"r.`{f.name}`").isNotNull() for f in schema.fields]), True)
    good = F.col(f"r.{bad}").isNull() & F.coalesce(some, F.lit(False))
    at = ["_file", "_part", "_line"]
    return parsed.where(good).select(*at, *[F.col(f"r.`{f.name}`") for f in schema.fields]), parsed.where(~good).select(*at, "value")


def write(df: DataFrame, path: str, kind: str = "parquet", policy: str = "fail", partition_by: list[str] | None = None, **options: str) -> None:
    """Write a table; ``policy`` is one of POLICIES or "identical": replace a table only by one with the same rows.

    ``options`` are the writer's (compression, nullValue ...). CSV writes null as an empty field unless told otherwise.
    """
    if policy == "identical":
        if exists(df.sparkSession, path) and not same_rows(read(df.sparkSession, path, df.schema, kind), df):
            raise FileExistsError(f"{path} holds other rows")
        policy = "ignore"
    writer = df.write.mode(POLICIES[policy]).format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"').option("lineSep", "\n")
    for key, value in options.items():
        writer = writer.option(key, value)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_document(df: DataFrame, path: str, kind: str = "json") -> None:
    """One file of few rows (a manifest, a report)."""
    write(df.coalesce(1), path, kind, "overwrite")


def write_dataset(tables: dict[str, DataFrame], path: str, kind: str = "parquet", keep: int = 2) -> DataFrame:
    """Write the named tables below one folder so that all of them become visible together, and return their manifest.

    Tables are staged in a folder of their own and read back; then one file with their manifest is renamed into place,
    which is what readers go by. A run that fails before that leaves what was there. Of the versions the newest ``keep``
    stay. A folder with anything else in it is refused.
    """
    spark = next(iter(tables.values())).sparkSession
    foreign = [n for n in names(spark, path) if n not in ("versions", "manifests")]
    if foreign:
        raise FileExistsError(f"{path} also holds {', '.join(sorted(foreign))}")
    before = _versions(spark, path)
    version = f"v{uuid.uuid4().hex}"
    out = None
    for name, df in tables.items():
        at = f"{path}/versions/{version}/{name}"
        write(df, at, kind, "fail")
        one = manifest(read(spark, at, df.schema, kind), name)
        out = one if out is None else out.unionByName(one)
    rows = [r.asDict() for r in out.collect()]  # one row for each table
    publish(spark, f"{path}/manifests/{(before[-1][0] if before else 0) + 1:08d}.json", json.dumps({"version": version, "kind": kind, "tables": rows}))
    for number, old in before[: max(0, len(before) + 1 - keep)]:
        remove(spark, f"{path}/manifests/{number:08d}.json")
        remove(spark, f"{path}/versions/{old['version']}")
    return spark.createDataFrame(rows, out.schema)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Make a small file appear whole: written under another name, then renamed; an existing one is never replaced."""
    where, fs = _fs(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{uuid.uuid4().hex}")
    stream = fs.create(staged, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(where) or not fs.rename(staged, where):
        fs.delete(staged, False)
        raise FileExistsError(path)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """(number, manifest) of the versions of a dataset, oldest first."""
    found = names(spark, f"{path}/manifests")
    if not found:
        return []
    rows = spark.read.text([f"{path}/manifests/{n}" for n in found], wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("n"), "value").collect()  # one row for each version kept
    return sorted((int(r["n"].split(".")[0]), json.loads(r["value"])) for r in rows)


def dataset_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a dataset's newest version."""
    versions = _versions(spark, path)
    return versions[-1][1] if versions else None


def read_dataset(spark: SparkSession, path: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table of a dataset's newest version."""
    one = dataset_manifest(spark, path)
    if one is None:
        raise FileNotFoundError(f"{path} holds no dataset")
    return read(spark, f"{path}/versions/{one['version']}/{name}", schema, one["kind"])


def holds(spark: SparkSession, path: str, name: str) -> bool:
    """Whether the folder of a table of a dataset's newest version is there."""
    one = dataset_manifest(spark, path)
    return one is not None and exists(spark, f"{path}/versions/{one['version']}/{name}")


def validate_dataset(spark: SparkSession, path: str, expected: DataFrame, schemas: dict[str, T.StructType]) -> DataFrame:
    """Rows of ``expected`` (a manifest) whose table is missing or whose read-back rows or checksum differ."""
    one = dataset_manifest(spark, path)
    found = None
    for name, schema in schemas.items():
        if one is not None and exists(spark, f"{path}/versions/{one['version']}/{name}"):
            part = manifest(read_dataset(spark, path, name, schema), name)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return expected
    return expected.join(found, ["name", "rows", "columns", "checksum"], "left_anti")


def quarantined(failing: DataFrame, key: str) -> DataFrame:
    """key, reasons and a checksum of the payload of failing rows (key, reasons and others); the text itself is left out."""
    payload = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(failing.columns) if c != "reasons"]), {"ignoreNullFields": "false"}), 256)
    return failing.select(key, "reasons", payload.alias("payload_checksum"))


def write_quarantine(failing: DataFrame, path: str, key: str, policy: str = "overwrite") -> None:
    """Failing rows as ``quarantined`` has them, and a summary."""
    write(quarantined(failing, key), f"{path}/records", "json", policy)
    summary = failing.agg(F.count("*").alias("quarantine_count"), F.lit(False).alias("contains_full_text"))
    write_document(summary, f"{path}/summary")


def append_events(events: DataFrame, path: str, most_rows: int = 1_000_000, keep: int | None = None) -> None:
    """Append events as JSON lines, in files of ``most_rows`` at most; of the folder's files the newest ``keep`` stay."""
    write(events, path, "json", "append", maxRecordsPerFile=str(most_rows))
    if keep is not None:
        files = _files(events.sparkSession, path)
        for name, _, _ in sorted(files, key=lambda f: (f[2], f[0]))[: max(0, len(files) - keep)]:
            remove(events.sparkSession, name)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly below a folder, but for hidden and marker files."""
    where, fs = _fs(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files directly below a folder."""
    where, fs = _fs(spark, path)
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith((".", "_"))]


def inventory(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """name, bytes, checksum of the required files of a folder, by name; a missing file or a symbolic link raises."""
    where, fs = _fs(spark, path)
    for name in required:
        one = spark._jvm.org.apache.hadoop.fs.Path(where, name)
        if not fs.exists(one):
            raise FileNotFoundError(f"{path}/{name}")
        if fs.getFileLinkStatus(one).isSymlink():
            raise ValueError(f"{path}/{name} is a symbolic link")
    rows = file_checksums(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.where(F.col("name").isin(*required)).select("name", "bytes", "checksum").orderBy("name")


def large_files(spark: SparkSession, path: str, threshold: int) -> DataFrame:
    """path and bytes of the files above a number of bytes; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.col("length") > threshold).select("path", F.col("length").alias("bytes"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, by count and order-free checksum."""
    return sorted(a.columns) == sorted(b.columns) and manifest(a.select(*sorted(a.columns)), "x").first() == manifest(b.select(*sorted(b.columns)), "x").first()


def row_count(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> int:
    """Rows of a table; of Parquet and ORC Spark reads the footers only."""
    frame = read(spark, path, schema, kind)
    return frame.agg(F.count("*").alias("n")).first()["n"]


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Columns of a Parquet table, from one footer."""
    return spark.read.parquet(path).columns


def line_faults(spark: SparkSession, path: str, forbidden: tuple[str, ...]) -> DataFrame:
    """file and fault of JSON lines that end with CR LF or hold a forbidden field name."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    faults = F.array_compact(F.array(F.when(F.endswith("value", F.lit("\r")), F.lit("line ends with CR LF")), *[F.when(F.contains(F.lower("value"), F.lit(f'"{f}"')), F.lit(f"forbidden field {f}")) for f in forbidden]))
    return lines.select("file", F.explode(faults).alias("fault")).distinct()


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("checksum"))


def folder_checksum(spark: SparkSession, path: str) -> DataFrame:
    """One row: a digest of names and contents that no order of files changes, summed so that no task gathers the files."""
    rows = file_checksums(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "checksum")
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", "name", "checksum"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sha2(F.coalesce(F.sum(one), F.lit(0)).cast("string"), 256).alias("checksum"), F.count("*").alias("files"))


def manifest(df: DataFrame, name: str) -> DataFrame:
    """name, rows, columns and an order-free checksum of a table: the sum of its rows' hashes as an exact decimal."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("checksum"))
