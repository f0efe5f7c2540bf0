"""Configurations from YAML and JSON files: a data source of registries, layered settings, and checks of both.

Files are read where the query is planned, on the driver, since configuration lies beside the program; their entries
travel in the plan, so no executor needs the folder. A file above ``MOST_BYTES`` is refused, so what travels is bounded
by the number of files. JSON needs nothing but Python, YAML the ``yaml`` package.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BYTES = 1 << 20
ENDINGS = (".yaml", ".yml", ".json")
#: What the source adds to the columns of a registry.
PLACE = (("_file", "string"), ("_place", "int"), ("_faults", "array<string>"))

#: The columns of a retrieval configuration, of a remediation configuration and of a prompt contract.
RETRIEVAL = "configuration_id string, name string, active boolean, candidate_strategy string, candidate_top_k int, final_top_k int, complexity_rank int, embedding_provider string, granularity_policy string, reranker string, query_expansion_enabled boolean, abbreviation_expansion_enabled boolean, section_aliases_enabled boolean, negation_features_enabled boolean, numeric_features_enabled boolean, requires_optional_model boolean, weights map<string,double>"
REMEDIATION = "configuration_id string, candidate_retrievers array<string>, character_features array<string>, phrase_features array<string>, proximity_features array<string>, entity_features array<string>, synonym_expansion boolean, pseudo_relevance_feedback boolean, reranker string, diversification boolean, abstention boolean, description string"
PROMPT = "prompt_id string, prompt_version string, purpose string, allowed_input_fields array<string>, required_output_fields array<string>, citation_format string, refusal_rules array<string>, prohibited_content array<string>, maximum_context_size int, maximum_answer_size int, safety_disclaimer string"


class ConfigurationError(ValueError):
    """A configuration file that cannot be read, or a value of the wrong kind."""


def load_mapping(path: str | Path) -> dict:
    """The mapping in a file; an empty file is an empty mapping, anything else than a mapping raises."""
    path = Path(path)
    if path.suffix not in ENDINGS:
        raise ConfigurationError(f"{path}: endings are {', '.join(ENDINGS)}")
    if path.stat().st_size > MOST_BYTES:
        raise ConfigurationError(f"{path} is larger than {MOST_BYTES} bytes")
    text = path.read_text(encoding="utf-8")
    try:
        if path.suffix == ".json":
            found = json.loads(text) if text.strip() else None
        else:
            import yaml

            found = yaml.safe_load(text)
    except Exception as e:
        if isinstance(e, ImportError):
            raise
        raise ConfigurationError(f"{path} is malformed: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigurationError(f"{path} must hold a mapping")
    return found


def coerce(value: object, kind: T.DataType, at: str) -> tuple[object, list[str]]:
    """(value of the kind, faults); a value that is not of the kind is null. Numbers widen, nothing else is converted."""
    wrong = [f"{at}: {type(value).__name__} instead of {kind.simpleString()}"]
    if value is None:
        return None, []
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return None, wrong
        parts = [coerce(v, kind.elementType, f"{at}[{i}]") for i, v in enumerate(value)]
        return [v for v, _ in parts], [f for _, fs in parts for f in fs]
    if isinstance(kind, T.MapType):
        if not isinstance(value, Mapping):
            return None, wrong
        parts = {str(k): coerce(v, kind.valueType, f"{at}.{k}") for k, v in value.items()}
        return {k: v for k, (v, _) in parts.items()}, [f for _, fs in parts.values() for f in fs]
    if isinstance(kind, T.BooleanType):
        return (value, []) if isinstance(value, bool) else (None, wrong)
    if isinstance(value, bool):
        return None, wrong
    if isinstance(kind, (T.IntegerType, T.LongType)):
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        return (value, []) if isinstance(value, int) and -(1 << bits) <= value < 1 << bits else (None, wrong)
    if isinstance(kind, T.DoubleType):
        return (float(value), []) if isinstance(value, (int, float)) and math.isfinite(value) else (None, wrong)
    if isinstance(kind, T.StringType):
        return (value, []) if isinstance(value, str) else (None, wrong)
    raise ConfigurationError(f"{at}: no configuration value is {kind.simpleString()}")


def typed(entry: object, schema: T.StructType, at: str) -> tuple[list, list[str]]:
    """(values in the schema's order, faults) of an entry: wrong kinds and unknown keys are faults, missing keys are null."""
    if not isinstance(entry, Mapping):
        return [None] * len(schema), [f"{at}: not a mapping"]
    values, faults = [], []
    for f in schema.fields:
        value, wrong = coerce(entry.get(f.name), f.dataType, f.name)
        values.append(value)
        faults += wrong
        if f.name not in entry and not f.nullable:
            faults.append(f"{f.name}: missing")
    return values, faults + [f"{k}: unknown key" for k in sorted(map(str, set(entry) - {f.name for f in schema.fields}))]


class _File(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, path: str, entries: str | None, schema: T.StructType):
        self.path, self.entries, self.schema = path, entries, schema

    def partitions(self) -> list[InputPartition]:
        where = Path(self.path)
        files = sorted(p for p in where.iterdir() if p.suffix in ENDINGS) if where.is_dir() else [where]
        return [_File(self._rows(f)) for f in files]

    def _rows(self, file: Path) -> list[tuple]:
        found = load_mapping(file)
        entries = found.get(self.entries) if self.entries else [found]
        if not isinstance(entries, list):
            raise ConfigurationError(f"{file}: {self.entries} must be a list")
        added = {name for name, _ in PLACE}
        own = T.StructType([f for f in self.schema.fields if f.name not in added])
        out = []
        for i, entry in enumerate(entries):
            values, faults = typed(entry, own, f"entry {i}")
            row = dict(zip(own.names, values, strict=True)) | {"_file": file.name, "_place": i, "_faults": faults}
            out.append(tuple(row[n] for n in self.schema.names))
        return out

    def read(self, partition: InputPartition):
        yield from partition.rows


class RegistrySource(DataSource):
    """``spark.read.format("registry").schema(...).option("entries", key).load(path)``.

    ``path`` is a file or a folder of files; with ``entries`` each file has a list of entries under that key, without
    it a file is one entry. ``_file``, ``_place`` and ``_faults`` of the schema are filled by the source.
    """

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        raise ConfigurationError("a registry needs a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if "path" not in self.options:
            raise ConfigurationError("a registry needs a path")
        return _Reader(self.options["path"], self.options.get("entries"), schema)


def read_registry(spark: SparkSession, path: str, columns: str, entries: str | None = None) -> DataFrame:
    """Entries with the given columns, and ``_file``, ``_place`` and ``_faults``."""
    spark.dataSource.register(RegistrySource)
    reader = spark.read.format("registry").schema(columns + "".join(f", {n} {k}" for n, k in PLACE))
    return (reader.option("entries", entries) if entries else reader).load(str(path))


def registry_faults(registry: DataFrame, key: str) -> DataFrame:
    """_file, key and fault: what the source found, entries without a key, and keys that stand twice."""
    twice = registry.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min("_file").alias("_file")).where("_n > 1")
    own = registry.select("_file", F.col(key), F.explode(F.concat("_faults", F.array_compact(F.array(F.when(F.col(key).isNull(), F.lit(f"{key}: missing"))))))).toDF("_file", key, "fault")
    return own.unionByName(twice.select("_file", key, F.lit(f"{key}: stands twice").alias("fault")))


def remediation_features(registry: DataFrame) -> DataFrame:
    """configuration_id, complexity (the entry's place) and the boolean of each feature that ``experiments`` scores by."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return registry.select(
        "configuration_id", (F.col("_place") + 1).alias("complexity"),
        some("character_features").alias("character"), some("phrase_features").alias("phrase"), some("proximity_features").alias("proximity"),
        on("synonym_expansion").alias("synonym"), on("pseudo_relevance_feedback").alias("feedback"), some("entity_features").alias("entity"),
        # Fusion by ranks is a way to join retrievers, not a second scoring.
        F.coalesce(~F.col("reranker").isin("none", "rrf"), F.lit(False)).alias("rerank"), on("diversification").alias("diversify"), on("abstention").alias("abstain"),
    )


def retrieval_settings(registry: DataFrame) -> DataFrame:
    """The columns of ``experiments.retrieval_configurations`` of the active entries."""
    return registry.where(F.coalesce("active", F.lit(True))).select(
        "configuration_id", F.col("candidate_strategy").alias("strategy"), F.col("embedding_provider").alias("provider"), F.col("granularity_policy").alias("granularity"),
        "reranker", F.col("candidate_top_k").alias("candidates"), F.col("complexity_rank").alias("complexity"), F.col("requires_optional_model").alias("needs_model"),
    )


def settings(defaults: dict, path: str | Path | None = None, environment: Mapping[str, str] | None = None, prefix: str = "TEXTMILL_") -> dict:
    """``defaults``, then the values of a file, then those of the environment (``PREFIX_SECTION__KEY``, JSON or plain text).

    A key that the defaults do not have, or a value of another kind than the default's, raises; null defaults take any value.
    """
    out = _layered(defaults, load_mapping(path) if path is not None else {}, "")
    for name, text in sorted((environment or {}).items()):
        if not name.startswith(prefix):
            continue
        value: object = text
        keys = name[len(prefix) :].lower().split("__")
        at = defaults
        for k in keys[:-1]:
            at = at.get(k) if isinstance(at, Mapping) else None
        if not (isinstance(at, Mapping) and isinstance(at.get(keys[-1]), str)):
            try:
                value = json.loads(text)
            except ValueError:
                value = text
        for k in reversed(keys):
            value = {k: value}
        out = _layered(out, value, "")
    return out


def _layered(below: dict, above: dict, at: str) -> dict:
    out = dict(below)
    for key, value in above.items():
        name = f"{at}{key}"
        if key not in below:
            raise ConfigurationError(f"{name}: unknown setting")
        was = below[key]
        if isinstance(was, Mapping):
            if not isinstance(value, Mapping):
                raise ConfigurationError(f"{name}: must be a mapping")
            out[key] = _layered(was, value, f"{name}.")
            continue
        widened = isinstance(was, float) and type(value) is int
        if was is not None and type(value) is not type(was) and not widened:
            raise ConfigurationError(f"{name}: {type(value).__name__} instead of {type(was).__name__}")
        out[key] = float(value) if widened else value
    return out


def settings_rows(spark: SparkSession, values: dict) -> DataFrame:
    """name (dotted) and value (JSON text) of every setting, by name."""
    flat: list[tuple[str, str]] = []

    def walk(value: object, at: str) -> None:
        if isinstance(value, Mapping) and value:
            for k, v in value.items():
                walk(v, f"{at}.{k}" if at else k)
        else:
            flat.append((at, json.dumps(value, sort_keys=True)))

    walk(values, "")
    return spark.createDataFrame(sorted(flat), "name string, value string")


def setting_checks(rows: DataFrame) -> DataFrame:
    """check_id and status of the seven predicates over the settings of a service; a missing setting fails its check."""
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    number = lambda name: F.coalesce(of(name).cast("double") > 0, F.lit(False))
    true = lambda name: F.coalesce(of(name) == "true", F.lit(False))
    wild: Column = (F.coalesce(of("api_host"), F.lit('"0.0.0.0"')) == '"0.0.0.0"') | (F.coalesce(of("dashboard_host"), F.lit('"0.0.0.0"')) == '"0.0.0.0"')
    unsafe = true("allow_unsafe_local_binding")
    origins = F.from_json(F.coalesce(of("allowed_origins"), F.lit('["*"]')), "array<string>")
    root = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), of("event_root"), F.lit("}")), "$.v"), F.lit("/"))
    checks = {
        "localhost_default_binding": ~wild | unsafe,
        "wildcard_cors_rejected": ~F.coalesce(F.array_contains(origins, "*"), F.lit(True)) & ~true("cors_enabled"),
        "positive_timeouts": number("query_timeout_seconds") & number("trace_timeout_seconds"),
        "positive_concurrency": number("maximum_concurrent_queries"),
        "rate_limit_safe": number("rate_limit_requests") & number("rate_limit_window_seconds"),
        "event_root_local": ~root.rlike(r"^(/|\\|[A-Za-z][A-Za-z0-9+.-]*:)"),
        "unsafe_override_default_false": ~unsafe,
    }
    one = rows.agg(*[F.when(ok, F.lit("passed")).otherwise(F.lit("failed")).alias(name) for name, ok in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(n).alias("status")) for n in checks])).alias("c")).select("c.*")


def contract_violations(answers: DataFrame, contracts: DataFrame, purpose: str = "purpose", text: str = "answer_text") -> DataFrame:
    """The answers' columns and ``violation``, a row for each breach of the prompt contract of the answer's purpose.

    Breaches: no contract of that purpose, an answer longer than allowed, an answer that holds prohibited content (in any
    case), a required field that the answers lack. A null answer has length 0 and holds nothing; a null purpose has no contract.
    Contracts are few (their files' entries), so Spark may send them to the answers; of one purpose the first by id counts.
    """
    first = contracts.where("purpose IS NOT NULL").groupBy("purpose").agg(F.min_by(F.struct("required_output_fields", "prohibited_content", "maximum_answer_size"), "prompt_id").alias("_c"))
    have = F.array(*[F.lit(c) for c in answers.columns])
    # The user's columns travel in one struct, so no name of theirs meets one of this function's.
    rows = answers.select(F.struct(*[F.col(f"`{c}`") for c in answers.columns]).alias("_row"), F.col(f"`{purpose}`").alias("_purpose"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    joined = rows.join(first, rows["_purpose"] == first["purpose"], "left")
    none = F.array().cast("array<string>")
    held = F.filter(F.coalesce("_c.prohibited_content", none), lambda p: (p != "") & F.contains(F.lower("_text"), F.lower(p)))
    lacking = F.array_except(F.coalesce("_c.required_output_fields", none), have)
    found = F.concat(
        F.array_compact(F.array(F.when(F.col("_c").isNull(), F.lit("no contract")), F.when(F.length("_text") > F.col("_c.maximum_answer_size"), F.lit("answer too long")))),
        F.transform(held, lambda p: F.concat(F.lit("prohibited: "), p)),
        F.transform(lacking, lambda f: F.concat(F.lit("missing field: "), f)),
    )
    return joined.select("_row", F.explode(found).alias("_violation")).select(*[F.col(f"_row.`{c}`").alias(c) for c in answers.columns if c != "violation"], F.col("_violation").alias("violation"))
