"""Guards of a run's inputs: its time, its local model files, and its identifier."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.sources import io


def now() -> datetime:
    """The present time, in UTC and with its zone."""
    return datetime.now(UTC)


def require_zone(at: datetime, name: str = "time") -> datetime:
    """The time itself; one without a zone raises."""
    if at.utcoffset() is None:
        raise ValueError(f"{name} has no time zone")
    return at


def require_zoned_columns(df: DataFrame) -> DataFrame:
    """The table itself; timestamps without a zone, also inside arrays, maps and structs, raise with their names."""

    def faults(kind: T.DataType, name: str) -> list[str]:
        if isinstance(kind, T.TimestampNTZType):
            return [name]
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in faults(f.dataType, f"{name}.{f.name}".lstrip("."))]
        if isinstance(kind, T.ArrayType):
            return faults(kind.elementType, f"{name}[]")
        if isinstance(kind, T.MapType):
            return faults(kind.keyType, f"{name}.key") + faults(kind.valueType, f"{name}.value")
        return []

    found = faults(df.schema, "")
    if found:
        raise TypeError(f"timestamps without a zone: {', '.join(found)}")
    return df


def local_path(path: str) -> str:
    """The path of a model's folder; a repository name, an address or a relative path raises."""
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"{path!r} is no absolute path of a folder")
    return path.rstrip("/") or "/"


def model_card(spark: SparkSession, path: str) -> DataFrame:
    """One row: name, dimension and folder_checksum of a model's folder, whose config.json is read; nothing is fetched.

    The name is the configuration's own, else the folder's. A missing configuration or a dimension that is no whole
    number raises.
    """
    folder = local_path(path)
    if not io.exists(spark, f"{folder}/config.json"):
        raise FileNotFoundError(f"{folder}/config.json")
    text = spark.read.text(f"{folder}/config.json", wholetext=True).first()["value"]  # one small file
    stated = json.loads(text)
    dimension = stated.get("hidden_size")
    if dimension is not None and (isinstance(dimension, bool) or not isinstance(dimension, int)):
        raise ValueError(f"hidden_size is {dimension!r}")
    name = str(stated.get("_name_or_path") or folder.rsplit("/", 1)[1])
    return io.folder_checksum(spark, folder).select(F.lit(name).alias("name"), F.lit(dimension).cast("int").alias("dimension"), F.col("checksum").alias("folder_checksum"), "files")


def run_id(prefix: str, inputs: dict[str, str], settings: dict[str, object], at: datetime, length: int = 24) -> str:
    """prefix-hash over the checksums of the inputs, the settings and a zoned time, whatever the order of the names."""
    body = json.dumps({"inputs": inputs, "settings": settings, "at": require_zone(at).astimezone(UTC).isoformat()}, sort_keys=True, separators=(",", ":"))
    return f"{prefix}-{hashlib.sha256(body.encode()).hexdigest()[:length]}"
