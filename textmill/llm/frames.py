"""Small DataFrame helpers of the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size of the plan's leaves (stored bytes for scans, whatever columns are read); runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def group_count(df: DataFrame, target_bytes: int = 3 << 19, least: int = 16) -> int:
    """Number of hash groups so that each holds about ``target_bytes`` of stored input; it follows the input's size alone."""
    return max(least, min(math.ceil(plan_bytes(df) / target_bytes), 1 << 24))


def hash_group(column: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the columns that an operator is about to add (compared as Spark does, case-insensitively)."""
    lowered = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered])


def schema_of(kept: list[T.StructField], fields: list[tuple[str, str]]) -> T.StructType:
    """Kept fields (made nullable) followed by new ones given as (name, DDL type)."""
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept])
    for name, kind in fields:
        out.add(name, T._parse_datatype_string(kind), True)
    return out


def with_fields(df: DataFrame, fields: list[tuple[str, str]]) -> T.StructType:
    """The frame's schema followed by new fields."""
    return schema_of(df.schema.fields, fields)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared folder (``spark.checkpoint.dir``).

    The folder named by the session is used as it is; only where none is named
    (tests, a laptop) does the checkpoint go below the warehouse folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_checkpoints_{uuid.uuid4().hex}"
        sc.setCheckpointDir(named)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame written to ``path``, a new folder in the cluster's shared one, and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` has written and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
