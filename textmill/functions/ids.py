"""Identifiers and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sign between the parts of a stable identifier.
SEPARATOR = "␟"


def checksum_text(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """prefix-hash of the parts, which a separator sign keeps apart."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts]), 256), 1, length))


def quoted_id(prefix: str, text: Column, length: int = 32) -> Column:
    """Identifier over the JSON string of an ASCII text without control characters."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(quoted, 256), 1, length))


def unsigned_prefix(digest: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of a digest as an exact decimal."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)")


def numbered_id(prefix: str, digest: Column, width: int = 6) -> Column:
    """prefix-NNNNNN from a digest, 1 at least."""
    return F.concat(F.lit(prefix + "-"), F.lpad((F.pmod(unsigned_prefix(digest), F.lit(10**width - 1)) + 1).cast("bigint").cast("string"), width, "0"))


def row_checksum(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
