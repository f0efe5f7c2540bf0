"""Hashed term features of texts, and bounded training samples, for the trained operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops as B

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Everything in ASCII but letters and digits separates terms; bytes of other characters belong to terms.
_NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def word_terms(data: np.ndarray, offsets: np.ndarray, bits: int, prefix: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket), once each: lower-cased words, and the first ``prefix`` bytes of longer ones."""
    low = _LOWER[data]
    s, e, doc = B.words(low, offsets, _NOT_ALNUM)
    h = B.prefix_hash(low)
    long = e - s > prefix
    key = np.concatenate((B.mix(B.span_hash(h, s, e), 1), B.mix(B.span_hash(h, s[long], s[long] + prefix), 2)))
    doc = np.concatenate((doc, doc[long])).astype(np.uint64)
    pairs = np.unique((doc << B.U64(bits)) | (key >> B.U64(64 - bits)))
    return (pairs >> B.U64(bits)).astype(np.int64), (pairs & B.U64((1 << bits) - 1)).astype(np.int64)


def gram_terms(data: np.ndarray, offsets: np.ndarray, bits: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every word, and of every run of characters (code points) that stays in its document; with repeats."""
    s, e, doc = B.words(data, offsets)
    h = B.prefix_hash(data)
    words = (B.mix(B.span_hash(h, s, e), 3) >> B.U64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin; a text begins with one
    of = np.searchsorted(offsets, begins, side="right") - 1
    begins = np.append(begins, len(data))
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in grams:
        m = len(of) - n + 1
        if m <= 0:
            continue
        k = np.flatnonzero(of[:m] == of[n - 1 :])
        docs.append(of[k])
        keys.append((B.mix(B.span_hash(h, begins[k], begins[k + n]), 4) >> B.U64(64 - bits)).astype(np.int64))
    return doc, words, np.concatenate(docs), np.concatenate(keys)


def bucketed(column: pa.Array, f) -> Iterator[tuple[int, int, object]]:
    """f(bytes, offsets) over chunks of a text column: (first row, last row + 1, result)."""
    data, offsets = B.binary(column)
    for first, last, d, o in B.chunks(data, offsets):
        yield first, last, f(d, o)


def held_out(doc_id: object) -> bool:
    """Whether crc32 of the id as text is divisible by five; a null id is held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_labels(labels: DataFrame, target: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class, by the order of a hash of the id, and the count of each class.

    Null ids and null labels are left out; an id with several labels has its largest.
    """
    rows = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("_label"))
    counts = {int(r["_label"]): int(r["n"]) for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    parts = [rows.where(F.col("_label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def training_rows(docs: DataFrame, sample: DataFrame, encode, per_class: int) -> list[tuple[int, bytes, bytes]]:
    """(label, packed buckets, packed values) of the sampled documents; at most 2 x ``per_class`` rows reach the driver.

    The sample has that many rows at most, so it may be broadcast. A doc_id that stands in several rows gives the row
    with the smallest hash of its text only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for _, _, part in bucketed(batch.column(2), encode) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "_label", "text", "_keys", "_values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "_label", "text")
    rows = joined.mapInArrow(run, f"doc_id {kind}, _label int, text string, _keys binary, _values binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "_label", "_keys", "_values")).alias("r"))
    found = one.select("doc_id", "r._label", "r._keys", "r._values").collect()
    return [(int(r["_label"]), bytes(r["_keys"]), bytes(r["_values"])) for r in sorted(found, key=lambda r: r["doc_id"])]


def csr(rows: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, row starts, buckets, values) of packed rows, in the width they came in."""
    starts = np.concatenate(([0], np.cumsum([len(k) // 4 for _, k, _ in rows]))).astype(np.int64)
    keys = np.frombuffer(b"".join(k for _, k, _ in rows), np.int32)
    values = np.frombuffer(b"".join(v for _, _, v in rows), np.float32)
    return np.array([y for y, _, _ in rows], np.float64), starts, keys, values


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through scores (Newton steps, with a weak pull towards slope 1)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * scores + b)
        g = np.array([np.sum(weight * (p - y) * scores) + 1e-2 * (a - 1), np.sum(weight * (p - y)) + 1e-2 * b])
        d = weight * p * (1 - p)
        hess = np.array([[np.sum(d * scores * scores) + 1e-2, np.sum(d * scores)], [np.sum(d * scores), np.sum(d) + 1e-2]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)
