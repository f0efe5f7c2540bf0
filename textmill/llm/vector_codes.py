"""Product codes of vectors, with exact integer assignments behind a float32 screen.

Each component x becomes the integer floor(1024 x). Vectors are cut into ``parts``
equal consecutive parts, each with a codebook that starts as that part of the
``entries`` vectors with the smallest ids. A round gives every part the nearest
entry of its codebook (squared Euclidean distance, ties to the lower index) and
replaces each entry by the componentwise floor of its parts' mean; entries that
none chose stay. After ``rounds`` rounds parts are assigned once more.

The nearest entry is found in two steps. A float32 matrix product gives every
inner product at once; its rounding error is bounded by gamma(d + 2) |x| |c|
(whatever the order of summation, conversion of the integers included), which
makes an interval around each distance. Entries whose interval overlaps the
interval of the best are evaluated again in 64-bit integers, and the smallest
exact distance with the lowest index wins. An overflow in float32 gives an
interval without bounds, so such entries are always evaluated again.

Rounds are map-only scans: a task sends its sums and counts for each entry (a
fixed size, whatever it read), Spark adds them and the driver, which holds only
the codebooks, divides. Nothing depends on the order of rows or on retries. Sums
are added as decimals of two 31-bit halves, so that no number of rows passes
their range.

Defined cases: rows whose vector is null, has a null or non-finite component, a
component of 2^52 or more in magnitude (it has no 64-bit integer) or another
length than most vectors (ties: the greater) are dropped; a length that ``parts``
does not divide is filled with zeros; rows with a null id are coded, but give no
first entry while there are ids; repeated ids are rows of their own, ordered by
their components; with fewer rows than entries the codebooks are shorter; an
error or a label's sum beyond 64 bits is null; null labels are summed together;
without a label column every row has a null label; an empty table gives no row;
columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.frames import drop_clashing, schema_of

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 2048
#: Magnitudes from here on have no 64-bit integer after scaling.
TOO_LARGE = float(1 << 52)
_LONG = (1 << 63) - 1
_HALF = 31


def usable(vector: str, length: int | None = None) -> Column:
    """Whether a vector has no null, non-finite or too large component (and this length)."""
    v = F.col(f"`{vector}`")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))
    return good if length is None else good & (F.size(v) == length)


def integers(column: pa.Array, dim: int, parts: int = PARTS) -> np.ndarray:
    """floor(1024 x) of vectors of one length, as (rows, parts, width), filled up with zeros."""
    width = -(-dim // parts)
    out = np.zeros((len(column), parts * width), np.int64)
    if dim and len(column):
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[:, :dim] = np.floor(values.reshape(len(column), dim) * SCALE).astype(np.int64)
    return out.reshape(len(column), parts, width)


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in 64-bit integers, or in Python's where those could overflow."""
    if x.size and x.shape[1] * (int(np.abs(x).max()) + int(np.abs(c).max())) ** 2 > _LONG:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=1) if d.shape[1] else np.zeros(len(d), np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; int64 arrays, distances as objects where they need it."""
    n, d = x.shape
    unit = 2.0**-24
    gamma = (d + 2) * unit / (1 - (d + 2) * unit)
    c = book.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        c_squares = (c * c).sum(axis=1)
        c_norm = np.sqrt(c_squares)
        c32 = book.astype(np.float32).T.copy()
    index, distance = np.zeros(n, np.int64), []
    for at in range(0, n, BLOCK):
        part = x[at : at + BLOCK]
        with np.errstate(over="ignore", invalid="ignore"):
            f = part.astype(np.float64)
            x_norm = np.sqrt((f * f).sum(axis=1))
            middle = c_squares - 2.0 * (part.astype(np.float32) @ c32).astype(np.float64)
            # twice the product's error, and the float64 steps of this line and of the norms with room to spare
            error = 2.0 * gamma * (1 + 1e-9) * x_norm[:, None] * c_norm + 1e-12 * (c_squares + x_norm[:, None] * c_norm)
            best = (middle + error).min(axis=1)
            row, entry = np.nonzero(~(middle - error > best[:, None]))
        found = exact_distances(part[row], book[entry])
        order = np.lexsort((entry, found, row)) if found.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], found[i], entry[i])), np.int64)
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        index[at : at + BLOCK] = entry[first]
        distance.append(found[first])
    if not distance:
        return index, np.zeros(0, np.int64)
    return index, np.concatenate(distance) if len({a.dtype for a in distance}) == 1 else np.concatenate([a.astype(object) for a in distance])


def _first_entries(rows: DataFrame, vector: str, id_column: str, dim: int, parts: int, entries: int) -> np.ndarray:
    """The starting codebooks, (parts, entries, width), in the driver: ``entries`` vectors at most."""
    found = rows.select(F.col(f"`{id_column}`").alias("i"), F.col(f"`{vector}`").cast("array<double>").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    return integers(pa.array([r["v"] for r in found], pa.list_(pa.float64())), dim, parts).transpose(1, 0, 2)


def _sums(rows: DataFrame, vector: str, dim: int, books: np.ndarray) -> np.ndarray:
    """(parts, entries, 1 + width): how many parts chose each entry, and their sums, as Python integers."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width, 2), np.int64)
        for batch in batches:
            x = integers(batch.column(0), dim, parts)
            for p in range(parts):
                index, _ = nearest(x[:, p], books[p])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if not len(used):
                    continue
                y = np.concatenate((np.ones((len(index), 1), np.int64), x[:, p]), axis=1)[order]
                total[p, used, :, 0] += np.add.reduceat(y >> _HALF, starts)
                total[p, used, :, 1] += np.add.reduceat(y & ((1 << _HALF) - 1), starts)
        p, e = np.nonzero(total[:, :, 0, 1])
        if len(p):
            k = np.arange(1 + width)
            cell = ((p * entries + e)[:, None] * (1 + width) + k).ravel()
            high, low = total[p, e, :, 0].ravel(), total[p, e, :, 1].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(high), pa.array(low)], ["cell", "high", "low"])

    sent = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(run, "cell long, high long, low long")
    added = sent.groupBy("cell").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]).collect()
    out = np.zeros(books.shape[:2] + (1 + width,), object)
    for r in added:
        out.reshape(-1)[r["cell"]] = (int(r["high"]) << _HALF) + int(r["low"])
    return out


def fit_codebooks(rows: DataFrame, vector: str, id_column: str, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after all rounds, (parts, entries, width) of int64; ``rows`` are usable ones of length ``dim``."""
    books = _first_entries(rows, vector, id_column, dim, parts, entries)
    for _ in range(rounds if books.size else 0):
        sums = _sums(rows, vector, dim, books)
        for p, e in zip(*np.nonzero(sums[:, :, 0]), strict=True):
            books[p, e] = [s // sums[p, e, 0] for s in sums[p, e, 1:]]
    return books


def books_sha256(books: np.ndarray) -> str:
    """Hash of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def common_length(df: DataFrame, vector: str) -> int | None:
    """The length that most usable vectors have, the greater of equals; None without any."""
    sizes = df.where(usable(vector)).groupBy(F.size(F.col(f"`{vector}`")).alias("d")).count()
    found = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return None if found is None else int(found["d"])


def vector_codes(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Columns of the usable rows but the vector, then code, error, label_error and codebooks_sha256.

    ``code`` has two hexadecimal digits for each part. The label sums are added within tasks before they are
    shuffled and joined back; rows of one label are never gathered.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part, so 256 entries at most")
    added = ["code", "error", "label_error", "codebooks_sha256"]
    dim = common_length(df, vector)
    rows = df.where(usable(vector, dim if dim is not None else -1))
    books = fit_codebooks(rows, vector, id_column, dim or 0, parts, entries, rounds)
    kept = [c for c in drop_clashing(df, added).columns if c.lower() != vector.lower()]
    schema = schema_of([df.schema[c] for c in kept], [("code", "string"), ("error", "long")])
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(batch.num_columns - 1), dim or 0, parts)
            code, error = np.full(len(x), "", dtype=object), np.zeros(len(x), object)
            for p in range(parts if len(x) else 0):
                index, distance = nearest(x[:, p], books[p])
                code, error = code + hexes[index].astype(object), error + distance
            errors = pa.array([e if e <= _LONG else None for e in error.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code.tolist(), pa.string()), errors], schema.names)

    coded = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vector}`").cast("array<double>").alias(vector)).mapInArrow(run, schema)
    by = F.col(f"`{label}`") if label in kept else F.lit(None).cast("int")
    # a null label has a key of its own, so that equal labels meet by an equality that can be split
    key = [by.isNull().alias("_null"), (F.coalesce(by, F.lit(0).cast(df.schema[label].dataType)) if label in kept else F.lit(0)).alias("_key")]
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when((F.count("error") == F.count(F.lit(1))) & (total <= _LONG), total.cast("long")).alias("_sum")
    sums = coded.groupBy(*key).agg(whole)
    out = coded.select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("_row"), *key).join(sums, ["_null", "_key"])
    return out.select(*[F.col(f"_row.`{c}`") for c in schema.names], F.col("_sum").alias("label_error"), F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB SQL of the query: one pair of steps for each round."""
    kept = "list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)"
    parts = ", ".join(f"row({p}, list_transform(embedding[{p} * len(embedding) // {PARTS} + 1 : {p + 1} * len(embedding) // {PARTS}], lambda x: floor({SCALE} * x::DOUBLE)::BIGINT))" for p in range(PARTS))
    steps = [
        f"kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND {kept})",
        f"cut AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS n, unnest([{parts}]) AS pv FROM kept)",
        "parts AS (SELECT vec_id, label, n, pv[1] AS p, pv[2] AS v FROM cut)",
        f"book0 AS (SELECT p, n - 1 AS e, v AS c FROM parts WHERE n <= {ENTRIES})",
    ]
    square = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        steps.append(f"near{r} AS (SELECT n, p, min(row({square}, e)) AS best FROM parts JOIN book{r} USING (p) GROUP BY n, p)")
        if r < ROUNDS:
            steps += [
                f"long{r} AS (SELECT p, best[2] AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM parts JOIN near{r} USING (n, p))",
                f"mean{r} AS (SELECT p, e, list(floor_div ORDER BY i) AS c FROM (SELECT p, e, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_div FROM long{r} GROUP BY p, e, i) GROUP BY p, e)",
                f"book{r + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))",
            ]
    last = ROUNDS
    steps += [
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})",
        f"coded AS (SELECT n, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{last} GROUP BY n)",
        "flat AS (SELECT DISTINCT n, vec_id, label FROM cut)",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM flat JOIN coded USING (n), digest"


SQL = _sql()
