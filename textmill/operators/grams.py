"""Character grams of texts as numbers: Jaccard similarity of pairs, and the most similar texts of a whole table.

A text's grams (three to five characters of the lower-cased text, white space folded, a space at each end) are 64-bit
numbers made in one pass over its characters; a run of three is its characters' own bits, longer ones are mixed. The
retriever holds an inverted index of the queries' grams, in blocks of bounded size, and every text meets it once: shared
grams are counted for all queries of the block, the sizes of both sets give the similarity, and the best k of each
query leave a task. No pair without a common gram is made, and no text is shuffled. A text with so many grams that it
cannot be among the best k of any query so far (its similarity is at most the query's grams over its own) is not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.rank import top_k

LEAST, MOST = 3, 5
#: Grams of queries in one block, eight bytes each and as many for the lists of queries.
BLOCK_GRAMS = 4_000_000
#: Texts after which a task takes the best again.
ROUND = 250
#: Places of a hash table of grams, a power of two.
PLACES = 1 << 18
_U = np.uint64


def folded(text: Column) -> Column:
    """The form that grams are taken of."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), F.lit(" "))


def _mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185) + c * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def gram_numbers(text: str) -> np.ndarray:
    """The sorted distinct grams of a folded text."""
    return np.unique(_grams(text))


def _grams(text: str) -> np.ndarray:
    """The grams of a folded text, with repeats."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    if len(c) < LEAST:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        h = (c[:-2] << _U(42)) | (c[1:-1] << _U(21)) | c[2:]
        parts = [h]
        for n in range(LEAST + 1, MOST + 1):
            if len(c) < n:
                break
            h = _mixed(h[:-1], c[n - 1 :])
            parts.append(h | _U(1 << 63))  # three characters leave the uppermost bit 0
        if len(parts) == 3:
            parts[2] = parts[2] ^ _U(1)
    return np.concatenate(parts)


def _places(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((grams * _U(0x9E3779B97F4A7C15)) >> _U(64 - PLACES.bit_length() + 1)).astype(np.int64)


def _at_least(grams: np.ndarray) -> int:
    """No more than the number of distinct grams, without sorting them: the occupied places of a table."""
    seen = np.zeros(PLACES, bool)
    seen[_places(grams)] = True
    return int(np.count_nonzero(seen))


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 0.0


@F.pandas_udf(T.DoubleType())
def _pair(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[str, np.ndarray] = {}  # one side repeats within a batch
    grams = lambda t: known.setdefault(t, gram_numbers(t)) if t not in known else known[t]
    return pd.Series([_similarity(grams(x), grams(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def pair_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' grams; null counts as empty, and two texts without grams have 0."""
    return _pair(folded(a), folded(b))


def query_blocks(queries: DataFrame, query: str, text: str, block_grams: int = BLOCK_GRAMS) -> list[list[tuple[int, np.ndarray]]]:
    """The queries' grams in blocks that a task can hold; a query that is larger alone makes a block of its own.

    Queries are read in parts by hash, so the driver holds the texts of one part; their grams stay, as they go to
    the tasks.
    """
    size = queries.agg(F.coalesce(F.sum(F.length(text) * 3), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // block_grams))
    out: list[list[tuple[int, np.ndarray]]] = []
    for p in range(parts):
        rows = queries.where(F.col(query).isNotNull()).where(F.pmod(F.xxhash64(query), F.lit(parts)) == p).select(F.col(query).cast("long").alias("q"), folded(F.col(text)).alias("t")).collect()
        block, held = [], 0
        for r in sorted(rows, key=lambda r: r["q"]):
            grams = gram_numbers(r["t"])
            if block and held + len(grams) > block_grams:
                out.append(block)
                block, held = [], 0
            block.append((r["q"], grams))
            held += len(grams)
        if block:
            out.append(block)
    return out


class _Block:
    """An inverted index of a block's queries: sorted grams, and for each the queries that have it."""

    def __init__(self, block: list[tuple[int, np.ndarray]]):
        self.ids = np.array([q for q, _ in block], np.int64)
        self.sizes = np.array([len(g) for _, g in block], np.int64)
        self.lengths = self.sizes / (MOST - LEAST + 1)  # characters, about
        gram = np.concatenate([g for _, g in block])
        owner = np.repeat(np.arange(len(block)), self.sizes)
        order = np.argsort(gram, kind="stable")
        self.owner = owner[order]
        self.grams, at = np.unique(gram[order], return_index=True)
        self.starts = np.append(at, len(gram))
        self.known = np.zeros(PLACES, bool)
        self.known[_places(self.grams)] = True

    def most(self, n: int) -> np.ndarray:
        """What no similarity with a text of n grams or more exceeds; a shared gram is in both."""
        return np.where(n > self.sizes, self.sizes / max(n, 1), 1.0)

    def met(self, grams: np.ndarray) -> np.ndarray:
        """The distinct ones of these grams that a query may have; few others are among them."""
        return np.unique(grams[self.known[_places(grams)]])

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """How many grams each query shares with these."""
        if not len(self.grams) or not len(grams):
            return np.zeros(len(self.ids), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = at[self.grams[at] == grams]
        n = self.starts[hit + 1] - self.starts[hit]
        first = np.repeat(self.starts[hit] - (np.cumsum(n) - n), n)
        return np.bincount(self.owner[first + np.arange(n.sum())], minlength=len(self.ids))


def most_similar(units: DataFrame, unit: str, text: str, queries: DataFrame, query: str, query_text: str, k: int, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """query, unit, score (Jaccard, six places) and rank of the k units of the whole table most similar to each query.

    Units that share no gram with a query are none of its rows; ties go to the smaller unit. Ids are integers; rows with
    a null id are left out.
    """

    def best(block: list[tuple[int, np.ndarray]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _Block(block)
            top = [np.zeros((len(index.ids), 0)), np.zeros((len(index.ids), 0), np.int64)]  # scores and units, best first
            usual = np.log(max(1.0, float(np.median(index.lengths))))
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                # texts about as long as the queries come first: their scores rule most of the others out
                order = np.argsort(np.abs(np.log([max(1, len(t)) for t in texts]) - usual), kind="stable") if texts else np.zeros(0, np.int64)
                for at in range(0, len(order), ROUND):
                    least = top[0][:, k - 1] if top[0].shape[1] >= k else np.full(len(index.ids), -1.0)
                    met, columns = [], []
                    for j in order[at : at + ROUND]:
                        grams = _grams(texts[j])
                        n = _at_least(grams)
                        if not (np.round(index.most(n), 6) >= least).any():
                            continue
                        shared = index.shared(index.met(grams))
                        score = lambda n, shared=shared: np.round(shared / np.maximum(index.sizes + n - shared, 1), 6) + np.where(shared > 0, 0.0, -1.0)
                        if not (score(n) >= least).any():
                            continue
                        columns.append(score(len(np.unique(grams))))
                        met.append(ids[j])
                    if met:
                        rows = np.stack(columns, axis=1)
                        scores = np.concatenate((top[0], rows), axis=1)
                        units_ = np.concatenate((top[1], np.broadcast_to(np.array(met, np.int64), rows.shape)), axis=1)
                        best_ = np.lexsort((units_, -scores), axis=1)[:, :k]
                        top = [np.take_along_axis(scores, best_, 1), np.take_along_axis(units_, best_, 1)]
            q, j = np.nonzero(top[0] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(index.ids[q]), pa.array(top[1][q, j]), pa.array(top[0][q, j])], ["q", "u", "score"])

        return run

    slim = units.where(F.col(unit).isNotNull()).select(F.col(unit).cast("long").alias("u"), folded(F.col(text)).alias("t"))
    found = None
    for block in query_blocks(queries, query, query_text, block_grams):
        one = slim.mapInArrow(best(block), "q long, u long, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = units.sparkSession.createDataFrame([], "q long, u long, score double")
    return top_k(found, "q", "u", "score", k).select(F.col("q").alias(query), F.col("u").alias(unit), "score", "rank")
