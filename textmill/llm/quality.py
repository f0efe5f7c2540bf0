"""Quality rules: exact base counts, and a calibrated logistic regression over hashed n-grams.

The model sees the share of each hashed word among a text's words and of each
hashed character n-gram (of code points) among its n-grams. It is trained by AdaGrad on at most
``per_class`` labelled rows of each class, and a logistic curve fitted on a part
of the sample that was not trained on turns its output into a probability, with
class weights that bring the sample back to the shares of all labelled rows. The
model has a fixed size; texts are scored in Arrow batches against a fixed
threshold, with no shuffle.

Lines and windows of words are grouped by 64-bit hashes inside one text, and each
group is compared with its first member by its bytes; a text in which two
different ones share a hash is counted by its strings. Defined cases: null text
has no word and no line; a text that fails a base rule is not kept whatever the
model says; without labelled rows of both classes the model keeps every text; an
empty table gives no row; repeated rows are judged alike; a batch holds some
texts at a time and a very long text is one of its own; columns named like an
output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops as B
from textmill.llm.frames import schema_of
from textmill.llm.hashed import bucketed, csr, gram_terms, held_out_column, platt, sample_labels, sigmoid, training_rows

BITS = 17
GRAMS = (3, 4)
PER_CLASS = 2500
EPOCHS = 12
THRESHOLD = 0.5
WINDOW = 8
#: The characters that count as symbols, and the base rules' limits.
SYMBOLS = B.separators(b"#*$%&|<>")
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]+")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document, as rows."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    if not len(data):
        return out
    s, e, doc = B.words(data, offsets)
    out[:, 0] = np.bincount(doc, minlength=n)
    before = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    in_word = before(~B.SPACES[data] & ((data & 0xC0) != 0x80))
    symbols = before(SYMBOLS[data])
    out[:, 1] = in_word[offsets[1:]] - in_word[offsets[:-1]]
    out[:, 2] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    h = B.prefix_hash(data)
    # Lines with a word that equal an earlier line of their text.
    newline = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.sort(np.concatenate((offsets[full], newline + 1)))
    ends = np.sort(np.concatenate((newline, offsets[full + 1])))
    line_doc = np.sort(np.concatenate((full, np.searchsorted(offsets, newline, side="right") - 1)))
    use = in_word[ends] > in_word[starts]
    starts, ends, line_doc = starts[use], ends[use], line_doc[use]
    again, first = _grouped(line_doc, B.span_hash(h, starts, ends))
    out[:, 3] = np.bincount(line_doc[again], minlength=n)
    unsure = set(line_doc[again][~_equal(data, starts, ends, again, first)].tolist())
    # Words under windows that stand in their text more than once.
    if len(s) >= window:
        word = B.prefix_hash_of(B.span_hash(h, s, e))
        at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
        again, first = _grouped(doc[at], B.mix((word[at + window] - word[at]) * B.inverse_powers(len(word))[at]))
        twice = np.unique(np.concatenate((at[again], at[first])))
        change = np.bincount(twice, minlength=len(s) + 1) - np.bincount(twice + window, minlength=len(s) + 1)[: len(s) + 1]
        out[:, 4] = np.bincount(doc[np.cumsum(change)[: len(s)] > 0], minlength=n)
        # Neighbouring windows share words, so each pair of words is compared once.
        k = np.arange(window, dtype=np.int64)
        pairs = np.unique(((at[again][:, None] + k) << 32 | (at[first][:, None] + k)).ravel())
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        unsure |= set(doc[a][~_equal(data, s, e, a, b)].tolist())
    for i in unsure:
        out[i, 3:] = _by_strings(data[offsets[i] : offsets[i + 1]].tobytes(), window)
    return out


def _grouped(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries that are not the first with their key in their document, and that first entry of each."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return order[~new], head[~new]


def _equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the spans a[i] and b[i] have the same bytes."""
    size = ends[a] - starts[a]
    same = size == ends[b] - starts[b]
    same[same] = B.same_bytes(data, starts[a[same]], starts[b[same]], size[same])
    return same


def _by_strings(raw: bytes, window: int) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text, without hashes."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    words = [w for w in _SPACE.split(raw) if w]
    runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    count = Counter(runs)
    under = {j for i, r in enumerate(runs) if count[r] > 1 for j in range(i, i + window)}
    return len(lines) - len(set(lines)), len(under)


@dataclass
class Quality:
    """Weights of word buckets, then of n-gram buckets; the calibrated output is sigmoid(slope x + offset)."""

    w: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, data: np.ndarray, offsets: np.ndarray, bits: int, grams: tuple[int, ...]) -> np.ndarray:
        n = len(offsets) - 1
        doc, words, gram_doc, keys = gram_terms(data, offsets, bits, grams)
        x = np.full(n, self.bias)
        for d, weights in ((doc, self.w[words]), (gram_doc, self.w[(1 << bits) + keys])):
            x += np.bincount(d, weights=weights, minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)
        return sigmoid(self.slope * x + self.offset)


def _shares(bits: int, grams: tuple[int, ...]):
    def encode(data: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, bytes]]:
        n = len(offsets) - 1
        doc, words, gram_doc, keys = gram_terms(data, offsets, bits, grams)
        total = np.stack([np.bincount(doc, minlength=n), np.bincount(gram_doc, minlength=n)])
        key = np.concatenate((words, (1 << bits) + keys)).astype(np.uint64)
        of = np.concatenate((doc, gram_doc)).astype(np.uint64)
        pairs, count = np.unique((of << B.U64(32)) | key, return_counts=True)
        of, key = (pairs >> B.U64(32)).astype(np.int64), (pairs & B.U64(0xFFFFFFFF)).astype(np.int64)
        share = (count / total[(key >> bits).clip(0, 1), of]).astype(np.float32)
        cut = np.searchsorted(of, np.arange(n + 1))
        return [(key[a:b].astype(np.int32).tobytes(), share[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    return encode


def train_quality(y: np.ndarray, starts: np.ndarray, bucket: np.ndarray, value: np.ndarray, share: float, bits: int = BITS, epochs: int = EPOCHS) -> Quality:
    """AdaGrad on four fifths of the rows, calibration on the rest; ``share`` is the true share of class 1."""
    w, g = np.zeros(2 << bits), np.full(2 << bits, 1e-8)
    bias, gb = 0.0, 1e-8
    rng = np.random.default_rng(11)
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    rows_in = np.flatnonzero(~held)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    score = lambda rows: bias + _dot(w, starts, bucket, value, rows)
    for _ in range(epochs):
        order = rng.permutation(rows_in)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            r, k = B.ragged(np.diff(starts)[rows])
            cell = starts[rows][r] + k
            d = (sigmoid(bias + np.bincount(r, weights=w[bucket[cell]] * value[cell], minlength=len(rows))) - y[rows]) / len(rows)
            keys, index = np.unique(bucket[cell], return_inverse=True)
            grad = np.bincount(index, weights=d[r] * value[cell], minlength=len(keys)) + 1e-7 * w[keys]
            g[keys] += grad**2
            w[keys] -= 1.0 * grad / np.sqrt(g[keys])
            gb += d.sum() ** 2
            bias -= 0.1 * d.sum() / np.sqrt(gb)
    rows = np.flatnonzero(held) if held.any() else rows_in
    slope, offset = platt(score(rows), y[rows], weight[rows])
    return Quality(w.astype(np.float32), float(bias), slope, offset)


def _dot(w: np.ndarray, starts: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
    r, k = B.ragged(np.diff(starts)[rows])
    cell = starts[rows][r] + k
    return np.bincount(r, weights=w[bucket[cell]] * value[cell], minlength=len(rows))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> Quality | None:
    """Train on labelled rows outside the fifth that crc32 holds out; None if a class has no row."""
    sample, counts = sample_labels(labels.where(~held_out_column()).select("doc_id", "quality"), "quality", per_class)
    y, starts, bucket, value = csr(training_rows(docs, sample, _shares(bits, grams), per_class))
    if not len(y) or y.min() == y.max():
        return None
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return train_quality(y, starts, bucket, value, min(max(share, 1e-4), 1 - 1e-4), bits)


def quality_rules(docs: DataFrame, model: Quality | None, threshold: float = THRESHOLD, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """All rows and columns of ``docs`` with the base counts, base_failed, probability and kept."""
    new = [*[(c, "long") for c in _COUNTS], ("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean")]
    names = [c for c in docs.columns if c.lower() not in {n for n, _ in new}]
    at = names.index("text")
    schema = schema_of([docs.schema[c] for c in names], new)

    def both(data: np.ndarray, offsets: np.ndarray):
        p = model.probability(data, offsets, bits, grams) if model is not None else np.ones(len(offsets) - 1)
        return base_counts(data, offsets), p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, p = np.zeros((batch.num_rows, 5), np.int64), np.zeros(batch.num_rows)
            for first, last, (c, q) in bucketed(batch.column(at), both):
                counts[first:last], p[first:last] = c, q
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(counts[:, i]) for i in range(5)], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
