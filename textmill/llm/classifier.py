"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into tokens: runs of letters and digits (with all characters beyond
ASCII) and runs of other characters, white space between them dropped. Its terms
are the hashes of one and of two neighbouring tokens, and of up to three
neighbouring token kinds (how a word is capitalised, whether it has digits, the
characters of a run of signs, whether the token stood here one or two places
before), so that a text of unseen words has known terms too. A term's value is its
count divided by the Euclidean length of the text's counts.

FTRL-proximal keeps two numbers for each bucket, the sum of gradients (corrected
by the steps already taken) and the sum of their squares; a weight follows from
them when a row needs it, and the L1 part keeps the weights of terms without
evidence at exactly 0. Rows come one by one in a fixed order of a hash, weighted so
that the classes have the shares of all usable labels. The model is the
nonzero weights; scoring is a sparse dot product for each text in Arrow batches,
without a shuffle.

Bounds: at most ``per_class`` labelled rows of each class are trained on, each
with the ``most_terms`` terms of smallest hash (values are those of the whole
text), so the driver holds at most 2 x 12 bytes x per_class x most_terms. Scores
read whole texts.

Defined cases: null text counts as empty; a text without terms gets the score of
the bias; without usable labels of both classes every score is the share of class
1, or 0 without any; an id with several labels has its largest; null ids and null
labels train nothing; rows are scored one by one, so ties and repeated rows need no
rule; an empty table gives no row; a very long text is a batch of its own; columns
named like an output are replaced; held-out rows are never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops as B
from textmill.llm.frames import schema_of
from textmill.llm.hashed import bucketed, csr, held_out_column, sample_labels, sigmoid, training_rows

BITS = 20
PER_CLASS = 2500
MOST_TERMS = 4096
EPOCHS = 3
THRESHOLD = 0.3
#: FTRL-proximal: learning rate, its offset, and the strength of both penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1e-3

_SPACE, _WORD, _SIGN = 0, 1, 2
_CLASS = np.array([_SPACE if i in (9, 10, 11, 12, 13, 32) else _WORD if i >= 128 or chr(i).isalnum() else _SIGN for i in range(256)], np.int8)
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_BEGINS = np.array([(i & 0xC0) != 0x80 for i in range(256)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of one class that is not white space; runs end with their document."""
    kind = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    edges = offsets[:-1]
    first[edges[edges < len(data)]] = True
    s = np.flatnonzero(first)
    e = np.append(s[1:], len(data))
    use = kind[s] != _SPACE
    s, e = s[use], e[use]
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def ngram_terms(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value), ordered by document and bucket."""
    s, e, doc = tokens(data, offsets)
    word = B.span_hash(B.prefix_hash(data), s, e)
    total = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    upper, digit, chars = (c[e] - c[s] for c in map(total, (_UPPER[data], _DIGIT[data], _BEGINS[data])))
    kind = np.where(digit > 0, 4, np.where(upper == 0, 0, np.where((upper == chars) & (chars > 1), 2, np.where((upper == 1) & _UPPER[data[s]], 1, 3)))).astype(np.uint64)
    sign = _CLASS[data[s]] == _SIGN
    kind[sign] = word[sign]
    same = np.zeros(len(s), np.uint64)
    for back in (1, 2):
        same[back:] |= ((word[back:] == word[:-back]) & (doc[back:] == doc[:-back])).astype(np.uint64)
    kind = B.mix(kind * np.uint64(2) + same, 5)
    docs, keys = [], []
    for stream, longest, seed in ((word, 2, 11), (kind, 3, 21)):
        chain = stream
        for n in range(1, longest + 1):
            if n > 1:
                chain = B.mix(chain[:-1] * np.uint64(3) + stream[n - 1 :], seed + n)
            use = doc[: len(chain)] == doc[n - 1 :] if len(chain) else np.zeros(0, bool)
            docs.append(doc[: len(chain)][use])
            keys.append(B.mix(chain[use], seed) >> np.uint64(64 - bits))
            if not len(chain):
                break
    pairs, count = np.unique((np.concatenate(docs).astype(np.uint64) << np.uint64(bits)) | np.concatenate(keys), return_counts=True)
    of, bucket = (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)
    length = np.sqrt(np.bincount(of, weights=count.astype(np.float64) ** 2, minlength=len(offsets) - 1))
    return of, bucket, count / length[of]


@dataclass
class Classifier:
    bias: float
    w: np.ndarray

    def scores(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.bias + np.bincount(doc, weights=self.w[bucket] * value, minlength=n))


def _training_terms(bits: int, most: int):
    def encode(data: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, bytes]]:
        doc, bucket, value = ngram_terms(data, offsets, bits)
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        # buckets are the upper bits of hashes, so the first of a row are those of smallest hash
        return [(bucket[a : min(b, a + most)].astype(np.int32).tobytes(), value[a : min(b, a + most)].astype(np.float32).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    return encode


def _weight(z: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return -np.sign(z) * np.maximum(np.abs(z) - L1, 0.0) / ((BETA + np.sqrt(squares)) / ALPHA + L2)


def train_ftrl(y: np.ndarray, starts: np.ndarray, bucket: np.ndarray, value: np.ndarray, share: float, bits: int = BITS, epochs: int = EPOCHS) -> Classifier:
    """FTRL-proximal over the rows; the bias is a coordinate without a penalty that starts at the log odds of ``share``."""
    z, squares = np.zeros(1 << bits), np.zeros(1 << bits)
    prior = float(np.log(share / (1 - share)))
    bias_z, bias_squares = 0.0, 0.0
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    rng = np.random.default_rng(23)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            k, x = bucket[starts[i] : starts[i + 1]], value[starts[i] : starts[i + 1]].astype(np.float64)
            zk, nk = z[k], squares[k]
            w = _weight(zk, nk)
            b = -bias_z / ((BETA + np.sqrt(bias_squares)) / ALPHA)
            d = weight[i] * (sigmoid(np.float64(prior + b + w @ x)) - y[i])
            g = d * x
            more = nk + g * g
            z[k] = zk + g - (np.sqrt(more) - np.sqrt(nk)) / ALPHA * w
            squares[k] = more
            step = (np.sqrt(bias_squares + d * d) - np.sqrt(bias_squares)) / ALPHA
            bias_z += d - step * b
            bias_squares += d * d
    b = -bias_z / ((BETA + np.sqrt(bias_squares)) / ALPHA)
    return Classifier(prior + float(b), _weight(z, squares).astype(np.float32))


def fit_classifier(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_terms: int = MOST_TERMS, bits: int = BITS) -> Classifier:
    """Train on labelled rows outside the fifth that crc32 holds out."""
    sample, counts = sample_labels(labels.where(~held_out_column()).select("doc_id", "quality"), "quality", per_class)
    y, starts, bucket, value = csr(training_rows(docs, sample, _training_terms(bits, most_terms), per_class))
    share = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 1e-4), 1 - 1e-4)
    if not len(y) or y.min() == y.max():
        return Classifier(float(np.log(share / (1 - share))) if counts else -40.0, np.zeros(1 << bits, np.float32))
    return train_ftrl(y, starts, bucket, value, share, bits)


def classify(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """All rows and columns of ``docs`` with score (double) and predicted (int)."""
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    at = names.index("text")
    schema = schema_of([docs.schema[c] for c in names], [("score", "double"), ("predicted", "int")])
    used = np.flatnonzero(model.w).astype(np.int32)
    packed = (model.bias, used, model.w[used])  # what the tasks get is as large as the terms with evidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(packed[0], np.zeros(1 << bits, np.float32))
        own.w[packed[1]] = packed[2]
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for first, last, (doc, bucket, value) in bucketed(batch.column(at), lambda d, o: ngram_terms(d, o, bits)):
                score[first:last] = own.scores(doc, bucket, value, last - first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
