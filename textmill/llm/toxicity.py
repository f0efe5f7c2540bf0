"""Toxicity by a factorisation machine over hashed terms.

A text is the set of its hashed terms (lower-cased words, and the first bytes of
longer words, so that inflected forms share one). On at most ``per_class``
labelled documents of each class a factorisation machine is trained: a weight
for each term of the sample, and a vector for each whose inner products weigh
pairs, so that two terms may count together where neither does alone. No term is
left out; priors hold back the weights of terms with little evidence and the
vectors of rare ones. Evidence is weighed again every few epochs, beside what the
machine explains by then, so a term that matters only where its partner is absent
moves freely once the pair is known. Class weights bring the sampled rows back to
the shares of all labelled rows. The model has a fixed size and is sent
with the function; scoring is one pass in Arrow batches without a shuffle.

Defined cases: null text counts as empty and gets the score of no terms; without
labelled rows of both classes every score is 0; rows are scored one by one, so
repeated rows and ties need no rule; an empty table gives no row; whole texts are
scored, a very long one as a batch of its own; held-out rows are never trained on.
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
from textmill.llm.hashed import bucketed, csr, held_out_column, sample_labels, sigmoid, training_rows, word_terms

BITS = 18
PER_CLASS = 5000
FACTORS = 6
#: Terms of a training row that are sent to the driver, those of smallest hash; scoring reads all terms.
MOST_TERMS = 16384
#: Epochs and priors were chosen on a fold of the training rows (crc32 of the id mod 5 is 1), never on held-out ones.
EPOCHS = 25
#: Priors: from this z on a term's weight moves freely, below it is held back, to this share at most.
FULL_Z = 3.0
LEAST_SCALE = 0.01
#: Rows from which on a term's vector moves freely.
FULL_ROWS = 300
#: Epochs after which the evidence for weights is weighed again.
AGAIN = 5
#: Pairs of row and term that training takes at once where it takes all.
PART = 1 << 18


@dataclass
class Machine:
    """Weights by bucket; ``slot`` is -1 for buckets that the sample does not have."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        slot = self.slot[bucket]
        use = slot >= 0
        doc, slot = doc[use], slot[use]
        out = self.bias + np.bincount(doc, weights=self.w[slot], minlength=n)
        for f in range(self.v.shape[1]):
            out += 0.5 * np.bincount(doc, weights=self.v[slot, f], minlength=n) ** 2
        squares = (self.v.astype(np.float64) ** 2).sum(axis=1)
        return sigmoid(out - 0.5 * np.bincount(doc, weights=squares[slot], minlength=n))


def _terms(bits: int, most: int = MOST_TERMS):
    def encode(data: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, bytes]]:
        doc, bucket = word_terms(data, offsets, bits)
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        return [(bucket[a : min(b, a + most)].astype(np.int32).tobytes(), b"") for a, b in zip(cut[:-1], cut[1:], strict=True)]

    return encode


def _summed(of_row: np.ndarray, row: np.ndarray, term: np.ndarray, size: int) -> np.ndarray:
    """The sum of a term's rows, a part of the pairs after the other: the driver holds no more copies of the sample."""
    out = np.zeros(size)
    for at in range(0, len(row), PART):
        np.add.at(out, term[at : at + PART], of_row[row[at : at + PART]])
    return out


def prior_scales(y: np.ndarray, row: np.ndarray, term: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each term's weight and vector may move: by the z of its log odds ratio, and by its count.

    No scale is 0: the weight of a term that tells the classes apart poorly is held near 0, not left out, and a vector
    needs no difference between the classes, only enough rows.
    """
    n1, n0 = y.sum(), len(y) - y.sum()
    c1 = _summed(y, row, term, size) + 0.5
    c0 = _summed(1 - y, row, term, size) + 0.5
    odds = np.log(c1 / (n1 + 1 - c1).clip(0.5)) - np.log(c0 / (n0 + 1 - c0).clip(0.5))
    z = np.abs(odds) / np.sqrt(1 / c1 + 1 / c0)
    return np.clip((z / FULL_Z) ** 4, LEAST_SCALE, 1.0), np.clip((c1 + c0 - 1) / FULL_ROWS, 0.0, 1.0)


def residual_scale(error: np.ndarray, row: np.ndarray, term: np.ndarray, size: int) -> np.ndarray:
    """As the first of ``prior_scales``, by the z of the errors that remain in a term's rows."""
    z = np.abs(_summed(error, row, term, size)) / np.sqrt(_summed(error**2, row, term, size) + 1e-12)
    return np.clip((z / FULL_Z) ** 4, 0.0, 1.0)


def train_machine(y: np.ndarray, starts: np.ndarray, bucket: np.ndarray, share: float, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """AdaGrad on the weighted log loss; ``share`` is the true share of class 1. Every bucket of the sample is a term."""
    size = 1 << bits
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts))
    slot = np.full(size, -1, np.int32)
    for at in range(0, len(bucket), PART):
        slot[bucket[at : at + PART]] = 0
    seen = np.flatnonzero(slot == 0)
    slot[seen] = np.arange(len(seen))
    s = slot[bucket]
    w_scale, v_scale = prior_scales(y, row, s, len(seen))
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(17)
    w, v = np.zeros(len(seen)), rng.normal(0, 0.02, (len(seen), factors))  # before scaling
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    weight = weight * np.where(y == 1, 2.0, 1.0)  # a missed toxic row costs twice as much as a false alarm
    gw, gv, gb = np.full(len(w), 1e-4), np.full(v.shape, 1e-4), 1e-6
    for epoch in range(epochs):
        if epoch and epoch % AGAIN == 0:
            so_far, p = Machine(slot, bias, w * w_scale, v * v_scale[:, None]), np.zeros(len(y))
            for first in range(0, len(y), 256):
                a, b = starts[first], starts[min(first + 256, len(y))]
                n = min(256, len(y) - first)
                p[first : first + n] = so_far.scores(row[a:b] - first, bucket[a:b], n)
            wider = np.maximum(w_scale, residual_scale(weight * (y - p), row, s, len(seen)))
            w, gw, w_scale = w * w_scale / wider, gw * (wider / w_scale) ** 2, wider  # the weights themselves stay
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            rows = order[at : at + 256]
            r, k = B.ragged(np.diff(starts)[rows])
            n = len(rows)
            used, t = np.unique(s[starts[rows][r] + k], return_inverse=True)  # only the terms of these rows move
            a, b = w_scale[used], v_scale[used][:, None]
            vt = (v[used] * b)[t]
            sums = np.stack([np.bincount(r, weights=vt[:, f], minlength=n) for f in range(factors)], axis=1)
            squares = np.bincount(r, weights=(vt**2).sum(axis=1), minlength=n)
            p = sigmoid(bias + np.bincount(r, weights=(w[used] * a)[t], minlength=n) + 0.5 * ((sums**2).sum(axis=1) - squares))
            d = weight[rows] * (p - y[rows]) / n
            grad_w = np.bincount(t, weights=d[r], minlength=len(used)) * a + 1e-5 * w[used]
            grad_v = np.stack([np.bincount(t, weights=d[r] * (sums[r, f] - vt[:, f]), minlength=len(used)) for f in range(factors)], axis=1) * b + 1e-4 * v[used]
            grad_b = d.sum()
            gw[used] += grad_w**2
            gv[used] += grad_v**2
            gb += grad_b**2
            w[used] -= 0.3 * grad_w / np.sqrt(gw[used])
            v[used] -= 0.03 * grad_v / np.sqrt(gv[used])
            bias -= 0.1 * grad_b / np.sqrt(gb)
    return Machine(slot, float(bias), (w * w_scale).astype(np.float32), (v * v_scale[:, None]).astype(np.float32))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS) -> Machine | None:
    """Train on labelled rows that are not held out; None if a class has no row."""
    usable = labels.where(~held_out_column()).select("doc_id", "toxic")
    sample, counts = sample_labels(usable, "toxic", per_class)
    y, starts, bucket, _ = csr(training_rows(docs, sample, _terms(bits), per_class))
    if not len(y) or y.min() == y.max():
        return None
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return train_machine(y, starts, bucket, min(max(share, 1e-4), 1 - 1e-4), bits)


def score_toxicity(docs: DataFrame, model: Machine | None, bits: int = BITS) -> DataFrame:
    """All rows and columns of ``docs`` with score (double) and predicted (int); columns of these names are replaced."""
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    at = names.index("text")
    schema = schema_of([docs.schema[c] for c in names], [("score", "double"), ("predicted", "int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if model is not None:
                for first, last, (doc, bucket) in bucketed(batch.column(at), lambda d, o: word_terms(d, o, bits)):
                    score[first:last] = model.scores(doc, bucket, last - first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
