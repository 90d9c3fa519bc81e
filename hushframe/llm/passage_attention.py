"""Quality classification by attention-based multiple-instance learning.

A text is a bag of passages of ``WORDS`` words. Every passage is encoded (one tanh layer over its features), gated attention
(tanh times sigmoid) gives each passage a weight, and the weighted sum of the encodings gets the score. All is learned
from labels of whole documents by gradient descent, on at most ``per_label`` documents of each label with at most ``max_passages`` passages
(a fixed bound, chosen by a hash of doc_id).

Rows: one per document row; repeated rows get the same score, and of rows that repeat a labelled doc_id the least text is learned from. Null,
empty and blank texts are one empty passage and get a score too; a score of exactly 0.5 predicts label 1; without labels of both kinds every score
is the share of label 1 (0.5 without labels); an empty table gives no rows. Very long texts are scored whole. Columns besides id and text
are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import as_bytes, cut
from hushframe.llm.line_crf import labelled_sample
from hushframe.llm.text_stats import FEATURES, SLICE, Stats

WORDS, HIDDEN, GATES = 50, 12, 8
PER_LABEL, MAX_PASSAGES = 600, 60


def passages(texts: pa.Array):
    """For each slice of texts: the features of all passages and where each text's begin."""
    for part in cut(texts, texts, SLICE):
        stats = Stats(as_bytes(part))
        n = np.maximum(1, -(-np.diff(stats.doc_words) // WORDS))
        first = np.concatenate([[0], np.cumsum(n)])
        doc = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(doc)) - first[doc]
        at = np.concatenate([stats.word_at, [len(stats.data)]])
        a = np.where(k == 0, stats.doc_bytes[doc], at[np.minimum(stats.doc_words[doc] + k * WORDS, len(at) - 1)])
        b = np.where(k == n[doc] - 1, stats.doc_bytes[doc + 1], np.concatenate([a[1:], [len(stats.data)]]))
        yield stats.features(a, b), first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Attention:
    encode: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    out: np.ndarray
    bias: float

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each bag first[i]..first[i + 1]."""
        h = np.tanh(x @ self.encode)
        e = (np.tanh(h @ self.tanh) * _sigmoid(h @ self.gate)) @ self.weigh
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
        share = e / np.add.reduceat(e, first[:-1])[doc]
        return _sigmoid(np.add.reduceat(share[:, None] * h, first[:-1]) @ self.out + self.bias)


def train(bags: list[np.ndarray], labels: list[int], rounds: int = 400, rate: float = 0.02, l2: float = 1e-4, seed: int = 3) -> Attention:
    rng = np.random.default_rng(seed)
    width = len(FEATURES)
    shapes = [(width, HIDDEN), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
    p = [rng.normal(0, 0.3, s) for s in shapes]
    p[-1][:] = 0
    if len(set(labels)) < 2:
        for q in p:
            q[:] = 0
        p[-1][:] = (40 if labels[0] else -40) if labels else 0
        return Attention(*p[:-1], float(p[-1][0]))
    x, y = np.concatenate(bags).astype(np.float64), np.array(labels)
    first = np.cumsum([0, *map(len, bags)])[:-1]
    doc = np.repeat(np.arange(len(bags)), list(map(len, bags)))
    summed = lambda a: np.add.reduceat(a, first)
    weight = 0.5 / np.bincount(y, minlength=2)[y]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for t in range(1, rounds + 1):
        encode, to_tanh, to_gate, weigh, out, bias = p
        h = np.tanh(x @ encode)
        a, g = np.tanh(h @ to_tanh), _sigmoid(h @ to_gate)
        e = (a * g) @ weigh
        s = np.exp(e - np.maximum.reduceat(e, first)[doc])
        s /= summed(s)[doc]
        z = summed(s[:, None] * h)
        d = (_sigmoid(z @ out + bias[0]) - y) * weight
        dz = (d[:, None] * out)[doc]
        ds = (dz * h).sum(1)
        de = s * (ds - summed(s * ds)[doc])
        da, dg = de[:, None] * weigh * g * (1 - a**2), de[:, None] * weigh * a * g * (1 - g)
        dh = s[:, None] * dz + da @ to_tanh.T + dg @ to_gate.T
        grads = [x.T @ (dh * (1 - h**2)), h.T @ da, h.T @ dg, de @ (a * g), z.T @ d, np.array([d.sum()])]
        for i, grad in enumerate(grads):
            grad = grad + l2 * p[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad**2
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Attention(*p[:-1], float(p[-1][0]))


def _feature_lists():
    def run(texts: pa.Array) -> pa.Array:
        out = [x[a:b].ravel().tolist() if b - a <= MAX_PASSAGES else [] for x, first in passages(texts) for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.array(out, pa.list_(pa.float32()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<float>")


def fit(docs: DataFrame, labels: DataFrame, training: Column, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> Attention:
    """``training``: a condition on the labels' id."""
    rows = labelled_sample(docs, labels.filter(training), per_label, id_col, text_col).select("doc_id", "quality", _feature_lists()("text").alias("x")).collect()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["doc_id"], r["quality"]))
    return train([np.array(r["x"]).reshape(-1, len(FEATURES)) for r in rows], [int(r["quality"]) for r in rows])


def scorer(model: Attention):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score(x, first) for x, first in passages(texts)] or [np.zeros(0)]), pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def classify(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    model = fit(docs, labels, training, id_col=id_col, text_col=text_col)
    return docs.select(F.col(id_col).alias("doc_id"), scorer(model)(F.col(text_col)).alias("score"))
