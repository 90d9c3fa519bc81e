"""Quality rules by line sequence labelling.

A linear-chain conditional random field over the lines of a text tells content from boilerplate. It is trained on at most
``per_label`` documents of each quality label with at most ``max_lines`` lines (a fixed bound, chosen by a hash of doc_id):
the label of the document is the label of its lines, and the chain's likelihood is raised by gradient ascent with the
forward-backward algorithm. Viterbi decoding labels the lines of every text; a text is kept if at least ``share`` of its words are in
content lines and the base rules do not fail it.

Rows: one per document row; repeated rows are judged one by one and alike. Null and empty texts have no words and fail the base rules; a text
of one very long line is a chain of one, and texts of any length are read whole. Where two labels of a line are equally likely it counts as content.
Without labels of both kinds, or without documents that have them, every line counts as content; an empty table gives no rows. Whole rows
stand in a struct, so no column of theirs clashes with the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import as_bytes, cut, materialize, pack, release, small_batches
from hushframe.llm.numbering import hash48
from hushframe.llm.text_stats import FEATURES, SLICE, Stats

PER_LABEL, MAX_LINES, SHARE = 400, 200, 0.5
#: What part of the likelihood good documents have; to reject one of them is worse than to keep a bad one.
GOOD = 0.85
MIN_WORDS, MAX_REPEATED = 20, 30


@dataclass
class Crf:
    """Scores of label 1 (content) against 0: unary weights, and a table of transitions."""

    unary: np.ndarray
    moves: np.ndarray

    def decode(self, x: np.ndarray) -> list[int]:
        """The likeliest labels of a chain (Viterbi); content where equal."""
        gain = (x @ self.unary).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one, back = 0.0, gain[0], []
        for g in gain[1:]:
            a, b, c, d = zero + m00, one + m10, zero + m01, one + m11
            back.append((a < b, c <= d))
            zero, one = (b if a < b else a), (d if c <= d else c) + g
        label = int(one >= zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(chains: list[np.ndarray], labels: list[int], rounds: int = 250, rate: float = 0.15, l2: float = 1e-3) -> Crf:
    """Gradient ascent on the mean log-likelihood a line."""
    width = len(FEATURES)
    crf = Crf(np.zeros(width), np.zeros((2, 2)))
    if len(set(labels)) < 2:
        crf.unary[0] = 1.0
        return crf
    # Longest chains first, so that those still running at step j are the first ``alive[j]`` ones.
    by_length = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    x = np.concatenate([chains[i] for i in by_length]).astype(np.float64)
    y = np.array(labels)[by_length]
    sizes = np.array([len(chains[i]) for i in by_length])
    start = np.cumsum(sizes) - sizes
    chain = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(x)) - start[chain]
    alive = np.bincount(step)
    # The documents of a label weigh the same, however long they are.
    scale = np.array([1 - GOOD, GOOD])[y] / sizes / np.bincount(y, minlength=2)[y]
    params, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for t in range(1, rounds + 1):
        unary, moves = params[:width], params[width:].reshape(2, 2)
        gain = x @ unary
        emit, alpha, beta = (np.zeros((len(alive), len(sizes), 2)) for _ in range(3))
        emit[step, chain, 1] = gain
        alpha[0] = emit[0]
        for j in range(1, len(alive)):
            k = alive[j]
            before = alpha[j - 1, :k]
            alpha[j, :k] = np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1]) + emit[j, :k]
        for j in range(len(alive) - 2, -1, -1):
            k = alive[j + 1]
            ahead = emit[j + 1, :k] + beta[j + 1, :k]
            beta[j, :k] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        total = np.logaddexp(*alpha[sizes - 1, np.arange(len(sizes))].T)
        one = np.exp(alpha[step, chain, 1] + beta[step, chain, 1] - total[chain])
        grad = np.zeros(width + 4)
        grad[:width] = ((y[chain] - one) * scale[chain]) @ x
        at, who = step[step > 0], chain[step > 0]
        pair = np.exp(alpha[at - 1, who][:, :, None] + moves + (emit + beta)[at, who][:, None, :] - total[who, None, None])
        expected = np.einsum("i,iab->ab", scale[who], pair)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y, y), scale * (sizes - 1))
        grad[width:] = (seen - expected).ravel()
        grad -= l2 * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Crf(params[:width], params[width:].reshape(2, 2))


def _lines(stats: Stats, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the lines of document i."""
    a, b = int(stats.doc_bytes[i]), int(stats.doc_bytes[i + 1]) - 1
    feeds = np.flatnonzero(np.frombuffer(stats.data, np.uint8)[a:b] == 10) + a
    return np.concatenate([[a], feeds + 1]), np.concatenate([feeds, [b]])


def line_features(texts: pa.Array):
    """For each slice of texts: its Stats, for each document its lines' byte ranges, and the features of all lines."""
    for part in cut(texts, texts, SLICE):
        stats = Stats(as_bytes(part))
        lines = [_lines(stats, i) for i in range(len(part))]
        a, b = (np.concatenate([x[k] for x in lines]) for k in (0, 1))
        yield stats, lines, stats.features(a, b)


def _feature_lists():
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for _, lines, x in line_features(texts):
            edges = np.cumsum([0, *(len(a) for a, _ in lines)])
            out += [x[p:q].ravel().tolist() if q - p <= MAX_LINES else [] for p, q in zip(edges[:-1], edges[1:], strict=True)]
        release()
        return pa.array(out, pa.list_(pa.float32()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<float>")


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, quality, text) of at most per_label documents for each label, by a hash of doc_id; the ids are so few that they are broadcast.

    A row for each id and label: of rows that repeat a doc_id the least text counts. It is a table, so that nothing done to these texts is done to all others before the join.
    """
    some = [labels.filter(F.col("quality") == k).select(F.col(id_col).alias("doc_id"), "quality").distinct().orderBy(hash48("sample", F.col("doc_id")), "doc_id").limit(per_label) for k in (0, 1)]
    chosen = some[0].unionByName(some[1])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    return materialize(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sample")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    rows = labelled_sample(docs, labels, per_label, id_col, text_col).select("doc_id", "quality", _feature_lists()("text").alias("x")).collect()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["doc_id"], r["quality"]))
    return train([np.array(r["x"]).reshape(-1, len(FEATURES)) for r in rows], [int(r["quality"]) for r in rows])


def label(crf: Crf, share: float = SHARE):
    """A function of the text column: the base counts, the lines' labels (C or B, a letter for each line) and the verdict."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words"]
    kind = pa.struct([*((n, pa.int64()) for n in names), ("line_labels", pa.string()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def run(texts: pa.Array) -> pa.Array:
        cols: list[list] = [[] for _ in kind]
        for stats, lines, x in line_features(texts):
            da, db = stats.doc_bytes[:-1], stats.doc_bytes[1:]
            wa, wb = stats.doc_words[:-1], stats.doc_words[1:]
            n_words, repeated = wb - wa, stats.n_repeated(wa, wb)
            at = 0
            for i, (a, b) in enumerate(lines):
                own = crf.decode(x[at : at + len(a)])
                at += len(a)
                words = np.searchsorted(stats.word_at, b) - np.searchsorted(stats.word_at, a)
                content = int(words @ np.array(own))
                seen: set[bytes] = set()
                again = 0
                for p, q, n in zip(a.tolist(), b.tolist(), words.tolist(), strict=True):
                    if n:
                        line = stats.data[p:q]
                        again += line in seen
                        seen.add(line)
                cols[3].append(again)
                cols[5].append(content)
                cols[6].append("".join("BC"[k] for k in own))
            failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
            for k, v in ((0, n_words), (1, stats.count("chars", da, db)), (2, stats.count("symbols", da, db)), (4, repeated), (7, failed)):
                cols[k] += v.tolist()
        release()
        cols[8] = [not f and c >= share * n for f, c, n in zip(cols[7], cols[5], cols[0], strict=True)]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<" + ",".join(f"{n}:bigint" for n in names) + ",line_labels:string,base_failed:boolean,kept:boolean>")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, quality): each whole row in a struct, and a struct of the counts, the lines' labels and the verdict."""
    small_batches(docs.sparkSession)
    verdict = label(fit(docs, labels, id_col=id_col, text_col=text_col))
    return pack(docs, quality=verdict(F.col(text_col)))
