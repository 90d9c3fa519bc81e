import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import backoff_lm as lm
from hushframe.llm.common import crc_mod


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows, order, mu):
    """Scores from plain dictionaries."""
    learn = [zlib.crc32(str(d if d is not None else "").encode()) % 7 != 2 for d, _ in rows]
    counts = [Counter() for _ in range(order + 1)]
    for (_, text), l in zip(rows, learn, strict=True):
        if l:
            seq = ["<", *tokens(text)]
            for n in range(1, order + 1):
                counts[n].update(tuple(seq[i - n + 1 : i + 1]) for i in range(n - 1, len(seq)))
    begins = counts[1].pop(("<",), 0)
    total, types = sum(counts[1].values()), len(counts[1])

    def p(history, w):
        if not history:
            c = counts[1][w,]
            return (c - lm.DISCOUNT) / total if c else lm.DISCOUNT * types / total
        c_history = begins if history == ("<",) else counts[len(history)][history]
        m = mu[len(history) - 1]
        return (counts[len(history) + 1][(*history, w)] + m * p(history[1:], w)) / (c_history + m)

    out = []
    for _, text in rows:
        seq = ["<", *tokens(text)]
        score = sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        base = sum(math.log10((counts[1][w,] + 1) / (total + types + 1)) for w in seq[1:])
        out.append((len(seq) - 1, sum(counts[1][w,] > 0 for w in seq[1:]), total, base, score))
    return out, p, counts, begins


@pytest.mark.parametrize(("order", "mu"), [(2, (20.0,)), (3, lm.MU), (4, (30.0, 5.0, 0.5))])
def test_scores_are_those_of_brute_force(spark, odd, odd_rows, order, mu):
    got = lm.score(odd, crc_mod("doc_id", 7) != 2, order=order, mu=mu).collect()
    want, *_ = brute([r[:2] for r in odd_rows], order, mu)
    key = lambda r: (r[0], r[1], round(r[3], 4), round(r[4], 4))
    got = sorted(((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-9)


def test_probabilities_sum_to_one():
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b", "b b c", "c"])]
    _, p, counts, _ = brute(rows, 3, (5.0, 2.0))
    vocabulary = [k[0] for k in counts[1]] + ["an unknown word"]
    for history in [(), ("<",), (b"a",), (b"b",), ("never seen",), ("<", b"a"), (b"b", b"b"), (b"a", "never seen")]:
        assert abs(sum(p(history, w) for w in vocabulary) - 1) < 1e-12


def test_better_than_the_base_on_held_out_texts(spark):
    r = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), crc_mod("doc_id", 7) != 2).filter("not learned").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > 0.8 * r[0]


def test_nothing_to_learn_from(odd, empty):
    assert lm.score(empty, F.lit(True)).count() == 0
    assert {r["score"] for r in lm.score(odd, F.lit(False)).collect()} == {0.0}


def test_scores_on_documents(spark):
    """Production parameters, and equal answers however texts are dealt."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, *_ = brute(rows, lm.ORDER, lm.MU)
    for chunk_bytes in (lm.CHUNK_BYTES, 3000):
        got = {r["doc_id"]: r for r in lm.score(frame, crc_mod("doc_id", 7) != 2, chunk_bytes=chunk_bytes).collect()}
        for (d, _), (n_tokens, n_known, total, base, score) in zip(rows, want, strict=True):
            r = got[d]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, total) and np.allclose((r["base_score"], r["score"]), (base, score), rtol=1e-9)


def test_keys_and_counts_survive_packing():
    for bits in (64, 51, 40, 33):
        keys = np.unique(np.random.default_rng(0).integers(0, 2**bits, 5000, dtype=np.uint64))
        for some in (keys, keys[:1], keys[:3], np.arange(7, dtype=np.uint64), keys[-1:]):
            assert (lm.unpack_keys(lm.pack_keys(some, bits)) == some).all()
        assert len(lm.pack_keys(keys, bits)) < len(keys) * (bits - 9) / 8
    for counts in ([0, 1], [300], [70_000, 2], [2**40]):
        assert lm.unpack_counts(lm.pack_counts(np.array(counts))).tolist() == counts
