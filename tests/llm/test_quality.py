from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import line_crf, passage_attention
from hushframe.llm.common import crc_mod
from hushframe.llm.text_stats import FEATURES, Stats


def brute(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated |= set(range(i, i + 8))
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            again += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), again, len(repeated)


def test_base_counts(odd, odd_rows, labels):
    got = [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in line_crf.judge(odd, labels).select("quality.*").collect()]
    assert sorted(got) == sorted(brute(r[1]) for r in odd_rows)


def test_base_counts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = line_crf.judge(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).select("doc.text", "quality.*").collect()
    assert all(brute(r["text"]) == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    assert all(len(r["line_labels"]) == r["text"].count("\n") + 1 for r in rows)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        x = rng.normal(size=(n, len(FEATURES)))
        crf = line_crf.Crf(rng.normal(size=len(FEATURES)), rng.normal(size=(2, 2)))
        value = lambda y: sum(y[i] * (x[i] @ crf.unary) for i in range(n)) + sum(crf.moves[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        assert abs(value(crf.decode(x)) - max(map(value, product((0, 1), repeat=n)))) < 1e-9


def test_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = line_crf.judge(docs, labels).select("doc.doc_id", "quality.*").join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"]]) > 0.98
    assert np.mean([r["kept"] for r in rows if not r["quality"]]) < 0.1


def test_attention_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = passage_attention.classify(docs, labels, crc_mod("doc_id", 3) != 1).join(labels, "doc_id").filter(crc_mod("doc_id", 3) == 1).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in rows]) > 0.95


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.random((int(rng.integers(1, 5)), len(FEATURES))) + (0.8 * y) for y in (0, 1) * 20]
    model = passage_attention.train(bags, [0, 1] * 20, rounds=200)
    first = np.cumsum([0, *map(len, bags)])
    scores = model.score(np.concatenate(bags), first)
    assert np.mean((scores >= 0.5) == np.array([0, 1] * 20, bool)) > 0.9


@pytest.mark.parametrize("module", [line_crf, passage_attention])
def test_odd_tables(odd, empty, labels, odd_rows, module):
    run = (lambda d, l: line_crf.judge(d, l)) if module is line_crf else (lambda d, l: passage_attention.classify(d, l, F.lit(True)))
    assert run(odd, labels).count() == len(odd_rows)
    assert run(odd, labels.filter("false")).count() == len(odd_rows)
    assert run(odd, labels.filter("quality = 1")).count() == len(odd_rows)
    assert run(empty, labels).count() == 0
    if module is passage_attention:
        assert all(0 <= r["score"] <= 1 for r in run(odd, labels).collect())


def test_stats_of_nothing():
    stats = Stats([b"", b""])
    assert stats.features(np.array([0, 1]), np.array([0, 1])).shape == (2, len(FEATURES))


def described(segment, words, repeated):
    """FEATURES of a piece of text, written out."""
    n, count = max(len(words), 1), lambda chars: sum(segment.count(bytes([c])) for c in chars)
    chars = max(sum(1 for b in segment if b & 0xC0 != 0x80 and b not in b" \t\n\x0b\x0c\r"), 1)
    upper, lower = count(range(65, 91)), count(range(97, 123)) + sum(b >= 0xC0 for b in segment)
    clip = lambda x: min(1.0, max(0.0, x))
    row = [
        1, clip(4 * count(b"#*$%&|<>") / chars), upper / max(upper + lower, 1), count(b"0123456789") / chars, clip(count(b".,;:") / n), clip(count(b"!?") / n), clip(2 * count(b"|") / n),
        clip(1 - chars / n / 4), clip(chars / n / 8 - 1), repeated / n, (len(words) - len(set(words))) / n, len(words) < 8, len(words) < 2,
    ]
    return np.array(row, np.float32)


def in_repeats(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}


def sf(spark, *names):
    return [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in names]


def test_verdicts_are_those_of_brute_force(spark, odd, labels):
    """From text to `kept`: features of every line, the likeliest labels by looking at all moves, and the share of words in content lines."""
    for docs, marks in (sf(spark, "documents", "labels"), (odd, labels)):
        crf = line_crf.fit(docs, marks)
        for r in line_crf.judge(docs, marks).select("doc.text", "quality.*").collect():
            data = (r["text"] or "").encode()
            words, at, x, sizes = data.split(), 0, [], []
            again = in_repeats(words)
            for line in data.split(b"\n"):
                own = line.split()
                x.append(described(line, own, sum(i in again for i in range(at, at + len(own)))))
                at += len(own)
                sizes.append(len(own))
            best = np.array([0.0, x[0] @ crf.unary])
            paths = [[0], [1]]
            for row in x[1:]:
                came = [max((best[a] + crf.moves[a, b], a) for a in (0, 1)) for b in (0, 1)]
                paths = [paths[came[b][1]] + [b] for b in (0, 1)]
                best = np.array([came[0][0], came[1][0] + row @ crf.unary])
            own = paths[int(best[1] >= best[0])]
            content = sum(n for n, k in zip(sizes, own, strict=True) if k)
            failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
            if abs(best[1] - best[0]) > 1e-3:
                assert (r["base_failed"], r["n_content_words"], r["kept"]) == (failed, content, not failed and content >= 0.5 * len(words))


def test_attention_scores_are_those_of_brute_force(spark, odd, labels):
    """Passages of 50 words, their features, gated attention and the weighted sum, one text after the other."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for docs, marks in (sf(spark, "documents", "labels"), (odd, labels)):
        m = passage_attention.fit(docs, marks, crc_mod("doc_id", 3) != 1)
        texts = {}
        for d, t in docs.select("doc_id", "text").collect():
            words = (t or "").encode().split()
            again, h, e = in_repeats(words), [], []
            for a in range(0, max(1, len(words)), 50):
                own = words[a : a + 50]
                z = np.tanh(described(b" ".join(own), own, sum(i in again for i in range(a, a + len(own)))) @ m.encode)
                h.append(z)
                e.append((np.tanh(z @ m.tanh) * sigmoid(z @ m.gate)) @ m.weigh)
            share = np.exp(np.array(e) - max(e))
            texts.setdefault(d, []).append(float(sigmoid(share / share.sum() @ np.array(h) @ m.out + m.bias)))
        got = {}
        for r in passage_attention.classify(docs, marks, crc_mod("doc_id", 3) != 1).collect():
            got.setdefault(r["doc_id"], []).append(r["score"])
        assert got.keys() == texts.keys() and all(np.allclose(sorted(got[d]), sorted(texts[d]), atol=1e-4) for d in got)


@pytest.mark.parametrize("repeats", [1, 3])
def test_training_reads_only_the_sample(spark, labels, text_of, repeats):
    """No Python on all documents: the plan of the sampled texts joins before anything else, and a repeated id is one row."""
    docs = spark.createDataFrame([(i, text_of(i, 30)) for i in range(20)] * repeats, "doc_id long, text string")
    sample = line_crf.labelled_sample(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"), 5, "doc_id", "text")
    assert sample.count() == 10
    plan = sample.select(line_crf._feature_lists()("text"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Join" not in plan
