import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import suffix_dedup as sd
from hushframe.llm.gsaca import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 4))
def test_suffix_array(part, times):
    text = part * times
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(docs, length):
    seen, out = set(), []
    for _, data in docs:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans, at = [], 0
        while at < len(data):
            end = at
            while end < len(data) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = max(end, at + 1)
        out.append((len(data), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def made(seed):
    """Texts with shared passages, copies, edits and periods."""
    rng = random.Random(seed)
    pick = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [pick(rng.randint(90, 400)) for _ in range(6)]
    docs = []
    for _ in range(40):
        docs.append("".join(rng.choice([pick(rng.randint(0, 150)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :], "ab" * rng.randint(0, 150)]) for _ in range(rng.randint(1, 5))))
    return docs + docs[:5] + [d[:50] + "!" + d[50:] for d in docs[5:10]]


@pytest.mark.parametrize(("seed", "large", "meeting"), [(1, None, 256), (2, None, 5), (3, 100, 256)])
def test_spans_are_those_of_brute_force(spark, monkeypatch, seed, large, meeting):
    monkeypatch.setattr(sd, "MEETING", meeting)
    if large:
        monkeypatch.setattr(sd, "LARGE", large)
    docs = list(enumerate(made(seed)))
    got = {r["doc_id"]: r for r in sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=2000).collect()}
    want = brute([(d, t.encode()) for d, t in docs], 100)
    for (d, _), (n, spans, kept) in zip(docs, want, strict=True):
        assert (got[d]["n_bytes"], [(s["start"], s["end"]) for s in got[d]["spans"]], bytes(got[d]["kept"])) == (n, spans, kept)


@pytest.mark.parametrize("meeting", [256, 3])
def test_odd_rows(odd, odd_rows, empty, monkeypatch, meeting):
    monkeypatch.setattr(sd, "MEETING", meeting)
    got = sd.remove_repeats(odd).collect()
    assert len(got) == len(odd_rows) and sd.remove_repeats(empty).count() == 0
    # In order of doc_id, null last; rows with the same doc_id and text are one document.
    distinct = sorted({(r[0], r[1]) for r in odd_rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None))
    want = sorted((n, len(kept)) for (n, _, kept), (d, t) in zip(brute([(d, (t or "").encode()) for d, t in distinct], 100), distinct, strict=True) for _ in range(sum((r[0], r[1]) == (d, t) for r in odd_rows)))
    assert sorted((r["n_bytes"], len(r["kept"])) for r in got) == want


def test_columns_survive_packing():
    rows = np.zeros(5, sd._ANCHOR)
    rows["m"], rows["c"], rows["key"], rows["lo"], rows["size"], rows["inner"] = np.sort(np.random.default_rng(1).integers(0, 2**64, 5, dtype=np.uint64)), 2**64 - 1 - np.arange(5, dtype=np.uint64), [-3, 0, 1, 2**40, 5], [0, 1, 2, 70_000, 4], [100, 101, 168, 400, 5], [True, False, True, False, False]
    rows["d"] = rows["c"][::-1]
    assert (sd._unpack(sd._pack(rows)) == rows).all()


@pytest.mark.parametrize("column", ["c", "d"])
def test_sifted_contexts_keep_their_digest(column):
    rows = np.zeros(3, sd._ANCHOR)
    rows["m"], rows[column], rows["key"], rows["size"] = 7, [1, 2, 2**64 - 1], [1, 2, 3], 100
    sifted = sd._sift(4)(pa.table({"bucket": [0], "data": [sd._pack(rows)]}))
    assert sifted.column("wanted").to_pylist() == [True]
    assert (sd._unpack(sifted.column("data")[0].as_py()) == rows).all()


def test_ids_in_steps_are_dealt_evenly(spark):
    keys = np.arange(-500, 3000, dtype=np.int64) * 24
    got = [r[0] for r in spark.createDataFrame([(int(k),) for k in keys], "key long").selectExpr("pmod(hash(key), 24)").collect()]
    assert (sd.chunk_of(keys, 24) == got).all() and np.bincount(got, minlength=24).min() > 100


def test_ids_in_steps_give_the_same_spans(spark):
    docs = [(24 * i, t) for i, t in enumerate(made(7))]
    got = {r["doc_id"]: r for r in sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=2000).collect()}
    for (d, _), (n, spans, _) in zip(docs, brute([(d, t.encode()) for d, t in docs], 100), strict=True):
        assert (got[d]["n_bytes"], [(s["start"], s["end"]) for s in got[d]["spans"]]) == (n, spans)


@pytest.mark.parametrize("large", [1, 2000])
def test_stretches_of_one_hash_are_dealt_again(monkeypatch, large):
    """A common phrase in ever new surroundings, with repeats that begin and end anywhere, comes out the same in small pieces."""
    rng = random.Random(large)
    pick = lambda n: bytes(rng.choice(b"abcdef ") for _ in range(n))
    phrase, others = pick(60), [pick(150) for _ in range(8)]
    docs = [pick(rng.randint(0, 40)) + phrase + (rng.choice(others)[: rng.randint(20, 150)] if rng.random() < 0.7 else pick(60)) for _ in range(60)]
    monkeypatch.setattr(sd, "LARGE", large)
    covers = {}
    for key, a, n in sd.covered(np.ones(60, np.uint64), np.arange(60), np.zeros(60, np.int64), docs, 100, 32):
        covers.setdefault(key, set()).update(range(a, a + n))
    want = brute(list(enumerate(docs)), 100)
    assert [covers.get(i, set()) for i in range(60)] == [{x for a, b in spans for x in range(a, b)} for _, spans, _ in want]


def test_groups_are_taken_in_linear_time():
    """Steps of the construction, counted by the time it takes, grow with the text and not faster."""
    import time

    rng, took = random.Random(1), []
    base = [rng.randint(1, 4) for _ in range(500)]
    for times in (40, 160):
        began = time.perf_counter()
        suffix_array(base * times)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]
