import numpy as np
import pytest
import xxhash

from hushframe.llm import simhash
from hushframe.operators import components as cc


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, f in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd_rows):
    texts = [r[1] for r in odd_rows if len(r[1] or "") < 5000]
    assert simhash.fingerprints([(t or "").encode() for t in texts]).tolist() == [fingerprint(t) for t in texts]


def test_components_are_those_of_brute_force(spark, odd, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    fps = sorted({r["fp"] % (1 << 64) for r in got})
    own = dict(zip(fps, classes(fps), strict=True))
    least = {}
    for r in got:
        c = own[r["fp"] % (1 << 64)]
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(own[r["fp"] % (1 << 64)]) for r in got)


def planted(n, near, seed=1):
    """Random fingerprints, one chain, and a dense ball of near ones."""
    rng = np.random.default_rng(seed)
    fps = set(rng.integers(0, 2**64, n, dtype=np.uint64).tolist())
    x = 12345678901234567
    for _ in range(20):
        for b in rng.choice(64, 4, replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    center = 0xABCDEF0123456789
    for _ in range(near):
        y = center
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y ^= 1 << int(b)
        fps.add(y)
    return sorted(fps)


@pytest.mark.parametrize("tile", [2048, 16])
def test_links_lose_nothing(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = planted(600, 300)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    labels = {r["node"] % (1 << 64): r["label"] % (1 << 64) for r in cc.components(simhash.links(df)).collect()}
    want, got = {}, {}
    for f, c in zip(fps, classes(fps), strict=True):
        want.setdefault(c, set()).add(f)
        got.setdefault(labels.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_keys_cover_every_pair():
    for n in (10, 10**4, 10**6, 10**9):
        masks = [m % (1 << 64) for m in simhash.blocks(n)]
        rng = np.random.default_rng(2)
        for _ in range(300):
            differing = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(m & differing == 0 for m in masks)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    got = cc.components(edges).collect()
    assert len(got) == 200 and {r["label"] for r in got} == {0}


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
