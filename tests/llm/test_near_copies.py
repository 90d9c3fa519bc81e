import numpy as np
import pytest
import xxhash

import corpus_pipeline
from hushframe.llm import near_copies, simhash
from hushframe.llm.common import mix64


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """Numbers of the texts of each component, by brute force."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if label[i] != label[j] and (5 * both >= 4 * (len(a) + len(sets[j]) - both)):
                x, y = sorted((label[i], label[j]))
                label = [x if z == y else z for z in label]
    out = {}
    for i, x in enumerate(label):
        out.setdefault(x, set()).add(i)
    return sorted(map(sorted, out.values()))


def edited(text, every, tag):
    return " ".join(f"{tag}{i}" if i % every == every // 2 else w for i, w in enumerate(text.split()))


def texts(text_of):
    """Copies with edits that keep 0.7 to 0.97 of the shingles, a group of many copies, and odd texts."""
    out = []
    for n in range(30):
        base = text_of(f"base{n}", 150 + 10 * n)
        out += [base, *(edited(base, e, f"e{e}x") for e in (30, 48, 60, 120))]
    base = text_of("many", 200)
    out += [edited(base, 40 + 7 * n, f"m{n}x") for n in range(40)]
    return [*out, None, "", " \n", "one two", "One  two", "a b c d e", "a b c d f"]


def test_similar_pairs_beyond_four_bits_are_found(spark, text_of):
    base = text_of("far", 400)
    copies = [base] + [edited(base, 55, f"c{n}x") for n in range(12)]
    near = [c for c in copies[1:] if 5 * len(shingles(base) & shingles(c)) >= 4 * len(shingles(base) | shingles(c))]
    fps = simhash.fingerprints([c.encode() for c in copies])
    assert len(near) == 12 and max(np.bitwise_count(fps ^ fps[0])) > simhash.RADIUS
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


@pytest.mark.parametrize("tile", [1024, 8])
def test_groups_are_those_of_brute_force(spark, text_of, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "TILE_SETS", tile)
    all_texts = texts(text_of)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(all_texts)], "row long, text string, extra string")
    got = {}
    for r in near_copies.near_copies(docs, carry=("extra",)).collect():
        got.setdefault(r["label"], set()).add(r["row"])
    assert sorted(map(sorted, got.values())) == groups(all_texts)


def hashed(text):
    """256 bits for each 5-word shingle of a text, as numbers."""
    hashes = np.array(sorted(xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in shingles(text)), np.uint64)
    return [sum(int(x) << (64 * k) for k, x in enumerate(row)) for row in np.stack([mix64(hashes ^ a) for a in near_copies._ADD], axis=1)] if len(hashes) else []


def test_fingerprints_and_keys_are_those_of_brute_force(text_of):
    """A bit is 1 if set in over half the shingles; a key names the pivots, or complements, with the least sum of distances."""
    all_texts = [text_of("keys", 300), text_of("few", 7), "one two", None]
    _, _, _, keys, fp = near_copies.signatures([(t or "").encode() for t in all_texts])
    pivots = [sum(1 << i for i in np.flatnonzero(p > 0).tolist()) for p in near_copies.spread().T[:512]]
    for t, key, words in zip(all_texts, keys, fp, strict=True):
        h = hashed(t)
        assert sum(int(x) << (64 * k) for k, x in enumerate(words)) == sum(1 << b for b in range(256) if 2 * sum(x >> b & 1 for x in h) > len(h))
        far = [sum((x ^ p).bit_count() for x in h) for p in pivots]
        for table in range(2):
            for half, cell in enumerate(divmod(int(key[table]), 256)):
                own = far[128 * (2 * table + half) :][:128]
                sides = [min(d, 256 * len(h) - d) for d in own]
                assert sides[cell // 2] == min(sides) and sides[cell // 2] == (256 * len(h) - own[cell // 2] if cell % 2 else own[cell // 2])


def test_pivot_table_discards_no_near_pair():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**64, (300, 4), dtype=np.uint64)
    pivots = simhash.pivots(4)
    table = simhash.distances(fp)
    assert all(table[i, j] == sum((int(x) ^ int(y)).bit_count() for x, y in zip(fp[i], pivots[j], strict=True)) for i in (0, 7) for j in range(simhash.PIVOTS))
    apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    assert (np.abs(table[:, None] - table[None]).max(2) <= apart).all()
    x, y = simhash._pairs(np.zeros(300, int), fp, table, np.arange(300), 110)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*(z.tolist() for z in simhash._forest(*np.nonzero(np.triu(apart <= 110, 1)))), strict=True)) and len(x)


@pytest.mark.parametrize("one, other, shared", [(4, 5, 4), (9, 9, 8), (90, 90, 80), (400, 500, 400)])
def test_pairs_of_the_least_similarity_are_candidates(one, other, shared):
    rng = np.random.default_rng(one)
    missed = 0
    for _ in range(4):
        n = np.array([one, other] * 250)
        sets = []
        for _ in range(250):
            h = rng.integers(0, 2**64, one + other - shared, dtype=np.uint64)
            sets += [h[:one], h[len(h) - other :]]
        total = near_copies.sums(np.concatenate(sets), n)
        keys, bits = near_copies.nearest(total, n), total > 0
        met = (keys[0::2] == keys[1::2]).any(1) & ((bits[0::2] != bits[1::2]).sum(1) <= near_copies.RADIUS)
        missed += int((~met).sum())
    assert missed <= 1


def test_the_stage_links_by_fingerprints(spark, text_of, monkeypatch):
    """Near copies whose fingerprints are beyond the radius are no candidates, whatever else they share."""
    base = text_of("prints", 300)
    docs = spark.createDataFrame([(0, base), (1, edited(base, 100, "x")), (2, base.upper())], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
    monkeypatch.setattr(near_copies, "RADIUS", 0)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 1]


def test_empty(empty):
    assert near_copies.near_copies(empty.selectExpr("doc_id row", "text")).count() == 0
