"""Near copies by the Jaccard similarity of their word shingles: at least ``NUMER / DENOM``, found by SimHash and pivots, verified exactly.

Candidates come by op2's method (``simhash``) with wider fingerprints: each bit of the hashes of a set's shingles, ``BITS`` to a shingle, is summed up
(+1 or -1), and the sums' signs are the fingerprint. No choice of whole blocks of bits brings together all pairs that differ in a seventh of their bits, so the
pivots do: a table of the distances of every set (the Hamming distances of its hashes, which the sums give) to ``SPREAD`` random pivots and their complements, twice for each
of ``TABLES`` keys, and a key is the nearest of both. Sets that share a key are candidates if their fingerprints are at most ``RADIUS`` bits apart: pairs with a larger
difference in a coordinate of op2's pivot table are discarded, the others compared bit by bit. At this radius most of the discarding is left to the bits.

Pairs of similarity 0.8 share no key with a probability of 2.5e-5 (equal sizes, the worst case; drawn), and differ in more than ``RADIUS`` bits with 8e-6 (sets of
4 and 5 shingles; 2e-8 of others). Both fall fast above 0.8. Chance meets a set with n / 65,536 others for each key. Keys shared by many sets are dealt in tiles
(``meeting``), and each group passes on a forest of its links. Keys are taken in rounds, whose shuffle files are let go: the first has few keys, and what it connects needs no
links in the next ones.

Verification: the components of these links are blocks. The sets of a block meet in tiles in the same way, first those of a tile and then those that
are not connected yet; pairs are counted exactly by an inverted list of shingles. A forest of the pairs that are similar enough goes on, and its components
are the result.

Rows: one per document row. A text of fewer words than a shingle is one shingle; null, empty and blank texts have none and are copies of
each other; equal sets of shingles (compared by 128 bits and their size) are one node; a similarity of exactly 0.8 links; texts of any length
are read whole; an empty table gives no rows; columns besides row, text and ``carry`` are not read, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import as_bytes, cut, forget, materialize, mix64
from hushframe.llm.meeting import meet
from hushframe.llm.simhash import _forest, linked
from hushframe.operators.components import components

WIDTH, NUMER, DENOM, SEED = 5, 4, 5, 42
#: 64-bit words of a fingerprint, its bits, and how many of them may differ.
WORDS, RADIUS = 4, 76
BITS = 64 * WORDS
#: Keys of each round, all keys, and the pivots for each half of a key.
ROUNDS = (8, 32, 32)
TABLES, SPREAD = sum(ROUNDS), 128
#: Shingles whose bits are summed at once.
PIECE = 1 << 15
#: A key with more sets than this is dealt in tiles of this size.
TILE = 1024
#: Sets and shingles of a tile in verification.
TILE_SETS, TILE_SHINGLES = 256, 500_000
_ADD = mix64(np.arange(1001, 1001 + WORDS, dtype=np.uint64))
_SIGNED = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("keys", pa.list_(pa.int32())), ("fp", pa.list_(pa.int64()))])


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = text.lower().split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)] if w else []
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(g, SEED) for g in grams}), np.uint64)


def sums(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set (``n`` of the hashes ``h``) and each bit of a fingerprint, how many shingles have it less how many have not."""
    out, owner = np.zeros((len(n), BITS), np.int64), np.repeat(np.arange(len(n)), n)
    for s in range(0, len(h), PIECE):
        words = np.stack([mix64(h[s : s + PIECE] ^ a) for a in _ADD], axis=1)
        own = owner[s : s + PIECE]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        # Bits as bytes, eight to a word, are summed in runs too short to overflow.
        runs = np.unique(np.concatenate([np.arange(0, len(own), 255), first]))
        parts = np.add.reduceat(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").view(np.uint64), runs, axis=0).view(np.uint8)
        out[own[first]] += np.add.reduceat(parts, np.searchsorted(runs, first), axis=0, dtype=np.int64)
    return 2 * out - n[:, None]


@cache
def spread() -> np.ndarray:
    """The pivots of the keys as columns of -1 and +1."""
    words = mix64(np.arange(1, TABLES * 2 * SPREAD * WORDS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)).reshape(-1, WORDS)
    return np.ascontiguousarray((2 * np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.int8) - 1).astype(np.float32).T)


def nearest(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The keys of each set. The hashes of its n shingles are (BITS n - x) / 2 bits from a pivot whose product with ``total`` is x, and (BITS n + x) / 2 from its complement."""
    most = 65_000  # products of larger sums would not be exact
    scaled = np.where(n[:, None] > most, np.rint(total * (most / np.maximum(n, 1))[:, None]), total).astype(np.float32)
    keys = np.zeros((len(n), TABLES), np.int32)
    for s in range(0, len(n), 128):
        x = (scaled[s : s + 128] @ spread()).reshape(-1, TABLES * 2, SPREAD)
        at = np.abs(x).argmax(2)
        cell = 2 * at + (np.take_along_axis(x, at[:, :, None], 2)[:, :, 0] < 0)
        keys[s : s + 128] = cell[:, 0::2] * 2 * SPREAD + cell[:, 1::2]
    return keys


def signatures(docs: list[bytes]):
    """Of each document: number of shingles, two hashes of their set, the keys and the fingerprint (words)."""
    sets = [shingles(d) for d in docs]
    n = np.array([len(s) for s in sets], np.int64)
    a, b = np.zeros(len(docs), np.uint64), np.zeros(len(docs), np.uint64)
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    if n.any():
        some = n > 0
        starts = (np.cumsum(n) - n)[some]
        a[some], b[some] = np.add.reduceat(mix64(h), starts), np.add.reduceat(mix64(h ^ _ADD[0]), starts)
    total = sums(h, n)
    return n, a, b, nearest(total, n), np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64)


def signature_udf():
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in cut(texts, texts, 1 << 18):
            n, a, b, keys, fp = signatures(as_bytes(part))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (keys, fp.view(np.int64))]
            out.append(pa.StructArray.from_arrays([pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *lists], fields=list(_SIGNED)))
        return pa.concat_arrays(out) if out else pa.array([], _SIGNED)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<n:long,a:long,b:long,keys:array<int>,fp:array<long>>")


def _linked(x: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (x, y))
    u, v = _forest(u, v) if len(u) else (u, v)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def candidates(sets: DataFrame) -> DataFrame:
    """(node, label): the component of each of ``sets`` (node, keys, fp) by links of those that share a key and differ in few bits."""
    words = [f"fp{k}" for k in range(WORDS)]
    least, n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), sets.count()
    prints = sets.select("node", "keys", *(F.col("fp")[k].alias(w) for k, w in enumerate(words)))
    labels, first = sets.select("node", F.col("node").alias("label")), 0
    for size in ROUNDS:
        keyed = prints.join(labels, "node").select("node", "label", *words, F.posexplode(F.slice("keys", first + 1, size)).alias("t", "key"))
        merged = components(linked(keyed, max(least, n * size // 500_000), RADIUS, TILE, "node", tuple(words)))
        merged = merged.select(F.col("node").alias("label"), F.col("label").alias("now"))
        labels = materialize(labels.join(merged, "label", "left").select("node", F.coalesce("now", "label").alias("label")), "labels")
        first += size
        forget(sets.sparkSession)
    return labels


def similar(node: np.ndarray, sets: list[np.ndarray], label: np.ndarray) -> pa.RecordBatch:
    """A forest of all pairs of ``sets`` with different labels that are similar enough."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.concatenate([first, [len(h)]]))
    # Every entry stands before its followers in the list of its shingle: the sets it meets.
    place = np.arange(len(h)) - np.repeat(first, size)
    after = np.repeat(size, size) - place - 1
    mine = np.argsort(owner, kind="stable")
    edges = np.concatenate([[0], np.cumsum(n)])
    u, v = [], []
    for i in range(len(sets)):
        at = mine[edges[i] : edges[i + 1]]
        k = after[at]
        total = int(k.sum())
        if not total:
            continue
        met = owner[np.repeat(at + 1 - (np.cumsum(k) - k), k) + np.arange(total)]
        shared = np.bincount(met, minlength=len(sets))
        j = np.flatnonzero((NUMER + DENOM) * shared >= NUMER * (n + n[i]))
        j = j[(j > i) & (label[j] != label[i])]
        u.append(node[j])
        v.append(np.full(len(j), node[i]))
    return _linked(u, v)


def _verify(rows):
    sets = [shingles(t) for part in rows.column("text").chunks for t in as_bytes(part)]
    return pa.Table.from_batches([similar(np.asarray(rows.column("node")), sets, np.asarray(rows.column("label")))])


def near_copies(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, carry, label) for each of ``docs`` (row: a long that is unique, text): near copies, and what they connect, have one label."""
    signed = materialize(docs.select("row", *carry, signature_udf()(F.col("text")).alias("r")).select("row", *carry, "r.*"), "signatures")
    same = ["n", "a", "b"]
    classes = materialize(signed.groupBy(*same).agg(F.min("row").alias("node")), "classes")
    sets = materialize(signed.select(F.col("row").alias("node"), "n", "keys", "fp").join(classes.select("node").filter("n > 0"), "node", "left_semi"), "sets")
    found = candidates(sets).withColumnRenamed("label", "block")
    blocks = materialize(found.join(found.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("block"), "block"), "blocks")
    texts = docs.select(F.col("row").alias("node"), "text").join(blocks.join(sets.select("node", "n"), "node"), "node")
    weight = F.greatest(F.lit(1.0 / TILE_SETS), F.col("n") / TILE_SHINGLES)
    verified = meet(texts, ["block"], "node", weight, lambda dealt: dealt.select("block", "i", "j", "node", "text", "label").groupBy("block", "i", "j").applyInArrow(_verify, "u long, v long"))
    labels = components(verified)
    named = materialize(classes.join(labels, "node", "left").select(*same, F.coalesce("label", "node").alias("label")), "named")
    return signed.join(named, same).select("row", *carry, "label")
