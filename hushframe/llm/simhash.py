"""Near-duplicates by SimHash fingerprints and pivot distance tables.

The pivot table holds the Hamming distances of every fingerprint to ``2 * 8`` pivot fingerprints. Two fingerprints at
distance r differ by at most r in every coordinate (triangle inequality), so pairs with a larger coordinate difference are
discarded and only survivors are verified bit by bit.

A pivot table alone must look at all pairs. Pairs are therefore met in blocks: the 64 bits are cut into b blocks, two
fingerprints with at most r differing bits agree in at least b - r of them, and each choice of b - r blocks is a key; b grows with the
number of fingerprints. This loses no pair. A key shared by many fingerprints is cut into tiles (``meeting``): rows of a tile meet first,
then only those that are not connected yet. Within a group only a forest of the links goes on, which keeps components whole.

Rows: one per document row, repeated rows too. Null, empty and blank texts have fingerprint zero and are linked like any other; a null doc_id
is never a component's smallest (a component of null ids has none); a bit set in exactly half the shingles is 0; texts of any length are read whole; an
empty table gives no rows; columns besides id, text and ``carry`` are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import as_bytes, cut, materialize, mix64
from hushframe.llm.meeting import meet
from hushframe.operators.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
PIVOTS = 16
#: A key with more fingerprints than this is dealt in tiles of this size.
TILE = 2048


def fingerprints(docs: list[bytes], width: int = SHINGLE) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes, sizes = [], []
    for doc in docs:
        w = doc.lower().split()
        grams = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)] if w else []
        own = [digest(g, SEED) for g in grams]
        hashes += own
        sizes.append(len(own))
    n = np.array(sizes, np.int64)
    out = np.zeros(len(docs), np.uint64)
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = n > 0
    counts = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * counts > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_udf():
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([fingerprints(as_bytes(p)) for p in cut(texts, texts, 1 << 18)] or [np.zeros(0, np.uint64)]).view(np.int64))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")


def pivots(words: int = 1) -> np.ndarray:
    """A row of ``words`` 64-bit words for each pivot."""
    return mix64(np.arange(1, PIVOTS * words + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).reshape(PIVOTS, words)


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table of fingerprints of any number of words (a row each)."""
    return np.stack([np.bitwise_count(fp ^ p).sum(1) for p in pivots(fp.shape[1])], axis=1).astype(np.int16)


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fps`` with the distances to the pivots, eight to a long."""
    packed = []
    for half in pivots().view(np.int64).reshape(2, 8).tolist():
        column = F.lit(0).cast("long")
        for i, p in enumerate(half):
            column = column.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
        packed.append(column)
    return fps.withColumns({"d0": packed[0], "d1": packed[1]})


def blocks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the keys, so many bits each that a key meets few of n fingerprints by chance."""
    b = radius + 1
    while 64 * (b - radius) / b < np.log2(max(n, 2)) + 1 and comb(b + 1, radius) <= 100:
        b += 1
    edges = [64 * i // b for i in range(b + 1)]
    parts = [sum(1 << j for j in range(x, y)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(c) for c in combinations(parts, b - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the least of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]
        label = new


def _pairs(group: np.ndarray, fp: np.ndarray, d: np.ndarray, label: np.ndarray, radius: int):
    """Links (numbers of rows) among rows of equal ``group`` (sorted) with different labels, by the pivots and then bit by bit."""
    u, v, held = [], [], 0
    for s in range(1, len(group)):
        i = np.flatnonzero(group[s:] == group[:-s])
        if not len(i):
            break
        i = i[label[i + s] != label[i]]
        i = i[(np.abs(d[i + s] - d[i]).max(1) <= radius)]
        i = i[np.bitwise_count(fp[i + s] ^ fp[i]).sum(1) <= radius]
        u.append(i + s)
        v.append(i)
        held += len(i)
        if held > 1 << 18:
            x, y = _forest(np.concatenate(u), np.concatenate(v))
            u, v, held = [x], [y], 0
    if not u or not held + len(u[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(u), np.concatenate(v))


def _link(radius: int, words: tuple[str, ...]):
    def run(batches):
        kept = None

        def solve(t):
            cols = [np.asarray(t.column(k)) for k in ("t", "key", "i", "j")]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            fp = np.stack([np.asarray(t.column(w)) for w in words], axis=1).view(np.uint64)
            d = np.stack([np.asarray(t.column("d0")), np.asarray(t.column("d1"))], axis=1).view(np.int8).reshape(-1, PIVOTS) if "d0" in t.column_names else distances(fp)
            label = np.asarray(t.column("label"))
            x, y = _pairs(np.cumsum(new), fp, d, label, radius)
            return pa.RecordBatch.from_arrays([pa.array(label[x], pa.int64()), pa.array(label[y], pa.int64())], names=["u", "v"])

        for batch in batches:
            rows = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch]).combine_chunks()
            last = np.ones(rows.num_rows, bool)
            for k in ("t", "key", "i", "j"):
                c = np.asarray(rows.column(k))
                last &= c == c[-1] if len(c) else last
            cutoff = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            if cutoff:
                yield solve(rows.slice(0, cutoff).combine_chunks())
            kept = rows.slice(cutoff)
        if kept is not None and kept.num_rows:
            yield solve(kept.combine_chunks())

    return run


def linked(keyed: DataFrame, parts: int, radius: int, tile: int, node: str = "fp", words: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(u, v): links of the labels (nodes, unless ``keyed`` has a label) of rows that share a key and are at most ``radius`` bits apart, as forests of the groups they meet in.

    ``keyed``: (t, key, node, words of the fingerprint), and the pivot table in d0 and d1; without these it is made where rows meet.
    """
    by = ("t", "key", "i", "j")
    names = dict.fromkeys((node, *words, *(c for c in ("d0", "d1") if c in keyed.columns)))

    def solve(dealt: DataFrame) -> DataFrame:
        return dealt.select(*by, *names, "label").repartition(parts, *by).sortWithinPartitions(*by, node).mapInArrow(_link(radius, words), "u long, v long")

    return meet(keyed, ["t", "key"], node, F.lit(1.0 / tile), solve)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): fingerprints at most ``radius`` bits apart, as forests of the groups they meet in. ``fps``: distinct, in a column fp."""
    n = fps.count()
    masks = blocks(n, radius)
    keyed = pivot_table(fps).select("fp", "d0", "d1", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // 500_000)
    return linked(keyed, parts, radius, TILE)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry, fp, label, component_id) for each row of ``docs``: label is the component's least fingerprint, component_id the smallest doc_id in it."""
    printed = materialize(docs.select(F.col(id_col).alias("doc_id"), *carry, fingerprint_udf()(F.col(text_col)).alias("fp")), "fingerprints")
    classes = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    labelled = materialize(classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    named = materialize(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "named")
    named = labelled.join(named, "label").select("fp", "label", "component_id")
    return printed.join(named, "fp").select("doc_id", *carry, "fp", "label", "component_id")
