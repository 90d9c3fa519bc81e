import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hushframe.llm import mixing, shard_tree


def test_shards_of_odd_rows(odd, odd_rows, empty):
    got = shard_tree.shard_rows(odd)
    rows = got.collect()
    assert len(rows) == len(odd_rows) and shard_tree.shard_rows(empty).count() == 0
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(odd.columns) <= set(got.columns)


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    got = shard_tree.assign(ids, F.col("doc_id"), {"a": shard_tree.topology(n), "b": shard_tree.topology(n + 1)}).collect()
    assert all(r["b"] in (r["a"], n) for r in got)
    counts = Counter(r["b"] for r in got)
    assert len(counts) == n + 1 and all(abs(c - 3000 / (n + 1)) < 6 * math.sqrt(3000 / (n + 1)) for c in counts.values())


def test_movement_follows_weights(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    old, new = shard_tree.topology(8), shard_tree.topology(8)
    new[3] = shard_tree.Leaf(new[3].region, new[3].rack, 3, 2.0)
    got = shard_tree.assign(ids, F.col("doc_id"), {"a": old, "b": new}).collect()
    moved = [r for r in got if r["a"] != r["b"]]
    assert moved and all(r["b"] == 3 for r in moved)
    assert abs(sum(r["b"] == 3 for r in got) - 3000 * 2 / 9) < 120


def water(sizes, weights, most=3):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 1000, None: 5}, {"a": 1, "b": 1, "c": 10_000, "d": 3, "e": 500}, {"a": 7}, {"a": 0, "b": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got.keys() == sizes.keys()
    for s, t in water(sizes, mixing.WEIGHTS).items():
        assert abs(got[s] - t) < 1e-6


def test_mix_of_odd_rows(odd, odd_rows, empty):
    mixed = mixing.mix(mixing.sized(odd))
    rows = mixed.collect()
    assert len(rows) == len(odd_rows) and mixing.mix(mixing.sized(empty)).count() == 0
    assert all(r["size"] == len((r["doc"]["text"] or "").encode().split()) and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    out = mixing.emit(mixed)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in rows)


def test_mix_comes_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(mixing.sized(docs)).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r["k"] - r["t"]) < 0.15 * r["t"] for r in got)
