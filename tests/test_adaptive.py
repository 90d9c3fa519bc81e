import itertools
import math
import random
import struct
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.functions.hashing import fnv
from hushframe.operators import adaptive as ab
from hushframe.operators.anonymize import Agg, Aid, Context, contributed, prepare, statistics
from hushframe.params import Suppression, noiseless


def test_snapping():
    assert ab.snap(1, 21) == (0, 32) and ab.snap(0, 2) == (0, 2)
    assert ab.snap(0, 5e-324) == (0, ab.LEAST_RANGE) and ab.snap(-5e-324, 0) == (-ab.LEAST_RANGE / 2, ab.LEAST_RANGE / 2)


@given(st.floats(-1e6, 1e6), st.floats(0, 1e6))
def test_snapped_ranges_hold_their_ends(low, size):
    a, b = ab.snap(low, low + size)
    assert a <= low and low + size <= b
    n = b - a
    assert n == 2.0 ** round(math.log2(n)) and (a / (n / 2)).is_integer()


def test_texts_become_reals(spark):
    texts = ["", "a", "Berlin", "Zoë"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ab.text_number(F.col("t")).alias("x")).collect()
    for r in got:
        bits = fnv(r["t"]) & ((1 << 56) - 1) | 0x40 << 56
        assert r["x"] == struct.unpack("<d", struct.pack("<Q", bits))[0]


def make(spark, rows, schema, kinds):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {schema}")
    params = noiseless({}, suppression=Suppression(3, 0.0, 0.0))
    return ab.synthesize(df, {n: (F.col(n), k) for n, k in kinds.items()}, [Aid(F.col("id"), True)], Context(params))


def test_common_values_survive_and_rare_ones_do_not(spark):
    rows = [(3,)] * 40 + [(1,)] * 30 + [(None,)] * 20 + [(6,)]
    got = Counter(r["n"] for r in make(spark, rows, "n long", {"n": "integer"}).collect())
    assert abs(sum(got.values()) - 91) <= 5 and abs(got[3] - 40) <= 5 and abs(got[1] - 30) <= 5 and abs(got[None] - 20) <= 5


def test_nothing_in_nothing_out(spark):
    assert make(spark, [], "n long", {"n": "integer"}).count() == 0
    assert make(spark, [(1,), (2,)], "n long", {"n": "integer"}).count() == 0


def grown(points, roots, depths):
    """Nodes of all combinations by plain recursion over the points: node, n, crosses, solid, stub, split and the ends without bad halves."""
    dims = len(roots)
    combos = [c for size in range(1, dims + 1) for c in itertools.combinations(range(dims), size)]
    cell = lambda p, d, depth: min(max(math.floor((p[d] - roots[d][0]) / ((roots[d][1] - roots[d][0]) / 2**depth)), 0), 2**depth - 1)
    levels, alive = [], None
    for depth in range(depths):
        held = {}
        for combo in combos:
            for p in points:
                if alive is None or (combo, tuple(cell(p, d, depth - 1) for d in combo)) in alive:
                    held.setdefault((combo, tuple(cell(p, d, depth) for d in combo)), []).append(p)
        out = {}
        for (combo, cells), own in sorted(held.items(), key=lambda x: len(x[0][0])):
            single = all(len({p[d] for p in own}) == 1 for d in combo)
            below = [out.get((combo[:i] + combo[i + 1 :], cells[:i] + cells[i + 1 :])) for i in range(len(combo))] if len(combo) > 1 else []
            node = {"n": len(own), "crosses": len(own) >= 3, "solid": len(own) >= (4 if single else 8), "stub": bool(below) and all(x is None or x["stub"] or not x["solid"] for x in below)}
            node["split"] = node["crosses"] and not single and not node["stub"]
            steps = [(roots[d][1] - roots[d][0]) / 2**depth for d in combo]
            ends = [[roots[d][0] + c * s, roots[d][0] + (c + 1) * s] for d, c, s in zip(combo, cells, steps, strict=True)]
            if node["stub"] and node["crosses"] and not single:
                for i, d in enumerate(combo):
                    upper = sum(cell(p, d, depth + 1) % 2 for p in own)
                    if (upper >= 3) != (len(own) - upper >= 3):
                        ends[i][0 if upper >= 3 else 1] = sum(ends[i]) / 2
            node["ends"] = ends
            out[combo, cells] = node
        levels.append(out)
        alive = {k for k, x in out.items() if x["split"]}
        if not alive:
            return levels
    return levels


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_forest_is_that_of_plain_recursion(spark, dims):
    rng = random.Random(dims)
    rows = [tuple(rng.choice([rng.randint(0, 6), rng.randint(0, 60), 3]) for _ in range(dims)) for _ in range(150)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"x{d} long" for d in range(dims))).repartition(3)
    forest = ab.Forest(df, {f"x{d}": (F.col(f"x{d}"), "integer") for d in range(dims)}, [Aid(F.col("id"), True)], Context(noiseless({}, suppression=Suppression(3, 0.0, 0.0))))
    want = grown(rows, forest.roots, ab.DEEPEST)
    assert len(forest.levels) == len(want)
    for level, nodes in zip(forest.levels, want, strict=True):
        got = {r["node"]: r for r in level.collect()}
        named = {",".join(map(str, combo)) + ":" + ",".join(map(str, cells)): x for (combo, cells), x in nodes.items()}
        assert got.keys() == named.keys()
        for name, x in named.items():
            r = got[name]
            assert all(r[k] == x[k] for k in ("crosses", "solid", "stub", "split")) and r["n"] == max(3, x["n"] if x["n"] > 1 else 3)
            if x["stub"]:
                assert [list(e) for e in zip(r["hlo"], r["hhi"], strict=True)] == x["ends"]
    buckets = ab.harvest(forest).collect()
    assert abs(sum(b["count"] for b in buckets) - 150) <= 1 and all(len(b["lo"]) == dims and all(x <= y for x, y in zip(b["lo"], b["hi"], strict=True)) for b in buckets)


def test_scaled_counts_add_up(spark):
    rows = [("a", [float(i)], [i + 1.0], 1 + i % 7, None, 500) for i in range(400)] + [("b", [0.0], [1.0], 10, None, 7)]
    totals = Counter()
    for node, _, _, count, _, _ in rows:
        totals[node] += count
    df = spark.createDataFrame([(n, lo, hi, c, totals[n], w) for n, lo, hi, c, _, w in rows], "node string, lo array<double>, hi array<double>, count long, total long, n long").repartition(3)
    got = ab.scaled(df).collect()
    for node, want in (("a", 500), ("b", 7)):
        assert sum(r["count"] for r in got if r["node"] == node) == want
    assert all(abs(r["count"] - (1 + r["lo"][0] % 7) * 500 / totals["a"]) < 1 for r in got if r["node"] == "a")


def test_matches_keep_to_what_buckets_show():
    own = pa.Table.from_pylist([{"node": "0,1:0,0", "lo": [0.0, 0.0], "hi": [8.0, 8.0], "hlo": [0.0, 0.0], "hhi": [8.0, 8.0], "want": 1000, "seed": 5}])
    below = lambda rows: pa.Table.from_pylist([{"out": o, "lo": [a], "hi": [b], "count": c} for o, a, b, c in rows], pa.schema([("out", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("count", pa.int64())]))
    got = ab.match(own, below([(1, 1, 1, 30), (1, 3, 3, 10), (0, 5, 5, 20), (0, 6, 7, 20)])).to_pylist()
    assert sum(r["count"] for r in got) == 1000
    firsts = Counter()
    for r in got:
        firsts[r["lo"][0], r["hi"][0]] += r["count"]
        assert (r["lo"][1], r["hi"][1]) in {(5, 5), (6, 7)}
    assert firsts.keys() == {(1, 1), (3, 3)} and abs(firsts[1, 1] - 750) < 80
    # A dimension of which nothing is known: the node's own bucket.
    assert ab.match(own, below([(1, 1, 1, 30)])).to_pylist() == [{"node": "0,1:0,0", "lo": [0.0, 0.0], "hi": [8.0, 8.0], "count": 1000}]


def test_many_equal_rows_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ab, "BLOCK", 7)
    df = spark.createDataFrame([("a", 30), ("b", 0), ("c", 7), ("d", 1)], "k string, n long")
    got = ab.repeated(df, "n", "i").groupBy("k").agg(F.count("i").alias("n"), F.countDistinct("i").alias("m"), F.max("i").alias("x")).collect()
    assert {(r["k"], r["n"], r["m"], r["x"]) for r in got} == {("a", 30, 30, 30), ("c", 7, 7, 7), ("d", 1, 1, 1)}


def test_large_counts_are_spread(spark):
    df = spark.createDataFrame([("a", 20 * ab.BLOCK)], "k string, n long").coalesce(1)
    parts = ab.repeated(df, "n", "i").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 20 * ab.BLOCK and len(parts) > 1


def test_levels_read_points_and_not_rows(spark):
    """Two kinds of entities, some missing, some with several points: the statistics of cells are those of all rows, though few rows are kept."""
    rng = random.Random(5)
    rows = [(rng.choice([None, i, i % 40]), rng.choice([None, f"e{i % 300}", "e"]), i % 3, rng.randint(0, 4)) for i in range(1500)] + [(10000 + i, f"s{i}", 7, 7) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b string, x long, y long")
    aids, context = [Aid(F.col("a"), True), Aid(F.col("b"), False)], Context(noiseless({}, suppression=Suppression(3, 0.0, 0.0)))
    forest = ab.Forest(df, {c: (F.col(c), "integer") for c in "xy"}, aids, context)
    assert forest.points.count() == 16 and forest.single.count() <= 32
    p = prepare(df, {"k": F.col("x")}, aids, {"n": Agg("count")}, context)
    want = statistics(contributed(p, [True, False]), p.keys, 2).collect()
    got = forest._statistics(lambda t: t.withColumn("k0", F.col("f0").cast("long")), 2).collect()
    shown = lambda r: (r["k0"], r["aid"], r["leg"], r["n"], r["xor"], *((r["total"], r["unaccounted"], r["top"]) if r["leg"] == 0 else ()))
    assert len(want) == 16 and sorted(map(shown, got), key=str) == sorted(map(shown, want), key=str)


def test_levels_of_three_dimensions_keep_eight_points(spark):
    df = spark.range(4000).selectExpr("id", "id % 2 = 0 AS a", "id % 4 < 2 AS b", "id % 8 < 4 AS c")
    forest = ab.Forest(df, {c: (F.col(c), "boolean") for c in "abc"}, [Aid(F.col("id"), True)], Context(noiseless({})))
    assert forest.mixed is None and forest.points.count() == forest.single.count() == 8
    assert sorted((tuple(r["lo"]), r["count"]) for r in ab.harvest(forest).collect()) == [((float(i >> 2), float(i >> 1 & 1), float(i & 1)), 500) for i in range(8)]
