"""Synthetic rows from adaptive buckets.

Every selected column becomes a real dimension with a root range of a power of two. For each combination of dimensions a tree halves all
its dimensions at each level, so a node is a cell of a grid: (combination, depth, cell numbers). Nodes are counted level by level with
group-bys (all combinations at once), never by inserting rows one after the other, so the forest does not depend on their order. Rows are read once:
entities with one point only (a combination of values) are counted for each point, and a level puts these counts together; it adds up again just what
belongs to entities with several points.

Buckets are made from the deepest level up, again by group-bys and joins of whole levels: a leaf gives its own bucket, and a node the buckets of its
children, scaled to its count or filled up with matches of buckets that have a dimension less. Nodes, buckets and rows are tables in the shared folder;
the driver sees the ends of the columns and whether a level is empty. A node's matches are drawn by a seeded generator in blocks of ``BLOCK``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions import hashing as H
from hushframe.operators.anonymize import ROWS, Agg, Aid, Context, Prepared, combine, flatten, hashed, join_keys, prepare, statistics, threshold, _entities, _seeded
from hushframe.storage import materialize

#: Timestamps are seconds from here (fixed value).
EPOCH = "1800-01-01 00:00:00"
DEEPEST = 60
#: Of smaller ranges halves could not be told apart.
LEAST_RANGE = 2.0**-1000
Range = tuple[float, float]


def text_number(text: Column) -> Column:
    """A moderate positive real for a text: its hash with the highest byte fixed to 0x40, read as a float of 64 bits."""
    return H.let(H.fnv_text(text), lambda h: F.pow(F.lit(2.0), 1 + F.shiftright(h["hi"], 20).bitwiseAND(F.lit(15))) * (1 + (h["hi"].bitwiseAND(F.lit((1 << 20) - 1)).cast("double") * 2.0**32 + h["lo"]) / 2.0**52))


def encode(column: Column, kind: str) -> Column:
    if kind == "text":
        return text_number(column)
    if kind == "timestamp":
        return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), column).cast("double") / 1e6
    return column.cast("double") if kind != "boolean" else column.cast("int").cast("double")


def snap(low: float, high: float) -> Range:
    """The least range of a power of two, aligned to half its size, that holds both ends."""
    while True:
        size = max(2.0 ** math.ceil(math.log2(high - low)), LEAST_RANGE) if high > low else 1.0
        start = math.floor(low / (size / 2)) * (size / 2)
        if start + size >= high:
            return start, start + size
        low = start


#: Draws of one node that are made, and equal rows that are written, at once.
BLOCK = 1 << 16
#: Buckets of a node are scaled in so many groups, which know what those before them left over.
GROUPS = 256
_NODE = ["node", "size", "n", "crosses", "solid", "alo", "ahi", "slo", "shi"]


def _cell(roots: list[Range], depth: int, dim: int) -> Column:
    low, high = roots[dim]
    step = (high - low) / 2.0**depth
    return F.least(F.greatest(F.floor((F.col(f"f{dim}") - low) / step), F.lit(0)), F.lit(2**depth - 1)).cast("long")


def _name(combos: list[tuple[int, ...]], roots: list[Range], depth: int) -> Column:
    """The nodes of a row at a depth, one for each combination: "combination:cell,cell"."""
    return F.array(*(F.concat(F.lit(",".join(map(str, c)) + ":"), F.concat_ws(",", *(_cell(roots, depth, d).cast("string") for d in c))) for c in combos))


def _dims(node: Column) -> Column:
    return F.split(F.split_part(node, F.lit(":"), F.lit(1)), ",").cast("array<int>")


def _cells(node: Column) -> Column:
    return F.split(F.split_part(node, F.lit(":"), F.lit(2)), ",").cast("array<bigint>")


def _without(values: Column, out: Column) -> Column:
    return F.filter(values, lambda _, i: i != out)


def _projected(node: Column, out: Column) -> Column:
    """The node's cell in the grid that lacks one of its dimensions (by its place)."""
    return F.concat(F.array_join(_without(_dims(node), out).cast("array<string>"), ","), F.lit(":"), F.array_join(_without(_cells(node), out).cast("array<string>"), ","))


def _parent(node: Column) -> Column:
    return F.concat(F.split_part(node, F.lit(":"), F.lit(1)), F.lit(":"), F.array_join(F.transform(_cells(node), lambda c: F.shiftright(c, 1)).cast("array<string>"), ","))


def _places(size: int) -> Column:
    return F.explode(F.array(*map(F.lit, range(size))))


def tasks(spark: SparkSession) -> int:
    """Parts for rows whose number the size of their files does not tell."""
    return 4 * spark.sparkContext.defaultParallelism


def repeated(df: DataFrame, count: str, into: str) -> DataFrame:
    """Each row as often as it says, numbered from 1; a block at a time is in memory."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / BLOCK))
    out = df.filter(F.col(count) > 0).withColumn("__block", F.explode(blocks))
    first = F.col("__block") * BLOCK + 1
    # A few large counts would stand in one task.
    return out.repartition(tasks(df.sparkSession)).withColumn(into, F.explode(F.sequence(first, F.least(F.col(count), first + (BLOCK - 1))))).drop("__block")


class Forest:
    """``levels``: a table of nodes for each depth."""

    def __init__(self, df: DataFrame, columns: dict[str, tuple[Column, str]], aids: list[Aid], context: Context):
        self.context, self.params = context, context.params
        self.names, self.kinds = list(columns), [k for _, k in columns.values()]
        self.aids = [Aid(F.col(f"a{i}"), a.integer) for i, a in enumerate(aids)]
        self.integers = [a.integer for a in aids]
        n = len(columns)
        texts = [i for i, k in enumerate(self.kinds) if k == "text"]
        spread = df.select(*(c.alias(f"v{i}") for i, (c, _) in enumerate(columns.values())), *((a.column.cast("long") if a.integer else a.column.cast("string")).alias(f"a{i}") for i, a in enumerate(aids))).repartition(tasks(df.sparkSession))
        # Texts are long to encode, so that is done once.
        rows = materialize(spread.select(*(encode(F.col(f"v{i}"), k).alias(f"f{i}") for i, k in enumerate(self.kinds)), *(F.col(f"v{i}") for i in texts), *(f"a{i}" for i in range(len(aids)))), "points")
        self.texts = {i: rows.select(F.col(f"v{i}").alias("text"), F.col(f"f{i}").alias("value")).distinct() for i in texts}
        ends = rows.agg(*(f(f"f{i}").alias(f"{f.__name__}{i}") for i in range(n) for f in (F.min, F.max))).first()
        pairs = [(ends[f"min{i}"] or 0.0, ends[f"max{i}"] or 0.0) for i in range(n)]
        self.nulls = [2 * hi if hi > 0 else 2 * lo if lo < 0 else 1.0 for lo, hi in pairs]
        self.roots = [snap(min(lo, z), max(hi, z)) for (lo, hi), z in zip(pairs, self.nulls, strict=True)]
        self._count_points(rows.select(*(F.coalesce(F.col(f"f{i}"), F.lit(z)).alias(f"f{i}") for i, z in enumerate(self.nulls)), *(f"a{i}" for i in range(len(aids)))))
        for i in range(n):
            self._push_down(i)
        self.combos = [c for size in range(1, n + 1) for c in combinations(range(n), size)]
        self.levels: list[DataFrame] = []
        self._grow()

    def _count_points(self, rows: DataFrame) -> None:
        """``points``: all of them; ``single``: statistics of each point's entities that have no other one; ``mixed``: entities (or None) at each of their several points."""
        at = [f"f{i}" for i in range(len(self.roots))]
        self.points = materialize(rows.select(*at).distinct(), "distinct")
        p = prepare(rows, {f: F.col(f) for f in at}, self.aids, {}, self.context)
        entities = p.rows.select(*(F.col(k).alias(f) for k, f in zip(p.keys, at, strict=True)), _entities(p))
        entities = entities.groupBy(*at, "aid", "t").agg(F.count(F.lit(1)).cast("double").alias("amount")).withColumn("entity", F.col("t"))
        # What belongs to no entity is one row for each point.
        own = Window.partitionBy("aid", "entity", F.when(F.col("entity").isNull(), F.xxhash64(*at)))
        counted = materialize(hashed(entities, self.integers).withColumn("several", F.col("entity").isNotNull() & (F.count(F.lit(1)).over(own) > 1)), "entities")
        most = self.params.outlier_count.upper + self.params.top_count.upper
        self.single = materialize(statistics(counted.filter("not several").withColumn("leg", F.lit(ROWS + 1)), at, most), "single")
        mixed = counted.filter("several")
        self.mixed = None if mixed.isEmpty() else mixed

    def _statistics(self, placed: Callable[[DataFrame], DataFrame], most: int = 0) -> DataFrame:
        """``statistics`` of the key ``k0``, which ``placed`` gives to points; the largest entities for the leg after ROWS."""
        parts = placed(self.single).select("k0", "aid", "n", "total", "unaccounted", "xor.hi", "xor.lo", "top")
        if self.mixed is not None:
            again = placed(self.mixed).groupBy("k0", "aid", "entity", "h").agg(F.sum("amount").alias("amount"))
            parts = parts.unionByName(again.select("k0", "aid", F.lit(1).cast("long").alias("n"), F.col("amount").alias("total"), F.lit(0.0).alias("unaccounted"), "h.hi", "h.lo", F.array(F.struct(F.lit(1).alias("rank"), "amount", "h")).alias("top")))
        xor = F.struct(F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo")).alias("xor")
        stats = parts.groupBy("k0", "aid").agg(*(F.sum(c).alias(c) for c in ("n", "total", "unaccounted")), xor)
        if not most:
            return stats.withColumn("leg", F.lit(ROWS))
        order = Window.partitionBy("k0", "aid").orderBy(F.col("amount").desc(), F.col("h.hi").desc(), F.col("h.lo").desc())
        top = parts.select("k0", "aid", F.explode("top").alias("z")).select("k0", "aid", "z.amount", "z.h").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        top = top.groupBy("k0", "aid").agg(F.array_sort(F.collect_list(F.struct("rank", "amount", "h"))).alias("top"))
        stats = join_keys(stats, top, ["k0", "aid"], "left").withColumn("leg", F.explode(F.array(F.lit(ROWS), F.lit(ROWS + 1))))
        return stats.withColumn("top", F.when(F.col("leg") != ROWS, F.col("top")))

    def _push_down(self, dim: int) -> None:
        """Halves a root as long as exactly one of its halves has enough entities."""
        for _ in range(DEEPEST):
            low, high = self.roots[dim]
            half = F.when(F.col(f"f{dim}") < (low + high) / 2, 0).otherwise(1)
            crosses = {r["k0"]: not r["low"] for r in self._verdicts(self._statistics(lambda t, half=half: t.withColumn("k0", half))).select("k0", "low").collect()}
            if crosses.get(0, False) == crosses.get(1, False):
                return
            self.roots[dim] = (low, (low + high) / 2) if crosses.get(0, False) else ((low + high) / 2, high)

    def _verdicts(self, stats: DataFrame) -> DataFrame:
        ab = self.params.adaptive_buckets
        few = lambda n: F.bool_or(threshold(self.params, F.col("n"), F.col("xor"), n))
        return stats.filter(F.col("leg") == ROWS).groupBy("k0").agg(few(None).alias("low"), few(ab.singularity_low_threshold).alias("low_single"), few(ab.range_low_threshold).alias("low_range"))

    def _counted(self, placed: Callable[[DataFrame], DataFrame], depth: int) -> DataFrame:
        """Nodes that ``placed`` gives to points as ``k0``: noisy count, whether they cross the low threshold and are solid enough to be no stub, the ends of their values, and their cells' ends."""
        p = Prepared(self.points, ["node"], len(self.aids), {"n": Agg("count")}, self.context, ["k0"])
        stats = self._statistics(placed, self.params.outlier_count.upper + self.params.top_count.upper)
        counts = combine(flatten(_seeded(stats, p), self.params), p, False).select("k0", "n")
        dims = range(len(self.roots))
        ends = placed(self.points).groupBy("k0").agg(*(F.array(*(f(f"f{i}") for i in dims)).alias(n) for f, n in ((F.min, "lows"), (F.max, "highs"))))
        out = counts.join(self._verdicts(stats), "k0").join(ends, "k0").withColumnRenamed("k0", "node")
        out = out.withColumns({"dims": _dims(F.col("node")), "cells": _cells(F.col("node"))})
        of = lambda values: F.transform("dims", lambda d: F.get(F.col(values), d))
        starts, steps = F.array(*(F.lit(lo) for lo, _ in self.roots)), F.array(*(F.lit((hi - lo) / 2.0**depth) for lo, hi in self.roots))
        edge = lambda more: F.transform(F.arrays_zip("dims", "cells"), lambda z: F.get(starts, z["dims"]) + (z["cells"] + more) * F.get(steps, z["dims"]))
        out = out.withColumns({"alo": of("lows"), "ahi": of("highs"), "slo": edge(0), "shi": edge(1), "size": F.size("dims"), "crosses": ~F.col("low")})
        return out.withColumn("solid", ~F.when(F.col("alo") == F.col("ahi"), F.col("low_single")).otherwise(F.col("low_range"))).select(*_NODE)

    def _grow(self) -> None:
        """Level by level: rows of nodes that are split go on to the next depth."""
        for depth in range(DEEPEST):
            if not self.levels:
                placed = lambda t: t.withColumn("k0", F.explode(_name(self.combos, self.roots, 0)))
            else:
                parents = F.arrays_zip(_name(self.combos, self.roots, depth - 1).alias("parent"), _name(self.combos, self.roots, depth).alias("node"))
                split = self.levels[-1].filter("split").select(F.col("node").alias("parent"))
                placed = lambda t, parents=parents, split=split: t.withColumn("z", F.explode(parents)).select(*t.columns, "z.parent", F.col("z.node").alias("k0")).join(split, "parent", "left_semi")
            nodes = self._counted(placed, depth)
            # With several dimensions a level is read more than once.
            level = self._judged(nodes if len(self.roots) == 1 else materialize(nodes, "nodes"))
            self.levels.append(materialize(self._halved(level, depth), "level"))
            if self.levels[-1].filter("split").isEmpty():
                return

    def _judged(self, nodes: DataFrame) -> DataFrame:
        """Adds stub (no node with a dimension less, in the same cell, is solid and no stub itself) and split."""
        out, lower = None, None
        for size in range(1, len(self.roots) + 1):
            own = nodes.filter(F.col("size") == size)
            if lower is None:
                own = own.withColumn("stub", F.lit(False))
            else:
                found = own.select("node", _places(size).alias("out")).select("node", _projected(F.col("node"), F.col("out")).alias("lower")).join(lower, "lower")
                own = own.join(found.groupBy("node").agg(F.bool_or("carries").alias("carried")), "node", "left").withColumn("stub", ~F.coalesce("carried", F.lit(False))).drop("carried")
            lower = own.select(F.col("node").alias("lower"), (F.col("solid") & ~F.col("stub")).alias("carries"))
            out = own if out is None else out.unionByName(own)
        return out.withColumn("split", ~F.col("stub") & F.col("crosses") & (F.col("alo") != F.col("ahi")))

    def _halved(self, level: DataFrame, depth: int) -> DataFrame:
        """Adds hlo and hhi: the cell's ends, without the half of each dimension that has not enough entities. Only stubs are cut."""
        if len(self.roots) == 1:
            return level.withColumns({"hlo": F.col("slo"), "hhi": F.col("shi")})
        stubs = level.filter("stub and crosses").filter(F.col("alo") != F.col("ahi")).select("node")
        halves = F.array(*(F.pmod(_cell(self.roots, depth + 1, d), F.lit(2)).cast("string") for d in range(len(self.roots))))
        key = F.concat_ws("/", "node", F.col("place").cast("string"), F.get("halves", F.col("dim")))

        def placed(table: DataFrame) -> DataFrame:
            rows = table.withColumns({"node": F.explode(_name(self.combos, self.roots, depth)), "halves": halves}).join(stubs, "node", "left_semi")
            return rows.select(*table.columns, "node", "halves", F.posexplode(_dims(F.col("node"))).alias("place", "dim")).withColumn("k0", key)

        good = self._verdicts(self._statistics(placed)).filter("not low")
        part = lambda i: F.split_part("k0", F.lit("/"), F.lit(i))
        cut = good.select(part(1).alias("node"), part(2).cast("int").alias("place"), part(3).alias("half")).groupBy("node", "place").agg(F.count(F.lit(1)).alias("halves"), F.min("half").alias("half")).filter("halves = 1")
        cut = cut.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("place", "half"))).alias("cut"))
        middle = lambda z: (z["slo"] + z["shi"]) / 2
        zipped = F.arrays_zip("slo", "shi")
        side = lambda keep, end: F.transform(zipped, lambda z, i: F.when(F.try_element_at("cut", i) == keep, middle(z)).otherwise(z[end]))
        return level.join(cut, "node", "left").withColumns({"hlo": side("1", "slo"), "hhi": side("0", "shi")}).drop("cut")


def _shown(end: str) -> Column:
    """What a bucket tells: a value where there is one only, else the cell."""
    ends = F.arrays_zip("alo", "ahi", "slo", "shi")
    return F.transform(ends, lambda z: F.when(z["alo"] == z["ahi"], z[f"a{end}"]).otherwise(z[f"s{end}"]))


def scaled(buckets: DataFrame) -> DataFrame:
    """Counts of (node, lo, hi, count, total, n) in proportion, so that they add up to n; what rounding leaves goes on to the next ones."""
    exact = F.col("count") * F.col("n") / F.col("total")
    out = buckets.withColumns({"exact": exact, "group": F.pmod(F.xxhash64("lo", "hi"), F.lit(GROUPS))})
    sums = out.groupBy("node", "group").agg(F.sum("exact").alias("part"))
    before = F.coalesce(F.sum("part").over(Window.partitionBy("node").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = out.join(sums.select("node", "group", before.alias("before")), ["node", "group"])
    until = F.col("before") + F.sum("exact").over(Window.partitionBy("node", "group").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda x: F.floor(x + 1e-6)
    return out.withColumn("until", until).select("node", "lo", "hi", (whole(F.col("until")) - whole(F.col("until") - F.col("exact"))).cast("long").alias("count"))


_DRAWN = pa.schema([("node", pa.string()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("count", pa.int64())])


def match(node: pa.Table, below: pa.Table) -> pa.Table:
    """Draws for one block of a node: a range of one dimension, and the others from a bucket that lacks it; dimensions take turns.

    ``below``: buckets that lack the dimension at place ``out``. Only what lies within the ranges they show together is drawn; without such, the node's own bucket stands.
    """
    own = node.to_pylist()[0]
    k, want = len(own["lo"]), own["want"]
    plain = pa.Table.from_pylist([{"node": own["node"], "lo": own["lo"], "hi": own["hi"], "count": want}], _DRAWN)
    out, weights = np.asarray(below.column("out")), np.asarray(below.column("count"), np.float64)
    if set(out.tolist()) != set(range(k)):
        return plain
    # A range for every dimension of each bucket, none for the one it lacks.
    low, high = np.full((len(out), k), np.nan), np.full((len(out), k), np.nan)
    for i in range(k):
        at = out == i
        rest = [j for j in range(k) if j != i]
        low[np.ix_(at, rest)] = np.array(below.filter(pa.array(at)).column("lo").to_pylist())
        high[np.ix_(at, rest)] = np.array(below.filter(pa.array(at)).column("hi").to_pylist())
    fits = np.ones((len(out), k), bool)
    for j in range(k):
        spans = [(low[out == i, j].min(), high[out == i, j].max()) for i in range(k) if i != j]
        a, b = min(spans, key=lambda r: r[1] - r[0])
        c, d = own["hlo"][j], own["hhi"][j]
        a, b = (max(a, c), min(b, d)) if c < b and d > a else (min(a, c), max(b, d))
        fits[:, j] = (out == j) | (low[:, j] >= a) & (high[:, j] <= b)
    one = [(out != j) & fits[:, j] for j in range(k)]
    others = [(out == j) & fits.all(1) for j in range(k)]
    if not all(x.any() for x in (*one, *others)):
        return plain
    rng = np.random.default_rng(own["seed"] & (1 << 63) - 1)
    draw = lambda mask, size: rng.choice(np.flatnonzero(mask), size, p=weights[mask] / weights[mask].sum())
    turns = k - 1 - np.arange(want) % k
    rows = []
    for j in range(k):
        size = int((turns == j).sum())
        a, b = draw(one[j], size), draw(others[j], size)
        lows, highs = low[b], high[b]
        lows[:, j], highs[:, j] = low[a, j], high[a, j]
        rows.append(np.concatenate([lows, highs], axis=1))
    found, count = np.unique(np.concatenate(rows), axis=0, return_counts=True)
    ends = [pa.array(list(found[:, x : x + k]), pa.list_(pa.float64())) for x in (0, k)]
    return pa.Table.from_arrays([pa.array([own["node"]] * len(found)), *ends, pa.array(count, pa.int64())], schema=_DRAWN)


def _matched(nodes: DataFrame, lower: DataFrame, size: int) -> DataFrame:
    """(node, lo, hi, count) of ``want`` matches for each of ``nodes``; ``lower``: the buckets of the same depth that have a dimension less."""
    block = F.col("__block")
    blocks = nodes.filter("want > 0").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("want") - 1) / BLOCK))))
    own = blocks.select("node", block, F.least(F.lit(BLOCK), F.col("want") - block * BLOCK).alias("want"), _shown("lo").alias("lo"), _shown("hi").alias("hi"), "hlo", "hhi", F.xxhash64("node", block).alias("seed"))
    each = blocks.select("node", block, "n", "alo", "ahi", _places(size).alias("out"))
    single = _without(F.col("alo"), F.col("out")) == _without(F.col("ahi"), F.col("out"))
    known = each.filter(single).select("node", block, "out", _without(F.col("alo"), F.col("out")).alias("lo"), _without(F.col("ahi"), F.col("out")).alias("hi"), F.col("n").alias("count"))
    others = each.filter(~single).withColumn("lower", _projected(F.col("node"), F.col("out"))).join(lower.withColumnRenamed("node", "lower"), "lower").select("node", block, "out", "lo", "hi", "count")
    below = known.unionByName(others).filter("count > 0").select(F.col("node").alias("of"), F.col("__block").alias("part"), "out", "lo", "hi", "count")

    def run(node: pa.Table, below: pa.Table) -> pa.Table:
        return match(node, below) if node.num_rows else _DRAWN.empty_table()

    return own.groupBy("node", "__block").cogroup(below.groupBy("of", "part")).applyInArrow(run, "node string, lo array<double>, hi array<double>, count long")


def harvest(forest: Forest) -> DataFrame:
    """Buckets (lo, hi, count) of the combination of all dimensions."""
    dims, below = len(forest.roots), None
    for depth in range(len(forest.levels) - 1, -1, -1):
        level, done = forest.levels[depth], []
        for size in range(1, dims + 1):
            nodes = level.filter(F.col("size") == size)
            leaves = nodes.filter("not split and crosses")
            own = lambda rows: rows.select("node", _shown("lo").alias("lo"), _shown("hi").alias("hi"), F.col("n").alias("count"))
            plain = leaves if size == 1 else leaves.filter(F.col("alo") == F.col("ahi"))
            filled = None if size == 1 else leaves.filter(F.col("alo") != F.col("ahi")).withColumn("want", F.col("n"))
            parts = []
            if below is not None:
                given = below.filter(F.size("lo") == size).withColumn("node", _parent(F.col("node")))
                totals = given.groupBy("node").agg(F.sum("count").alias("total"))
                # A node whose children show too little of it is one bucket, or filled up.
                split = nodes.filter("split").join(totals, "node", "left").withColumn("total", F.coalesce("total", F.lit(0)))
                enough = 2 * F.col("total") >= F.col("n")
                parts.append(scaled(given.join(split.filter(enough & (F.col("total") > 0)).select("node", "n", "total"), "node")))
                short = split.filter(~enough)
                if size == 1:
                    plain = plain.unionByName(short.drop("total"))
                else:
                    parts.append(given.join(short.select("node"), "node", "left_semi"))
                    filled = filled.unionByName(short.withColumn("want", F.col("n") - F.col("total")).drop("total"))
            parts.append(own(plain))
            if size > 1:
                parts.append(_matched(filled, done[-1], size))
            every = reduce(DataFrame.unionByName, parts).groupBy("node", "lo", "hi").agg(F.sum("count").alias("count")).filter("count > 0")
            done.append(materialize(every, "buckets"))
        below = reduce(DataFrame.unionByName, done)
    return below.filter(F.size("lo") == dims).select("lo", "hi", "count")


def synthesize(df: DataFrame, columns: dict[str, tuple[Column, str]], aids: list[Aid], context: Context) -> DataFrame:
    """Rows under the names of ``columns`` that follow the distribution of ``df`` in anonymized buckets."""
    forest = Forest(df, columns, aids, context)
    buckets = harvest(forest).withColumn("bucket", F.xxhash64("lo", "hi"))
    for d, kind in enumerate(forest.kinds):
        buckets = buckets.withColumns({f"lo{d}": F.get("lo", F.lit(d)), f"hi{d}": F.get("hi", F.lit(d))})
        if kind == "text":
            # Equal reals for different texts are rare; one of them stands for both.
            known = forest.texts[d].groupBy(F.col("value").alias(f"lo{d}")).agg(F.min("text").alias(f"text{d}"))
            buckets = buckets.join(known, f"lo{d}", "left")
    rows = repeated(buckets.drop("lo", "hi"), "count", "i")
    made = []
    for d, (name, kind) in enumerate(zip(forest.names, forest.kinds, strict=True)):
        lo, hi = F.col(f"lo{d}"), F.col(f"hi{d}")
        share = F.pmod(F.xxhash64("bucket", "i", F.lit(d)), F.lit(1 << 30)).cast("double") / float(1 << 30)
        value = lo + share * (hi - lo)
        null = lo == forest.nulls[d]
        if kind == "text":
            made.append(F.when(null, None).when(lo == hi, F.col(f"text{d}")).otherwise("*").alias(name))
            continue
        typed = {"boolean": value >= 0.5, "integer": value.cast("long"), "real": value}.get(kind)
        if typed is None:
            typed = F.timestamp_add("MICROSECOND", F.round(value * 1e6).cast("long"), F.lit(EPOCH).cast("timestamp_ntz"))
        made.append(F.when(~null, typed).alias(name))
    return rows.select(*made)
