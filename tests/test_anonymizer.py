"""Noisy answers against the definition written out in plain Python."""

import math
import random
from collections import defaultdict
from functools import reduce
from operator import xor

import pytest
from pyspark.sql import functions as F

from hushframe.functions.hashing import crypt_number, fnv
from hushframe.operators.anonymize import Agg, Aid, Context, anonymize
from hushframe.params import Interval, Params, Suppression

TOP = (1 << 32) - 1


def normal(sd, seed):
    return sd * math.sqrt(-2 * math.log((seed & TOP) / TOP)) * math.sin(2 * math.pi * (seed >> 32) / TOP)


def noise(p, step, sd, layers):
    return sum(normal(sd, crypt_number(p.salt, layer) ^ fnv(step)) for layer in layers) if sd else 0.0


def uniform(interval, seed):
    return interval[0] + (((seed >> 32) ^ seed) & TOP) % (interval[1] - interval[0] + 1)


def entity(v):
    return fnv(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v)


def low(p, sets):
    def one(s):
        if len(s) < p.suppression.low_threshold:
            return True
        mean = p.suppression.low_threshold + p.suppression.low_mean_gap * p.suppression.layer_sd * math.sqrt(2)
        return len(s) < mean + noise(p, "suppress", p.suppression.layer_sd, [reduce(xor, s, 0)])

    return any(map(one, sets))


def flattened(p, seed, amounts, unaccounted):
    o, t, n = [p.outlier_count.lower, p.outlier_count.upper], [p.top_count.lower, p.top_count.upper], len(amounts)
    if n < o[0] + t[0]:
        return None
    surplus = max(0, o[1] + t[1] - n)
    o_cut = surplus // 2
    t_cut = surplus - o_cut
    if o_cut > o[1] - o[0]:
        o_cut = o[1] - o[0]
        t_cut = surplus - o_cut
    elif t_cut > t[1] - t[0]:
        t_cut = t[1] - t[0]
        o_cut = surplus - t_cut
    o[1], t[1] = o[1] - o_cut, t[1] - t_cut
    ranked = sorted(((c, a) for a, c in amounts.items()), reverse=True)
    flat_seed = crypt_number(p.salt, reduce(xor, (a for _, a in ranked[: o[1] + t[1]]), 0))
    oc, tc = uniform(o, flat_seed ^ fnv("outlier")), uniform(t, flat_seed ^ fnv("top"))
    mean = sum(c for c, _ in ranked[oc : oc + tc]) / tc
    flattening = sum(max(0, c - mean) for c, _ in ranked[:oc])
    kept = sum(amounts.values()) - flattening
    sd = p.layer_noise_sd * max(kept / n, mean / 2)
    return kept + max(0, unaccounted - flattening), flattening, sd, noise(p, "noise", sd, [seed, reduce(xor, amounts, 0)])


def combined(parts):
    value = max(parts, key=lambda x: (x[1], x[0]))[0]
    sd, _, made = max((x[2], abs(x[3]), x[3]) for x in parts)
    return value + made, sd


def away(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def expected(p, rows, seed, n_aids, integer):
    """(low, count, sum) of one bucket."""
    rows = [r for r in rows if any(a is not None for a in r[0])]
    sets = [{entity(r[0][i]) for r in rows if r[0][i] is not None} for i in range(n_aids)]

    def leg(amount, holds):
        out = []
        for i in range(n_aids):
            amounts, unaccounted = defaultdict(float), 0.0
            for aids, x in rows:
                if holds(x):
                    if aids[i] is None:
                        unaccounted += amount(x)
                    else:
                        amounts[entity(aids[i])] += amount(x)
            out.append(flattened(p, seed, amounts, unaccounted))
        return out

    counted = leg(lambda x: x is not None, lambda x: True)
    count = p.suppression.low_threshold if None in counted else max(p.suppression.low_threshold, away(combined(counted)[0]))
    plus, minus = leg(lambda x: x, lambda x: x is not None and x >= 0), leg(lambda x: -x, lambda x: x is not None and x <= 0)
    total = None
    if not any(a is None and b is None for a, b in zip(plus, minus, strict=True)):
        value = lambda parts: combined([x for x in parts if x])[0] if any(parts) else 0.0
        total = value(plus) - value(minus)
        total = away(total) if integer else total
    return low(p, sets), count, total


PARAMS = [Params(salt=b"salt"), Params(salt=b"other", outlier_count=Interval(1, 3), top_count=Interval(3, 4), layer_noise_sd=2.5, suppression=Suppression(4, 1.5, 2.0)), Params(strict=False, outlier_count=Interval(0, 2), top_count=Interval(1, 1), suppression=Suppression(2, 0.0, 0.0), layer_noise_sd=0.0)]


@pytest.mark.parametrize("params", PARAMS)
@pytest.mark.parametrize(("n_aids", "integer"), [(1, True), (2, False)])
def test_buckets(spark, params, n_aids, integer):
    rng = random.Random(f"{params.salt}{n_aids}")
    rows = []
    for k in ("a", "b", "c", None, "tiny"):
        for _ in range({"tiny": 3}.get(k, rng.randint(5, 120))):
            who = [None if rng.random() < 0.1 else rng.randint(1, rng.choice([4, 12, 40])), None if rng.random() < 0.1 else rng.choice("pqrstuvw") * rng.randint(1, 2)][:n_aids]
            x = None if rng.random() < 0.1 else rng.randint(-5, 20) if integer else rng.randint(-20, 80) / 4
            rows.append((k, *who, x))
    columns = ["k string", "a0 long", "a1 string"][: n_aids + 1] + [f"x {'long' if integer else 'double'}"]
    df = spark.createDataFrame(rows, ", ".join(columns)).repartition(5)
    aids = [Aid(F.col("a0"), True), Aid(F.col("a1"), False)][:n_aids]
    got = {r["k"]: r for r in anonymize(df, {"k": F.col("k")}, aids, {"n": Agg("count", F.col("x")), "s": Agg("sum", F.col("x"), integer)}, Context(params, 77, ("label",)), recover=False).collect()}
    assert got.keys() == {r[0] for r in rows}
    for k, r in got.items():
        seed = 77 ^ fnv("label") ^ fnv("NULL" if k is None else k)
        is_low, count, total = expected(params, [(x[1 : 1 + n_aids], x[-1]) for x in rows if x[0] == k], seed, n_aids, integer)
        assert (r["low"], r["n"]) == (is_low, count)
        assert r["s"] == total if integer or total is None else abs(r["s"] - total) < 1e-6


def dealt(p, rows, aid):
    """(number of safe values, amount for each entity) of a bucket, one value after the other."""
    shown = defaultdict(lambda: [set(), set()])
    for aids, v in rows:
        if v is not None and any(a is not None for a in aids):
            for i, a in enumerate(aids):
                shown[v][i] |= {entity(a)} if a is not None else set()
    rare = [v for v, sets in shown.items() if low(p, sets[: len(rows[0][0])])]
    stacks = defaultdict(list)
    for v in sorted(rare):
        for a in shown[v][aid]:
            stacks[a].append(v)
    queue, used, got = sorted(stacks.items(), key=lambda e: (len(e[1]), e[0])), set(), defaultdict(int)
    while any(s for _, s in queue):
        for a, s in queue:
            while s:
                v = s.pop()
                if v not in used:
                    used.add(v)
                    got[a] += 1
                    break
    return len(shown) - len(rare), got


@pytest.mark.parametrize("whole", [200_000, 0])
@pytest.mark.parametrize("params", PARAMS)
@pytest.mark.parametrize("n_aids", [1, 2])
def test_rare_distinct_values(spark, monkeypatch, params, n_aids, whole):
    """Values of few entities, some contested, some in several connected parts; all of them counted by entity, flattened and noised."""
    from hushframe.operators import anonymize as module

    monkeypatch.setattr(module, "WHOLE", whole)
    rng = random.Random(n_aids)
    rows = []
    for k in ("a", None):
        for i in range(150):
            who = [None if rng.random() < 0.05 else rng.randint(1, 25), None if rng.random() < 0.1 else rng.choice("pqrstuvwxyz")][:n_aids]
            rows.append((k, *who, None if i % 20 == 0 else rng.choice([f"own{i}", f"pair{i % 40}", f"few{i % 15}", "all", "most"])))
    df = spark.createDataFrame(rows, ", ".join([*["k string", "a0 long", "a1 string"][: n_aids + 1], "x string"])).repartition(3)
    aids = [Aid(F.col("a0"), True), Aid(F.col("a1"), False)][:n_aids]
    got = {r["k"]: r["n"] for r in anonymize(df, {"k": F.col("k")}, aids, {"n": Agg("count_distinct", F.col("x"))}, Context(params, 5), recover=False).collect()}
    for k, n in got.items():
        own = [(r[1:-1], r[-1]) for r in rows if r[0] == k]
        seed = 5 ^ fnv("NULL" if k is None else k)
        parts = [dealt(params, own, i) for i in range(n_aids)]
        flat = [flattened(params, seed, amounts, 0.0) for _, amounts in parts]
        safe = parts[0][0]
        want = safe if None in flat else away(combined(flat)[0]) + safe
        assert n == max(params.suppression.low_threshold, want)


def dropped(p, amounts):
    """What flattening takes from the largest entities."""
    o, t, n = p.outlier_count, p.top_count, len(amounts)
    surplus = max(0, o.upper + t.upper - n)
    o_cut = min(max(surplus // 2, surplus - (t.upper - t.lower)), o.upper - o.lower)
    o_up, t_up = o.upper - o_cut, t.upper - (surplus - o_cut)
    ranked = sorted(((c, a) for a, c in amounts.items()), reverse=True)
    seed = crypt_number(p.salt, reduce(xor, (a for _, a in ranked[: o_up + t_up]), 0))
    oc, tc = uniform((o.lower, o_up), seed ^ fnv("outlier")), uniform((t.lower, t_up), seed ^ fnv("top"))
    mean = sum(c for c, _ in ranked[oc : oc + tc]) / tc
    return {a: c - mean for c, a in ranked[:oc] if c > mean}


def noisy_buckets(p, rows, seed):
    """Counts of (keys, entity) rows with all steps: merging into siblings, the star bucket, suppression, noise and the recovery of outliers."""
    buckets = defaultdict(lambda: defaultdict(float))
    for keys, who in rows:
        buckets[keys][entity(who)] += 1
    is_low = {k: low(p, [set(b)]) for k, b in buckets.items()}
    moves, width = defaultdict(list), len(next(iter(buckets)))
    for k in buckets:
        siblings = [[x for x in buckets if x[:i] + x[i + 1 :] == k[:i] + k[i + 1 :]] for i in range(width)]
        targets = [x for s in siblings if len(s) == 2 for x in s if not is_low[x]]
        if is_low[k] and any(len(s) == 1 for s in siblings) and targets:
            moves[k] = targets
    merged = {k: dict(b) for k, b in buckets.items()}
    for k, targets in moves.items():
        for x in targets:
            for a, c in buckets[k].items():
                merged[x][a] = merged[x].get(a, 0.0) + c
    is_low = {k: low(p, [set(b)]) for k, b in merged.items()}
    loose = [k for k in merged if is_low[k] and k not in moves]
    star = defaultdict(float)
    for k in loose:
        for a, c in merged[k].items():
            star[a] += c
    shown = {k: b for k, b in merged.items() if not is_low[k]}
    if len(loose) >= 2 and not low(p, [set(star)]):
        shown["star"] = dict(star)
    counts, again = {}, defaultdict(float)
    for k, b in shown.items():
        labels = ["NULL", "*", "NULL"] if k == "star" else [str(k[0]), k[1], f"{k[2]:g}"]
        flat = flattened(p, reduce(xor, (fnv(t) for t in dict.fromkeys(labels)), seed), b, 0.0)
        counts[k] = p.suppression.low_threshold if flat is None else max(p.suppression.low_threshold, away(combined([flat])[0]))
        for a, c in (b if flat is None else dropped(p, b)).items():
            again[a] += c
    out = flattened(p, seed, again, 0.0)
    factor = 1 + (max(0, away(combined([out])[0])) if out else 0) / sum(counts.values())
    return {(None, "*", None) if k == "star" else k: away(n * factor) for k, n in counts.items()}


def test_a_noisy_query_with_all_steps(spark):
    """The registered query `noisy_fine` on customers, many of whose buckets are suppressed, and on heavier entities."""
    from hushframe import catalog
    from hushframe.engine import Engine

    sql = catalog.CATALOG["noisy_fine"][1]
    params, steps = catalog.MODES["noisy"]
    seed = fnv("customer.c_nationkey") ^ fnv("customer.c_mktsegment") ^ fnv("floor,customer.c_acctbal,1000")
    customers = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").collect()]
    rng = random.Random(8)
    heavy = [(rng.randint(1, 60) ** 2 % 61, rng.randint(0, 2), rng.choice("ABC"), float(rng.choice([500, 1500, 1700]))) for _ in range(900)] + [(7, 1, "A", 500.0)] * 40 + [(9, 2, "B", 500.0)] * 25 + [(70, 5, "Z", 1.0)]
    for rows in (customers, heavy):
        df = spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
        want = noisy_buckets(params, [((n, s, math.floor(b / 1000) * 1000.0), who) for who, n, s, b in rows], seed)
        got = {(r["nation"], r["seg"], r["step"]): r["n"] for r in Engine(spark, params, {"customer": df}, steps).sql(sql).collect()}
        assert got == want
