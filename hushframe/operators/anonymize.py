"""Anonymizing aggregation as a plan of group-bys and one window.

Every row contributes, for each of its entities (AID instances), to some legs: ``rows`` (the entity is there), a leg for each
count, two for each sum (positive and negative amounts), one for each distinct count. All legs are one long table (keys, aid,
leg, entity hash, amount), summed per entity before anything else. Per (keys, aid, leg) follow counts, totals and the xor of the
hashes, and the largest few entities from a row_number that Spark limits before it shuffles. The rest is arithmetic on arrays of at most
``outlier_count.upper + top_count.upper`` entries. No Python runs but for the order-dependent part of distinct counts: rare values that several
entities show, dealt out separately for each connected part of values and entities.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import hashing as H
from hushframe.functions.text import real_column
from hushframe.operators.components import components
from hushframe.params import Params
from hushframe.storage import materialize

ROWS = -1
#: Contested values of a bucket are dealt to entities in one task up to so many pairs of both; beyond, what is connected stays together.
WHOLE = 200_000
#: A key of its own for the bucket that collects suppressed ones.
STAR = "star"


@dataclass(frozen=True)
class Agg:
    """``kind``: count, sum, count_distinct or histogram. ``aid`` and ``bin``: of histograms."""

    kind: str
    arg: Column | None = None
    integer: bool = True
    aid: int = 0
    bin: int = 1


@dataclass(frozen=True)
class Aid:
    column: Column
    integer: bool


@dataclass(frozen=True)
class Context:
    params: Params
    seed: int = 0
    base_labels: tuple[str, ...] = ()


@dataclass
class Prepared:
    """Rows with keys k0.., entity hashes h0.. (null where the entity is null), and arguments x0.. ; ``labels``: names of the keys."""

    rows: DataFrame
    labels: list[str]
    aids: int
    aggs: dict[str, Agg]
    context: Context
    keys: list[str] = field(default_factory=list)
    #: Keys of buckets that were merged into siblings.
    merged: DataFrame | None = None
    #: The contributions of the rows, once they are a table.
    long: DataFrame | None = None

    @property
    def is_global(self) -> bool:
        return not self.keys

    def changed(self, **changes) -> Prepared:
        return replace(self, **changes)


def label_text(column: Column, kind: str) -> Column:
    """The text of a group's label that seeds its noise."""
    if kind == "boolean":
        text = F.when(column, "t").otherwise("f")
    elif kind.startswith("timestamp"):
        text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    elif kind in ("double", "float"):
        text = real_column(column.cast("double"))
    else:
        text = column.cast("string")
    return F.when(column.isNull(), F.lit("NULL")).otherwise(text)


def prepare(df: DataFrame, keys: dict[str, Column], aids: list[Aid], aggs: dict[str, Agg], context: Context) -> Prepared:
    names = [f"k{i}" for i in range(len(keys))]
    columns = [c.alias(n) for c, n in zip(keys.values(), names, strict=True)]
    raw = [(a.column.cast("long") if a.integer else a.column.cast("string")).alias(f"a{i}") for i, a in enumerate(aids)]
    args = [a.arg.alias(f"x{i}") for i, a in enumerate(aggs.values()) if a.arg is not None]
    rows = df.select(*columns, *raw, *args)
    rows = rows.filter(F.coalesce(*(F.col(f"a{i}").cast("string") for i in range(len(aids)))).isNotNull())
    return Prepared(rows, list(keys), len(aids), aggs, context, names)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A null-safe join on the keys, of which one copy stays."""
    if not keys:
        return left.join(F.broadcast(right), how=how, on=F.lit(True)) if how != "inner" else left.crossJoin(F.broadcast(right))
    renamed = right.select(*(F.col(k).alias(f"r{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys))
    joined = left.join(renamed, same, how)
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(k, f"r{k}") for k in keys})
    return joined.drop(*(f"r{k}" for k in keys))


def _legs(aggs: dict[str, Agg]) -> list[tuple[str, int, int]]:
    """(kind, argument, first leg) of each aggregate."""
    return [(a.kind, i, 2 * i) for i, a in enumerate(aggs.values())]


def _entities(p: Prepared) -> Column:
    """Pairs (aid, t) of a row's entities, as they are if all are integers and else as texts."""
    kinds = dict(p.rows.dtypes)
    same = all(kinds[f"a{i}"] == "bigint" for i in range(p.aids))
    return F.posexplode(F.array(*(F.col(f"a{i}") if same else F.col(f"a{i}").cast("string") for i in range(p.aids)))).alias("aid", "t")


def contributions(p: Prepared, aids: list[bool]) -> DataFrame:
    """(keys, aid, leg, hash, amount): hash is null for what belongs to no entity."""
    args = [c for c in p.rows.columns if c.startswith("x")]
    rows = p.rows.select(*p.keys, _entities(p), *args)
    sums = [F.count(F.lit(1)).cast("double").alias("m")]
    parts = [F.struct(F.lit(ROWS).alias("leg"), F.lit(1.0).alias("amount"), F.lit(True).alias("is_in"))]
    for kind, i, leg in _legs(p.aggs):
        x = F.col(f"x{i}") if f"x{i}" in args else None
        if kind == "count":
            sums.append((F.count(x) if x is not None else F.count(F.lit(1))).cast("double").alias(f"m{i}"))
            parts.append(F.struct(F.lit(leg).alias("leg"), F.col(f"m{i}").alias("amount"), F.lit(True).alias("is_in")))
        elif kind == "sum":
            for j, (holds, amount) in enumerate(((x >= 0, x), (x <= 0, -x))):
                sums += [F.coalesce(F.sum(F.when(holds, amount.cast("double"))), F.lit(0.0)).alias(f"m{i}_{j}"), (F.count_if(holds) > 0).alias(f"n{i}_{j}")]
                parts.append(F.struct(F.lit(leg + j).alias("leg"), F.col(f"m{i}_{j}").alias("amount"), F.col(f"n{i}_{j}").alias("is_in")))
    # Hashed once for each entity of a bucket, before it gets a row for each leg.
    per_entity = hashed(rows.groupBy(*p.keys, "aid", "t").agg(*sums), aids)
    long = per_entity.select(*p.keys, "aid", "h", F.explode(F.array(*parts)).alias("c")).filter("c.is_in")
    return long.select(*p.keys, "aid", F.col("c.leg").alias("leg"), F.col("c.amount").alias("amount"), "h")


def hashed(rows: DataFrame, aids: list[bool]) -> DataFrame:
    """The entity ``t`` as its hash ``h``; ``aids``: whether each instance is an integer."""
    if all(aids):
        return H.with_fnv_long(rows, F.col("t").cast("long"), "h").drop("t")
    of_text = H.fnv_text(F.col("t"))
    if any(aids):
        kind = F.element_at(F.array(*map(F.lit, aids)), F.col("aid") + 1)
        rows = H.with_fnv_long(rows, F.when(kind, F.col("t").try_cast("long")), "__h")
        return rows.withColumn("h", F.when(kind, F.col("__h")).otherwise(F.when(F.col("t").isNotNull(), of_text))).drop("t", "__h")
    return rows.withColumn("h", F.when(F.col("t").isNotNull(), of_text)).drop("t")


def statistics(long: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, aid, leg): n, total, xor, unaccounted, and the ``most`` largest entities in order."""
    by = [*keys, "aid", "leg"]
    known = F.col("h").isNotNull()
    stats = long.groupBy(*by).agg(
        F.count_if(known).alias("n"), F.coalesce(F.sum(F.when(known, F.col("amount"))), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(~known, F.col("amount"))), F.lit(0.0)).alias("unaccounted"),
        F.struct(F.coalesce(F.bit_xor("h.hi"), F.lit(0)).alias("hi"), F.coalesce(F.bit_xor("h.lo"), F.lit(0)).alias("lo")).alias("xor"),
    )
    # What belongs to no entity comes last and is left out after ranking: a filter on the hash would be pushed below the sums of the entities, to every row.
    order = Window.partitionBy(*by).orderBy(known.desc(), F.col("amount").desc(), F.col("h.hi").desc(), F.col("h.lo").desc())
    top = long.filter(F.col("leg") != ROWS).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    top = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(known, F.struct("rank", "amount", "h")))).alias("top"))
    top = top.withColumn("top", F.when(F.size("top") > 0, F.col("top")))
    return join_keys(stats.withColumns({"g": F.struct("aid", "leg")}), top.withColumn("g", F.struct("aid", "leg")).drop("aid", "leg"), [*keys, "g"], "left").drop("g")


def threshold(params: Params, n: Column, xor: Column, low_threshold: int | None = None) -> Column:
    """Whether a set of entities is too small to show."""
    s = params.suppression
    least = s.low_threshold if low_threshold is None else low_threshold
    mean = least + s.low_mean_gap * s.layer_sd * 2**0.5
    limit = F.lit(mean) if s.layer_sd == 0 else mean + H.noise(params.salt, "suppress", F.lit(float(s.layer_sd)), [H.of(xor)])
    return F.when(n < least, True).otherwise(n.cast("double") < limit)


def bucket_seed(context: Context, keys: list[Column], kinds: list[str]) -> Column:
    """A struct: the query's seed mixed with the distinct labels."""
    texts = [F.lit(t) for t in context.base_labels] + [label_text(k, t) for k, t in zip(keys, kinds, strict=True)]
    if not texts:
        return H.literal(context.seed).struct()
    return F.aggregate(F.array_distinct(F.array(*texts)), H.literal(context.seed).struct(), lambda a, t: (H.of(a) ^ H.of(H.fnv_text(t))).struct())


def flatten(stats: DataFrame, params: Params) -> DataFrame:
    """Adds ``flat``: null where there are too few entities, else a struct of sum, flattening, sd, noise and the dropped excess.

    ``stats`` has a column ``seed`` with the bucket's seed.
    """
    o, t = params.outlier_count, params.top_count
    n = F.col("n")
    surplus = F.lit(o.upper + t.upper) - n
    o_range, t_range = o.upper - o.lower, t.upper - t.lower
    # The intervals shrink by half of the surplus each (the top one by the larger half); what one cannot give the other does.
    half = F.floor(surplus / 2).cast("long")
    o_cut = F.when(surplus <= 0, 0).otherwise(F.least(F.greatest(half, surplus - t_range), F.lit(o_range)))
    t_cut = F.when(surplus <= 0, 0).otherwise(surplus - o_cut)
    out = stats.withColumn("fits", (n >= o.lower + t.lower) & F.col("top").isNotNull())
    out = out.withColumns({"o_up": F.lit(o.upper) - o_cut, "t_up": F.lit(t.upper) - t_cut})
    first = F.slice("top", F.lit(1), (F.col("o_up") + F.col("t_up")).cast("int"))
    out = out.withColumn("mixed", F.when(F.col("fits"), H.xor_all(F.transform(first, lambda x: x["h"]))))
    out = out.withColumn("flat_seed", F.when(F.col("fits"), H.crypt(params.salt, H.of(F.col("mixed")))))
    seed = H.of(F.col("flat_seed"))
    out = out.withColumns({"oc": H.uniform(F.lit(o.lower), F.col("o_up"), seed ^ H.fnv("outlier")).cast("int"), "tc": H.uniform(F.lit(t.lower), F.col("t_up"), seed ^ H.fnv("top")).cast("int")})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    group = F.slice("top", F.col("oc") + 1, F.col("tc"))
    out = out.withColumn("top_mean", total(F.transform(group, lambda x: x["amount"])) / F.col("tc"))
    # slice() takes no length of zero columns under every version, so the outliers are filtered by rank.
    excess = F.transform(F.filter("top", lambda x: (x["rank"] <= F.col("oc")) & (x["amount"] > F.col("top_mean"))), lambda x: F.struct(x["h"].alias("h"), (x["amount"] - F.col("top_mean")).alias("amount")))
    out = out.withColumn("dropped", excess).withColumn("flattening", total(F.transform("dropped", lambda x: x["amount"])))
    out = out.withColumn("kept", F.col("total") - F.col("flattening"))
    out = out.withColumn("sd", params.layer_noise_sd * F.greatest(F.col("kept") / n, 0.5 * F.col("top_mean")))
    made = F.lit(0.0) if params.layer_noise_sd == 0 else H.noise(params.salt, "noise", F.col("sd"), [H.of(F.col("seed")), H.of(F.col("xor"))])
    value = F.col("kept") + F.greatest(F.col("unaccounted") - F.col("flattening"), F.lit(0.0))
    flat = F.struct(value.alias("sum"), F.col("flattening").alias("flattening"), F.col("sd").alias("sd"), made.alias("noise"), F.col("dropped").alias("dropped"))
    return out.withColumn("flat", F.when(F.col("fits"), flat)).drop("fits", "o_up", "t_up", "mixed", "flat_seed", "oc", "tc", "top_mean", "dropped", "flattening", "kept", "sd")


def money_round(sd: Column) -> Column:
    """A reported deviation, rounded up to a multiple of the next 1, 2 or 5 (times a power of ten) near a twentieth of it."""
    small = 0.05 * sd
    unit = F.pow(F.lit(10.0), F.floor(F.log10(small)))
    ratio = small / unit
    step = unit * F.when(ratio < 1.5, 1.0).when(ratio < 3.5, 2.0).when(ratio < 7.5, 5.0).otherwise(10.0)
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.ceil(sd / step) * step)


def half_away(x: Column) -> Column:
    return F.round(x).cast("long")


def combine(flat: DataFrame, p: Prepared, is_global: bool, extra: DataFrame | None = None) -> DataFrame:
    """One row for each bucket: low, and for each aggregate value, noise and whether it could be anonymized."""
    keys, params = p.keys, p.context.params
    pivot = [F.bool_or(F.when(F.col("leg") == ROWS, threshold(params, F.col("n"), F.col("xor")))).alias("low")]
    legs = sorted({leg + j for kind, _, leg in _legs(p.aggs) if kind != "histogram" for j in range(2 if kind == "sum" else 1)})
    fields = lambda leg: F.struct(F.col("flat.sum").alias("sum"), F.col("flat.flattening").alias("flattening"), F.col("flat.sd").alias("sd"), F.col("flat.noise").alias("noise"))
    pivot += [F.max(F.when((F.col("leg") == leg) & F.col("flat").isNotNull(), fields(leg))).alias(f"l{leg}") for leg in legs]
    per_aid = flat.groupBy(*keys, "aid").agg(*pivot)
    aggs = [F.bool_or("low").alias("low"), F.count(F.lit(1)).alias("instances")]
    for leg in legs:
        c = F.col(f"l{leg}")
        aggs += [F.max(F.when(c.isNotNull(), F.struct(c["flattening"].alias("a"), c["sum"].alias("b")))).alias(f"v{leg}"), F.max(F.when(c.isNotNull(), F.struct(c["sd"].alias("a"), F.abs(c["noise"]).alias("b"), c["noise"].alias("c")))).alias(f"s{leg}"), F.bool_or(c.isNull()).alias(f"none{leg}")]
    for kind, i, leg in _legs(p.aggs):
        if kind == "sum":
            aggs.append(F.bool_or(F.col(f"l{leg}").isNull() & F.col(f"l{leg + 1}").isNull()).alias(f"lost{i}"))
    # Two stages of one shuffle: (keys, aid) first, then keys.
    out = per_aid.groupBy(*keys).agg(*aggs) if keys else per_aid.agg(*aggs)
    if extra is not None:
        out = join_keys(out, extra, keys, "left")
    least = 0 if is_global and not p.context.base_labels else params.suppression.low_threshold
    value = lambda leg: F.col(f"v{leg}.b") + F.col(f"s{leg}.c")
    columns: list[Column] = []
    for (kind, i, leg), (name, agg) in zip(_legs(p.aggs), p.aggs.items(), strict=True):
        if kind == "count":
            lost = F.coalesce(F.col(f"none{leg}"), F.lit(True))
            columns += [F.when(lost, F.lit(least)).otherwise(F.greatest(half_away(value(leg)), F.lit(least))).cast("long").alias(name), F.when(~lost, money_round(F.col(f"s{leg}.a"))).alias(f"{name}__noise"), lost.alias(f"{name}__lost")]
        elif kind == "count_distinct":
            lost = F.coalesce(F.col(f"none{leg}"), F.lit(True))
            safe = F.coalesce(F.col(f"safe{i}"), F.lit(0))
            found = F.when(~lost, half_away(value(leg)) + safe).when(safe > 0, safe)
            columns += [F.coalesce(F.greatest(found, F.lit(least)), F.lit(least)).cast("long").alias(name), F.when(~lost, money_round(F.col(f"s{leg}.a"))).when(safe > 0, F.lit(0.0)).alias(f"{name}__noise"), F.lit(False).alias(f"{name}__lost")]
        elif kind == "sum":
            lost = F.coalesce(F.col(f"lost{i}"), F.lit(True))
            total = F.coalesce(value(leg), F.lit(0.0)) - F.coalesce(value(leg + 1), F.lit(0.0))
            sd = F.sqrt(F.pow(F.coalesce(F.col(f"s{leg}.a"), F.lit(0.0)), 2) + F.pow(F.coalesce(F.col(f"s{leg + 1}.a"), F.lit(0.0)), 2))
            columns += [F.when(~lost, half_away(total) if agg.integer else total).alias(name), F.when(~lost, money_round(sd)).alias(f"{name}__noise"), lost.alias(f"{name}__lost")]
        else:
            columns += [F.col(f"hist{i}").alias(name), F.lit(None).cast("double").alias(f"{name}__noise"), F.lit(False).alias(f"{name}__lost")]
    return out.select(*keys, F.coalesce("low", F.lit(True)).alias("low"), *columns)


def _seeded(stats: DataFrame, p: Prepared, context: Context | None = None) -> DataFrame:
    kinds = dict(stats.dtypes)
    labels = [k for k in p.keys if k != STAR]
    return stats.withColumn("seed", bucket_seed(context or p.context, [F.col(k) for k in labels], [kinds[k] for k in labels]))


def _distinct_values(p: Prepared, i: int, aids: list[bool]) -> DataFrame:
    """(keys, value, aid, h) without repeats."""
    rows = p.rows.filter(F.col(f"x{i}").isNotNull()).select(*p.keys, F.col(f"x{i}").alias("v"), _entities(p))
    return hashed(rows.distinct(), aids)


def _parts(contested: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``part``: values and entities that are connected are in one, as only these compete. Small buckets stay whole."""
    by = [*keys, "aid"]
    largest = contested.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= WHOLE:
        return contested.withColumn("part", F.lit(0).cast("long"))
    name = lambda *columns: F.xxhash64(*columns, *by)
    named = contested.withColumns({"entity": name(F.lit("e"), F.col("hi"), F.col("lo")), "value": name(F.lit("v"), F.col("v"))})
    labels = components(named.filter("n > 1").select(F.col("entity").alias("u"), F.col("value").alias("v"))).withColumnRenamed("node", "entity")
    part = F.pmod(F.xxhash64(F.coalesce("label", "entity")), F.lit(4 * -(-largest // max(WHOLE, 1))))
    return named.join(labels, "entity", "left").withColumn("part", part).drop("entity", "value", "label")


def count_distinct(p: Prepared, i: int, leg: int, aids: list[bool]) -> tuple[DataFrame, DataFrame]:
    """Values shown by enough entities, as (keys, safe<i>); contributions (keys, aid, leg, h, amount) of the others, each value given to one entity."""
    rows = _distinct_values(p, i, aids)
    by = [*p.keys, "v"]
    sets = rows.groupBy(*by, "aid").agg(F.count("h").alias("n"), F.struct(F.coalesce(F.bit_xor("h.hi"), F.lit(0)).alias("hi"), F.coalesce(F.bit_xor("h.lo"), F.lit(0)).alias("lo")).alias("xor"))
    verdict = sets.groupBy(*by).agg(F.bool_or(threshold(p.context.params, F.col("n"), F.col("xor"))).alias("low_value"))
    safe = verdict.groupBy(*p.keys).agg(F.count_if(~F.col("low_value")).alias(f"safe{i}")) if p.keys else verdict.agg(F.count_if(~F.col("low_value")).alias(f"safe{i}"))
    low = join_keys(rows.filter("h is not null"), verdict.filter("low_value").drop("low_value"), by)
    low = join_keys(low, sets.select(*by, "aid", "n"), [*by, "aid"]).select(*p.keys, "aid", F.col("h.hi").alias("hi"), F.col("h.lo").alias("lo"), "v", "n")
    mine = [*p.keys, "aid", "hi", "lo"]
    low = materialize(low.withColumn("contested", F.max("n").over(Window.partitionBy(*mine)) > 1), "rare")
    # Who shares no value with others keeps all of them.
    free = low.filter("not contested").groupBy(*mine).agg(F.count(F.lit(1)).cast("double").alias("amount"))
    contested = _parts(low.filter("contested").drop("contested"), p.keys)
    names = list(p.keys)
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in names)

    def share(group):
        """Entities with few values first; each takes its last value that nobody has, in rounds."""
        import pandas as pd

        values = {}
        for hi, lo, v in sorted(zip(group["hi"], group["lo"], group["v"], strict=True), key=lambda r: r[2]):
            values.setdefault((hi, lo), []).append(v)
        queue = sorted(values.items(), key=lambda e: (len(e[1]), e[0]))
        used, got = set(), dict.fromkeys(values, 0)
        while queue:
            left = []
            for entity, stack in queue:
                while stack and stack[-1] in used:
                    stack.pop()
                if stack:
                    used.add(stack.pop())
                    got[entity] += 1
                    if stack:
                        left.append((entity, stack))
            queue = left
        taken = {e: n for e, n in got.items() if n}
        first = group.iloc[0]
        return pd.DataFrame({**{k: [first[k]] * len(taken) for k in names}, "aid": first["aid"], "hi": [e[0] for e in taken], "lo": [e[1] for e in taken], "amount": [float(n) for n in taken.values()]})

    shared = contested.groupBy(*p.keys, "aid", "part").applyInPandas(share, ", ".join(filter(None, [fields, "aid int, hi long, lo long, amount double"])))
    return safe, shared.unionByName(free).select(*p.keys, "aid", F.lit(leg).alias("leg"), "amount", F.struct("hi", "lo").alias("h"))


def histogram(p: Prepared, i: int, agg: Agg, aids: list[bool]) -> DataFrame:
    """(keys, hist<i>): pairs of bin and number of entities, ascending; bins of too few entities together first, under NULL."""
    params, counted = p.context.params, f"a{agg.aid}"
    own = p.rows.filter(F.col(counted).isNotNull()).withColumn("c", F.col(counted))
    bins = own.groupBy(*p.keys, "c").agg((F.floor(F.count(F.lit(1)) / agg.bin) * agg.bin).cast("long").alias("bin"))
    sets = hashed(join_keys(own, bins, [*p.keys, "c"]).select(*p.keys, "bin", _entities(p)).distinct(), aids)

    def judged(rows: DataFrame, by: list[str]) -> DataFrame:
        per = rows.groupBy(*by, "aid").agg(F.count("h").alias("n"), F.struct(F.coalesce(F.bit_xor("h.hi"), F.lit(0)).alias("hi"), F.coalesce(F.bit_xor("h.lo"), F.lit(0)).alias("lo")).alias("xor"))
        out = per.groupBy(*by).agg(F.bool_or(threshold(params, F.col("n"), F.col("xor"))).alias("low_bin"), F.max(F.when(F.col("aid") == agg.aid, F.struct("n", "xor"))).alias("own"))
        seeded = _seeded(out, p)
        made = F.lit(0.0) if params.layer_noise_sd == 0 else H.noise(params.salt, "count_histogram", F.lit(float(params.layer_noise_sd)), [H.of(F.col("seed")), H.of(F.col("own.xor"))])
        return seeded.withColumn("shown", F.greatest(half_away(F.col("own.n") + made), F.lit(params.suppression.low_threshold)).cast("long"))

    each = judged(sets, [*p.keys, "bin"])
    merged = judged(join_keys(sets, each.filter("low_bin").select(*p.keys, "bin"), [*p.keys, "bin"]).drop("bin").distinct(), p.keys).filter("not low_bin")
    rows = each.filter("not low_bin").select(*p.keys, "bin", "shown").unionByName(merged.select(*p.keys, F.lit(None).cast("long").alias("bin"), "shown"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(F.col("bin").isNotNull().alias("o"), F.col("bin").alias("b"), F.col("shown").alias("n")))), lambda x: F.array(x["b"], x["n"])).alias(f"hist{i}")
    return rows.groupBy(*p.keys).agg(pairs) if p.keys else rows.agg(pairs)


def low_counts(long: DataFrame, keys: list[str], params: Params) -> DataFrame:
    """(keys, low) of all buckets."""
    stats = long.filter(F.col("leg") == ROWS).groupBy(*keys, "aid").agg(F.count("h").alias("n"), F.struct(F.coalesce(F.bit_xor("h.hi"), F.lit(0)).alias("hi"), F.coalesce(F.bit_xor("h.lo"), F.lit(0)).alias("lo")).alias("xor"))
    verdict = F.bool_or(threshold(params, F.col("n"), F.col("xor"))).alias("low")
    return stats.groupBy(*keys).agg(verdict) if keys else stats.agg(verdict)


def contributed(p: Prepared, aids: list[bool]) -> DataFrame:
    return contributions(p, aids).select(*p.keys, "aid", "leg", "amount", "h")


def aggregate(p: Prepared, aids: list[bool]) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(columns of distinct counts and histograms, flattened legs, hashed contributions)."""
    long = p.long if p.long is not None else contributed(p, aids)
    extra = None
    for kind, i, leg in _legs(p.aggs):
        more = None
        if kind == "count_distinct":
            more, shared = count_distinct(p, i, leg, aids)
            long = long.unionByName(shared)
        elif kind == "histogram":
            more = histogram(p, i, list(p.aggs.values())[i], aids)
        if more is not None:
            extra = more if extra is None else join_keys(extra, more, p.keys, "full")
    params = p.context.params
    flat = flatten(_seeded(statistics(long, p.keys, params.outlier_count.upper + params.top_count.upper), p), params)
    return extra, flat, long


def recover_outliers(buckets: DataFrame, flat: DataFrame, long: DataFrame, p: Prepared) -> DataFrame:
    """Scales the values of shown buckets so that what flattening dropped, anonymized as a whole, comes back in proportion."""
    scaled = [(k, i, leg, n) for (k, i, leg), n in zip(_legs(p.aggs), p.aggs, strict=True) if k in ("count", "sum")]
    if not scaled:
        return buckets
    params = p.context.params
    shown = buckets.filter("not low")
    legs = [leg + j for k, _, leg, _ in scaled for j in range(2 if k == "sum" else 1)]
    lost = F.array(*(F.struct(F.lit(leg + j).alias("leg")) for k, _, leg, _ in scaled for j in range(2 if k == "sum" else 1)))
    flags = F.array(*(F.col(f"{n}__lost") for k, _, _, n in scaled for _ in range(2 if k == "sum" else 1)))
    marks = shown.select(*p.keys, F.explode(F.arrays_zip(lost.alias("l"), flags.alias("f"))).alias("z")).select(*p.keys, F.col("z.l.leg").alias("leg"), F.col("z.f").alias("gone"))
    # explode_outer: a filter on the flattened values would be pushed below and repeat their whole arithmetic.
    dropped = join_keys(flat.filter(F.col("leg").isin(legs)), marks.filter("not gone"), [*p.keys, "leg"]).select("aid", "leg", F.explode_outer("flat.dropped").alias("d")).filter("d is not null").select("aid", "leg", "d.amount", "d.h")
    whole = join_keys(long.filter(F.col("h").isNotNull()), marks.filter("gone"), [*p.keys, "leg"]).select("aid", "leg", "amount", "h")
    again = dropped.unionByName(whole).groupBy("aid", "leg", "h").agg(F.sum("amount").alias("amount"))
    every = p.rows.sparkSession.range(p.aids).select(F.col("id").cast("int").alias("aid"), F.explode(F.array(*map(F.lit, [ROWS, *legs]))).alias("leg"), F.lit(0.0).alias("amount"), F.lit(None).cast("struct<hi:long,lo:long>").alias("h"))
    world = Context(params, p.context.seed)
    q = Prepared(p.rows, [], p.aids, p.aggs, world, [])
    total = combine(flatten(_seeded(statistics(again.unionByName(every), [], params.outlier_count.upper + params.top_count.upper), q, world), params), q, True, _no_extra(p))
    sums = shown.agg(*(F.sum(F.abs(F.col(n).cast("double"))).alias(f"{n}__sum") for *_, n in scaled))
    factors = total.select(*(F.col(n).cast("double").alias(f"{n}__out") for *_, n in scaled)).crossJoin(sums)
    factors = factors.select(*(F.when(F.col(f"{n}__sum") > 0, 1.0 + F.coalesce(F.col(f"{n}__out"), F.lit(0.0)) / F.col(f"{n}__sum")).otherwise(1.0).alias(f"{n}__factor") for *_, n in scaled))
    out = buckets.crossJoin(F.broadcast(factors))  # one row
    for *_, n in scaled:
        value = F.col(n) * F.col(f"{n}__factor")
        out = out.withColumn(n, F.when(F.col("low"), F.col(n)).otherwise(half_away(value) if dict(buckets.dtypes)[n] == "bigint" else value))
    return out.drop(*(f"{n}__factor" for *_, n in scaled))


def _no_extra(p: Prepared) -> DataFrame | None:
    """Columns that distinct counts and histograms would bring, for one row without any."""
    names = [(f"safe{i}", "long") if k == "count_distinct" else (f"hist{i}", "array<array<bigint>>") for k, i, _ in _legs(p.aggs) if k in ("count_distinct", "histogram")]
    return p.rows.sparkSession.range(1).select(*(F.lit(None).cast(t).alias(n) for n, t in names)) if names else None


def anonymize(df: DataFrame, keys: dict[str, Column], aids: list[Aid], aggs: dict[str, Agg], context: Context, hooks=(), recover: bool | None = None) -> DataFrame:
    """(keys, low, aggregates and their ``__noise``): all buckets, with ``low`` for those that must not be shown."""
    p = prepare(df, keys, aids, aggs, context)
    kinds = [a.integer for a in aids]
    recovers = bool(p.keys) and (context.params.recover_outliers if recover is None else recover)
    # What several steps read becomes a table: entities per bucket first, then buckets, each smaller than the rows.
    if p.keys and (hooks or recovers):
        p = p.changed(long=materialize(contributed(p, kinds), "contributions"))
    for hook in hooks if p.keys else ():
        p = hook(p, kinds)
    extra, flat, long = aggregate(p, kinds)
    if not recovers:
        buckets = combine(flat, p, p.is_global, extra)
    else:
        flat = materialize(flat, "flattened")
        buckets = materialize(combine(flat, p, p.is_global, extra), "buckets")
        buckets = recover_outliers(buckets, flat, long, p)
    names = [*p.labels, "low", *(c for n in aggs for c in (n, f"{n}__noise"))]
    buckets = buckets.select(*(k for k in p.keys if k != STAR), "low", *names[len(p.labels) + 1 :])
    return buckets.toDF(*names)
