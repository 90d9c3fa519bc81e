"""SQL that computes noisy answers: hashes, salted digests, flattening and noise written out, for queries over one entity column and one group key."""

from __future__ import annotations

from hushframe.functions.hashing import OFFSET, PRIME, fnv
from hushframe.params import Params

_WORD, _TOP = 1 << 64, (1 << 32) - 1


def _fold(octets: str) -> str:
    return f"list_reduce(list_prepend({OFFSET}::HUGEINT, {octets}), lambda h, b: (xor(h, b) * {PRIME}::HUGEINT) % {_WORD}::HUGEINT)"


def of_long(x: str) -> str:
    return _fold(f"list_transform(range(8), lambda i: (({x} >> CAST(8 * i AS BIGINT)) & 255)::HUGEINT)")


def of_text(x: str) -> str:
    return _fold(f"list_transform(range(octet_length(encode({x}))), lambda i: CAST(('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2)) AS HUGEINT))")


def _digest(salt: bytes, word: str) -> str:
    """Hex digits of SHA-256 of the salt and the word's bytes, the lowest first."""
    octets = " || ".join(f"lpad(hex(CAST(({word} >> {8 * i}::HUGEINT) & 255::HUGEINT AS BIGINT)), 2, '0')" for i in range(8))
    return f"sha256(unhex('{salt.hex()}' || {octets}))"


def _half(digest: str, first: int) -> str:
    return f"CAST(('0x' || {' || '.join(f'substr({digest}, {first + i}, 2)' for i in (6, 4, 2, 0))}) AS BIGINT)"


def _normal(digest: str, step: str) -> str:
    mix = fnv(step)
    low, high = f"xor({_half(digest, 1)}, {mix & _TOP})", f"xor({_half(digest, 9)}, {mix >> 32})"
    return f"sqrt(-2.0 * ln(CAST({low} AS DOUBLE) / {float(_TOP)}::DOUBLE)) * sin(2 * pi() * CAST({high} AS DOUBLE) / {float(_TOP)}::DOUBLE)"


def _uniform(lower: int, upper: str, digest: str, step: str) -> str:
    mix = fnv(step)
    return f"{lower} + xor(xor({_half(digest, 1)}, {mix & _TOP}), xor({_half(digest, 9)}, {mix >> 32})) % ({upper} - {lower} + 1)"


def flattened(name: str, source: str, keys: list[str], seed: str, p: Params) -> str:
    """Tables name1.. and name: of the entities (keys, leg, m, h) of ``source`` the flattened, noisy sum of each (keys, leg). ``seed``: of the bucket, from its keys."""
    o, t = p.outlier_count, p.top_count
    by = ", ".join([*keys, "leg"])
    surplus = f"greatest(0, {o.upper + t.upper} - c)"
    return f"""
{name}1 AS (SELECT {by}, count(*) AS c, sum(m) AS total, bit_xor(h) AS x, list({{'m': m, 'h': h}} ORDER BY m DESC, h DESC)[1:{o.upper + t.upper}] AS top FROM {source} GROUP BY {by}),
{name}2 AS (SELECT *, CASE WHEN {surplus} = 0 THEN 0 ELSE least(greatest({surplus} // 2, {surplus} - {t.upper - t.lower}), {o.upper - o.lower}) END AS cut FROM {name}1 WHERE c >= {o.lower + t.lower}),
{name}3 AS (SELECT *, {o.upper} - cut AS o_up, {t.upper} - ({surplus} - cut) AS t_up FROM {name}2),
{name}4 AS (SELECT *, list_reduce(list_transform(top[1:o_up + t_up], lambda e: e.h), lambda a, b: xor(a, b)) AS mixed FROM {name}3),
{name}5 AS (SELECT *, {_digest(p.salt, "mixed")} AS d FROM {name}4),
{name}6 AS (SELECT *, {_uniform(o.lower, "o_up", "d", "outlier")} AS oc, {_uniform(t.lower, "t_up", "d", "top")} AS tc FROM {name}5),
{name}7 AS (SELECT *, list_sum(list_transform(top[oc + 1:oc + tc], lambda e: e.m)) / tc AS tm FROM {name}6),
{name}8 AS (SELECT *, coalesce(list_sum(list_transform(top[1:oc], lambda e: greatest(e.m - tm, 0))), 0) AS fl, {seed} AS seed FROM {name}7),
{name}9 AS (SELECT *, {p.layer_noise_sd}::DOUBLE * greatest((total - fl) / c, 0.5 * tm) AS sd, {_digest(p.salt, "seed")} AS d1, {_digest(p.salt, "x")} AS d2 FROM {name}8),
{name} AS (SELECT *, total - fl AS kept, total - fl + sd * ({_normal("d1", "noise")}) + sd * ({_normal("d2", "noise")}) AS v FROM {name}9)"""


def entities(source: str, keys: dict[str, str], aid: str, arg: str) -> str:
    """Tables e and long: amounts of each entity, by leg (n: rows, p and q: sums of what is not negative, and not positive)."""
    kk = "".join(f"{k}, " for k in keys)
    named = "".join(f"{v} AS {k}, " for k, v in keys.items())
    legs = " UNION ALL ".join(f"SELECT {kk}h, '{leg}' AS leg, {leg} AS m FROM e WHERE {leg} IS NOT NULL" for leg in "npq")
    return f"""e AS (SELECT {kk}{of_long("a")} AS h, count(*)::DOUBLE AS n, CAST(sum(x) FILTER (WHERE x >= 0) AS DOUBLE) AS p, CAST(sum(-x) FILTER (WHERE x <= 0) AS DOUBLE) AS q FROM (SELECT {named}{aid} AS a, {arg} AS x FROM {source}) WHERE a IS NOT NULL GROUP BY {kk}a),
long AS ({legs})"""


def _shown(p: Params, table: str, keys: list[str]) -> str:
    """Table shown: buckets with enough entities."""
    s = p.suppression
    mean = s.low_threshold + s.low_mean_gap * s.layer_sd * 2**0.5
    return f"""
shown1 AS (SELECT {", ".join(keys)}, count(*) AS c, bit_xor(h) AS x FROM {table} GROUP BY {", ".join(keys)}),
shown2 AS (SELECT *, {_digest(p.salt, "x")} AS d FROM shown1),
shown AS (SELECT {", ".join(keys)} FROM shown2 WHERE c >= {s.low_threshold} AND c >= {mean!r}::DOUBLE + {s.layer_sd}::DOUBLE * ({_normal("d", "suppress")}))"""


def _money(sd: str) -> str:
    unit = f"pow(10.0, floor(log10(0.05 * {sd})))"
    ratio = f"(0.05 * {sd} / {unit})"
    step = f"({unit} * CASE WHEN {ratio} < 1.5 THEN 1.0 WHEN {ratio} < 3.5 THEN 2.0 WHEN {ratio} < 7.5 THEN 5.0 ELSE 10.0 END)"
    return f"(CASE WHEN {sd} = 0 THEN 0.0 ELSE ceil({sd} / {step}) * {step} END)"


def grouped(p: Params, source: str, name: str, key: str, material: str, aid: str, arg: str, recover: bool) -> str:
    """(name, n, cn, s) of `SELECT key, count(*), count_noise(*), sum(arg)` over text labels; ``material``: what seeds the group. Sums are of reals. ``recover``: outliers come back in proportion."""
    seed = f"xor({fnv(material)}::HUGEINT, {of_text(f"coalesce({name}, 'NULL')")})"
    low = p.suppression.low_threshold
    value = f"""WITH {entities(source, {name: key}, aid, arg)},{flattened("f", "long", [name], seed, p)},{_shown(p, "e", [name])},
b AS (SELECT {name}, max(v) FILTER (WHERE leg = 'n') AS vn, max(sd) FILTER (WHERE leg = 'n') AS sn, max(v) FILTER (WHERE leg = 'p') AS vp, max(v) FILTER (WHERE leg = 'q') AS vq FROM f SEMI JOIN shown USING ({name}) GROUP BY {name}),
r AS (SELECT {name}, CASE WHEN vn IS NULL THEN {low} ELSE greatest(round(vn), {low}) END AS n, {_money("sn")} AS cn, CASE WHEN vp IS NOT NULL OR vq IS NOT NULL THEN coalesce(vp, 0) - coalesce(vq, 0) END AS s FROM b)"""
    if not recover:
        return f"{value} SELECT {name}, CAST(n AS BIGINT) AS n, round(cn, 4) AS cn, round(s, 4) AS s FROM r"
    return f"""{value},
gone AS (SELECT leg, z.h AS h, sum(z.m - tm) AS m FROM (SELECT leg, tm, unnest(top[1:oc]) AS z FROM f SEMI JOIN shown USING ({name})) WHERE z.m > tm GROUP BY leg, z.h),{flattened("g", "gone", [], f"{fnv(material)}::HUGEINT", p)},
o AS (SELECT coalesce(greatest(round(max(v) FILTER (WHERE leg = 'n')), 0), 0) AS n, coalesce(max(v) FILTER (WHERE leg = 'p'), 0) - coalesce(max(v) FILTER (WHERE leg = 'q'), 0) AS s FROM g),
w AS (SELECT sum(n) AS n, sum(abs(s)) AS s FROM r)
SELECT {name}, CAST(round(r.n * CASE WHEN w.n > 0 THEN 1 + o.n / w.n ELSE 1 END) AS BIGINT) AS n, round(cn, 4) AS cn, round(r.s * CASE WHEN w.s > 0 THEN 1 + o.s / w.s ELSE 1 END, 4) AS s FROM r, o, w"""


def _low(p: Params, name: str, table: str, keys: list[str]) -> str:
    """Table name: buckets, and whether they have too few entities."""
    s = p.suppression
    mean = s.low_threshold + s.low_mean_gap * s.layer_sd * 2**0.5
    by = ", ".join(keys)
    enough = f"c >= {s.low_threshold} AND c >= {mean!r}::DOUBLE + {s.layer_sd}::DOUBLE * ({_normal('d', 'suppress')})"
    return f"""
{name}1 AS (SELECT {by + ", " if keys else ""}count(*) AS c, bit_xor(h) AS x FROM {table}{" GROUP BY " + by if keys else ""}),
{name}2 AS (SELECT *, {_digest(p.salt, "x")} AS d FROM {name}1),
{name} AS (SELECT {by + ", " if keys else ""}NOT ({enough}) AS low FROM {name}2)"""


def merged(p: Params, source: str, keys: dict[str, str], texts: dict[str, str], star: dict[str, str], seed: int, aid: str) -> str:
    """(keys, n) of `SELECT keys, count(*)` over three keys with all steps: merging into siblings, the star bucket, noise, and outliers back in proportion.

    ``texts``: the labels of keys; ``star``: the keys of the star bucket. No key is null, and the second one's labels are none of the others'.
    """
    k = list(keys)
    by, low = ", ".join(k), p.suppression.low_threshold
    others = [[x for x in k if x != y] for y in k]
    sibling = " OR ".join(f"(v.n{i} = 2 AND {' AND '.join(f't.{x} = v.{x}' for x in rest)} AND t.{y} <> v.{y})" for i, (y, rest) in enumerate(zip(k, others, strict=True)))
    a, b, c = (f"coalesce({texts[x]}, 'NULL')" for x in k)
    labelled = f"xor(xor({seed}::HUGEINT, {of_text(a)}), xor({of_text(b)}, CASE WHEN {a} = {c} THEN 0::HUGEINT ELSE {of_text(c)} END))"
    same = lambda x, y: " AND ".join(f"{x}.{z} IS NOT DISTINCT FROM {y}.{z}" for z in k)
    return f"""WITH e AS (SELECT {by}, {of_long("a")} AS h, count(*)::DOUBLE AS m FROM (SELECT {", ".join(f"{v} AS {x}" for x, v in keys.items())}, {aid} AS a FROM {source}) GROUP BY {by}, a),{_low(p, "first", "e", k)},
w AS (SELECT *, {", ".join(f"count(*) OVER (PARTITION BY {', '.join(rest)}) AS n{i}" for i, rest in enumerate(others))} FROM first),
v AS (SELECT * FROM w WHERE low AND (n0 = 1 OR n1 = 1 OR n2 = 1)),
moves AS (SELECT {", ".join(f"v.{x} AS of_{x}, t.{x}" for x in k)} FROM v JOIN w t ON NOT t.low AND ({sibling})),
e2 AS (SELECT {by}, h, sum(m) AS m FROM (SELECT {by}, h, m FROM e UNION ALL SELECT {", ".join(f"t.{x}" for x in k)}, e.h, e.m FROM moves t JOIN e ON {" AND ".join(f"e.{x} = t.of_{x}" for x in k)}) GROUP BY {by}, h),{_low(p, "second", "e2", k)},
loose AS (SELECT {by} FROM second ANTI JOIN moves ON {" AND ".join(f"second.{x} = moves.of_{x}" for x in k)} WHERE low),
star AS (SELECT h, sum(m) AS m FROM e2 SEMI JOIN loose USING ({by}) GROUP BY h),{_low(p, "dim", "star", [])},
long AS (SELECT {by}, h, 'n' AS leg, m FROM e2 SEMI JOIN (SELECT {by} FROM second WHERE NOT low) USING ({by}) UNION ALL SELECT {", ".join(star[x] for x in k)}, h, 'n', m FROM star WHERE (SELECT count(*) FROM loose) >= 2 AND NOT (SELECT low FROM dim)),{flattened("f", "long", k, labelled, p)},
r AS (SELECT {", ".join(f"d.{x}" for x in k)}, CASE WHEN f.v IS NULL THEN {low} ELSE greatest(round(f.v), {low}) END AS n FROM (SELECT DISTINCT {by} FROM long) d LEFT JOIN f ON {same("d", "f")}),
gone AS (SELECT leg, h, sum(m) AS m FROM (SELECT leg, z.h AS h, z.m - tm AS m FROM (SELECT leg, tm, unnest(top[1:oc]) AS z FROM f) WHERE z.m > tm UNION ALL SELECT leg, h, m FROM long ANTI JOIN f ON {same("long", "f")}) GROUP BY leg, h),{flattened("g", "gone", [], f"{seed}::HUGEINT", p)},
o AS (SELECT coalesce(greatest(round(max(v)), 0), 0) AS n FROM g), s AS (SELECT sum(n) AS n FROM r)
SELECT {by}, CAST(round(r.n * CASE WHEN s.n > 0 THEN 1 + o.n / s.n ELSE 1 END) AS BIGINT) AS n FROM (SELECT {by}, n FROM r) r, o, s"""
