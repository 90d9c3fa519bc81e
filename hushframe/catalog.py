"""The registered queries of the dialect, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import catalog_cases, catalog_noise
from hushframe.engine import Engine
from hushframe.functions.hashing import fnv
from hushframe.operators import hooks
from hushframe.params import AccessLevel, Params, noiseless

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
AIDS = {"customer": ("c_custkey",), "orders": ("o_custkey",), "events": ("user_id",), "lineitem": ("l_orderkey", "l_suppkey")}
QUIET = noiseless(AIDS, recover_outliers=False)
NOISY = Params(aid_columns=AIDS, salt=b"salt")
MODES = {
    "direct": (Params(), ()),
    "quiet": (QUIET, ()),
    "recover": (noiseless(AIDS), ()),
    "star": (QUIET, (hooks.star_bucket,)),
    "led": (QUIET, (hooks.led,)),
    "noisy": (NOISY, hooks.DEFAULT),
    "unscaled": (replace(NOISY, recover_outliers=False), ()),
    "level_direct": (replace(QUIET, access_level=AccessLevel.DIRECT), ()),
    "synthetic": (replace(QUIET, use_adaptive_buckets=True), ()),
}


def engine(spark: SparkSession, sf_dir: str, mode: str) -> Engine:
    params, steps = MODES[mode]
    read = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Engine(spark, params, {name: read(name) for name in TABLES}, steps)


def settled(df: DataFrame) -> DataFrame:
    """Reals to four decimals and lists as JSON, so that rows can be compared by value."""
    shown = {"double": lambda c: F.round(c, 4), "array": F.to_json}
    return df.select(*(shown.get(t.split("<")[0], lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes))


def query(mode: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: settled(engine(spark, sf_dir, mode).sql(sql))


def contributions(source: str, keys: dict[str, str], aid: str, arg: str | None = None) -> str:
    """Common table expressions: r (rows), c (amounts for each entity), b (buckets, flattened by the difference of the two largest)."""
    k = ", ".join(keys)
    named = "".join(f"{v} AS {n}, " for n, v in keys.items())
    group = f"GROUP BY {k}" if keys else ""
    kk = f"{k}, " if keys else ""
    x = arg or "1"
    leg = lambda m: f"CASE WHEN count({m}) FILTER (WHERE a IS NOT NULL) >= 2 THEN coalesce(sum({m}) FILTER (WHERE a IS NOT NULL), 0) - greatest((list_reverse_sort(list({m}) FILTER (WHERE a IS NOT NULL AND {m} IS NOT NULL)))[1] - (list_reverse_sort(list({m}) FILTER (WHERE a IS NOT NULL AND {m} IS NOT NULL)))[2], 0) END"
    return f"""
r AS (SELECT {named}{aid} AS a, {x} AS x FROM {source}),
c AS (SELECT {kk}a, count(*) AS n, count(x) AS m, sum(CASE WHEN x >= 0 THEN x END)::DOUBLE AS p, sum(CASE WHEN x <= 0 THEN -x END)::DOUBLE AS q FROM r GROUP BY {kk}a),
b AS (SELECT {kk}count(a) AS entities, {leg("n")} AS n, {leg("m")} AS m, {leg("p")} AS p, {leg("q")} AS q FROM c {group})"""


def _anon(source: str, keys: dict[str, str], aid: str, outputs: str, arg: str | None = None, having: str = "entities >= 2", least: int = 2) -> str:
    return f"WITH {contributions(source, keys, aid, arg)} SELECT {', '.join(keys)}{', ' if keys else ''}{outputs.format(least=least)} FROM b WHERE {having if keys else 'true'}"


_COUNT = "CAST(greatest(coalesce(round(n), {least}), {least}) AS BIGINT) AS n"
_SUM = "CASE WHEN p IS NULL AND q IS NULL THEN NULL ELSE round(coalesce(p, 0) - coalesce(q, 0), 4) END AS s"
_SEG = {"c_mktsegment": "c_mktsegment"}
_PRI = {"o_orderpriority": "o_orderpriority"}
#: Buckets of which many are too small to show.
_FINE_KEYS = {"nation": "CAST(c_nationkey AS BIGINT)", "seg": "c_mktsegment", "step": "floor(c_acctbal / 1000.0) * 1000.0"}
_FINE = "SELECT c_nationkey AS nation, c_mktsegment AS seg, floor_by(c_acctbal, 1000.0) AS step, count(*) AS n FROM customer GROUP BY 1, 2, 3"

#: The text of a real, for reals whose decimal exponent is between -8 and 14.
_TEXT = "CASE WHEN {x} <> 0 AND abs({x}) < 0.0001 THEN upper(regexp_replace(CAST({x} AS VARCHAR), '\\.0e', 'e')) ELSE regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '') END"
#: name: (mode, query, SQL; None for the query itself)
CATALOG: dict[str, tuple[str, str, str | None]] = {
    # Plan nodes, joins and plain aggregates
    "scan": ("direct", "SELECT * FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "project": ("direct", "SELECT o_orderkey AS k, o_totalprice * 2 AS twice, -o_custkey AS neg FROM orders", "SELECT o_orderkey AS k, round(o_totalprice * 2, 4) AS twice, -o_custkey AS neg FROM orders"),
    "filter": ("direct", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000 AND NOT o_orderstatus = 'F' OR o_custkey < 20", None),
    "filter_3vl": ("direct", "SELECT c_custkey AS k FROM customer WHERE nullif(c_nationkey, 3) <> 5 OR c_acctbal >= 9000.5", None),
    "is_null": ("direct", "SELECT c_custkey AS k, nullif(c_nationkey, 3) IS NULL AS b FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL", None),
    "boolean_column": ("direct", "SELECT t.k AS k FROM (SELECT o_orderkey AS k, o_totalprice < 5000.0 AS small FROM orders) t WHERE t.small", None),
    "inner_join": ("direct", "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey", None),
    "left_join": ("direct", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000.0", None),
    "right_join": ("direct", "SELECT c_custkey AS c, o_orderkey AS o FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'", None),
    "full_join": ("direct", "SELECT a.k AS a, b.k AS b FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) b ON a.k = b.k", None),
    "full_join_whole": ("direct", "SELECT o_orderkey AS o, c_custkey AS c FROM orders FULL JOIN customer ON o_custkey = c_custkey", None),
    "cross_join": ("direct", "SELECT n_name, r_name FROM nation, region", None),
    "theta_join": ("direct", "SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None),
    "self_join": ("direct", "SELECT count(*) AS n FROM orders AS a JOIN orders AS b ON a.o_custkey = b.o_custkey", None),
    "multi_join": ("direct", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    "subquery": ("direct", "SELECT t.p AS p, t.n + 1 AS m FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1) t WHERE t.n > 10", None),
    "join_of_subqueries": ("direct", "SELECT a.c AS c, a.n AS n, b.seg AS seg FROM (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer) b ON a.c = b.k", None),
    "group_by": ("direct", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY ALL"),
    "group_by_ordinal": ("direct", "SELECT floor(o_totalprice / 100000.0) AS b, count(*) AS n FROM orders GROUP BY 1", "SELECT CAST(floor(o_totalprice / 100000.0) AS BIGINT) AS b, count(*) AS n FROM orders GROUP BY 1"),
    "group_by_null": ("direct", "SELECT nullif(c_mktsegment, 'BUILDING') AS seg, count(*) AS n FROM customer GROUP BY 1", None),
    "having": ("direct", "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60 AND avg(c_acctbal) > 0", "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60 AND avg(c_acctbal) > 0"),
    "global_aggregate": ("direct", "SELECT count(*) AS n, count(l_tax) AS m, sum(l_linenumber) AS s, avg(l_discount) AS a FROM lineitem", "SELECT count(*) AS n, count(l_tax) AS m, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_discount), 4) AS a FROM lineitem"),
    "global_empty": ("direct", "SELECT count(*) AS n, sum(l_linenumber) AS s FROM lineitem WHERE l_orderkey < 0", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_orderkey < 0"),
    "count_distinct": ("direct", "SELECT o_orderstatus AS st, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1", None),
    "sum_avg": ("direct", "SELECT event_type AS e, sum(value) AS s, avg(value) AS a, sum(user_id) AS u FROM events GROUP BY 1", "SELECT event_type AS e, round(sum(value), 4) AS s, round(avg(value), 4) AS a, CAST(sum(user_id) AS BIGINT) AS u FROM events GROUP BY 1"),
    "count_histogram": ("direct", "SELECT o_orderstatus AS st, count_histogram(o_custkey) AS h FROM orders GROUP BY 1", "SELECT st, CAST(to_json(list([bin, n] ORDER BY bin)) AS VARCHAR) AS h FROM (SELECT st, bin, count(*) AS n FROM (SELECT o_orderstatus AS st, o_custkey, count(*) AS bin FROM orders GROUP BY ALL) GROUP BY ALL) GROUP BY st"),
    "count_histogram_bin": ("direct", "SELECT count_histogram(user_id, 5) AS h FROM events", "SELECT CAST(to_json(list([bin, n] ORDER BY bin)) AS VARCHAR) AS h FROM (SELECT bin, count(*) AS n FROM (SELECT count(*) // 5 * 5 AS bin FROM events GROUP BY user_id) GROUP BY ALL)"),
    "order_nulls": ("direct", "SELECT c_custkey AS k, nullif(c_nationkey, 3) AS n FROM customer ORDER BY n_sort DESC, 1 LIMIT 70".replace("n_sort", "nullif(c_nationkey, 3)"), "SELECT c_custkey AS k, CAST(nullif(c_nationkey, 3) AS BIGINT) AS n FROM customer ORDER BY nullif(c_nationkey, 3) DESC NULLS FIRST, 1 LIMIT 70"),
    "order_limit": ("direct", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 25", "SELECT o_orderkey AS k, round(o_totalprice, 4) AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "distinct": ("direct", "SELECT DISTINCT o_orderstatus AS st, o_orderpriority AS p FROM orders", None),
    # Scalar functions
    "arithmetic_integer": ("direct", "SELECT o_orderkey AS k, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * 3 AS m, (o_custkey - o_orderkey) / 7 AS d, (o_custkey - o_orderkey) % 7 AS r, abs(o_custkey - o_orderkey) AS b FROM orders", "SELECT o_orderkey AS k, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * 3 AS m, CAST(trunc((o_custkey - o_orderkey) / 7) AS BIGINT) AS d, (o_custkey - o_orderkey) % 7 AS r, abs(o_custkey - o_orderkey) AS b FROM orders"),
    "arithmetic_real": ("direct", "SELECT c_custkey AS k, c_acctbal + 1 AS a, c_acctbal - c_custkey AS s, c_acctbal * 0.5 AS m, c_acctbal / 4 AS d, abs(c_acctbal) AS b FROM customer", "SELECT c_custkey AS k, round(c_acctbal + 1, 4) AS a, round(c_acctbal - c_custkey, 4) AS s, round(c_acctbal * 0.5::DOUBLE, 4) AS m, round(c_acctbal / 4, 4) AS d, round(abs(c_acctbal), 4) AS b FROM customer"),
    "rounding": ("direct", "SELECT c_custkey AS k, round(c_acctbal) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c FROM customer", "SELECT c_custkey AS k, CAST(round(c_acctbal) AS BIGINT) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c FROM customer"),
    "rounding_by_real": ("direct", "SELECT c_custkey AS k, round_by(c_acctbal, 2.5) AS r, floor_by(c_acctbal, 2.5) AS f, ceil_by(c_acctbal, 2.5) AS c, round_by(c_acctbal, 0.0) AS z FROM customer", "SELECT c_custkey AS k, round(round(c_acctbal / 2.5::DOUBLE) * 2.5::DOUBLE, 4) AS r, round(floor(c_acctbal / 2.5::DOUBLE) * 2.5::DOUBLE, 4) AS f, round(ceil(c_acctbal / 2.5::DOUBLE) * 2.5::DOUBLE, 4) AS c, CAST(NULL AS DOUBLE) AS z FROM customer"),
    "rounding_by_integer": ("direct", "SELECT o_orderkey AS k, round_by(o_custkey, 10) AS r, floor_by(o_custkey, 10) AS f, ceil_by(o_custkey, 10) AS c FROM orders", "SELECT o_orderkey AS k, CAST(round(o_custkey / 10) * 10 AS BIGINT) AS r, CAST(floor(o_custkey / 10) * 10 AS BIGINT) AS f, CAST(ceil(o_custkey / 10) * 10 AS BIGINT) AS c FROM orders"),
    "width_bucket": ("direct", "SELECT c_custkey AS k, width_bucket(c_acctbal, 0.0, 8000.0, 16) AS w FROM customer", "SELECT c_custkey AS k, CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 8000 THEN 17 ELSE floor(c_acctbal / 500.0) + 1 END AS BIGINT) AS w FROM customer"),
    "strings": ("direct", "SELECT c_custkey AS k, length(c_name) AS l, lower(c_mktsegment) AS lo, upper(c_name) AS up, c_name || '-' || c_mktsegment AS cc FROM customer", None),
    "substring": ("direct", "SELECT c_custkey AS k, substring(c_name, 1, 4) AS a, substring(c_name, 10, 3) AS b, substring(c_name, 0, 2) AS c, substring(c_name, 400, 2) AS d, substring(c_name, 2, 0) AS e FROM customer", "SELECT c_custkey AS k, substring(c_name, 1, 4) AS a, substring(c_name, 10, 3) AS b, CAST(NULL AS VARCHAR) AS c, '' AS d, '' AS e FROM customer"),
    "casts": ("direct", "SELECT o_orderkey AS k, cast(o_totalprice AS integer) AS i, cast(o_custkey AS real) AS r, cast(o_custkey AS text) AS t, cast(o_orderdate AS text) AS d, cast(o_custkey % 2 AS boolean) AS b, cast(o_orderstatus AS integer) AS bad FROM orders", "SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS i, CAST(o_custkey AS DOUBLE) AS r, CAST(o_custkey AS VARCHAR) AS t, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS d, o_custkey % 2 <> 0 AS b, CAST(NULL AS BIGINT) AS bad FROM orders"),
    "casts_from_text": ("direct", "SELECT n_nationkey AS k, cast('12' AS integer) AS i, cast('1,200.5' AS real) AS r, cast(' TRUE ' AS boolean) AS b, cast('yes' AS boolean) AS nb, cast('2017-06-07T04:05:06' AS timestamp) AS ts FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(12 AS BIGINT) AS i, CAST(1200.5 AS DOUBLE) AS r, true AS b, CAST(NULL AS BOOLEAN) AS nb, TIMESTAMP '2017-06-07 04:05:06' AS ts FROM nation"),
    "nullif": ("direct", "SELECT c_custkey AS k, nullif(c_nationkey, 4) AS a, nullif(c_mktsegment, 'BUILDING') AS b, nullif(c_custkey, 2.0) AS c FROM customer", "SELECT c_custkey AS k, CAST(nullif(c_nationkey, 4) AS BIGINT) AS a, nullif(c_mktsegment, 'BUILDING') AS b, CAST(nullif(CAST(c_custkey AS DOUBLE), 2.0) AS DOUBLE) AS c FROM customer"),
    "comparisons": ("direct", "SELECT c_custkey AS k, c_acctbal < 0 AS a, 100 <= c_acctbal AS b, c_mktsegment > 'C' AS c, c_nationkey <> 3 AS d, NOT c_acctbal >= 5 AS e FROM customer", None),
    # Anonymizing queries
    "anon_count": ("quiet", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", _anon("customer", _SEG, "c_custkey", _COUNT)),
    "anon_count_heavy": ("quiet", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority", _anon("orders", _PRI, "o_custkey", _COUNT)),
    "anon_count_column": ("quiet", "SELECT event_type, count(value) AS n FROM events GROUP BY 1", _anon("events", {"event_type": "event_type"}, "user_id", _COUNT.replace("round(n)", "round(m)"), "value")),
    "anon_sum": ("quiet", "SELECT c_nationkey AS nation, sum(c_acctbal) AS s FROM customer GROUP BY 1", _anon("customer", {"nation": "CAST(c_nationkey AS BIGINT)"}, "c_custkey", _SUM, "c_acctbal")),
    "anon_sum_orders": ("quiet", "SELECT o_orderstatus AS st, sum(o_totalprice) AS s FROM orders GROUP BY 1", _anon("orders", {"st": "o_orderstatus"}, "o_custkey", _SUM, "o_totalprice")),
    "anon_avg": ("quiet", "SELECT o_orderstatus AS st, avg(o_totalprice) AS a FROM orders GROUP BY 1", _anon("orders", {"st": "o_orderstatus"}, "o_custkey", "round((coalesce(p, 0) - coalesce(q, 0)) / greatest(round(m), 2), 4) AS a", "o_totalprice")),
    "anon_noise": ("quiet", "SELECT c_mktsegment, count_noise(*) AS cn, sum_noise(c_acctbal) AS sn FROM customer GROUP BY 1", "SELECT c_mktsegment, 0.0::DOUBLE AS cn, 0.0::DOUBLE AS sn FROM customer GROUP BY 1"),
    "anon_global": ("quiet", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders", _anon("orders", {}, "o_custkey", f"{_COUNT}, {_SUM}", "o_totalprice", least=0)),
    "anon_filter_labels": ("quiet", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND extract(year FROM o_orderdate) = 1997.0", _anon("orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1997", {}, "o_custkey", _COUNT)),
    "anon_generalization": ("quiet", "SELECT date_trunc('year', o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1", _anon("orders", {"y": "CAST(date_trunc('year', o_orderdate) AS TIMESTAMP)"}, "o_custkey", _COUNT)),
    "anon_histogram": ("quiet", "SELECT count_histogram(o_custkey, 5) AS h FROM orders", "WITH c AS (SELECT count(*) // 5 * 5 AS bin FROM orders GROUP BY o_custkey), g AS (SELECT bin, count(*) AS n FROM c GROUP BY 1), m AS (SELECT bin, n FROM g WHERE n >= 2 UNION ALL SELECT NULL, sum(n)::BIGINT FROM g WHERE n < 2 HAVING sum(n) >= 2) SELECT CAST(to_json(list([bin, n] ORDER BY bin NULLS FIRST)) AS VARCHAR) AS h FROM m"),
    "anon_suppression": ("quiet", _FINE, _anon("customer", _FINE_KEYS, "c_custkey", _COUNT)),
    "anon_join": ("quiet", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", _anon("customer JOIN nation ON c_nationkey = n_nationkey", {"n_name": "n_name"}, "c_custkey", _COUNT)),
    "anon_subquery": ("quiet", "SELECT t.seg || '!' AS seg, t.n * 2 AS n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1) t", "SELECT seg || '!' AS seg, n * 2 AS n FROM (" + _anon("customer", {"seg": "c_mktsegment"}, "c_custkey", _COUNT) + ")"),
    "bucket_expansion": ("quiet", "SELECT c_mktsegment FROM customer WHERE c_nationkey = 3", f"SELECT c_mktsegment FROM ({_anon('customer WHERE c_nationkey = 3', _SEG, 'c_custkey', _COUNT)}), unnest(range(n)) AS u(i)"),
    "bucket_expansion_whole": ("quiet", "SELECT c_mktsegment FROM customer", f"SELECT c_mktsegment FROM ({_anon('customer', _SEG, 'c_custkey', _COUNT)}), unnest(range(n)) AS u(i)"),
    "low_count": ("level_direct", "SELECT c_nationkey AS nation, c_mktsegment AS seg, floor_by(c_acctbal, 1000.0) AS step, anon_low_count(c_custkey) AS low FROM customer GROUP BY 1, 2, 3", "SELECT CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS seg, floor(c_acctbal / 1000.0) * 1000.0 AS step, count(DISTINCT c_custkey) < 2 AS low FROM customer GROUP BY ALL"),
    "explicit_count_distinct": ("direct", "SELECT anon_count(DISTINCT o_orderstatus, o_custkey) AS d FROM orders", "SELECT count(DISTINCT o_orderstatus) AS d FROM orders"),
    "explicit_sum": ("level_direct", "SELECT o_orderstatus AS st, anon_low_count(o_custkey) AS low, anon_sum(o_totalprice, o_custkey) AS s, anon_count(*, o_custkey) AS n, anon_sum_noise(o_totalprice, o_custkey) AS sn, anon_count_noise(*, o_custkey) AS cn FROM orders GROUP BY 1", _anon("orders", {"st": "o_orderstatus"}, "o_custkey", f"entities < 2 AS low, {_SUM}, {_COUNT}, 0.0::DOUBLE AS sn, 0.0::DOUBLE AS cn", "o_totalprice", having="true")),
    "explicit_avg": ("level_direct", "SELECT c_nationkey AS nation, anon_low_count(c_custkey) AS low, anon_avg(c_acctbal, c_custkey) AS a, anon_avg_noise(c_acctbal, c_custkey) AS an FROM customer GROUP BY 1", _anon("customer", {"nation": "CAST(c_nationkey AS BIGINT)"}, "c_custkey", "entities < 2 AS low, round((coalesce(p, 0) - coalesce(q, 0)) / greatest(round(m), 2), 4) AS a, 0.0::DOUBLE AS an", "c_acctbal", having="true")),
    "explicit_histogram": ("level_direct", "SELECT anon_count_histogram(0, 5, o_custkey) AS h FROM orders", "WITH c AS (SELECT count(*) // 5 * 5 AS bin FROM orders GROUP BY o_custkey), g AS (SELECT bin, count(*) AS n FROM c GROUP BY 1), m AS (SELECT bin, n FROM g WHERE n >= 2 UNION ALL SELECT NULL, sum(n)::BIGINT FROM g WHERE n < 2 HAVING sum(n) >= 2) SELECT CAST(to_json(list([bin, n] ORDER BY bin NULLS FIRST)) AS VARCHAR) AS h FROM m"),
    "anon_avg_noise": ("quiet", "SELECT c_mktsegment, avg_noise(c_acctbal) AS an FROM customer GROUP BY 1", "SELECT c_mktsegment, 0.0::DOUBLE AS an FROM customer GROUP BY 1"),
    "anon_having_order_limit": ("quiet", "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 55 ORDER BY 2 DESC, 1 LIMIT 5", f"SELECT nation, n FROM ({_anon('customer', {'nation': 'CAST(c_nationkey AS BIGINT)'}, 'c_custkey', _COUNT)}) WHERE n > 55 ORDER BY n DESC, nation LIMIT 5"),
    "anon_text_label": ("quiet", "SELECT substring(c_name, 1, 15) AS part, count(*) AS n FROM customer GROUP BY 1", _anon("customer", {"part": "substring(c_name, 1, 15)"}, "c_custkey", _COUNT)),
    "anon_null_label": ("quiet", "SELECT extract(dow FROM o_orderdate) AS d, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", _anon("orders WHERE o_orderstatus = 'F'", {"d": "CAST(date_part('dow', o_orderdate) AS DOUBLE)"}, "o_custkey", _COUNT)),
    "order_nulls_first": ("direct", "SELECT c_custkey AS k FROM customer ORDER BY nullif(c_nationkey, 3) ASC NULLS FIRST, c_custkey DESC LIMIT 40", None),
    "anon_multi_aid": ("quiet", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1", f"""WITH {contributions("lineitem", {"f": "l_returnflag"}, "l_orderkey").strip().replace("r AS", "r1 AS").replace("FROM r ", "FROM r1 ").replace("c AS", "c1 AS").replace("FROM c ", "FROM c1 ").replace("b AS", "b1 AS")}, {contributions("lineitem", {"f": "l_returnflag"}, "l_suppkey").strip()},
t AS (SELECT l_returnflag AS f, count(*) AS all_rows FROM lineitem GROUP BY 1)
SELECT f, CAST(round(CASE WHEN all_rows - b1.n >= all_rows - b.n THEN b1.n ELSE b.n END) AS BIGINT) AS n FROM b1 JOIN b USING (f) JOIN t USING (f)"""),
    "outlier_recovery": ("recover", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1", f"""WITH {contributions("orders", _PRI, "o_custkey")},
v AS (SELECT o_orderpriority, greatest(round(n), 2) AS n FROM b WHERE entities >= 2),
o AS (SELECT a, sum(excess) AS x FROM (SELECT o_orderpriority, arg_max(a, n) AS a, (list_reverse_sort(list(n)))[1] - (list_reverse_sort(list(n)))[2] AS excess FROM c GROUP BY 1) WHERE excess > 0 GROUP BY 1),
w AS (SELECT CASE WHEN count(*) >= 2 THEN round(sum(x) - ((list_reverse_sort(list(x)))[1] - (list_reverse_sort(list(x)))[2])) ELSE 0 END AS x FROM o)
SELECT o_orderpriority, CAST(round(n * (1 + w.x / (SELECT sum(n) FROM v))) AS BIGINT) AS n FROM v, w"""),
    "star_bucket": ("star", _FINE, f"""WITH {contributions("customer", _FINE_KEYS, "c_custkey")},
shown AS (SELECT nation, seg, step, CAST(greatest(n, 2) AS BIGINT) AS n FROM b WHERE entities >= 2),
low AS (SELECT count(*) AS buckets, sum(entities) AS n FROM b WHERE entities < 2)
SELECT * FROM shown UNION ALL SELECT NULL, '*', NULL, CAST(n AS BIGINT) FROM low WHERE n >= 2 AND buckets >= 2"""),
    "led": ("led", _FINE, f"""WITH {contributions("customer", _FINE_KEYS, "c_custkey")},
w AS (SELECT *, entities < 2 AS low, count(*) OVER (PARTITION BY seg, step) AS n0, count(*) OVER (PARTITION BY nation, step) AS n1, count(*) OVER (PARTITION BY nation, seg) AS n2 FROM b),
v AS (SELECT * FROM w WHERE low AND (n0 = 1 OR n1 = 1 OR n2 = 1)),
m AS (SELECT t.nation, t.seg, t.step, count(*) AS more FROM v JOIN w t ON NOT t.low AND ((v.n0 = 2 AND t.seg = v.seg AND t.step = v.step AND t.nation <> v.nation) OR (v.n1 = 2 AND t.nation = v.nation AND t.step = v.step AND t.seg <> v.seg) OR (v.n2 = 2 AND t.nation = v.nation AND t.seg = v.seg AND t.step <> v.step)) GROUP BY ALL)
SELECT w.nation, w.seg, w.step, CAST(greatest(w.n + coalesce(more, 0), 2) AS BIGINT) AS n FROM w LEFT JOIN m USING (nation, seg, step) WHERE NOT w.low"""),
    "noisy_count": ("noisy", "SELECT c_mktsegment, count(*) AS n, count_noise(*) AS cn, sum(c_acctbal) AS s FROM customer GROUP BY 1", catalog_noise.grouped(NOISY, "customer", "c_mktsegment", "c_mktsegment", "customer.c_mktsegment", "c_custkey", "c_acctbal", True)),
    "noisy_unscaled": ("unscaled", "SELECT c_mktsegment, count(*) AS n, count_noise(*) AS cn, sum(c_acctbal) AS s FROM customer GROUP BY 1", catalog_noise.grouped(NOISY, "customer", "c_mktsegment", "c_mktsegment", "customer.c_mktsegment", "c_custkey", "c_acctbal", False)),
    "noisy_heavy": ("noisy", "SELECT o_orderpriority, count(*) AS n, count_noise(*) AS cn, sum(o_totalprice) AS s FROM orders GROUP BY 1", catalog_noise.grouped(NOISY, "orders", "o_orderpriority", "o_orderpriority", "orders.o_orderpriority", "o_custkey", "o_totalprice", True)),
    "noisy_suppressed": ("unscaled", "SELECT substring(c_name, 1, 17) AS part, count(*) AS n, count_noise(*) AS cn, sum(c_acctbal) AS s FROM customer GROUP BY 1", catalog_noise.grouped(NOISY, "customer", "part", "substring(c_name, 1, 17)", "substring,customer.c_name,1,17", "c_custkey", "c_acctbal", False)),
    "noisy_fine": ("noisy", _FINE, catalog_noise.merged(NOISY, "customer", _FINE_KEYS, {"nation": "CAST(nation AS VARCHAR)", "seg": "seg", "step": "CAST(CAST(step AS BIGINT) AS VARCHAR)"}, {"nation": "NULL", "seg": "'*'", "step": "NULL"}, fnv("customer.c_nationkey") ^ fnv("customer.c_mktsegment") ^ fnv("floor,customer.c_acctbal,1000"), "c_custkey")),
    "anon_count_distinct": ("quiet", "SELECT o_orderpriority, count(DISTINCT o_totalprice) AS n FROM orders GROUP BY 1", """WITH v AS (SELECT o_orderpriority, o_totalprice, count(DISTINCT o_custkey) AS k, min(o_custkey) AS a FROM orders GROUP BY ALL),
e AS (SELECT o_orderpriority, a, count(*) AS m FROM v WHERE k < 2 GROUP BY ALL),
f AS (SELECT o_orderpriority, count(*) AS entities, sum(m) - ((list_reverse_sort(list(m)))[1] - (list_reverse_sort(list(m)))[2]) AS rare FROM e GROUP BY 1),
s AS (SELECT o_orderpriority, count(*) FILTER (WHERE k >= 2) AS safe FROM v GROUP BY 1)
SELECT o_orderpriority, CAST(greatest(safe + CASE WHEN entities >= 2 THEN rare ELSE 0 END, 2) AS BIGINT) AS n FROM s LEFT JOIN f USING (o_orderpriority)"""),
    "anon_count_distinct_noise": ("quiet", "SELECT o_orderpriority, count_noise(DISTINCT o_totalprice) AS n FROM orders GROUP BY 1", "SELECT o_orderpriority, 0.0::DOUBLE AS n FROM orders GROUP BY 1"),
    "casts_to_text": ("direct", "SELECT c_custkey AS k, cast(c_acctbal * 100000.0 AS text) AS a, cast(c_acctbal / 1000000.0 AS text) AS b, cast(floor_by(c_acctbal, 0.5) AS text) AS c, cast(c_acctbal < 0 AS text) AS d FROM customer", f"SELECT c_custkey AS k, {_TEXT.format(x='(c_acctbal * 100000.0::DOUBLE)')} AS a, {_TEXT.format(x='(c_acctbal / 1000000.0::DOUBLE)')} AS b, {_TEXT.format(x='(floor(c_acctbal / 0.5::DOUBLE) * 0.5::DOUBLE)')} AS c, CAST(c_acctbal < 0 AS VARCHAR) AS d FROM customer"),
    "casts_of_numbers": ("direct", "SELECT c_custkey AS k, cast(substring(c_name, 10, 9) AS integer) AS i, cast(substring(c_name, 10, 5) || '.5' AS real) AS r FROM customer", "SELECT c_custkey AS k, CAST(substring(c_name, 10, 9) AS BIGINT) AS i, CAST(substring(c_name, 10, 5) || '.5' AS DOUBLE) AS r FROM customer"),
    "synthetic_column": ("synthetic", "SELECT c_mktsegment FROM customer", None),
    "synthetic_pairs": ("synthetic", "SELECT c_mktsegment, c_nationkey / 13 AS part FROM customer", "SELECT c_mktsegment, CAST(c_nationkey // 13 AS BIGINT) AS part FROM customer"),
    "synthetic_triples": ("synthetic", "SELECT c_mktsegment AS seg, c_nationkey / 13 AS part, c_acctbal < 4500.0 AS low FROM customer", "SELECT c_mktsegment AS seg, CAST(c_nationkey // 13 AS BIGINT) AS part, c_acctbal < 4500 AS low FROM customer"),
    "synthetic_rows": ("synthetic", "SELECT c_mktsegment, c_nationkey FROM customer", ""),
}
for _part in ("second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium"):
    _first = {"decade": 10, "century": 100, "millennium": 1000}.get(_part)
    _base = f"year(ts) - year(ts) % {_first}" if _part == "decade" else f"year(ts) - (year(ts) - 1) % {_first}"
    _sql = f"make_timestamp({_base}, 1, 1, 0, 0, 0.0)" if _first else f"CAST(date_trunc('{_part}', ts) AS TIMESTAMP)"
    CATALOG[f"date_trunc_{_part}"] = ("direct", f"SELECT event_id AS k, date_trunc('{_part}', ts) AS t FROM events", f"SELECT event_id AS k, {_sql} AS t FROM events")
for _part in ("second", "epoch", "minute", "hour", "day", "dow", "doy", "isodow", "week", "month", "quarter", "year", "isoyear", "decade", "century", "millennium"):
    _sql = {"epoch": "round(floor(epoch_us(ts) / 1000) / 1000, 4)", "second": "floor(second(ts))"}.get(_part, f"date_part('{_part}', ts)")
    CATALOG[f"extract_{_part}"] = ("direct", f"SELECT event_id AS k, extract({_part} FROM ts) AS x FROM events", f"SELECT event_id AS k, CAST({_sql} AS DOUBLE) AS x FROM events")

QUERIES = {name: query(mode, sql) for name, (mode, sql, _) in CATALOG.items()} | catalog_cases.QUERIES
ORACLES = {name: (sql if oracle is None else oracle) for name, (_, sql, oracle) in CATALOG.items() if oracle != ""} | catalog_cases.ORACLES
