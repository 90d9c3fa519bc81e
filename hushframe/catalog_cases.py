"""Registered queries about what returns no rows of a table by itself: refusals, seeds, parameters, sources, sinks, command line and tools.

Each gives a table of cases and outcomes; its SQL lists the outcomes, or computes them from the tables where they depend on these.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import sqlite3
import sys
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import __version__, cli, log, sinks
from hushframe.catalog_noise import of_text
from hushframe.engine import Engine
from hushframe.operators import adaptive
from hushframe.params import AccessLevel, AdaptiveBuckets, Interval, Params, Suppression, noiseless
from hushframe.plans import analyzer as an
from hushframe.plans import parser, tree
from hushframe.sources import tables_in
from hushframe.storage import shared_dir

AIDS = {"customer": ("c_custkey",), "orders": ("o_custkey",)}


def _table(spark: SparkSession, columns: str, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns.split()))


def _values(columns: str, rows: Iterable[tuple]) -> str:
    text = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({', '.join(columns.split())})"


def _engine(spark: SparkSession, sf_dir: str, level: AccessLevel = AccessLevel.PUBLISH_TRUSTED, **options) -> Engine:
    read = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Engine(spark, noiseless(AIDS, access_level=level, recover_outliers=False), {n: read(n) for n in ("nation", "region", "customer", "orders")}, **options)


# Refusals: (query, message)

_C = "FROM customer"
REFUSED: dict[str, tuple[AccessLevel, list[tuple[str, str]]]] = {
    "refused_aggregates": (AccessLevel.PUBLISH_TRUSTED, [
        (f"SELECT count(c_acctbal + 1) {_C}", an.ONLY_COUNT_COLUMN), (f"SELECT sum(c_acctbal + 1) {_C}", an.ONLY_SUM_COLUMN), (f"SELECT sum(DISTINCT c_acctbal) {_C}", an.ONLY_SUM_COLUMN), (f"SELECT anon_count(*, c_custkey) {_C}", an.AGGREGATE_NOT_SUPPORTED),
        (f"SELECT count_histogram(c_nationkey) {_C}", an.HISTOGRAM_AID), (f"SELECT count_histogram(c_custkey, 0) {_C}", an.HISTOGRAM_CONSTANT), (f"SELECT count_histogram(DISTINCT c_custkey) {_C}", an.HISTOGRAM_DISTINCT), (f"SELECT DISTINCT c_mktsegment {_C}", an.DISTINCT_ANONYMIZING),
    ]),
    "refused_generalizations": (AccessLevel.PUBLISH_TRUSTED, [
        (f"SELECT round_by(c_acctbal + 1, 5), count(*) {_C} GROUP BY 1", an.PRIMARY_ARGUMENT), (f"SELECT floor_by(c_acctbal, c_nationkey), count(*) {_C} GROUP BY 1", an.SECONDARY_ARGUMENTS), (f"SELECT c_name || 'x', count(*) {_C} GROUP BY 1", an.UNSUPPORTED_FUNCTION),
    ]),
    "refused_untrusted": (AccessLevel.PUBLISH_UNTRUSTED, [
        (f"SELECT round_by(c_acctbal, 3), count(*) {_C} GROUP BY 1", an.UNTRUSTED), (f"SELECT ceil_by(c_acctbal, 2), count(*) {_C} GROUP BY 1", an.UNTRUSTED), (f"SELECT substring(c_name, 2, 2), count(*) {_C} GROUP BY 1", an.UNTRUSTED), (f"SELECT width_bucket(c_acctbal, 0, 50, 5), count(*) {_C} GROUP BY 1", an.UNTRUSTED),
        (f"SELECT count_histogram(c_custkey, 3) {_C}", an.HISTOGRAM_ALIGNED), (f"SELECT round_by(c_acctbal, 5), count(*) {_C} GROUP BY 1", "accepted"), (f"SELECT floor_by(c_acctbal, 0.2), substring(c_name, 1, 2), count(*) {_C} GROUP BY 1, 2", "accepted"),
    ]),
    "refused_filters": (AccessLevel.PUBLISH_TRUSTED, [
        (f"SELECT count(*) {_C} WHERE c_custkey = 1", an.AID_FILTER), (f"SELECT count(*) {_C} WHERE c_acctbal > 3", an.FILTER_EQUALITIES), (f"SELECT count(*) {_C} WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3", an.FILTER_EQUALITIES), (f"SELECT count(*) {_C} WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3", "accepted"),
    ]),
    "refused_sources": (AccessLevel.PUBLISH_TRUSTED, [
        ("SELECT count(*) FROM customer, nation", an.CROSS_JOIN), ("SELECT count(*) FROM customer JOIN nation ON c_nationkey > n_nationkey", an.JOIN_EQUALITIES), ("SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey OR c_custkey = n_regionkey", an.JOIN_OR),
        ("SELECT count(*) FROM customer JOIN (SELECT n_nationkey AS x FROM nation) n ON c_nationkey = x", an.SUBQUERIES), ("SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey", "accepted"),
    ]),
    "refused_names": (AccessLevel.DIRECT, [
        ("SELECT x FROM nation", "Column `x` not found in query range."), ("SELECT n.x FROM nation AS n", "Column `n.x` not found in query range."), ("SELECT n_name FROM nation AS a JOIN nation AS b ON a.n_name = b.n_name", "Column reference `n_name` is ambiguous in query range."),
        ("SELECT a FROM missing", "Could not find table `missing`."), ("SELECT n_name FROM nation GROUP BY 3", "Invalid `GROUP BY` index: 3"), ("SELECT n_name FROM nation ORDER BY 2", "Invalid `ORDER BY` index: 2"), ("SELECT n_name FROM nation, nation", "Ambiguous target names in `FROM` clause."),
        ("SELECT anon_low_count(c_custkey), anon_low_count(c_nationkey) FROM customer", an.SINGLE_LOW_COUNT), ("SELECT n_name FROM nation WHERE count(*) > 1", "Aggregates are not allowed in `WHERE`."), ("SELECT n_name FROM nation GROUP BY count(*)", "Aggregates are not allowed in `GROUP BY`."),
    ]),
}


def _outcome(run: Callable[[], object]) -> str:
    try:
        run()
    except parser.SqlError as error:
        return str(error)
    return "accepted"


def refused(name: str) -> Callable[[SparkSession, str], DataFrame]:
    level, cases = REFUSED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir, level)
        return _table(spark, "query outcome", [(q, _outcome(lambda q=q: engine.sql(q))) for q, _ in cases])

    return run


# Syntax: whether a text can be parsed
SYNTAX = [
    ("SELECT 1 FROM t", True), ("SELECT 1 FROM t;", True), ("select A.b as c from T as A -- tail", True), ("SELECT \"odd name\" FROM t", True), ("SELECT a FROM t ORDER BY a DESC NULLS FIRST LIMIT 3", True), ("SELECT count(DISTINCT a) FROM t HAVING count(*) > 1", True), ("SELECT cast(a AS integer), cast(a, 'real') FROM t", True),
    ("SELECT 1", False), ("SELECT FROM t", False), ("SELECT a FROM t; SELECT b FROM t", False), ("SELECT a FROM t WHERE", False), ("SELECT (a FROM t", False), ("SELECT cast(a AS money) FROM t", False), ("SELECT a FROM t LIMIT x", False), ("SELECT a # b FROM t", False), ("", False),
]


def syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, "query outcome", [(q, "parsed" if _outcome(lambda q=q: parser.parse(q)) == "accepted" else "refused") for q, _ in SYNTAX])


# What seeds the noise of a grouping expression
SEEDS = [
    ("c_mktsegment", "customer.c_mktsegment"), ("substring(c_name, 1, 2)", "substring,customer.c_name,1,2"), ("round(c_acctbal)", "round,customer.c_acctbal,1"), ("cast(c_acctbal AS integer)", "round,customer.c_acctbal,1"), ("floor(c_acctbal)", "floor,customer.c_acctbal,1"), ("ceil_by(c_acctbal, 0.5)", "ceil,customer.c_acctbal,0.5"),
    ("floor_by(c_acctbal, 10000000.0)", "floor,customer.c_acctbal,10000000"), ("round_by(c_acctbal, 0.0001)", "round,customer.c_acctbal,0.0001"), ("round(c_custkey)", "customer.c_custkey"), ("cast(c_nationkey AS real)", "customer.c_nationkey"), ("width_bucket(c_acctbal, 0, 100, 5)", "width_bucket,customer.c_acctbal,0,100,5"),
]


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"c_mktsegment": "text", "c_name": "text", "c_acctbal": "real", "c_custkey": "integer", "c_nationkey": "integer"}
    columns = [an.RangeColumn("customer", n, k, False, n) for n, k in kinds.items()]
    of = lambda e: an.seed_material(an.bucket_expression(an.resolve(columns, parser.parse(f"SELECT {e} FROM customer").items[0].expr)))
    return _table(spark, "expression material", [(e, of(e)) for e, _ in SEEDS])


# Steps that are 1, 2 or 5 times a power of ten
MONEY = [(x, x in (1, 2, 5, 10, 50, 0.1, 0.02, 1000.0, 0.005)) for x in (1, 2, 3, 4, 5, 7, 10, 15, 25, 50, 0.1, 0.02, 0.3, 1000.0, 2500, 0.005, 0, -5)]


def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, "step aligned", [(str(x), str(an.money_rounded(x))) for x, _ in MONEY])


# Parameters that are refused when made, and some that are not
PARAMETERS: list[tuple[str, dict, bool]] = [
    ("default", {}, True), ("low_threshold 1", {"suppression": Suppression(1)}, False), ("layer_sd 0.5", {"suppression": Suppression(2, 0.5)}, False), ("low_mean_gap 1", {"suppression": Suppression(2, 1.0, 1.0)}, False), ("layer_noise_sd 0.5", {"layer_noise_sd": 0.5}, False),
    ("outliers from 0", {"outlier_count": Interval(0, 2)}, False), ("outliers of one number", {"outlier_count": Interval(2, 2)}, False), ("top from 1", {"top_count": Interval(1, 3)}, False), ("top reversed", {"top_count": Interval(5, 2)}, False), ("outliers reversed, not strict", {"outlier_count": Interval(5, 2), "strict": False}, False),
    ("no noise, not strict", {"strict": False, "layer_noise_sd": 0.0, "suppression": Suppression(1, 0.0, 0.0), "outlier_count": Interval(0, 0), "top_count": Interval(1, 1)}, True), ("negative noise, not strict", {"strict": False, "layer_noise_sd": -1.0}, False), ("other buckets", {"adaptive_buckets": AdaptiveBuckets(2, 3)}, True),
]


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    def accepted(changes: dict) -> bool:
        try:
            Params(**changes)
        except ValueError:
            return False
        return True

    return _table(spark, "parameters accepted", [(n, str(accepted(c))) for n, c, _ in PARAMETERS])


# Command line


def _said(*args: str, spark: SparkSession, stdin: str = "") -> tuple[int, list[str], str]:
    out, err, before = io.StringIO(), io.StringIO(), sys.stdin
    sys.stdin = io.StringIO(stdin)
    try:
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            code = cli.main(list(args), spark)
    finally:
        sys.stdin = before
    return code, out.getvalue().splitlines(), err.getvalue()


_QUIET = ["--strict", "false", "--low-layer-sd", "0", "--low-mean-gap", "0", "--layer-noise-sd", "0", "--outlier-count", "1", "1", "--top-count", "1", "1", "--recover-outliers", "false"]
_SEGMENTS = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"
_OF_SEGMENTS = "(SELECT c_mktsegment AS s, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1)"


def cli_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anonymizing query of a folder of tables, from standard input, as CSV."""
    _, lines, _ = _said("-f", sf_dir, "--aid-columns", "customer.c_custkey", "--query-stdin", *_QUIET, spark=spark, stdin=f"{_SEGMENTS}\n")
    return _table(spark, "line", [(x,) for x in lines])


def cli_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines, _ = _said("-f", sf_dir, "--json", "-q", "SELECT n_name, n_regionkey, n_regionkey / 2.0 AS half, nullif(n_regionkey, 1) IS NULL AS b FROM nation", spark=spark)
    found = json.loads("".join(lines))
    return _table(spark, "kind content", [("column", f"{c['name']} {c['type']}") for c in found["columns"]] + [("row", " ".join(map(str, r))) for r in found["rows"]])


def cli_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries with parameters of their own, one of which fails."""
    quiet = {"strict": False, "suppression": {"low_threshold": 2, "layer_s_d": 0, "low_mean_gap": 0}, "outlier_count": {"lower": 1, "upper": 1}, "top_count": {"lower": 1, "upper": 1}, "layer_noise_s_d": 0, "recover_outliers": False}
    private = quiet | {"table_settings": {"customer": {"aid_columns": ["c_custkey"]}}}
    requests = [{"query": q, "db_path": os.path.abspath(sf_dir), "anonymization_parameters": p} for q, p in ((_SEGMENTS, private), ("SELECT count(*) AS n FROM nation", quiet), ("SELECT nothing FROM nation", quiet))]
    path = _local(spark, "queries.json")
    try:
        with open(path, "w") as f:
            json.dump(requests, f)
        found = json.loads("".join(_said("--queries-path", path, spark=spark)[1]))
    finally:
        os.remove(path)
    rows = [(str(i), str(r["success"]), " ".join(map(str, x))) for i, r in enumerate(found["query_results"]) for x in (r["result"]["rows"] if r["success"] else [[r["error"]]])]
    return _table(spark, "query success row", rows)


def cli_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes, and what errors begin with; the version."""
    cases = {name: _said(*args, spark=spark) for name, args in _CLI.items()}
    rows = [(name, str(code), err[:7]) for name, (code, _, err) in cases.items()]
    return _table(spark, "arguments code error", [*rows, ("version", json.loads(cases["version alone"][1][0])["version"], "")])


_CLI: dict[str, list[str]] = {
    "version alone": ["--version"], "no file": ["-q", "SELECT 1 FROM t"], "no query": ["-f", "/nowhere"], "unknown flag": ["--unknown"], "file that is not there": ["-f", "/nowhere", "-q", "SELECT 1 FROM t"],
    "entity column without table": ["-f", "/nowhere", "-q", "SELECT 1 FROM t", "--aid-columns", "id"], "access level that is none": ["-f", "/nowhere", "-q", "SELECT 1 FROM t", "--access-level", "any"], "both query and standard input": ["-f", "/nowhere", "-q", "SELECT 1 FROM t", "--query-stdin"], "parameters too weak": ["-f", "/nowhere", "-q", "SELECT 1 FROM t", "--low-threshold", "0"],
}


# Sources and sinks


def _local(spark: SparkSession, name: str) -> str:
    """A file's path in the shared folder, which must be one that this machine sees as a folder."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{uuid.uuid4().hex}-{name}"


def sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types of a SQLite file, read by two queries that name some columns of it; what is read is shown too."""
    path = _local(spark, "nations.sqlite")
    with contextlib.closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE nations (k INTEGER, name TEXT, half REAL, first BOOLEAN, other BLOB)")
        db.executemany("INSERT INTO nations VALUES (?, ?, ?, ?, NULL)", [(r[0], r[1], r[0] / 2, r[0] < 5) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()])
        db.commit()
    engine = Engine(spark, tables=tables_in(spark, path))
    rows = engine.sql("SELECT k, name, half, first FROM nations").collect()
    read = engine.tables["nations"].load(["k"]).columns
    total = engine.sql("SELECT sum(k) AS s FROM nations WHERE first").first()[0]
    os.remove(path)
    return _table(spark, "kind content", [("row", f"{k} {name} {sinks.value_text(half)} {sinks.value_text(first)}") for k, name, half, first in rows] + [("read", " ".join(read)), ("sum", str(total))])


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written by Spark in each form and read back."""
    engine, out = _engine(spark, sf_dir, AccessLevel.DIRECT), None
    for form in ("parquet", "csv", "json"):
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.{form}"
        sinks.write(engine.sql("SELECT n_nationkey AS k, n_name AS name FROM nation"), path, form)
        reader = spark.read.schema("k long, name string")
        back = (reader.option("header", True) if form == "csv" else reader).format(form).load(path).select(F.lit(form).alias("form"), "k", "name")
        out = back if out is None else out.unionByName(back)
    return out


# Tools


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of results, and what plans are made of, without running anything."""
    engine = _engine(spark, sf_dir)
    query = "SELECT c_mktsegment, count(*), avg(c_acctbal) AS a, round(c_acctbal) FROM customer GROUP BY 1, 4"
    plan = engine.explain("SELECT n_name FROM nation WHERE n_regionkey = 1")
    steps = [(s, str(s in plan)) for s in ("Scan parquet", "PushedFilters", "ReadSchema: struct<n_name:string,n_regionkey:int>", "Exchange")]
    return _table(spark, "what value", [*engine.columns(query), ("columns", str(len(engine.columns(query)))), *steps])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held: list[log.Message] = []
    log.use(held.append)
    try:
        log.info("begun")
        _engine(spark, sf_dir).columns("SELECT n_name FROM nation")
        log.warning("done")
    finally:
        log.use(None)
    log.info("dropped")
    return _table(spark, "level text", [(m.level, str(m)[13:]) for m in held])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a query, and the query with other names."""
    q = parser.parse("SELECT a, sum(b + 1) FROM t JOIN u ON t.x = u.x WHERE c = 'k' GROUP BY a")
    names = sorted(n.column for n in tree.walk(q) if isinstance(n, parser.Name))
    renamed = tree.rewrite(q, lambda n: parser.Name(n.table, n.column.upper()) if isinstance(n, parser.Name) else n)
    calls = sorted(n.fn for n in tree.walk(q) if isinstance(n, parser.Call))
    return _table(spark, "what found", [("names", " ".join(names)), ("renamed", " ".join(sorted(n.column for n in tree.walk(renamed) if isinstance(n, parser.Name)))), ("calls", " ".join(calls)), ("children", str(len(tree.children(q))))])


def or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other precedence of OR and AND, and of % and *."""
    return _engine(spark, sf_dir, AccessLevel.DIRECT, or_first=True).sql("SELECT c_custkey AS k, c_custkey * 7 % 4 AS m FROM customer WHERE c_nationkey < 5 AND c_acctbal < 0.0 OR c_mktsegment = 'BUILDING'")


def prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates over explicit entities under another first word."""
    engine = _engine(spark, sf_dir, AccessLevel.DIRECT, explicit="private_")
    return engine.sql("SELECT c_mktsegment AS s, private_count(*, c_custkey) AS n, private_count_noise(DISTINCT c_nationkey, c_custkey) AS cn FROM customer GROUP BY 1")


# Adaptive buckets


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda r: f"{r[0]:g} {r[1]:g}"
    return _table(spark, "ends range", [(shown(r), shown(adaptive.snap(*map(float, r)))) for r, _ in SNAPPED])


#: Ends of values, and the least aligned range of a power of two around them.
SNAPPED = [((1, 21), "0 32"), ((0, 2), "0 2"), ((5, 5), "5 6"), ((3, 5), "3 5"), ((-7, 7), "-8 8"), ((0.25, 0.5), "0.25 0.5"), ((64, 190), "64 192")]


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all types as reals."""
    customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    rows = customer.select(F.col("c_custkey").alias("k"), adaptive.encode(F.col("c_nationkey"), "integer").alias("x"), adaptive.encode(F.col("c_acctbal") < 0, "boolean").alias("y"))
    return rows.unionByName(orders.select((-F.col("o_orderkey")).alias("k"), adaptive.encode(F.col("o_orderdate"), "timestamp").alias("x"), adaptive.encode(F.col("o_totalprice"), "real").alias("y")))


def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", adaptive.encode(F.col("n_name"), "text").alias("x"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: refused(name) for name in REFUSED} | {
    "syntax": syntax, "seed_materials": seeds, "money_steps": money, "parameter_checks": parameters, "cli_csv": cli_csv, "cli_json": cli_json, "cli_batch": cli_batch, "cli_outcomes": cli_outcomes, "sqlite_scan": sqlite_scan, "written_results": written,
    "described": described, "log_messages": messages, "tree_steps": steps, "explicit_prefix": prefixed, "or_before_and": or_first, "snapped_ranges": snapped, "encoded_values": encoded, "encoded_texts": encoded_texts,
}
ORACLES: dict[str, str] = {name: _values("query outcome", cases) for name, (_, cases) in REFUSED.items()} | {
    "syntax": _values("query outcome", [(q, "parsed" if ok else "refused") for q, ok in SYNTAX]),
    "seed_materials": _values("expression material", SEEDS),
    "money_steps": _values("step aligned", MONEY),
    "parameter_checks": _values("parameters accepted", [(n, ok) for n, _, ok in PARAMETERS]),
    "cli_csv": f"""SELECT '"c_mktsegment","n"' AS line UNION ALL SELECT '"' || s || '",' || n FROM {_OF_SEGMENTS}""",
    "cli_json": "SELECT * FROM (VALUES ('column', 'n_name text'), ('column', 'n_regionkey integer'), ('column', 'half real'), ('column', 'b boolean')) AS t(kind, content) UNION ALL SELECT 'row', n_name || ' ' || n_regionkey || ' ' || CAST(n_regionkey / 2.0::DOUBLE AS VARCHAR) || ' ' || CASE WHEN n_regionkey = 1 THEN 'True' ELSE 'False' END FROM nation",
    "cli_batch": f"SELECT '0' AS query, 'True' AS success, s || ' ' || n AS row FROM {_OF_SEGMENTS} UNION ALL SELECT '1', 'True', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT '2', 'False', 'Column `nothing` not found in query range.'",
    "cli_outcomes": _values("arguments code error", [(n, "0" if n == "version alone" else "1", "" if n == "version alone" else "ERROR: ") for n in _CLI] + [("version", __version__, "")]),
    "sqlite_scan": "SELECT 'row' AS kind, n_nationkey || ' ' || n_name || ' ' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey // 2 AS VARCHAR) ELSE CAST(n_nationkey / 2.0::DOUBLE AS VARCHAR) END || ' ' || CASE WHEN n_nationkey < 5 THEN 't' ELSE 'f' END AS content FROM nation UNION ALL SELECT 'read', 'k' UNION ALL SELECT 'sum', CAST(sum(n_nationkey) AS VARCHAR) FROM nation WHERE n_nationkey < 5",
    "written_results": "SELECT form, CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation, (VALUES ('parquet'), ('csv'), ('json')) AS f(form)",
    "described": _values("what value", [("c_mktsegment", "text"), ("count", "integer"), ("a", "real"), ("round", "integer"), ("columns", "4"), ("Scan parquet", True), ("PushedFilters", True), ("ReadSchema: struct<n_name:string,n_regionkey:int>", True), ("Exchange", False)]),
    "log_messages": _values("level text", [("info", "[INF] begun"), ("debug", "[DBG] Query: SELECT n_name FROM nation"), ("warning", "[WRN] done")]),
    "tree_steps": _values("what found", [("names", "a a b c x x"), ("renamed", "A A B C X X"), ("calls", "+ = = sum"), ("children", 5)]),
    "or_before_and": "SELECT c_custkey AS k, c_custkey * (7 % 4) AS m FROM customer WHERE c_nationkey < 5 AND (c_acctbal < 0 OR c_mktsegment = 'BUILDING')",
    "explicit_prefix": "SELECT c_mktsegment AS s, count(*) AS n, 0.0::DOUBLE AS cn FROM customer GROUP BY 1",
    "snapped_ranges": _values("ends range", [(f"{a:g} {b:g}", r) for (a, b), r in SNAPPED]),
    "encoded_texts": f"SELECT n_name, pow(2.0, CAST(w // {1 << 52}::HUGEINT AS DOUBLE) - 1023) * (1 + CAST(w % {1 << 52}::HUGEINT AS DOUBLE) / {float(1 << 52)!r}) AS x FROM (SELECT n_name, {of_text('n_name')} % {1 << 56}::HUGEINT + {0x40 << 56}::HUGEINT AS w FROM nation)",
    "encoded_values": "SELECT c_custkey AS k, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_acctbal < 0 AS INTEGER)::DOUBLE AS y FROM customer UNION ALL SELECT -o_orderkey, date_diff('second', TIMESTAMP '1800-01-01', o_orderdate)::DOUBLE, o_totalprice FROM orders",
}
