"""Runs queries of the dialect over registered DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe import log
from hushframe.functions import scalar
from hushframe.operators import hooks as hook_functions
from hushframe.operators.adaptive import repeated, synthesize
from hushframe.operators.anonymize import Agg, Aid, Context, anonymize, join_keys
from hushframe.params import AccessLevel, Params
from hushframe.plans import analyzer as an
from hushframe.plans import parser as ast
from hushframe.plans.parser import SqlError
from hushframe.plans.tree import rewrite, walk

class Source(Protocol):
    """A table that is loaded with just the columns a query names."""

    columns: list[str]

    def load(self, columns: list[str]) -> DataFrame: ...


Table = DataFrame | Callable[[], DataFrame] | Source


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "list" if isinstance(t, T.ArrayType) else "null"


@dataclass
class Scope:
    df: DataFrame
    columns: list[an.RangeColumn]
    on: list


class Engine:
    """``tables``: DataFrames, functions that make them, or sources, by name; without any, no table is found. ``hooks``: steps between grouping and
    finalizing. ``explicit``: what the names of aggregates over entities given in the query begin with (``anon_count(*, id)``). ``or_first``: OR binds tighter than AND."""

    def __init__(self, spark: SparkSession, params: Params | None = None, tables: dict[str, Table] | None = None, hooks=(), explicit: str = scalar.EXPLICIT, or_first: bool = False):
        self.spark, self.params, self.hooks, self.explicit, self.or_first = spark, params or Params(), tuple(hooks), explicit, or_first
        self.tables = dict(tables or {})

    def register(self, name: str, table: Table) -> None:
        self.tables[name] = table

    def sql(self, text: str) -> DataFrame:
        df, names, _ = self._planned(text)
        return df.toDF(*names)

    def columns(self, text: str) -> list[tuple[str, str]]:
        """Names and types of what a query returns."""
        _, names, kinds = self._planned(text)
        return list(zip(names, kinds, strict=True))

    def _planned(self, text: str) -> tuple[DataFrame, list[str], list[str]]:
        log.debug(f"Query: {text}")
        query = ast.parse(text, self.or_first)
        if self.explicit != scalar.EXPLICIT:
            query = rewrite(query, lambda n: replace(n, fn=scalar.EXPLICIT + n.fn.removeprefix(self.explicit)) if isinstance(n, ast.Call) and n.fn.startswith(self.explicit) else n)
        return self._query(query)

    def explain(self, text: str, mode: str = "formatted") -> str:
        df = self.sql(text)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    # Sources

    def _table(self, name: str, used: set[str] | None) -> DataFrame:
        """``used``: names of columns in lower case, or None for all."""
        for known, table in self.tables.items():
            if known.lower() == name.lower():
                if hasattr(table, "load"):
                    wanted = None if used is None else used | {a.lower() for a in self.params.aids_of(name)}
                    return table.load([c for c in table.columns if wanted is None or c.lower() in wanted])
                return table() if callable(table) else table
        raise SqlError(f"Could not find table `{name}`.")

    @staticmethod
    def _used(q: ast.Select) -> set[str] | None:
        """Names of the columns that a query refers to, without those inside its subqueries; None for all."""
        nodes = walk(q, lambda n: not isinstance(n, ast.SubQuery))
        if any(isinstance(i.expr, ast.Star) for i in q.items):
            return None
        return {n.column.lower() for n in nodes if isinstance(n, ast.Name)}

    def _scope(self, source, at: list[int], used: set[str] | None) -> Scope:
        if isinstance(source, ast.Join):
            left, right = self._scope(source.left, at, used), self._scope(source.right, at, used)
            columns = left.columns + right.columns
            if {c.range.lower() for c in left.columns} & {c.range.lower() for c in right.columns}:
                raise SqlError("Ambiguous target names in `FROM` clause.")
            if source.kind == "cross":
                return Scope(left.df.crossJoin(right.df), columns, left.on + right.on)
            on = an.resolve(columns, source.on)
            return Scope(left.df.join(right.df, self._column(on), source.kind), columns, [*left.on, *right.on, on])
        if isinstance(source, ast.SubQuery):
            df, names, kinds = self._query(source.query)
            alias, aids = source.alias, ()
        else:
            df = self._table(source.name, used)
            names, kinds = df.columns, [kind_of(f.dataType) for f in df.schema.fields]
            alias, aids = source.alias, [a.lower() for a in self.params.aids_of(source.name)]
        columns, selected = [], []
        plain = df.toDF(*(f"p{i}" for i in range(len(names))))
        for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            inner = f"c{at[0]}"
            at[0] += 1
            c = F.col(f"p{i}")
            selected.append((c.cast(scalar.SPARK_TYPE[kind]) if kind in scalar.SPARK_TYPE else c).alias(inner))
            columns.append(an.RangeColumn(alias, name, kind, name.lower() in aids, inner))
        return Scope(plain.select(*selected), columns, [])

    # Expressions

    def _column(self, e, known: dict | None = None) -> Column:
        """``known``: columns that hold whole expressions (group keys and aggregates)."""
        if known and e in known:
            return known[e]
        if isinstance(e, an.Ref):
            if known is not None:
                raise SqlError(f"Column `{e.source.name}` must appear in the `GROUP BY` clause or be used in an aggregate function.")
            return F.col(e.source.column)
        if isinstance(e, an.Const):
            return F.lit(e.value).cast(scalar.SPARK_TYPE[e.kind]) if e.kind in scalar.SPARK_TYPE else F.lit(e.value)
        if e.aggregates:
            raise SqlError(f"Aggregate `{e.fn}` is not allowed here.")
        try:
            return scalar.build(e.fn, [(self._column(a, known), a.kind) for a in e.args], [a.value if isinstance(a, an.Const) else None for a in e.args])[0]
        except scalar.TypeMismatch as error:
            raise SqlError(str(error)) from error

    # Queries

    def _query(self, q: ast.Select) -> tuple[DataFrame, list[str], list[str]]:
        """The plan under columns o0, o1, ..., their names and types."""
        scope = self._scope(q.source, [0], self._used(q))
        items: list[tuple[str, object]] = []
        for item in q.items:
            if isinstance(item.expr, ast.Star):
                items += [(c.name, an.Ref(c)) for c in scope.columns if not c.is_aid]
            else:
                items.append((item.alias if item.alias is not None else an.default_alias(item.expr), an.resolve(scope.columns, item.expr)))
        exprs = [e for _, e in items]
        where = an.resolve(scope.columns, q.where) if q.where is not None else None
        having = an.resolve(scope.columns, q.having) if q.having is not None else None

        def by_place(e, clause: str):
            e = an.resolve(scope.columns, e)
            if isinstance(e, an.Const) and e.kind == "integer":
                if not 1 <= e.value <= len(exprs):
                    raise SqlError(f"Invalid `{clause}` index: {e.value}")
                return exprs[e.value - 1]
            return e

        groups = list(dict.fromkeys(by_place(e, "GROUP BY") for e in q.group_by))
        if an.aggregates(*groups):
            raise SqlError("Aggregates are not allowed in `GROUP BY`.")
        order = [(by_place(o.expr, "ORDER BY"), o) for o in q.order_by]
        if where is not None and an.aggregates(where):
            raise SqlError("Aggregates are not allowed in `WHERE`.")
        every = [*exprs, *([having] if having is not None else []), *(e for e, _ in order)]
        aids = [c for c in scope.columns if c.is_aid]
        anonymizing = bool(aids) and self.params.access_level is not AccessLevel.DIRECT
        expand = False
        if anonymizing:
            an.validate_anonymizing(self.params.access_level, every, where, q.source, q.distinct, scope.on)
            if not groups and not an.aggregates(*exprs):
                if self.params.use_adaptive_buckets:
                    return self._synthesize(q, scope, items, where, order, aids)
                groups, expand = list(dict.fromkeys(exprs)), True
            groups = [g for g in groups if not isinstance(g, an.Const)]
        else:
            an.validate_direct(every)
        df = scope.df if where is None else scope.df.filter(self._column(where))
        found = an.aggregates(*every)
        known = None
        if groups or found or expand:
            df, known = self._aggregate(df, groups, found, where, aids if anonymizing else [], anonymizing, expand)
        if having is not None:
            df = df.filter(self._column(having, known))
        out = [self._column(e, known).alias(f"o{i}") for i, e in enumerate(exprs)]
        keys = [self._column(e, known).alias(f"s{i}") for i, (e, _) in enumerate(order)]
        count = [F.col("__expand")] if expand else []
        df = df.select(*out, *keys, *count)
        names = [n for n, _ in items]
        kinds = [e.kind for e in exprs]
        if expand:
            df = repeated(df, "__expand", "__n").drop("__n", "__expand")
        return self._finish(df, q, order, len(exprs)), names, kinds

    def _finish(self, df: DataFrame, q: ast.Select, order, width: int) -> DataFrame:
        outputs = [f"o{i}" for i in range(width)]
        if q.distinct:
            df = df.dropDuplicates(outputs)
        if order:
            by = []
            for i, (e, o) in enumerate(order):
                # Texts stand by their letters and digits first, then as they are.
                cols = [F.collate(F.regexp_replace(F.col(f"s{i}"), r"[^\p{L}\p{N}]", ""), "UNICODE"), F.col(f"s{i}")] if e.kind == "text" else [F.col(f"s{i}")]
                for c in cols:
                    by.append((c.desc_nulls_first() if o.nulls_first else c.desc_nulls_last()) if o.descending else (c.asc_nulls_first() if o.nulls_first else c.asc_nulls_last()))
            df = df.orderBy(*by)
        if q.limit is not None:
            if q.limit > 2**31 - 1:
                raise SqlError("`LIMIT` amount is greater than supported range.")
            df = df.limit(q.limit)
        return df.select(*outputs)

    def _context(self, groups: list, where) -> Context:
        pairs = an.filters(where)
        buckets = [an.bucket_expression(e) for e in [*groups, *(e for e, _ in pairs)]]
        for e in buckets:
            an.validate_generalization(e, self.params.access_level)
        return Context(self.params, an.query_seed(buckets), tuple(an.const_text(c) for _, c in pairs))

    def _aggregate(self, df: DataFrame, groups: list, found: list[an.Call], where, aids: list, anonymizing: bool, expand: bool):
        """One row for each group, and the columns that hold the groups and the aggregates."""
        keys = {f"k{i}": self._column(g) for i, g in enumerate(groups)}
        known = {g: F.col(f"k{i}") for i, g in enumerate(groups)}
        names = list(keys)
        noisy = [a for a in found if a.fn.startswith(scalar.EXPLICIT)]
        plain = [a for a in found if a not in noisy]
        if anonymizing:
            return self._anonymized(df, keys, groups, found, where, [an.Ref(c) for c in aids], known, expand, hide=True)
        out = None
        for place, entities in enumerate(dict.fromkeys(self._entities(a) for a in noisy)):
            own = [a for a in noisy if self._entities(a) == entities]
            part, known = self._anonymized(df, keys, groups, own, where, list(entities), known, False, hide=False, place=place)
            out = part if out is None else join_keys(out, part, names)
        if plain or out is None:
            part, known = self._plain(df, keys, plain, known)
            out = part if out is None else join_keys(out, part, names)
        return out, known

    @staticmethod
    def _entities(a: an.Call) -> tuple:
        skip = {"low_count": 0, "count_histogram": 2}.get(a.fn.removeprefix(scalar.EXPLICIT), 1)
        return tuple(a.args[skip:])

    def _plain(self, df: DataFrame, keys: dict[str, Column], found: list[an.Call], known: dict):
        rows = df.withColumns(keys) if keys else df
        names = list(keys)
        columns, later = [], []
        for i, a in enumerate(found):
            name = f"g{i}"
            if a.fn == "count":
                columns.append((F.count_distinct(self._column(a.args[0])) if a.distinct else F.count(self._column(a.args[0])) if a.args else F.count(F.lit(1))).alias(name))
            elif a.fn == "sum":
                columns.append((F.sum_distinct if a.distinct else F.sum)(self._column(a.args[0])).alias(name))
            elif a.fn == "count_histogram":
                size = a.args[1].value if len(a.args) > 1 else 1
                per = rows.select(*names, self._column(a.args[0]).alias("v")).filter("v is not null").groupBy(*names, "v").agg((F.floor(F.count(F.lit(1)) / size) * size).cast("long").alias("bin"))
                bins = per.groupBy(*names, "bin").agg(F.count(F.lit(1)).alias("n"))
                listed = F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: F.array(x["bin"], x["n"])).alias(name)
                later.append(bins.groupBy(*names).agg(listed) if names else bins.agg(listed))
            else:
                raise SqlError(f"Aggregate `{a.fn}` needs an anonymizing query.")
            known = known | {a: F.col(name)}
        if names:
            out = rows.groupBy(*names).agg(*columns) if columns else rows.select(*names).distinct()
        else:
            out = rows.agg(*(columns or [F.count(F.lit(1)).alias("__rows")]))
        for part in later:
            out = join_keys(out, part, names, "left")
        return out, known

    def _anonymized(self, df: DataFrame, keys: dict[str, Column], groups: list, found: list[an.Call], where, entities: list, known: dict, expand: bool, hide: bool, place: int = 0):
        """``place``: of these entities among those of the query; it names the columns."""
        aids = [Aid(self._column(e), e.kind == "integer") for e in entities]
        aggs: dict[str, Agg] = {}
        tag = f"d{place}_"
        low = f"{tag}low"
        for a in found:
            fn = a.fn.removeprefix(scalar.EXPLICIT)
            base, noise = fn.removesuffix("_noise"), fn.endswith("_noise")
            if fn == "low_count":
                known = known | {a: F.col(low)}
                continue
            if base == "count_histogram":
                if hide:
                    aid, size = entities.index(a.args[0]), a.args[1].value if len(a.args) > 1 else 1
                else:
                    aid, size = a.args[0].value, a.args[1].value
                agg = Agg("histogram", aid=aid, bin=size)
            else:
                arg = a.args[0] if a.args else None
                column = self._column(arg) if arg is not None else None
                agg = Agg("count_distinct", column) if base == "count" and a.distinct else Agg("count", column) if base == "count" else Agg("sum", column, arg.kind == "integer")
            same = next((n for n, x in aggs.items() if (x.kind, str(x.arg), x.aid, x.bin) == (agg.kind, str(agg.arg), agg.aid, agg.bin)), None)
            name = same or f"{tag}{len(aggs)}"
            aggs[name] = agg
            known = known | {a: F.col(f"{name}__noise" if noise else name)}
        if expand:
            aggs["__expand"] = Agg("count")
        out = anonymize(df, keys, aids, aggs, self._context(groups, where), hooks=self.hooks)
        if hide and keys:
            out = out.filter("not low")
        return out.withColumnRenamed("low", low), known

    def _synthesize(self, q: ast.Select, scope: Scope, items, where, order, aids):
        df = scope.df if where is None else scope.df.filter(self._column(where))
        exprs = [e for _, e in items]
        context = self._context([], where)
        rows = synthesize(df, {f"o{i}": (self._column(e), e.kind) for i, e in enumerate(exprs)}, [Aid(F.col(a.column), a.kind == "integer") for a in aids], context)
        known = {e: F.col(f"o{i}") for i, e in enumerate(exprs)}
        keys = [self._column(e, known).alias(f"s{i}") for i, (e, _) in enumerate(order)]
        return self._finish(rows.select(*(f"o{i}" for i in range(len(exprs))), *keys), q, order, len(exprs)), [n for n, _ in items], [e.kind for e in exprs]


def default_hooks():
    return hook_functions.DEFAULT
