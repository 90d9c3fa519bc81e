"""Scalar functions as native columns.

``build`` takes a function's name and its arguments as (column, type) and gives the result's column and type. Types: boolean,
integer (bigint), real (double), text, timestamp (without zone).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.text import real_column

SPARK_TYPE = {"boolean": "boolean", "integer": "bigint", "real": "double", "text": "string", "timestamp": "timestamp_ntz"}
_INTEGER = r"^\s*[+-]?\d+\s*$"

#: Accepted spellings of date parts (fixed values).
PARTS = {
    "second": "second", "seconds": "second", "minute": "minute", "minutes": "minute", "hour": "hour", "hours": "hour", "day": "day", "days": "day", "week": "week", "weeks": "week",
    "month": "month", "months": "month", "quarter": "quarter", "year": "year", "years": "year", "decade": "decade", "decades": "decade", "century": "century", "centuries": "century",
    "millennium": "millennium", "millenniums": "millennium", "millennia": "millennium", "epoch": "epoch", "dow": "dow", "doy": "doy", "isodow": "isodow", "isoyear": "isoyear",
}

#: What the names of aggregates over entities that the query itself gives begin with.
EXPLICIT = "anon_"
AGGREGATES = {"count", "count_noise", "sum", "sum_noise", "avg", "avg_noise", "count_histogram"} | {EXPLICIT + n for n in ("low_count", "count", "count_noise", "sum", "sum_noise", "avg", "avg_noise", "count_histogram")}
FUNCTIONS = {"+", "-", "*", "/", "%", "=", "<", "<=", ">", ">=", "and", "or", "not", "is_null", "||", "abs", "round", "floor", "ceil", "ceiling", "round_by", "floor_by", "ceil_by", "width_bucket", "length", "lower", "upper", "substring", "cast", "nullif", "date_trunc", "extract"}


class TypeMismatch(ValueError):
    pass


def result_type(fn: str, types: list[str], target: str | None = None) -> str:
    if fn in ("+", "-", "*", "/", "abs"):
        return "real" if "real" in types else "integer"
    if fn in ("%", "round", "floor", "ceil", "ceiling", "length", "width_bucket"):
        return "integer"
    if fn in ("round_by", "floor_by", "ceil_by"):
        return types[1]
    if fn in ("=", "<", "<=", ">", ">=", "and", "or", "not", "is_null"):
        return "boolean"
    if fn in ("||", "lower", "upper", "substring"):
        return "text"
    if fn == "cast":
        return target or "text"
    if fn == "nullif":
        return "real" if {"integer", "real"} == set(types) else types[0]
    return {"date_trunc": "timestamp", "extract": "real"}[fn]


def promoted(a: tuple[Column, str], b: tuple[Column, str]) -> tuple[Column, Column]:
    """Both sides as reals where one is."""
    (x, s), (y, t) = a, b
    if {s, t} == {"integer", "real"}:
        return x.cast("double"), y.cast("double")
    if s != t and "null" not in (s, t):
        raise TypeMismatch(f"Values of types {s} and {t} can't be compared or combined.")
    return x, y


def _away(x: Column) -> Column:
    return F.round(x).cast("long")


def _stepped(x: Column, n: Column, kind: str, step) -> Column:
    ratio = x.cast("double") / n.cast("double")
    # Steps give integers, which have no sign at zero and end at 2^63; reals from 2^52 on are whole.
    whole = F.when(F.abs(ratio) < 2.0**52, step(ratio).cast("double")).otherwise(ratio)
    out = F.when(whole == 0, ratio * 0.0).otherwise(whole) * n.cast("double")
    return F.when(n > 0, F.floor(out).cast("long") if kind == "integer" else out)


def cast(x: Column, source: str, target: str) -> Column:
    if source == target:
        return x
    if (source, target) == ("text", "integer"):
        return F.when(x.rlike(_INTEGER), F.trim(x).try_cast("bigint"))
    if (source, target) == ("text", "real"):
        return F.regexp_replace(x, ",", "").try_cast("double")
    if (source, target) == ("text", "boolean"):
        low = F.lower(F.trim(x))
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    if (source, target) == ("real", "integer"):
        return _away(x)
    if target == "text" and source == "timestamp":
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    if target == "text" and source == "real":
        return real_column(x)
    if (source, target) in (("text", "timestamp"), ("integer", "real"), ("integer", "boolean"), ("integer", "text"), ("boolean", "text"), ("boolean", "integer"), ("boolean", "real"), ("null", target)):
        return x.cast(SPARK_TYPE[target])
    raise TypeMismatch(f"A value of type {source} can't be cast to {target}.")


def date_trunc(part: str, x: Column) -> Column:
    year = F.year(x)
    first = {"decade": year - year % 10, "century": year - (year - 1) % 100, "millennium": year - (year - 1) % 1000}.get(part)
    if first is not None:
        return F.make_timestamp_ntz(first, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0))
    return F.date_trunc(part, x).cast("timestamp_ntz")


def extract(part: str, x: Column) -> Column:
    year = F.year(x)
    utc = F.make_timestamp(F.year(x), F.month(x), F.dayofmonth(x), F.hour(x), F.minute(x), F.second(x).cast("double"), F.lit("UTC"))
    value = {
        "second": lambda: F.second(x), "epoch": lambda: F.unix_seconds(utc) + F.floor(F.extract(F.lit("SECOND"), x) % 1 * 1000) / 1000, "minute": lambda: F.minute(x), "hour": lambda: F.hour(x), "day": lambda: F.dayofmonth(x),
        "dow": lambda: F.dayofweek(x) - 1, "doy": lambda: F.dayofyear(x), "isodow": lambda: F.extract(F.lit("DAYOFWEEK_ISO"), x), "week": lambda: F.weekofyear(x), "month": lambda: F.month(x),
        "quarter": lambda: F.quarter(x), "year": lambda: year, "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), x), "decade": lambda: F.floor(year / 10), "century": lambda: F.floor((year - 1) / 100) + 1, "millennium": lambda: F.floor((year - 1) / 1000) + 1,
    }[part]()
    return value.cast("double")


def build(fn: str, args: list[tuple[Column, str]], constants: list) -> tuple[Column, str]:
    """``constants``: the arguments' values where they are constants, else None."""
    types = [t for _, t in args]
    x, s = args[0]
    kind = result_type(fn, types, constants[-1] if fn == "cast" else None)
    if fn in ("+", "-", "*"):
        a, b = promoted(*args)
        return {"+": a + b, "-": a - b, "*": a * b}[fn], kind
    if fn == "/":
        a, b = promoted(*args)
        return (a / b if kind == "real" else F.call_function("div", a, b)), kind
    if fn == "%":
        if set(types) - {"integer"}:
            raise TypeMismatch("% takes integers.")
        return x % args[1][0], kind
    if fn in ("=", "<", "<=", ">", ">="):
        a, b = promoted(*args)
        return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[fn], kind
    if fn in ("and", "or"):
        return (x & args[1][0] if fn == "and" else x | args[1][0]), kind
    if fn == "not":
        return ~x, kind
    if fn == "is_null":
        return x.isNull(), kind
    if fn == "||":
        return F.concat(x, args[1][0]), kind
    if fn == "abs":
        return F.abs(x), kind
    if fn in ("round", "floor", "ceil", "ceiling"):
        return (x if s == "integer" else _away(x) if fn == "round" else (F.floor(x) if fn == "floor" else F.ceil(x)).cast("long")), kind
    if fn in ("round_by", "floor_by", "ceil_by"):
        return _stepped(x, args[1][0], kind, {"round_by": F.round, "floor_by": F.floor, "ceil_by": F.ceil}[fn]), kind
    if fn == "width_bucket":
        return F.width_bucket(*(c.cast("double") for c, _ in args[:3]), args[3][0].cast("int")).cast("long"), kind
    if fn == "length":
        return F.length(x).cast("long"), kind
    if fn in ("lower", "upper"):
        return getattr(F, fn)(x), kind
    if fn == "substring":
        start, n = args[1][0], args[2][0]
        return F.when((start > 0) & (n >= 0), F.substring(x, start.cast("int"), n.cast("int"))), kind
    if fn == "cast":
        return cast(x, s, kind), kind
    if fn == "nullif":
        a, b = promoted(*args)
        return F.nullif(a, b), kind
    part = PARTS.get(str(constants[0]).lower())
    if part is None or fn == "date_trunc" and part in ("epoch", "dow", "doy", "isodow", "isoyear"):
        raise TypeMismatch(f"Unknown date part {constants[0]!r}.")
    return (date_trunc if fn == "date_trunc" else extract)(part, args[1][0]), kind
