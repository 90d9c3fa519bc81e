"""Results as CSV or JSON text, or written by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame

from hushframe.engine import kind_of
from hushframe.functions.text import real_text


def quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def value_text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "t" if v else "f"
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%S")
    if isinstance(v, float):
        return real_text(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(value_text, v)) + "]"
    return str(v)


def csv_lines(df: DataFrame) -> Iterator[str]:
    """A line for the names and one for each row; a partition at a time is in memory."""
    cell = lambda v: quoted(value_text(v)) if isinstance(v, (str, list, tuple)) else value_text(v)
    yield ",".join(map(quoted, df.columns))
    for row in df.toLocalIterator():
        yield ",".join(map(cell, row))


def type_name(t) -> str:
    kind = kind_of(t)
    return f"list({type_name(t.elementType)})" if kind == "list" else "unknown" if kind == "null" else kind


def _plain(v):
    return v.isoformat() if isinstance(v, datetime) else [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _named(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": type_name(f.dataType)} for f in df.schema.fields]


def result(df: DataFrame) -> dict:
    """The whole result in memory, for what is told of several queries at once."""
    return {"columns": _named(df), "rows": [[_plain(v) for v in row] for row in df.toLocalIterator()]}


def json_parts(df: DataFrame) -> Iterator[str]:
    """The text of ``result`` as JSON, row by row."""
    yield f'{{"columns": {to_json(_named(df))}, "rows": ['
    for i, row in enumerate(df.toLocalIterator()):
        yield f"{', ' if i else ''}{to_json([_plain(v) for v in row])}"
    yield "]}"


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes all partitions in parallel; ``form`` is parquet, csv or json."""
    writer = df.write.mode("error")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
