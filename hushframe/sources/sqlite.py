"""SQLite files as a Spark data source: a range of row ids is a partition, and each task reads its own."""

from __future__ import annotations

import json
import sqlite3
from contextlib import closing

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Declared column types and what they are read as; others are text.
KINDS = {"integer": "bigint", "text": "string", "boolean": "boolean", "real": "double"}
#: Row ids of a partition at least, and partitions at most: what the driver plans does not grow with the largest row id.
ROWS_PER_PARTITION, MOST_PARTITIONS = 1_000_000, 1024


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def table_names(path: str) -> list[str]:
    with closing(connect(path)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def columns(path: str, table: str) -> list[tuple[str, str]]:
    with closing(connect(path)) as db:
        return [(r[1], KINDS.get(r[2].lower(), "string")) for r in db.execute(f"PRAGMA table_info({quoted(table)})")]


class Rows(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, fields: list[tuple[str, str]]):
        self.path, self.table, self.fields = path, table, fields

    def partitions(self):
        with closing(connect(self.path)) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row ids
                return [Rows(None, None)]
        if low is None:  # no rows, or a view, whose rows have no ids
            return [Rows(None, None)]
        step = max(ROWS_PER_PARTITION, -(-(high - low + 1) // MOST_PARTITIONS))
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        where = "" if partition.first is None else f" WHERE rowid BETWEEN {partition.first} AND {partition.last}"
        convert = {"bigint": int, "double": float, "boolean": bool, "string": str}
        make = [convert[k] for _, k in self.fields]
        with closing(connect(self.path)) as db:
            for row in db.execute(f"SELECT {', '.join(quoted(n) for n, _ in self.fields) or '1'} FROM {quoted(self.table)}{where}"):
                yield tuple(None if v is None else f(v) for f, v in zip(make, row, strict=False))


class Sqlite(DataSource):
    """``spark.read.format("sqlite").option("table", ...).load(path)``; the path must be one that all executors see. ``columns``: a JSON list of those to read."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _fields(self) -> list[tuple[str, str]]:
        wanted = self.options.get("columns")
        every = columns(self.options["path"], self.options["table"])
        return every if wanted is None else [f for f in every if f[0] in json.loads(wanted)]

    def schema(self) -> str:
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in self._fields())

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], self.options["table"], self._fields())
