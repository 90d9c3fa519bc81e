"""Finds the tables at a path."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hushframe.sources import sqlite


@dataclass(frozen=True)
class SqliteTable:
    """A table of a SQLite file, of which only the columns asked for are read."""

    spark: SparkSession
    path: str
    name: str

    @property
    def columns(self) -> list[str]:
        return [n for n, _ in sqlite.columns(self.path, self.name)]

    def load(self, columns: list[str] | None = None) -> DataFrame:
        """``columns``: names as declared; rows need one at least, so the first stands for none."""
        self.spark.dataSource.register(sqlite.Sqlite)
        wanted = self.columns if columns is None else columns or self.columns[:1]
        return self.spark.read.format("sqlite").option("table", self.name).option("columns", json.dumps(wanted)).load(self.path)


def tables_in(spark: SparkSession, path: str) -> dict[str, Callable[[], DataFrame] | SqliteTable]:
    """Tables by name, each loaded when it is used: of a SQLite file, or of a folder with .parquet and .csv files or folders."""
    if os.path.isfile(path):
        return {name: SqliteTable(spark, path, name) for name in sqlite.table_names(path)}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        raise FileNotFoundError(f"Could not find a file at {path}")
    out = {}
    for status in files.listStatus(hadoop):
        name, _, ending = status.getPath().getName().rpartition(".")
        full = status.getPath().toString()
        if ending == "parquet":
            out[name] = lambda full=full: spark.read.parquet(full)
        elif ending == "csv":
            out[name] = lambda full=full: spark.read.option("header", True).option("inferSchema", True).csv(full)
    return out
