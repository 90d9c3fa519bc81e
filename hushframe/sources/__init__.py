"""Where tables come from: folders of Parquet or CSV, SQLite files, or any DataFrame."""

from hushframe.sources.providers import tables_in

__all__ = ["tables_in"]
