import sqlite3
from types import SimpleNamespace

import pytest

from hushframe import storage
from hushframe.engine import Engine
from hushframe.params import noiseless
from hushframe.plans.parser import SqlError
from hushframe.sources import sqlite, tables_in


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "data.sqlite")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE people (id INTEGER, city TEXT, score REAL, "odd, `name`" TEXT)')
        db.executemany("INSERT INTO people VALUES (?, ?, ?, ?)", [(i, "ab"[i % 2], i / 2, "x") for i in range(40)])
        db.execute("CREATE TABLE sparse (a INTEGER PRIMARY KEY, b TEXT)")
        db.executemany("INSERT INTO sparse VALUES (?, 'b')", [(1,), (2**62,), (-(2**62),)])
        db.execute("CREATE VIEW seen AS SELECT city FROM people")
    return path


def test_only_columns_of_the_query_are_read(spark, db, monkeypatch):
    read = []
    load = type(tables_in(spark, db)["people"]).load
    monkeypatch.setattr(type(tables_in(spark, db)["people"]), "load", lambda self, columns=None: read.append((self.name, columns)) or load(self, columns))
    e = Engine(spark, noiseless({"people": ("id",)}), tables_in(spark, db))
    assert sorted(map(tuple, e.sql("SELECT CITY, count(*) FROM people AS p GROUP BY p.city").collect())) == [("a", 20), ("b", 20)]
    assert e.sql("SELECT count(*) FROM seen").first()[0] == 40
    assert e.sql("SELECT t.s FROM (SELECT score AS s, city AS c FROM people) t").columns == ["s"]
    assert e.sql("SELECT * FROM people").columns == ["city", "score", "odd, `name`"]
    assert read == [("people", ["id", "city"]), ("seen", []), ("people", ["id", "city", "score"]), ("people", ["id", "city", "score", "odd, `name`"])]


def test_partitions_are_bounded(spark, db):
    parts = sqlite.Reader(db, "sparse", [("a", "bigint")]).partitions()
    assert len(parts) <= sqlite.MOST_PARTITIONS and parts[0].first == -(2**62) and parts[-1].last == 2**62
    assert all(x.last + 1 == y.first for x, y in zip(parts, parts[1:], strict=False))
    assert {r[0] for r in tables_in(spark, db)["sparse"].load().select("a").collect()} == {1, 2**62, -(2**62)}


def test_no_tables(spark):
    with pytest.raises(SqlError, match="Could not find table"):
        Engine(spark).sql("SELECT a FROM t")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"])
def test_clusters_must_name_a_shared_folder(master):
    held = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)
