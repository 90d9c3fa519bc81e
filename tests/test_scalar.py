from datetime import datetime

import pytest

from hushframe.engine import Engine
from hushframe.plans.parser import SqlError


@pytest.fixture(scope="module")
def engine(spark):
    row = spark.createDataFrame([(7, 2.5, "héllo", True, datetime(2017, 6, 7, 4, 5, 6, 789000), None)], "i long, r double, t string, b boolean, ts timestamp_ntz, n long")
    return Engine(spark, tables={"one": row})


CASES = {
    "i + 1": 8, "i - r": 4.5, "i * r": 17.5, "i / 2": 3, "-7 / 2 + i - i": -3, "r / 2": 1.25, "i % 4": 3, "(0 - i) % 4": -3, "abs(0 - r)": 2.5, "n + 1": None, "i + n": None,
    "round(r)": 3, "round(0 - r)": -3, "floor(r)": 2, "ceil(r)": 3, "floor(0 - r)": -3, "round(i)": 7, "round_by(r, 2)": 2, "round_by(r, 0.2)": 2.6, "floor_by(i, 5)": 5, "ceil_by(i, 5)": 10, "round_by(i, 0)": None, "floor_by(r, -1.0)": None,
    "width_bucket(r, 0, 5, 5)": 3, "width_bucket(0 - r, 0, 5, 5)": 0, "width_bucket(5.0, 0.0, 5.0, 5)": 6, "length(t)": 5, "upper(t)": "HÉLLO", "lower('ABC')": "abc", "t || '!'": "héllo!", "nullif(t, 'x') || cast(n AS text)": None,
    "substring(t, 2, 3)": "éll", "substring(t, 0, 2)": None, "substring(t, 9, 2)": "", "substring(t, 2, -1)": None, "substring(t, 4, 99)": "lo",
    "cast('12' AS integer)": 12, "cast('1.5' AS integer)": None, "cast('+0.0' AS integer)": None, "cast('1,000.5' AS real)": 1000.5, "cast('x' AS real)": None, "cast(' True ' AS boolean)": True, "cast('0' AS boolean)": False, "cast('t' AS boolean)": None,
    "cast(r AS integer)": 3, "cast(i AS real)": 7.0, "cast(0 AS boolean)": False, "cast(i AS boolean)": True, "cast(b AS text)": "true", "cast(i AS text)": "7", "cast(1.0 * i AS text)": "7", "cast(r AS text)": "2.5", "cast(ts AS text)": "2017-06-07T04:05:06",
    "cast('2017-06-07T04:05:06' AS timestamp)": datetime(2017, 6, 7, 4, 5, 6), "nullif(i, 7)": None, "nullif(i, 7.5)": 7.0, "nullif(n, 1)": None,
    "date_trunc('second', ts)": datetime(2017, 6, 7, 4, 5, 6), "date_trunc('hours', ts)": datetime(2017, 6, 7, 4), "date_trunc('week', ts)": datetime(2017, 6, 5), "date_trunc('quarter', ts)": datetime(2017, 4, 1), "date_trunc('decade', ts)": datetime(2010, 1, 1),
    "date_trunc('century', ts)": datetime(2001, 1, 1), "date_trunc('century', cast('2113-01-01T00:00:00' AS timestamp))": datetime(2101, 1, 1), "date_trunc('century', cast('2000-05-01T00:00:00' AS timestamp))": datetime(1901, 1, 1), "date_trunc('millennia', ts)": datetime(2001, 1, 1),
    "extract(second FROM ts)": 6.0, "extract(epoch FROM ts)": 1496808306.789, "extract(dow FROM ts)": 3.0, "extract(isodow FROM ts)": 3.0, "extract(doy FROM ts)": 158.0, "extract(week FROM ts)": 23.0, "extract(quarter FROM ts)": 2.0, "extract(isoyear FROM ts)": 2017.0,
    "extract(decade FROM ts)": 201.0, "extract(century FROM ts)": 21.0, "date_part('millennium', ts)": 3.0, "date_part('minutes', ts)": 5.0, "n IS NULL": True, "i IS NOT NULL": True, "n = 1": None, "n = 1 AND i = 0": False, "n = 1 OR i = 7": True, "NOT b": False, "i <> 7": False, "4 < i": True, "t >= 'a'": True,
}


def test_values(engine):
    row = engine.sql("SELECT " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(CASES)) + " FROM one").first()
    wrong = {e: (got, want) for (e, want), got in zip(CASES.items(), row, strict=True) if got != want or type(got) is not type(want)}
    assert not wrong


@pytest.mark.parametrize("expression", ["r % 2", "t + 1", "t = 1", "extract(never FROM ts)", "date_trunc('dow', ts)", "cast(ts AS integer)", "unknown(i)", "sum(t)"])
def test_misuse(engine, expression):
    with pytest.raises(SqlError):
        engine.sql(f"SELECT {expression} FROM one")


@pytest.mark.parametrize("expression", ["i / 0", "i % (i - 7)", "cast(t AS timestamp)"])
def test_failures_of_values(engine, expression):
    with pytest.raises(Exception, match="ZERO|CAST_INVALID|zero"):
        engine.sql(f"SELECT {expression} FROM one").collect()
