"""The shape of the plans."""

from hushframe import catalog

DATA = "/root/testdata/sf0.001"


def test_anonymizing_plan(spark):
    plan = catalog.engine(spark, DATA, "quiet").explain("SELECT o_orderpriority, count(*), sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
    assert "WindowGroupLimit" in plan and "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan


def test_direct_plan(spark):
    plan = catalog.engine(spark, DATA, "direct").explain("SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
    assert "GreaterThan(c_acctbal" in plan and "c_mktsegment" not in plan and "HashAggregate" in plan
