import pytest

from hushframe.engine import Engine
from hushframe.operators import hooks
from hushframe.params import AccessLevel, Interval, Params, Suppression, noiseless
from hushframe.plans import analyzer
from hushframe.plans.parser import SqlError
from tests import fixtures


@pytest.fixture(scope="module")
def tables(spark):
    out = {"customers_small": fixtures.customers_small(spark).cache(), "regular": fixtures.regular(spark).cache(), "products": fixtures.products(spark).cache()}
    return out


def engine(spark, tables, **changes):
    return Engine(spark, noiseless({"customers_small": ("id",), "regular": ("id",)}, **changes), tables)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_direct_aggregates(spark, tables):
    e = engine(spark, tables, access_level=AccessLevel.DIRECT)
    assert rows(e.sql("SELECT city, count(distinct id), sum(age) FROM regular GROUP BY city")) == [("Berlin", 10, 295), ("Rome", 10, 300)]
    assert rows(e.sql("SELECT name FROM products WHERE price IS NULL ORDER BY id")) == [("Coke",), (None,)]
    assert e.sql("SELECT name, price AS p, cast(price AS integer), price + 1 FROM products").columns == ["name", "p", "price", "+"]
    assert rows(e.sql("SELECT count(*) + count(price) FROM products")) == [(20,)]


def test_anonymizing_queries(spark, tables):
    e = engine(spark, tables)
    assert rows(e.sql("SELECT city, count(*) FROM customers_small GROUP BY city")) == [("Berlin", 10), ("Lima", 10), ("Rome", 10)]
    assert rows(e.sql("SELECT city FROM regular")) == [("Berlin",)] * 10 + [("Rome",)] * 10
    assert rows(e.sql("SELECT round_by(age, 5), count(*) FROM regular GROUP BY 1")) == [(25, 7), (30, 7), (35, 6)]
    assert rows(e.sql("SELECT city, avg(age) FROM regular GROUP BY 1")) == [("Berlin", 29.5), ("Rome", 30.0)]
    assert rows(e.sql("SELECT t.n + 1 FROM (SELECT count(*) AS n FROM regular) t")) == [(21,)]
    assert e.sql("SELECT * FROM customers_small").columns == ["first_name", "age", "city"]


@pytest.mark.parametrize(
    ("sql", "message"),
    [
        ("SELECT count(distinct age) FROM regular WHERE id = 1", analyzer.AID_FILTER),
        ("SELECT count(age + id) FROM regular", analyzer.ONLY_COUNT_COLUMN),
        ("SELECT sum(age + 1) FROM regular", analyzer.ONLY_SUM_COLUMN),
        ("SELECT sum(distinct age) FROM regular", analyzer.ONLY_SUM_COLUMN),
        ("SELECT anon_count(*, id) FROM regular", analyzer.AGGREGATE_NOT_SUPPORTED),
        ("SELECT count(*) FROM regular, products", analyzer.CROSS_JOIN),
        ("SELECT count(*) FROM regular JOIN products ON age > price", analyzer.JOIN_EQUALITIES),
        ("SELECT count(*) FROM regular JOIN products ON regular.id = products.id OR age = price", analyzer.JOIN_OR),
        ("SELECT count(*) FROM regular JOIN (SELECT id AS x FROM products) p ON id = x", analyzer.SUBQUERIES),
        ("SELECT count(*) FROM regular WHERE age > 3", analyzer.FILTER_EQUALITIES),
        ("SELECT city || 'x', count(*) FROM regular GROUP BY 1", analyzer.UNSUPPORTED_FUNCTION),
        ("SELECT round_by(age + 1, 5), count(*) FROM regular GROUP BY 1", analyzer.PRIMARY_ARGUMENT),
        ("SELECT floor_by(age, age), count(*) FROM regular GROUP BY 1", analyzer.SECONDARY_ARGUMENTS),
        ("SELECT count_histogram(age) FROM regular", analyzer.HISTOGRAM_AID),
        ("SELECT count_histogram(id, 0) FROM regular", analyzer.HISTOGRAM_CONSTANT),
        ("SELECT age, count(*) FROM regular GROUP BY 5", "Invalid `GROUP BY` index: 5"),
        ("SELECT nothing FROM regular", "not found"),
        ("SELECT age FROM missing", "Could not find table"),
        ("SELECT id FROM regular AS a JOIN products AS b ON a.id = b.id", "ambiguous"),
        ("SELECT age, count(*) FROM products GROUP BY name", "not found"),
        ("SELECT name || 1 FROM products GROUP BY price", "GROUP BY"),
    ],
)
def test_refusals(spark, tables, sql, message):
    with pytest.raises(SqlError) as error:
        engine(spark, tables).sql(sql)
    assert message in str(error.value)


def test_untrusted_level_needs_round_steps(spark, tables):
    e = engine(spark, tables, access_level=AccessLevel.PUBLISH_UNTRUSTED)
    assert e.sql("SELECT round_by(age, 5), count(*) FROM regular GROUP BY 1").count() == 3
    for sql in ("SELECT round_by(age, 3), count(*) FROM regular GROUP BY 1", "SELECT substring(city, 2, 2), count(*) FROM regular GROUP BY 1", "SELECT width_bucket(age, 0, 50, 5), count(*) FROM regular GROUP BY 1"):
        with pytest.raises(SqlError, match="untrusted"):
            e.sql(sql)


def seed(text, **kwargs):
    from hushframe.plans.parser import parse

    q = parse(text)
    columns = [analyzer.RangeColumn("customers", n, k, False, n) for n, k in (("age", "integer"), ("city", "text"), ("amount", "real"), ("last_seen", "timestamp"))]
    return analyzer.seed_material(analyzer.bucket_expression(analyzer.resolve(columns, q.group_by[0])))


@pytest.mark.parametrize(
    ("expression", "material"),
    [("city", "customers.city"), ("substring(city, 1, 2)", "substring,customers.city,1,2"), ("round(amount)", "round,customers.amount,1"), ("cast(amount AS integer)", "round,customers.amount,1"), ("extract(dow FROM last_seen)", "extract,dow,customers.last_seen"), ("round(age)", "customers.age"), ("floor_by(amount, 2.5)", "floor,customers.amount,2.5")],
)
def test_seed_material(expression, material):
    assert seed(f"SELECT 1 FROM t GROUP BY {expression}") == material


def noisy(spark, tables, **changes):
    return Engine(spark, Params(aid_columns={"customers_small": ("id",), "regular": ("id",)}, salt=b"pepper", **changes), tables)


def test_noise_is_sticky(spark, tables):
    e = noisy(spark, tables)
    by_group = rows(e.sql("SELECT city, count(*) FROM regular GROUP BY city"))
    assert by_group == rows(e.sql("SELECT city, count(*) FROM regular GROUP BY 1, city"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert rows(e.sql("SELECT city, count(*) FROM regular GROUP BY city")) == by_group
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    no_recovery = noisy(spark, tables, recover_outliers=False)
    berlin = dict(rows(no_recovery.sql("SELECT city, count(*) FROM regular GROUP BY city")))["Berlin"]
    # A filter and a group with the same label have the same seed.
    assert rows(no_recovery.sql("SELECT count(*) FROM regular WHERE city = 'Berlin'")) == [(berlin,)]


def test_noise_is_reported(spark, tables):
    (cn, n), = rows(noisy(spark, tables).sql("SELECT count_noise(*), count(*) FROM regular"))
    assert cn > 0 and n != 0


@pytest.mark.parametrize("change", [{"suppression": Suppression(1)}, {"suppression": Suppression(2, 0.5)}, {"suppression": Suppression(2, 1, 1)}, {"outlier_count": Interval(0, 2)}, {"outlier_count": Interval(2, 2)}, {"top_count": Interval(1, 3)}, {"top_count": Interval(5, 2)}, {"layer_noise_sd": 0.5}])
def test_params_are_checked(change):
    with pytest.raises(ValueError):
        Params(**change)


def test_led_and_star_bucket(spark):
    people = [("Math", "M", "Prof")] * 4 + [("Math", "F", "Prof")] * 5 + [("Bio", "M", "Prof")] + [("Bio", "F", "Prof")] * 4 + [("Art", "M", "Aide"), ("Law", "F", "Dean"), ("Law", "F", "Dean")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(people)], "i long, dept string, gender string, title string")
    params = noiseless({"t": ("i",)}, suppression=Suppression(3, 0.0, 0.0), recover_outliers=False)
    sql = "SELECT dept, gender, title, count(*) FROM t GROUP BY 1, 2, 3"
    plain = rows(Engine(spark, params, {"t": df}).sql(sql))
    assert plain == [("Bio", "F", "Prof", 4), ("Math", "F", "Prof", 5), ("Math", "M", "Prof", 4)]
    # (Bio, M, Prof) has no sibling in title, and one shown sibling each in dept and gender.
    led = rows(Engine(spark, params, {"t": df}, (hooks.led,)).sql(sql))
    assert led == [("Bio", "F", "Prof", 5), ("Math", "F", "Prof", 5), ("Math", "M", "Prof", 5)]
    both = rows(Engine(spark, params, {"t": df}, hooks.DEFAULT).sql(sql))
    assert ("*", "*", "*", 3) in both and len(both) == 4


def test_star_bucket_needs_two(spark):
    params = noiseless({"t": ("i",)}, suppression=Suppression(3, 0.0, 0.0), recover_outliers=False)
    sql = "SELECT letter, count(*) FROM t GROUP BY 1"
    table = lambda letters: spark.createDataFrame(list(enumerate(letters)), "i long, letter string")
    star = lambda letters: [r for r in rows(Engine(spark, params, {"t": table(letters)}, (hooks.star_bucket,)).sql(sql)) if r[0] == "*"]
    assert star("AAABBBCCD") == [("*", 3)]
    assert star("AAABBBCC") == []


def test_distinct_values_are_dealt_to_entities(spark):
    fruit = [(f"p{i}", f) for i in range(5) for f in ("apple", "pear", "plum", "fig")] + [("p9", "kiwi"), ("p8", "kaki"), ("p7", "date")]
    df = spark.createDataFrame(fruit, "who string, fruit string")
    e = Engine(spark, noiseless({}, suppression=Suppression(2, 0.0, 0.0)), {"t": df})
    assert rows(e.sql("SELECT anon_count(DISTINCT fruit, who) FROM t")) == [(7,)]


def test_histogram(spark):
    df = spark.createDataFrame([(a, str(i)) for a, n in enumerate((1, 1, 1, 1, 2, 2, 2, 6, 7, 13)) for i in range(n)], "a long, s string")
    e = Engine(spark, noiseless({"t": ("a",)}), {"t": df})
    assert rows(e.sql("SELECT count_histogram(a) FROM t")) == [([[None, 3], [1, 4], [2, 3]],)]
    assert rows(e.sql("SELECT count_histogram(a, 5) FROM t")) == [([[0, 7], [5, 2]],)]


def test_synthetic_rows_keep_common_values(spark, tables):
    e = engine(spark, tables, use_adaptive_buckets=True, suppression=Suppression(3, 0.0, 0.0))
    made = rows(e.sql("SELECT city, age FROM regular"))
    assert 18 <= len(made) <= 22
    assert {c for c, _ in made} <= {"Berlin", "Rome", "*"} and all(25 <= a <= 35 or a is None for _, a in made)
