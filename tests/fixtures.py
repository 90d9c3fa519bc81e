"""Small tables with known answers."""

from itertools import cycle, islice

FIRST = ["Alice", "Bob"]
AGES = [25, 30, 35]
CITIES = ["Berlin", "Rome"]
#: Rows without entity, without anything, and of two entities with many rows.
ODD = [(None, "Nobody", 100, "Oslo"), (None, None, None, None)] + [(1001, "Heavy", 40, "Lima")] * 5 + [(1002, "Heavy", 41, "Lima")] * 7


def customers_small(spark):
    take = lambda values: list(islice(cycle(values), 20))
    rows = list(zip(range(1, 21), take(FIRST), take(AGES), take(CITIES), strict=True))
    return spark.createDataFrame(rows + ODD, "id long, first_name string, age int, city string")


def regular(spark):
    return customers_small(spark).filter("id <= 20")


def products(spark):
    names = ["Water", "Pasta", "Chicken", "Wine", "Cheese", "Milk", "Coffee", "Bagels", None, "Drugs", "Coke"]
    prices = [1.3, 7.5, 12.81, 9.25, 20.0, 3.74, 10.4, 5.0, None, 30.7, None]
    return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(zip(names, prices, strict=True), 1)], "id long, name string, price double")
