"""Steps between grouping and finalizing: merging suppressed buckets into a star bucket or into their only sibling.

Each step decides on a small table of buckets and relabels the contributions (and the rows, for distinct counts and histograms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators.anonymize import STAR, Prepared, join_keys, low_counts
from hushframe.storage import materialize


def _moved(df: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """Rows under the keys that ``moves`` gives for theirs."""
    out = join_keys(df, moves, keys)
    return out.select(*(F.col(f"to_{k}").alias(k) for k in keys), *(c for c in df.columns if c not in keys))


def _summed(long: DataFrame, keys: list[str]) -> DataFrame:
    return materialize(long.groupBy(*keys, "aid", "leg", "h").agg(F.sum("amount").alias("amount")), "merged")


def led(p: Prepared, aids: list[bool]) -> Prepared:
    """Low-effect detection, for three grouping columns or more.

    A suppressed bucket is merged into a shown sibling (which differs in one column only) if that is its only sibling in the column and
    another column has no sibling at all.
    """
    if len(p.labels) < 3:
        return p
    keys = p.keys
    buckets = materialize(low_counts(p.long, keys, p.context.params), "buckets")
    victims = buckets.filter("low").drop("low")
    for i, key in enumerate(keys):
        # Only who has one sibling or none counts, so no join meets many buckets of one group.
        others = [k for k in keys if k != key]
        near = buckets.groupBy(*others).agg(F.count(F.lit(1)).alias(f"n{i}"), F.max(F.when(~F.col("low"), F.struct(F.col(key).alias("to")))).alias(f"t{i}")).filter(F.col(f"n{i}") <= 2)
        victims = join_keys(victims, near, others, "left")
    targets = F.filter(
        F.array(*(F.when((F.col(f"n{i}") == 2) & F.col(f"t{i}").isNotNull(), F.struct(*((F.col(f"t{i}.to") if j == i else F.col(k)).alias(f"to_{k}") for j, k in enumerate(keys)))) for i in range(len(keys)))),
        lambda t: t.isNotNull(),
    )
    unknown = F.greatest(*(F.coalesce(F.col(f"n{i}") == 1, F.lit(False)) for i in range(len(keys))))
    victims = victims.filter(unknown).withColumn("targets", targets).filter(F.size("targets") > 0).select(*keys, "targets")
    victims = materialize(victims, "victims")
    if victims.isEmpty():
        return p
    moves = victims.select(*keys, F.explode("targets").alias("t")).select(*keys, "t.*")
    long = _summed(p.long.unionByName(_moved(p.long, moves, keys)), keys)
    return p.changed(rows=p.rows.unionByName(_moved(p.rows, moves, keys)), long=long, merged=victims.select(*keys))


def star_bucket(p: Prepared, aids: list[bool]) -> Prepared:
    """All suppressed buckets as one with `*` (text) or NULL labels, if it can be shown itself and holds two or more."""
    keys = p.keys
    low = low_counts(p.long, keys, p.context.params).filter("low").drop("low")
    if p.merged is not None:
        low = join_keys(low, p.merged, keys, "left_anti")
    kinds = dict(p.rows.dtypes)
    labels = [(F.lit("*") if kinds[k] == "string" else F.lit(None).cast(kinds[k])).alias(f"to_{k}") for k in keys]
    moves = materialize(low.select(*keys, *labels), "suppressed")
    rows, long = p.rows.withColumn(STAR, F.lit(False)), p.long.withColumn(STAR, F.lit(False))
    starred = p.changed(rows=rows, long=long, keys=[*keys, STAR])
    if len(moves.head(2)) < 2:
        return starred
    star = _summed(_moved(p.long, moves, keys), keys)
    shown = low_counts(star, keys, p.context.params)
    if shown.filter("low").count():
        return starred
    return starred.changed(rows=rows.unionByName(_moved(p.rows, moves, keys).withColumn(STAR, F.lit(True))), long=long.unionByName(star.withColumn(STAR, F.lit(True))))


DEFAULT = (led, star_bucket)
