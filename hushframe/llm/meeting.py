"""Links among all rows of a group, of any size, without a task or a copy for every pair of its parts.

A large group is dealt in tiles of bounded weight, twice and differently. First only rows of one tile meet: what is dense is connected after that, through rows
that share a tile here and another one there. Then a row has to meet only rows of other components. In each group one component is the largest; the others'
tiles meet each other and the largest one's tiles, and those of the largest do not meet among themselves. So a group of n rows of which m are outside its
largest component makes about 3 n + m n / tile rows, and no pair of different components is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import materialize
from hushframe.operators.components import components


def meet(rows: DataFrame, by: list[str], node: str, weight: Column, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v): what ``solve`` links. ``rows``: ``by``, ``node`` (a long) and what ``solve`` needs; ``weight``: what part of a tile a row takes.

    Rows may come with a ``label``, one for all that is connected already; then ``solve`` has to link labels.

    ``solve`` gets the rows with ``i`` and ``j``, and links rows that agree in ``by``, i and j and differ in ``label``, at least so many that these are connected as all links connect them.
    """
    none = F.lit(0).cast("long")
    rows = rows if "label" in rows.columns else rows.withColumn("label", F.col(node))
    sized = materialize(rows.groupBy(*by).agg(F.ceil(F.sum(weight)).cast("long").alias("tiles")).filter("tiles > 1"), "large-groups")
    if sized.isEmpty():
        return solve(rows.withColumns({"i": none, "j": none}))
    dealt = rows.join(sized, by, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    dealt = dealt.withColumn("turn", F.explode(F.when(F.col("tiles") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    own = F.col("turn") * F.col("tiles") + F.pmod(F.xxhash64("turn", node), F.col("tiles"))
    first = materialize(solve(dealt.withColumns({"i": own, "j": own}).drop("tiles", "turn")), "links")
    known = components(first).select(F.col("node").alias("of"), F.col("label").alias("now"))
    large = rows.join(sized.drop("tiles"), by, "left_semi")
    large = large.join(known, large["label"] == known["of"], "left").withColumn("label", F.coalesce("now", "label")).drop("of", "now")
    parts = materialize(large.groupBy(*by, "label").agg(F.sum(weight).alias("part")), "parts")
    mixed = parts.groupBy(*by).agg(F.max(F.struct("part", "label")).alias("most"), F.count(F.lit(1)).alias("kinds"), F.sum("part").alias("all")).filter("kinds > 1")
    tiles = lambda x: F.greatest(F.ceil(x - 1e-9), F.lit(1)).cast("long")
    mixed = materialize(mixed.select(*by, F.col("most.label").alias("largest"), tiles(F.col("all") - F.col("most.part")).alias("outside"), tiles(F.col("most.part")).alias("inside")), "mixed-groups")
    if mixed.isEmpty():
        return first
    is_out = F.col("label") != F.col("largest")
    spot = F.xxhash64(F.lit("again"), node)
    own = F.when(is_out, F.pmod(spot, F.col("outside"))).otherwise(F.col("outside") + F.pmod(spot, F.col("inside")))
    last = F.when(is_out, F.col("outside") + F.col("inside") - 1).otherwise(F.col("outside") - 1)
    again = large.join(mixed, by).withColumn("own", own).withColumn("other", F.explode(F.sequence(none, last)))
    again = again.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "largest", "outside", "inside")
    return first.unionByName(materialize(solve(again), "links"))
