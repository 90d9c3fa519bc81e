"""Gapless numbers within groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash48(*parts: Column | str) -> Column:
    """48 bits of the md5 of the parts, joined by colons; nulls count as the empty text."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def number_rows(df: DataFrame, group: Column, coarse: Column, fine: Column, order: list[Column], into: str) -> DataFrame:
    """Adds ``into``: 0, 1, ... within each group, by coarse, fine and order.

    Rows are sorted only within (group, coarse, fine); counts of these cells give each cell its first number. So a group
    that holds most rows is still dealt over as many tasks as it has cells. Null is a group of its own.
    """
    keys = ["__group", "__coarse", "__fine"]
    cells = df.withColumns({"__group": F.when(group.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), group.cast("string"))), "__coarse": coarse, "__fine": fine})
    counts = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    lines = counts.groupBy("__group", "__coarse").agg(F.sum("__n").alias("__m"))
    up_to = Window.unboundedPreceding, -1
    lines = lines.withColumn("__above", F.coalesce(F.sum("__m").over(Window.partitionBy("__group").orderBy("__coarse").rowsBetween(*up_to)), F.lit(0))).drop("__m")
    firsts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("__group", "__coarse").orderBy("__fine").rowsBetween(*up_to)), F.lit(0)))
    firsts = firsts.join(lines, keys[:2]).select(*keys, (F.col("__above") + F.col("__before")).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return cells.join(firsts, keys).withColumn(into, F.col("__first") + rank - 1).drop(*keys, "__first")
