"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, at most ``most`` times its own words; what is above goes to the
others by weight. Each document of a source expects target / source_size copies. Expected copies are prefix-summed within
the source, one offset drawn for the source is added, and a document is emitted once per integer boundary that its
interval crosses. Documents stand by falling size (two leading digits), then by a hash: the words taken miss the target by about a large document's
size at most, whatever the number of documents.

Whole rows stand in a struct, so no column of theirs clashes; very long texts count like any other. Null texts have size 0 and are sampled too; a null source is the last source; a source without words has target 0 and
its documents are not taken; equal rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import pack, unpack
from hushframe.llm.numbering import hash48, number_rows

WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix"
#: Documents of one source and size are numbered in so many cells; a cell is what one task sorts.
CELLS = 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size). A row for each source meets in one task, no row of a document."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), k.cast("int") + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    # Sources reach their cap in the order of cap / weight; `level` is what a unit of weight gets if all before are at their caps.
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({"left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "free": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    # It rises as long as sources before the cut are truly above their caps and falls after, so the largest is the solution.
    s = s.withColumn("final", F.max(F.col("left") / F.col("free")).over(everything))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, id, source, size): each whole row in a struct."""
    # A generator is evaluated once; a projected size would be counted anew wherever it is used.
    return pack(docs, id=F.col(id_col), source=F.col(source_col), size=F.explode(F.array(n_words(F.col(text_col)))))


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``rows`` (of ``sized``) with source_size, target, copies and taken."""
    aims = targets(rows.select("source", "size"), weights, most).withColumnRenamed("source", "of")
    digits = F.pow(F.lit(10), F.greatest(F.length(F.col("size").cast("string")) - 2, F.lit(0))).cast("long")
    coarse = F.col("size") % digits - F.col("size")
    out = number_rows(rows, F.col("source"), coarse, hash48(SEED, F.col("id")) % CELLS, [F.col("size").desc(), F.col("id")], "index")
    out = out.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (hash48(SEED, F.lit("offset"), F.col("source")) % (1 << 32)).cast("double") / F.lit(float(1 << 32))
    crossed = F.floor((F.col("index") + 1) * each + offset) - F.floor(F.col("index") * each + offset)
    return out.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("index")


def emit(mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it has copies."""
    return unpack(mixed.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))
