"""Curates `documents` in five stages; each is written and read again as the next one's input.

Stages keep every column of the documents, whatever its name, and repeated rows unless they are copies. In any stage:
an empty table gives no rows, without failing; a document without an id is judged like any other; a null text counts as empty, and both as a text
without words, which the quality rules reject; very long texts are read whole; a null language or source is a value of its own. Without labels of both
kinds the quality rules decide by their base rules alone, and without benchmark items decontamination keeps everything. Ties: the smallest doc_id of a
group stays, of equal ids any one row; equal documents are sampled and sharded one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import decontaminate, line_crf, mixing, near_copies, shard_tree
from hushframe.llm.common import materialize, pack, table, unpack


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, row, doc_id, text): each whole row in a struct, with a number that stays, as it is in a table."""
    rows = materialize(pack(docs, row=F.monotonically_increasing_id()), "numbered")
    return rows.select("doc", "row", "doc.doc_id", "doc.text")


def _without(numbered: DataFrame, rejected: DataFrame) -> DataFrame:
    return unpack(numbered.select("row", "doc").join(rejected.select("row"), "row", "left_anti"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpack(line_crf.judge(docs, table(spark, sf_dir, "labels")).filter("quality.kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest doc_id stays (a null one last). Linked are texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    rows = _numbered(docs)
    found = near_copies.near_copies(rows, carry=("doc_id",))
    stays = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("stays"))
    return _without(rows, found.join(materialize(stays, "stays"), "label").filter("row <> stays"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a whole span of any benchmark item go, and those with two or more items, however short."""
    rows = _numbered(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), carry=("row",))
    return _without(rows, found.filter(F.col("contaminated") | F.exists("spans", lambda s: s["length"] >= decontaminate.SPAN)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(mixing.mix(mixing.sized(docs)))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with shard and slot, which replace columns of these names."""
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shard_tree.shard_rows(docs).select(*kept, "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mix),
    ("sharding", sharding),
]

#: A trained model and fingerprints of hashed shingles are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
