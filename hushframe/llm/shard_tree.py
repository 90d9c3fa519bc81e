"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. Each shard draws -ln(u) / weight for a key, u being a hash of key and shard; the
draw of a rack or region is the least below it, which is distributed as one weighted draw with the total weight below.
A key descends to the child with the least draw at each level. When the weight of a shard rises or a shard is added,
only the draws of the nodes above it change, and they change only to lead keys into it; when it falls or a shard goes, only
keys of that shard move. So the number of shards and the key decide alone, and one more shard takes rows only into itself.

Columns of the input that bear a result's name give way to it; ties of slots are broken by id and checksum; very long texts are placed like any other.
Null keys count as one key of their own (empty text); equal keys share a shard and get slots of their own; null texts
have size 1 and the crc32 of no bytes; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import pack, unpack
from hushframe.llm.numbering import hash48, number_rows

SEED = "tree"
#: Slots are numbered in CELLS x CELLS cells of each shard.
CELLS = 24


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 2, per_region: int = 4) -> list[Leaf]:
    """Shards of equal weight, filled rack by rack and region by region."""
    return [Leaf(s // per_region, s // per_rack, s) for s in range(shards)]


def draw(key: Column, leaf: Leaf) -> Column:
    u = (hash48(SEED, F.lit(str(leaf.shard)), key).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / F.lit(float(leaf.weight))


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def _descend(leaves: list[Leaf], draws: dict[int, Column], levels: tuple[str, ...]) -> Column:
    if not levels:
        return F.lit(leaves[0].shard)
    below: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        below.setdefault(getattr(leaf, levels[0]), []).append(leaf)
    drawn = {k: _least([draws[x.shard] for x in v]) for k, v in below.items()}
    first, *others = below
    picked = _descend(below[first], draws, levels[1:])
    best = _least(list(drawn.values()))
    for k in others:
        picked = F.when(drawn[k] == best, _descend(below[k], draws, levels[1:])).otherwise(picked)
    return picked


def assign(df: DataFrame, key: Column, trees: dict[str, list[Leaf]]) -> DataFrame:
    """Adds a column with the shard for each named tree."""
    leaves = {leaf: f"__d{i}" for i, leaf in enumerate(dict.fromkeys(x for t in trees.values() for x in t))}
    drawn = df.withColumns({name: draw(key, leaf) for leaf, name in leaves.items()})
    return drawn.withColumns({into: _descend(tree, {x.shard: F.col(leaves[x]) for x in tree}, ("region", "rack", "shard")).cast("int") for into, tree in trees.items()}).drop(*leaves.values())


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with size, text_crc32, shard, grown_shard (with one more shard) and slot, which replace columns of these names."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pack(docs, id=F.col(id_col), size=(F.octet_length(text) + 1).cast("long"), text_crc32=F.crc32(text))
    rows = assign(rows, F.col("id"), {"shard": topology(shards), "grown_shard": topology(shards + 1)})
    cell = hash48("slot", F.col("id"))
    rows = number_rows(rows, F.col("shard"), cell % CELLS, F.floor(cell / CELLS) % CELLS, [F.col("id"), F.col("text_crc32")], "slot")
    return unpack(rows, "size", "text_crc32", "shard", "grown_shard", "slot")
