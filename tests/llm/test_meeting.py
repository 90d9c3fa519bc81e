import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.llm.meeting import meet
from hushframe.operators.components import components


def solver(made):
    """Links values of a group that are at most 2 apart; ``made`` collects how many rows met."""

    def run(table: pa.Table) -> pa.Table:
        x, node, label = (np.asarray(table.column(c)) for c in ("x", "node", "label"))
        near = (np.abs(x[:, None] - x) <= 2) & (label[:, None] != label)
        u, v = np.nonzero(np.triu(near, 1))
        return pa.table({"u": pa.array(node[u], pa.int64()), "v": pa.array(node[v], pa.int64())})

    def solve(rows):
        made.append(rows.count())
        return rows.select("g", "i", "j", "node", "x", "label").groupBy("g", "i", "j").applyInArrow(run, "u long, v long")

    return solve


def plain(rows):
    label = {n: n for _, n, _ in rows}
    for g, a, x in rows:
        for h, b, y in rows:
            if g == h and abs(x - y) <= 2 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {n: low if z == high else z for n, z in label.items()}
    out = {}
    for n, z in label.items():
        out.setdefault(z, set()).add(n)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("tile", [4, 10, 1000])
def test_groups_of_any_size_are_linked_whole(spark, tile):
    rng = np.random.default_rng(tile)
    rows = [(1, i, int(x)) for i, x in enumerate(rng.integers(0, 40, 90))]  # dense
    rows += [(2, 100 + i, 3 * i) for i in range(40)] + [(2, 140 + i, 3 * i + 1) for i in range(30)]  # pairs
    rows += [(3, 200 + i, 2 * i) for i in range(35)] + [(4, 300, 1), (4, 301, 9)]  # a chain, and no link
    df = spark.createDataFrame(rows, "g long, node long, x long").repartition(3)
    made = []
    found = components(meet(df, ["g"], "node", F.lit(1.0 / tile), solver(made))).collect()
    label = {r["node"]: r["label"] for r in found}
    got = {}
    for _, n, _ in rows:
        got.setdefault(label.get(n, n), set()).add(n)
    assert sorted(map(sorted, got.values())) == plain(rows)


def test_a_dense_group_makes_no_row_for_each_pair_of_tiles(spark):
    """1000 rows in tiles of 10: all but 20 are connected within tiles, so few meet again."""
    rows = [(1, i, i % 3) for i in range(980)] + [(1, 2000 + i, 100 * (i + 1)) for i in range(20)]
    made = []
    found = components(meet(spark.createDataFrame(rows, "g long, node long, x long"), ["g"], "node", F.lit(0.1), solver(made))).collect()
    assert {r["label"] for r in found} == {0} and len(found) == 979
    assert sum(made) < 6 * len(rows)  # all pairs of 100 tiles would take 100 rows each
