"""Hard negatives against brute force, and the tree's elimination against the rows it may not lose."""

import math

import numpy as np
import pytest

from strandline.llm import hyperplanes
from strandline.llm.hyperplanes import Tree, distances, hard_negatives, inner_products

SCHEMA = "vec_id bigint, label int, embedding array<float>, leaf int, x string, score int, rank int, class_id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, "x", 2, 3, "c") for i, y, v in rows], SCHEMA).repartition(3)


def brute(rows, every=100):
    one = {}
    for i, y, v in rows:
        if i is not None and y is not None and v and None not in v and all(math.isfinite(c) for c in v):
            row = (y, len(v), tuple(math.floor(256 * float(np.float32(c))) for c in v))
            one[i] = min(one.get(i, row), row)
    out = []
    for a, (label, size, x) in one.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, z)), i, y) for i, (y, s, z) in one.items() if s == size and i != a)
        for minus, p, _ in [s for s in scores if s[2] == label][:5]:
            good = [(-s, i) for s, i, y in scores if y != label and -80 * minus <= -100 * s <= -100 * minus]
            out += [(a, p, k + 1, i, -minus, s) for k, (s, i) in enumerate(good[:5])]
    return sorted(out)


def clustered(n, seed=7, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims)) * 3
    return [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 12)] + 0.3 * rng.standard_normal(dims)).tolist()) for i in range(n)]


def got(spark, rows, every=100):
    return sorted(tuple(r) for r in hard_negatives(vectors(spark, rows), every).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Tree.__init__, "__defaults__", (4, 20))  # many small leaves
    monkeypatch.setattr(hyperplanes, "BLOCK_PARTS", 64)
    rows = clustered(400)
    rows += [(1000 + i, 1, rows[0][2]) for i in range(0, 230)]  # a hot vector, anchors among its copies
    rows += [(2000 + i, i % 3, [1.0, float(i)]) for i in range(30)]  # another length
    rows += [
        (300, 3, rows[5][2]), (300, 3, rows[5][2]), (None, 1, rows[3][2]), (500, None, rows[3][2]), (501, 1, None), (502, 1, []),
        (503, 1, [1.0, None]), (504, 1, [math.nan] * 6), (600, 2, [math.inf] * 6), (700, 1, [0.0] * 6), (800, 1, [-5.0] * 6),
    ]
    expected = brute(rows)
    assert len(expected) > 100 and got(spark, rows) == expected
    assert hard_negatives(vectors(spark, rows)).dtypes == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"),
        ("negative_score", "bigint"),
    ]


def test_empty_tables_and_lone_anchors(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, 1, [1.0, 2.0]), (1, 2, [1.0])]) == []
    big = [(0, 1, [4e6, 1.0]), (1, 1, [4e6, 1.0]), (2, 2, [3.9e6, 2.0]), (3, 2, [1e30, 1.0])]
    assert got(spark, big) == brute(big[:3]) != []


@pytest.mark.parametrize("seed", range(3))
def test_elimination_keeps_every_row_of_the_annulus(seed):
    x = np.array([[math.floor(256 * c) for c in v] for _, _, v in clustered(1500, seed)])
    tree = Tree(x[::3], int((x * x).sum(1).max()), len(x), 4, 20)
    lifted = tree.lifted(x)

    def see(node, found, nearest):
        for j in range(len(tree.children[node])):
            if (nearest == j).any():
                tree.low[node][:, j] = found[nearest == j].min(0)
                tree.high[node][:, j] = found[nearest == j].max(0)

    leaf, visited = tree.walk(lifted, see), 0
    for q in x[:40]:
        scores = x @ q
        top = int(np.sort(scores)[-20])
        leaves = tree.visited(tree.asking(q[None, :])[0], tree.annuli(int(q @ q), [(-(-8 * top // 10), top)]))
        assert set(leaf[(scores >= 0.8 * top) & (scores <= top)].tolist()) <= set(leaves)
        visited += len(leaves)
    assert visited < 0.8 * 40 * tree.leaves and tree.leaves > 30


def test_scores_are_exact():
    a = np.array([[2 ** 30, 3], [5, -(2 ** 30)]])
    assert inner_products(a, a).tolist() == [[2 ** 60 + 9, 2 * 2 ** 30], [2 * 2 ** 30, 25 + 2 ** 60]]
    assert inner_products(a // 2 ** 20, a[:0]).shape == (2, 0)
    assert distances(np.zeros((1, 2)), np.array([[3.0, 4.0]])).tolist() == [[5.0]]


def test_a_leaf_is_searched_in_few_blocks(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        rows = spark.range(hyperplanes.LEAF_ROWS).selectExpr("cast(1 as int) leaf", "id row_id", "id % 10 row_label", "cast('x' as binary) x")
        found = hyperplanes._blocks(rows, "row_id row_label x", hyperplanes.BLOCK_PARTS // 64).collect()
        assert sorted(i for b in found for i in b.row_id) == list(range(hyperplanes.LEAF_ROWS)) and len(found) <= 4
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
