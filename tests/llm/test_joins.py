"""Near-copy joins of texts and vectors against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from strandline.llm import forest, grouping, rotations
from strandline.llm.shared import folded_words, store
from tests.llm.conftest import odd_rows


def brute_components(nodes, edges):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def brute_jaccard(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = folded_words(t or "")
        if w:
            sets.setdefault(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))), []).append(-1 if d is None else d)
    ids = {s: min(m) for s, m in sets.items()}
    edges = [(ids[a], ids[b]) for a, b in itertools.combinations(sets, 2) if len(a & b) >= threshold * len(a | b)]
    root = brute_components(ids.values(), edges)
    out = []
    for s, m in sets.items():
        n = sum(ids[s] in e for e in edges)
        out += [(d, ids[s], len(m), n, root[ids[s]], d == root[ids[s]]) for d in m]
    return sorted(out)


def near_rows():
    rng = random.Random(1)
    rows, at = [], 0
    for size in (1, 1, 2, 5, 40):
        base = [f"v{rng.randrange(500)}" for _ in range(80)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(80)] = f"u{rng.randrange(500)}"
            rows.append((at, " ".join(words)))
            at += 1
    return rows


@pytest.mark.parametrize("block,crowd", [(192, 1 << 15), (7, 3)])
def test_jaccard_join(documents, block, crowd, monkeypatch):
    monkeypatch.setattr(grouping.verified_links, "__defaults__", (block,))
    monkeypatch.setattr(grouping.candidate_edges, "__defaults__", (crowd,))
    rows = near_rows()
    got = [tuple(-1 if v is None else v for v in r[:-1]) for r in forest.jaccard_join(documents(rows)).collect()]
    assert sorted(got) == brute_jaccard(rows)


def test_jaccard_odd_rows(odd):
    got = forest.jaccard_join(odd).collect()
    assert len(got) == len(odd_rows())
    full = [tuple(-1 if v is None else v for v in r[:-1]) for r in got]
    alone = [r for r in full if r[0] in (1, 2, 10)]
    assert all(r[1] == r[0] and r[2] == 1 and r[3] == 0 and r[5] for r in alone)
    assert sorted(r for r in full if r[0] not in (1, 2, 10)) == brute_jaccard(odd_rows())


def test_one_of_each_keeps_columns(odd):
    out = forest.one_of_each(odd)
    assert out.columns == odd.columns
    rows = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert [d for d, _ in rows].count(4) == 0 and (None, odd_rows()[2][1]) in rows and (11, "one two") not in rows
    assert forest.one_of_each(odd.limit(0)).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    depth = forest.prefix_depth(24, 6, 0.8, 0.9999)
    assert 1 - (1 - 0.8 ** depth) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 24


def test_prefixes_are_shortened_for_what_is_left(spark):
    """Copies stop at the whole label and their head goes on; a near text meets it only where prefixes are shorter."""
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    own = [rng.integers(0, 1 << 63, 100).astype(np.uint64) for _ in range(3)]
    sets = [np.concatenate([common, own[0], rng.integers(0, 1 << 63, 2).astype(np.uint64)]) for _ in range(20)]
    sets += [np.concatenate([common, x]) for x in own[1:]]
    rows = [(bytes([i]), forest.minhash_labels(s, 24, 6)) for i, s in enumerate(sets)]
    sketches = spark.createDataFrame([(n, x.tobytes()) for n, x in rows], "node binary, sketch binary")
    tries = spark.createDataFrame([(t, int(p), n) for n, x in rows for t, p in enumerate(x)], "tree int, prefix bigint, node binary")
    left, near = forest.climb(tries, sketches, forest.label_similarity(6), forest.STOP, forest.EDGE)
    left, near = left.collect(), {(bytes(r.a)[0], bytes(r.b)[0]) for r in near.collect()}
    crowd = {(r.tree, bytes(r.node)[0]) for r in left if bytes(r.node)[0] < 20}
    assert {t for t, _ in crowd} == set(range(24)) and len(crowd) < 24 * 20 / 2  # most have stopped, every trie keeps a head
    assert {(r.tree, bytes(r.node)[0]) for r in left if bytes(r.node)[0] >= 20} >= {(t, n) for t in range(24) for n in (20, 21)
            if not any(a == n for a, _ in near)}
    prefixes = lambda rows: {(r.tree, r.prefix) for r in rows}
    assert prefixes(left) == prefixes(tries.collect())  # no prefix is left without a text
    assert {a for a, _ in near} >= set(range(1, 20))


def test_labels_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1600, 200, 200))
    one, two = (forest.minhash_labels(np.concatenate([common, x]), 24, 6)[None].view(np.uint8) for x in (a, b))
    assert abs(forest.label_similarity()(one, two)[0] - 0.8) < 0.12


VECTORS = "vec_id bigint, embedding array<double>, label int, node int, payload string, sketch int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "p", 3) for i, v in rows], VECTORS).repartition(2)


def brute_vectors(rows):
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(good, 2) if x @ y >= 0.9]
    root = brute_components([i for i, _ in good], edges)
    return {i: (sum(i in e for e in edges), root[i], i == root[i]) for i, _ in good}


@pytest.mark.parametrize("block", [192, 11])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(grouping.verified_links, "__defaults__", (block,))
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(48).tolist()) for i in range(150)]
    for center, n, noise in ((0, 40, 0.25), (1, 5, 0.4), (2, 60, 0.05), (3, 30, 0.45)):
        for _ in range(n):
            rows.append((len(rows), (np.array(rows[center][1]) + noise * rng.standard_normal(48)).tolist()))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rotations.near_vectors(vectors(spark, rows)).collect()}
    want = brute_vectors(rows)
    total = sum(v[0] for v in want.values())
    assert sum(got[i][0] for i in want) >= 0.999 * total and all(got[i][0] <= want[i][0] for i in want)
    assert got == want


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    odd = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 2.0]), (5, [float("inf"), 1.0, 2.0]),
           (6, []), (7, [1.0, 2.0]), (None, v), (8, v), (9, [2e200, 4e200, 6e200]), (10, [2e-200, 4e-200, 6e-200]), (11, [-1.0, -2.0, -3.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rotations.near_vectors(vectors(spark, odd)).collect()}
    assert got == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11)} | {None: (0, None, False), 8: (2, 8, True), 9: (2, 8, False), 10: (2, 8, False)}
    assert rotations.near_vectors(vectors(spark, [])).count() == 0
    assert rotations.near_vectors(vectors(spark, [(1, None)])).count() == 1


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for dims, n in ((5, 9), (3, 4), (48, 6), (1, 2), (7, 1)):
        one, first = rng.standard_normal(dims), len(rows)
        for i in range(n):
            rows.append((first + i, (one * (i + 1)).tolist()))
            want[first + i] = (n - 1, first, i == 0)
    rows.append((0, rows[9][1]))  # vec_id 0 has two lengths: its links count together, and join both groups
    want |= {0: (8 + 4, 0, True)} | {i: (4, 0, False) for i in range(9, 13)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rotations.near_vectors(vectors(spark, rows)).collect()}
    assert got == want


def test_bit_groups_meet_the_recall():
    for n in (10, 50_000, 10 ** 9):
        bits, groups = rotations.bit_groups(n, 0.9, 0.999)
        agree = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - agree) ** groups >= 0.999 and 2 ** bits >= n


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    a, b = (x / np.linalg.norm(x) for x in rng.standard_normal((2, 64)))
    b = 0.9 * a + math.sqrt(1 - 0.81) * (b - (b @ a) * a) / np.linalg.norm(b - (b @ a) * a)
    found = []
    for k in range(400):
        turn = rotations.rotation(k, 64)
        signs = np.where(turn @ a >= 0, 1, -1) / 8
        found.append(signs @ (turn @ b) / (signs @ (turn @ a)))
    assert abs(np.mean(found) - 0.9) < 0.01


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (301, 300)]
    got = {r.node: r.root for r in grouping.components(store(spark.createDataFrame(edges, "a bigint, b bigint"), "test-edges")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 120)}, 300: 300, 301: 300}
