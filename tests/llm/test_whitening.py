"""Whitening against exact moments and numpy's eigenvectors."""

import math

import numpy as np
import pytest

from strandline.llm import whitening
from strandline.llm.whitening import one_sided_jacobi, pivoted_cholesky, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, size int, x string, place int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, components=4):
    """Rows by vector length, worked out with whole numbers and numpy."""
    by_size = {}
    for i, v in rows:
        if v and None not in v and all(math.isfinite(c) for c in v):
            by_size.setdefault(len(v), []).append((i, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    out = {}
    for size, found in by_size.items():
        fit = sorted({x for _, x in found})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], object)
        v = ((z.T @ z) / n ** 3).astype(float)
        values, directions = np.linalg.eigh(v)
        values, directions = values[::-1], directions[:, ::-1]
        for i, x in found:
            centred = np.array([(n * c - s) / n for c, s in zip(x, sums)])
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            for k in range(min(components, size)):
                out.setdefault((i, k + 1, size), []).append((n, deviation, abs(centred @ directions[:, k]) / math.sqrt(values[k]), values[k] / v.trace()))
    return out


def check(got, rows):
    expected, sizes = brute(rows), {i: len(v) for i, v in rows if v}
    assert len(got) == sum(map(len, expected.values()))
    for r in got:
        n, deviation, whitened, explained = expected[r.vec_id, r.component, sizes[r.vec_id]][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-8)
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(9) * [9, 5, 3, 2, 1, 1, 1, 0.5, 0.1] + 1000).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # copies count once in the fit
    rows += [(300 + i, rng.standard_normal(3).tolist()) for i in range(30)]  # another length, whitened among itself
    rows += [(400, None), (401, []), (402, [1.0] * 8 + [None]), (403, [math.nan] * 9), (404, [math.inf] + [0.0] * 8)]
    got = whiten(vectors(spark, rows)).collect()
    check(got, rows)
    assert whiten(vectors(spark, rows)).dtypes[:2] == [("vec_id", "bigint"), ("component", "int")]
    signs = {np.sign(a.whitened) == np.sign(b.whitened) for a in got for b in got if a.vec_id == 7 and b.vec_id == 205 and a.component == b.component}
    assert signs == {True}


def test_scales_that_differ_by_far(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(4) * [4000, 4, 0.04, 0.02] + 30000).tolist()) for i in range(300)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    got = whiten(vectors(spark, rows)).collect()
    assert max(r.identity_error for r in got) < 1e-6 and sorted({r.component for r in got}) == [1, 2, 3, 4]


def test_nothing_varies_and_odd_rows(spark):
    same = whiten(vectors(spark, [(1, [2.0, 3.0]), (1, [2.0, 3.0]), (None, [2.0, 3.0])])).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    line = whiten(vectors(spark, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [3.0, 3.0])])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and line[0].identity_error < 1e-12
    assert whiten(vectors(spark, [])).count() == 0 and whiten(vectors(spark, [(1, None)])).count() == 0
    huge = whiten(vectors(spark, [(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [1e30, 1.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2} and {r.deviation for r in huge} == {None} and huge[0].identity_error < 1e-9


@pytest.mark.parametrize("size,rank", [(1, 1), (5, 5), (8, 3), (17, 17)])
def test_factorisations(size, rank):
    a = np.random.default_rng(size).standard_normal((size, rank)) * 10.0 ** -np.arange(rank)
    g = pivoted_cholesky(a @ a.T)
    assert np.allclose(g @ g.T, a @ a.T, atol=1e-13 * np.abs(a @ a.T).max())
    values, directions = one_sided_jacobi(g)
    assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-12)
    assert np.allclose(values[:3], np.linalg.svd(a)[1][:3] ** 2, rtol=1e-6)
    assert whitening.COMPONENTS == 4


def test_number_of_jobs_does_not_follow_the_partitions(spark):
    rng = np.random.default_rng(9)
    table = vectors(spark, [(i, [float(c) for c in row]) for i, row in enumerate(rng.normal(size=(40, 6)))])
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        spark.sparkContext.setJobGroup("whitening-jobs", "")
        assert whiten(table).count() == 160
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whitening-jobs")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
