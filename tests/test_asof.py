import math
import random

import pytest

from strandline.operators import asof as af
from strandline.operators.grid import master_grid
from strandline.operators.ordered import Chunks

SOURCE = "log_id int, time_us long, record_index long, boundary_id string, v double, w double"
TARGET = "log_id int, time_us long, boundary_id string"


def align(table, source, target, max_age=100.0, gap=500.0, fields=("v",), **more):
    s = table(SOURCE, [(1, int(t * 1e6), i, b, *vs, *([0.0] * (2 - len(vs)))) for i, (t, b, *vs) in enumerate(source)])
    t = table(TARGET, [(1, int(t * 1e6), b) for t, b in target])
    out = af.asof_align(t, s, list(fields), max_age, gap, **more)
    return [r.asDict() for r in out.orderBy("time_us").collect()]


def test_causal_bounded_and_reacquired(table):
    got = align(table, [(1.0, "a", 1.0), (2.0, "a", 2.0)], [(0.9, "a"), (1.05, "a"), (1.5, "a"), (2.0, "a")])
    assert [r["v"] for r in got] == [None, 1.0, None, 2.0]
    assert [r["valid"] for r in got] == [False, True, False, True]
    assert got[0]["source_time_us"] is None and got[2]["source_time_us"] == 1_000_000  # expired keeps its origin
    assert got[2]["age_ms"] == 500.0


def test_limit_is_inclusive(table):
    got = align(table, [(1.0, "a", 1.0)], [(1.1, "a"), (1.100001, "a")])
    assert [r["valid"] for r in got] == [True, False]


def test_other_boundary_leaves_nothing(table):
    got = align(table, [(1.0, "a", 1.0)], [(1.05, "b")])
    assert got[0]["v"] is None and got[0]["age_ms"] is None and not got[0]["valid"]


def test_ties_take_the_last_row_and_there_is_no_fallback(table):
    got = align(table, [(1.0, "a", 1.0), (1.0, "a", 2.0)], [(1.0, "a")])
    assert got[0]["v"] == 2.0
    got = align(table, [(1.0, "a", 1.0), (1.01, "a", math.nan)], [(1.02, "a")])
    assert got[0]["v"] is None and got[0]["source_time_us"] == 1_010_000
    got = align(table, [(1.0, "a", 1.0, math.inf)], [(1.02, "a")], fields=("v", "w"))
    assert got[0]["v"] is None and not got[0]["valid"]


def test_gap_limit_also_bounds(table):
    assert not align(table, [(1.0, "a", 1.0)], [(1.08, "a")], max_age=100, gap=50)[0]["valid"]


def test_empty_sides_and_bad_arguments(table):
    assert align(table, [], [(1.0, "a")])[0]["valid"] is False
    assert align(table, [(1.0, "a", 1.0)], []) == []
    for bad in (-1.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            align(table, [], [], max_age=bad)
    with pytest.raises(ValueError):
        align(table, [], [], method="linear")


def test_fields_are_judged_one_by_one(table):
    s = table(SOURCE, [(1, 1_000_000, 0, "a", math.nan, 4.0)])
    t = table(TARGET, [(1, 1_000_000, "a")])
    r = af.asof_fields(t, s, {"v": 1.0, "w": 0.5}, 100, 500).first()
    assert r.v is None and r.w == 2.0 and r.valid
    assert af.asof_fields(t, s, {"w": None}, 100, 500).first().w is None


@pytest.mark.parametrize("chunks", [Chunks(), Chunks(500), Chunks(31)])
def test_against_brute_force_on_a_skewed_fleet(spark, chunks):
    rng = random.Random(3)
    log = lambda: 0 if rng.random() < 0.4 else rng.randint(1, 3)
    src = [(log(), rng.randint(0, 3000), i, rng.choice("ab"), rng.random(), 0.0) for i in range(300)]
    tgt = sorted({(log(), rng.randint(0, 3000), rng.choice("ab")) for _ in range(200)})
    out = af.asof_align(spark.createDataFrame(tgt, TARGET), spark.createDataFrame(src, SOURCE), ["v"], 0.2, 0.5, chunks=chunks)
    got = sorted((r.log_id, r.time_us, r.boundary_id, r.source_time_us, r.v) for r in out.collect())
    want = []
    for g, t, b in tgt:
        c = max((s for s in src if s[0] == g and s[1] <= t), key=lambda s: (s[1], s[2]), default=None)
        inside = c is not None and c[3] == b
        want.append((g, t, b, c[1] if inside else None, c[4] if inside and t <= c[1] + 200 else None))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_clock_faults(table):
    rows = table("log_id int, time_us long, record_index long", [(1, 5, 0), (1, 4, 1), (1, None, 2), (2, 1, 0), (2, 1, 1)])
    got = {r.log_id: (r.missing_times, r.backward_steps) for r in af.clock_faults(rows).collect()}
    assert got == {1: (1, 1), 2: (0, 0)}


def test_latest_of_all_instances(table):
    rows = [(1, i, i, i % 2, 100.0 * (1 + i % 2), 0) for i in range(4)] + [(1, 50, 9, 0, 100.0, 0), (1, 51, 10, 1, math.nan, 0)]
    df = table("log_id int, time_us long, record_index long, instance int, rpm double, ctx int", rows)
    got = af.latest_of_all(df, [0, 1], "rpm", 10, 1.0, context="ctx").orderBy("record_index").collect()
    assert [(r.record_index, r.ratio) for r in got] == [(1, 2.0), (2, 2.0), (3, 2.0)]


def test_latest_of_all_asks_each_log_for_its_own_instances(table):
    schema = "log_id int, time_us long, record_index long, instance int, rpm double"
    rows = [(1, i, i, i % 2, 100.0 + i) for i in range(4)] + [(2, i, i, i % 4, 100.0) for i in range(6)] + [(3, 1, 0, 0, 5.0)]
    got = af.latest_of_all(table(schema, rows), [0, 1, 2, 3], "rpm", 10).groupBy("log_id").count().collect()
    assert {r.log_id: r["count"] for r in got} == {1: 3, 2: 3}


def test_ratio_needs_a_fresh_positive_base(table):
    schema = "log_id int, time_us long, record_index long, volt double, ctx int"
    a = table(schema, [(1, 10, 0, 6.0, 0), (1, 30, 1, 6.0, 0), (1, 11, 2, 6.0, 1)])
    b = table(schema, [(1, 5, 0, 12.0, 0)])
    got = af.ratio_to_latest(a, b, "volt", 10, context="ctx").collect()
    assert [(r.record_index, r.ratio) for r in got] == [(0, 0.5)]


def test_grid_is_half_open_and_split_into_blocks(table):
    seg = table("log_id int, flight_id int, start_us long, end_us long", [(1, 1, 0, 1_000_000), (1, 2, 5, 5), (2, 1, 100, 350_101)])
    for block in (10_000, 3):
        got = [(r.log_id, r.time_us) for r in master_grid(seg, 1e5, block=block).orderBy("log_id", "time_us").collect()]
        assert got == [(1, k * 100_000) for k in range(10)] + [(2, 100 + k * 100_000) for k in range(4)]
