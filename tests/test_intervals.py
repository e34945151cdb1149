import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import continuity as ct
from strandline.operators import intervals as iv
from strandline.operators.ordered import Chunks
from strandline.plans.inspect import flights

S = 1_000_000
EVENT = "log_id int, time_us long, record_index long"


def us(x):
    return round(x * S)


def two_flights(table, arm=None, ev=()):
    arm = [(1.0, 1), (1.5, 0), (2.0, 1), (2.5, 0)] if arm is None else arm
    arms = table(EVENT + ", arm_state int", [(1, us(t), i, s) for i, (t, s) in enumerate(arm)])
    evs = table(EVENT + ", id int", [(1, us(t), 100 + i, e) for i, (t, e) in enumerate(ev)])
    modes = table(EVENT + ", mode_num int, mode int", [(1, us(1.0), 10, 0, None), (1, us(1.2), 11, None, 5)])
    records = table("log_id int, time_us long", [(1, us(t)) for t in (0.5, 1.0, 2.5, 3.0)])
    names = table("mode_number bigint, label string", [(0, "STABILIZE"), (5, "LOITER")])
    return flights(arms, evs, modes, records, names)


def spans(df):
    return [(r.flight_id, r.start_us / S, r.end_us / S, r.open_ended) for r in df.orderBy("start_us").collect()]


def test_segments_and_intervals(table):
    segments, intervals = two_flights(table)
    assert spans(segments) == [(1, 1.0, 1.5, False), (2, 2.0, 2.5, False)]
    got = [(r.start_us / S, r.end_us / S, r.flight_id, r.armed, r.mode) for r in intervals.orderBy("start_us").collect()]
    assert got == [
        (0.5, 1.0, None, None, "UNKNOWN"), (1.0, 1.2, 1, True, "STABILIZE"), (1.2, 1.5, 1, True, "LOITER"),
        (1.5, 2.0, None, False, "LOITER"), (2.0, 2.5, 2, True, "LOITER"), (2.5, 3.0, None, False, "LOITER"),
    ]
    assert {r.flight_id: r.modes for r in iv.flight_modes(intervals).collect()} == {1: ["STABILIZE", "LOITER"], 2: ["LOITER"]}


def test_event_ids_stand_in_for_missing_arm_messages(table):
    segments, _ = two_flights(table, arm=[], ev=[(1.0, 10), (1.5, 11), (1.7, 15)])
    assert spans(segments) == [(1, 1.0, 1.5, False)]
    segments, _ = two_flights(table, ev=[(0.6, 10), (0.7, 11)])  # ignored, the log has ARM
    assert len(spans(segments)) == 2


def test_repeated_stray_and_open_reports(table):
    segments, _ = two_flights(table, arm=[(0.6, 0), (1.0, 1), (1.2, 1), (1.5, 0), (1.6, 0), (2.0, 1)])
    assert spans(segments) == [(1, 1.0, 1.5, False), (2, 2.0, 3.0, True)]
    arms = iv.arm_events(table(EVENT + ", arm_state int", [(1, 1, 0, 1), (1, 2, 1, 1)]), table(EVENT + ", id int", []))
    assert [r.time_us for r in iv.repeated_arms(arms).collect()] == [2]


def test_unknown_mode_label(table):
    modes = table(EVENT + ", mode_num int, mode int", [(1, 1, 0, 99, None)])
    names = table("mode_number bigint, label string", [(0, "STABILIZE")])
    assert iv.label_modes(modes, names).first().mode == "UNKNOWN(99)"


STATUS = EVENT + ", core long, primary_core long, status long, fault long"


def test_status_hold_invalidates_on_core_switch(table):
    segments, _ = two_flights(table)
    rows = [(1.0, 0, 0), (1.1, 0, 1), (1.3, 1, 1), (1.8, 1, 1), (2.2, 1, 1)]
    st = table(STATUS, [(1, us(t), i, c, p, 9, 0) for i, (t, c, p) in enumerate(rows)])
    got = {r.flight_id: (r.valid_us, r.known_us, r.unknown_us) for r in iv.status_hold(st, segments).collect()}
    assert got == {1: (us(0.3), us(0.3), us(0.2)), 2: (us(0.3), us(0.3), us(0.2))}
    none = table(STATUS, [])
    assert {(r.valid_us, r.unknown_us) for r in iv.status_hold(none, segments).collect()} == {(None, us(0.5))}


def test_primary_status_announces_and_masks(table):
    rows = [(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 0, 1)]  # time, core, primary
    df = table("log_id int, flight_id int, time_us long, record_index long, core double, primary_core double, status double, fault double, timeout double, offset_n double, offset_e double",
               [(1, 1, t, t, float(c), float(p), 9.0, 0.0, 0.0, 0.0, 0.0) for t, c, p in rows])
    got = [(r.time_us, r.core, r.status) for r in ct.primary_status(df).orderBy("time_us").collect()]
    assert got == [(0, 0.0, 9.0), (2, None, None), (3, 1.0, 9.0)]


def test_continuity_boundaries_and_numbers(table):
    segments, intervals = two_flights(table)
    gps = table("log_id int, flight_id int, time_us long, record_index long, status int",
                [(1, 1, us(1.0), 0, 3), (1, 1, us(1.05), 1, 3), (1, 1, us(1.3), 2, 4), (1, 2, us(2.4), 3, 4)])
    breaks = [ct.break_points(gps, [F.col("status")], us(0.2))]
    ev = table(EVENT + ", id int", [(1, us(2.1), 5, 62), (1, us(2.2), 6, 1), (1, us(1.7), 7, 60)])
    got = [(r.continuity_id, r.flight_id, r.start_us / S, r.end_us / S) for r in
           ct.continuity(segments, intervals, ev, breaks).orderBy("start_us").collect()]
    assert got == [(1, 1, 1.0, 1.2), (2, 1, 1.2, 1.25), (3, 1, 1.25, 1.3), (4, 1, 1.3, 1.5), (5, 2, 2.0, 2.1), (6, 2, 2.1, 2.5)]


def brute(intervals):
    covered = set()
    for a, b in intervals:
        covered |= set(range(a, b))
    return covered


@pytest.mark.parametrize("chunks", [Chunks(), Chunks(16)])
def test_durations_against_brute_force(table, chunks):
    rng = random.Random(11)
    sets = [[(g, a, a + rng.randint(0, 12)) for g in (0, 0, 1, 2) for a in [rng.randint(0, 120)] * 1 for _ in range(8)] for _ in range(2)]
    dfs = [table("log_id int, start_us long, end_us long", s) for s in sets]
    union = {r.log_id: r.duration_us for r in iv.union_duration(dfs[0], ["log_id"], chunks).collect()}
    both = {r.log_id: r.duration_us for r in iv.overlap_duration(*dfs, ["log_id"], chunks).collect()}
    for g in (0, 1, 2):
        left, right = (brute([(a, b) for h, a, b in s if h == g]) for s in sets)
        assert union[g] == len(left)
        assert both.get(g, 0) == len(left & right)


def test_context_of_instants(table):
    _, intervals = two_flights(table)
    rows = table("log_id int, time_us long, record_index long", [(1, us(t), i) for i, t in enumerate((0.1, 0.7, 1.2, 1.49, 1.5, 3.0))])
    got = [(r.state, r.context is None) for r in iv.with_context(rows, intervals).orderBy("record_index").collect()]
    assert got == [("unknown", True), ("unknown", False), ("armed", False), ("armed", False), ("disarmed", False), ("unknown", True)]


def test_samples_and_receiver_status_per_flight(table):
    segments, _ = two_flights(table)
    rows = table("log_id int, time_us long, message string", [(1, us(1.0), "PSCN"), (1, us(1.5), "PSCN"), (1, us(2.0), "PSCE")])
    got = {(r.flight_id, r.message): r.samples for r in iv.samples_per_flight(segments, rows, ("PSCN", "PSCE")).collect()}
    assert got == {(1, "PSCN"): 1, (1, "PSCE"): 0, (2, "PSCN"): 0, (2, "PSCE"): 1}
    gps = table(EVENT + ", instance int, status int", [(1, us(1.1), 0, None, 4), (1, us(1.2), 1, 0, 3), (1, us(1.3), 2, 0, 1)])
    assert iv.gps_status_sets(segments, gps).first().gps_status == {"0": [1, 3], "unidentified": [4]}
