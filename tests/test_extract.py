import math

import pytest
from strandline.config import REQUIRED_COLUMNS, ExtractPolicy, override
from strandline.operators import params as pm
from strandline.operators import split as sp
from strandline.operators.ordered import Chunks
from strandline.plans import extract as ex

S = 1_000_000
BASE = "log_id int, time_us long, record_index long"


def us(t):
    return round(t * S)


FIELDS = {
    "PSCE": ("PE double, VE double, AE double, TAE double", (2, 5, 3, 1), range(1)),
    "PSCN": ("PN double, VN double, AN double, TAN double", (1, 4, 7, 2), range(1)),
    "PSCD": ("PD double, VD double, AD double, TAD double", (3, 6, 4, 1), range(10)),
    "ATT": ("Yaw double", (0,), range(10)),
    "XKF1": ("C double, PN double, PE double, PD double, VN double, VE double, VD double", (0, 11, 12, 13, 14, 15, 16), range(10)),
    "XKF4": ("C double, PI double, FS double, SS double, TS double, OFN double, OFE double", (0, 0, 0, 47, 0, 0, 0), range(10)),
    "GPS": ("I int, Status double", (0, 3), range(10)),
    "BAT": ("Inst int, Volt double, Curr double", (0, 11.7, 2.3), range(10)),
    "CTUN": ("ThO double", (0.4,), range(10)),
    "RCOU": ("C1 double, C2 double, C3 double, C4 double", (1100, 1200, 1300, 1400), range(10)),
}
PLAIN, MODE, CORE, UNITS, OTHER, RANGE = range(1, 7)  # one scenario per log


def scenario(log, name, i, values):
    """Ten sources over t = 1.0 .. 1.9; horizontal controllers report once. None drops the row."""
    if log == MODE and i == 3 and name in ("PSCD", "XKF1", "XKF4", "ATT"):
        return None
    if log == CORE and name == "XKF4" and i >= 5:  # primary changes at 1.5, core 1 speaks from 1.7
        return (1.0 if i >= 7 else 0.0, 1.0, *values[2:])
    if log == OTHER and name == "BAT":
        return (1, *values[1:])
    if log == OTHER and name == "CTUN":
        return None
    if log == RANGE and name == "BAT" and i == 4:
        return (0, 20.0, 2.3)
    return values


@pytest.fixture
def inputs(table):
    tables = {}
    for name, (fields, values, times) in FIELDS.items():
        rows = [(log, us(1 + i / 10), i, *v) for log in range(1, 7) for i in times if (v := scenario(log, name, i, values))]
        tables[name] = table(f"{BASE}, {fields}", rows)
    segments = table("log_id int, flight_id long, start_us long, end_us long", [(log, 1, us(1), us(2)) for log in range(1, 7)])
    modes = [(log, 1, us(1), us(2), "LOITER") for log in range(1, 7) if log != MODE]
    modes += [(MODE, 1, us(1), us(1.25), "LOITER"), (MODE, 1, us(1.25), us(2), "ALT_HOLD")]
    intervals = table("log_id int, flight_id long, start_us long, end_us long, mode string", modes)
    names = [f"{m}.{f.split()[0]}" for m, (fields, *_) in FIELDS.items() for f in fields.split(", ")]
    factors = table("log_id int, factors map<string,double>",
                    [(log, {"BAT.Volt": 0.5, "ATT.Yaw": 1.0} if log == UNITS else dict.fromkeys(names, 1.0)) for log in range(1, 7)])
    parm = table("log_id int, record_index long, name string, value double", [(log, n, f"SERVO{n}_FUNCTION", 32 + n) for log in range(1, 7) for n in range(1, 5)])
    return tables, segments, intervals, factors, pm.motor_map(parm)


@pytest.mark.parametrize("chunks", [Chunks(), Chunks(250_000)])
def test_ten_sources_on_one_grid(inputs, chunks):
    tables, segments, intervals, factors, motors = inputs
    found = ex.aligned_dataset(tables, segments, intervals, factors=factors, motors=motors, chunks=chunks).orderBy("time_us").collect()
    logs = {log: [r for r in found if r.log_id == log] for log in range(1, 7)}
    assert all(len(rows) == 10 for rows in logs.values()) and found[0].asDict().keys() >= set(REQUIRED_COLUMNS)

    rows = logs[PLAIN]
    first = rows[0]
    assert (first.px, first.py, first.pz) == (2, 1, -3) and (first.dx, first.dy, first.dz) == (2, 5, -3)
    assert first.yaw == pytest.approx(math.pi / 2)
    assert (first.battery_v, first.battery_i, first.throttle, first.motor1, first.motor4) == (11.7, 2.3, 0.4, 1100, 1400)
    assert [sum(r[f"valid_d{a}"] for r in rows) for a in "xyz"] == [2, 2, 10]
    assert rows[2].dx is None and rows[2].px == 12 and rows[2].source_px == "XKF1.PE[C=0]" and first.source_px == "PSCE.PE"
    assert not any(r.eligible_dx or r.eligible_dy for r in rows) and all(r.eligible_dz for r in rows)
    assert rows[1].age_psce_ms == 100 and rows[2].age_psce_ms == 200 and rows[2].mode == "LOITER"
    assert all(r.gps_valid and r.ekf_healthy for r in rows)

    rows = logs[MODE]  # values from before the mode change are not held, fresh ones restore validity
    assert not rows[3].valid_dz and rows[3].pz is None and rows[3].yaw is None and rows[3].mode == "ALT_HOLD"
    assert rows[4].valid_dz and rows[4].ekf_healthy

    rows = logs[CORE]  # the old core's status is masked until the new one speaks; its states never serve it
    assert [r.ekf_status_known for r in rows] == [True] * 5 + [False] * 2 + [True] * 3
    assert rows[5].ekf_primary_core == 1.0 and rows[5].ekf_solution_status is None
    assert rows[4].px == 12 and rows[5].px is None and rows[8].px is None

    first = logs[UNITS][0]  # unverified units leave nothing
    assert first.battery_v == 5.85 and first.battery_i is None and first.throttle is None
    first = logs[OTHER][0]  # another battery, no throttle message
    assert first.throttle is None and first.battery_v is None and first.valid_dz
    rows = logs[RANGE]  # flagged, not removed
    assert rows[4].outlier_battery_v and rows[4].outlier and not rows[4].eligible_dz and rows[4].battery_v == 20


@pytest.mark.parametrize("rows,expected", [
    (((1, 33), (2, 34), (3, 35), (4, 36)), {1: 1, 2: 2, 3: 3, 4: 4}),
    (((1, 33), (2, 33), (4, 36)), {4: 4}),  # two channels for motor 1
    (((1, 33), (1, 34)), None),  # changed during the log
    (((15, 33), (2, 34)), {2: 2}),  # channel out of range
])
def test_motor_mapping_must_be_unique_stable_and_in_range(table, rows, expected):
    parm = table("log_id int, record_index long, name string, value double", [(1, i, f"SERVO{n}_FUNCTION", v) for i, (n, v) in enumerate(rows)])
    got = pm.motor_map(parm).collect()
    assert (got[0].motors if got else None) == expected


TIMES = "log_id int, flight_id int, time_us long"


def test_chronological_split_never_divides_a_time(table):
    got = sp.split_chronological(table(TIMES, [(1, 1, t) for t in (1, 2, 2, 3, 4, 5)]), 0.5, Chunks(2)).orderBy("time_us").collect()
    assert [r.split for r in got] == ["train", "train", "train", "test", "test", "test"]
    many = table(TIMES, [(g, 1, t) for g in (1, 2) for t in range(101)])
    sizes = {(r.log_id, r.split): r["count"] for r in sp.split_chronological(many, 0.7, Chunks(7)).groupBy("log_id", "split").count().collect()}
    assert sizes == {(g, s): n for g in (1, 2) for s, n in (("train", 70), ("test", 31))}


def test_holdout_rules(table):
    df = table(TIMES + ", valid_dx boolean, valid_dy boolean, valid_dz boolean", [(1, f, t, True, True, True) for f, t in ((1, 1), (1, 2), (2, 3), (2, 4))])
    got = ex.split_dataset(df, override(ExtractPolicy(), holdout_flight_id=2)).orderBy("time_us").collect()
    assert [r.split for r in got] == ["train", "train", "test", "test"]
    for flight in (1, 9):
        with pytest.raises(ValueError):
            ex.split_dataset(df, override(ExtractPolicy(), holdout_flight_id=flight))
    assert sp.absent_flights(df, table("log_id int, flight_id int", [(1, 1), (1, 7)])).collect()[0].flight_id == 7
