import math

import pytest
from pyspark.sql import functions as F

from strandline.config import ScreenPolicy, override
from strandline.operators import intervals as iv
from strandline.operators import screening as sc

S = 1_000_000


def us(t):
    return round(t * S)


@pytest.fixture
def intervals(table):
    return table("log_id int, interval_id long, start_us long, end_us long, armed boolean, flight_id long",
                 [(1, 1, 0, us(1), False, None), (1, 2, us(1), us(3), True, 1), (2, 1, us(1), us(1.25), True, 1), (2, 2, us(1.25), us(3), True, 1)])


ROW = "log_id int, interval_id long, flight_id long, message string, time_us long, record_index long, actual double, target double, paired_ok boolean"


def test_candidate_durations(table):
    """Log 1: clean overlap case; log 2: a gap in the values and a mode boundary leave no candidate."""
    data, i = [], 0
    for message, times in (("PSCN", (1, 1.1, 1.2)), ("PSCE", (1.05, 1.15, 1.25)), ("PSCD", (1, 1.1, 1.2, 2.9))):
        for t in times:
            data.append((1, 2, 1, message, us(t), i := i + 1, 0.01, 0.0, True))
    for t, a in ((1, 1.0), (1.1, math.nan), (1.2, 1.0), (1.3, 1.0)):
        data.append((2, 1 if t < 1.25 else 2, 1, "PSCD", us(t), i := i + 1, a, 0.0, True))
    rows = table(ROW, data)
    edges = sc.evidence(rows, sc.usable_pair(), ("log_id", "flight_id", "interval_id", "message"))
    segments = table("log_id int, flight_id long", [(1, 1), (2, 1), (3, 1)])
    profile = table("log_id int, verified boolean", [(1, True), (2, True), (3, False)])
    got = {r.log_id: r for r in sc.flight_evidence(segments, rows, edges, profile).collect()}
    one = got[1]
    assert (one.pscn_active_us, one.xy_proxy_candidate_us, one.z_residual_candidate_us) == (us(0.2), us(0.15), us(0.2))
    assert one.x_residual_candidate_us == 0 and one.pscd_paired_samples == 4
    assert got[2].z_residual_candidate_us == 0 and got[2].pscd_active_us == us(0.2)
    assert got[3].z_residual_candidate_us is None and got[3].xy_proxy_candidate_us is None


def test_screening_codes(table):
    policy = ScreenPolicy()
    bat = table("log_id int, time_us long, record_index long, instance int, volt double, curr double, state string, context long",
                [(1, us(1 + i / 100), i, 0, 12.0, 0.2, "armed", 2) for i in range(20)])
    esc = table("log_id int, time_us long, record_index long, instance int, volt double, curr double, rpm double, state string, context long",
                [(1, us(1 + i / 100), 2 * i + j, j, 1.2, 0.0, 3000.0 * (1 + 3 * j), "armed", 2) for i in range(20) for j in (0, 1)])
    values = sc.battery_values(bat, policy).unionByName(sc.esc_values(esc, bat, [0, 1], policy))
    checks = sc.screen(values, policy.minimum_samples, policy.warning_fraction)
    got = {r.code for r in sc.warnings(checks).collect()}
    assert got == {"BAT_CURRENT_SUSPICIOUS", "ESC_VOLTAGE_IMPLAUSIBLE", "ESC_VOLTAGE_RATIO_IMPLAUSIBLE", "ESC_CURRENT_UNAVAILABLE",
                   "ESC_RPM_CROSS_INSTANCE_INCONSISTENT"}
    assert sc.warnings(sc.screen(values, override(policy, minimum_samples=100).minimum_samples)).count() == 0
    assert checks.where("code = 'BAT_VOLTAGE_IMPLAUSIBLE'").first().flagged_count == 0


def test_vibration_by_state_and_counters(table, intervals):
    samples = [(1, 0.1, 100, 5), (1, 0.2, 100, 7), (1, 1, 1, 10), (1, 1.1, 3, 12), (1, 1.2, 5, 15),
               (3, 0.1, 1, 100), (3, 0.2, 1, 110), (3, 1.0, 1, 15), (3, 1.1, 1, 0), (3, 1.2, 1, 3)]
    rows = table("log_id int, time_us long, record_index long, instance int, vibe_x double, vibe_y double, vibe_z double, clip double",
                 [(log, us(t), i, 0, x, x, x, c) for i, (log, t, x, c) in enumerate(samples)])
    unknown = intervals.where("log_id = 1").withColumn("log_id", F.lit(3)).withColumn("armed", F.when(F.col("interval_id") == 2, True))
    found = sc.vibration(iv.with_context(rows, intervals.unionByName(unknown))).where("field = 'vibe_x'").collect()
    got = {(r.log_id, r.state): r for r in found}
    armed = got[1, "armed"]
    assert armed.mean == 3 and armed.p95 == pytest.approx(4.8) and armed.increments == 5 and armed.max == 5
    assert got[1, "disarmed"].increments == 2 and got[1, "unknown"]["count"] == 0 and got[1, "unknown"].increments is None
    assert (got[3, "armed"].increments, got[3, "armed"].resets) == (3, 1)
    assert got[3, "unknown"]["count"] == 2 and got[3, "disarmed"]["count"] == 0


def test_checks_without_values_are_reported(table):
    schema = "log_id int, time_us long, record_index long, instance int, volt double, curr double, rpm double, state string, context string"
    bat = table(schema, [(1, 1, 0, 0, 12.0, None, 0, "disarmed", "a")])
    esc = table(schema, [(1, 1, 0, i, None, None, None, "disarmed", "a") for i in (0, 1)])
    policy = ScreenPolicy()
    checks = sc.screen(sc.battery_values(bat, policy).unionByName(sc.esc_values(esc, bat, [0, 1], policy))).collect()
    got = {(c.code, c.instance): (c.flagged_count, c.evaluated_count, c.fraction, c.sufficient_samples, c.warning) for c in checks}
    assert got["BAT_CURRENT_SUSPICIOUS", 0] == (0, 0, None, False, False) and got["BAT_VOLTAGE_IMPLAUSIBLE", 0][1] == 1
    assert {k for k, v in got.items() if v[1] == 0} == {("BAT_CURRENT_SUSPICIOUS", 0), ("ESC_RPM_CROSS_INSTANCE_INCONSISTENT", None)} | {
        (c, i) for c in ("ESC_VOLTAGE_IMPLAUSIBLE", "ESC_CURRENT_UNAVAILABLE", "ESC_VOLTAGE_RATIO_IMPLAUSIBLE") for i in (0, 1)}


def test_controller_reports(table):
    esc = table("log_id int, instance int, rpm double, volt double, curr double",
                [(1, 0, 1000, 1.2, 0), (1, 1, 4000, 1.2, None), (2, 0, 1000, 11, 1), (2, 1, 1100, 11, 0)])
    data = table("log_id int, battery_v double", [(1, 12.0), (2, 12.0)])
    got = {r.log_id: r for r in sc.esc_reports(esc, data).collect()}
    assert got[1].rpm_disagrees and got[1].voltage_disagrees and got[1].zero_current
    assert not got[2].rpm_disagrees and not got[2].voltage_disagrees and not got[2].zero_current


def test_esc_ratios_do_not_depend_on_the_order_of_a_sum(spark):
    """0.1 + 0.2 + 0.3 is above 0.6 in one order and not in the other; twice 0.1 * 3 must not disagree by that."""
    def reports(values):
        rows = [(1, 0, v, 1.0, 0.0) for v in values] + [(1, 1, v, 1.0, 0.0) for v in (0.1, 0.1, 0.1)]
        esc = spark.createDataFrame(rows, "log_id int, instance int, rpm double, volt double, curr double").coalesce(1)
        return sc.esc_reports(esc, spark.createDataFrame([(1, 1.0)], "log_id int, battery_v double")).first()

    assert 0.1 + 0.2 + 0.3 != 0.3 + 0.2 + 0.1
    one, other = reports((0.1, 0.2, 0.3)), reports((0.3, 0.2, 0.1))
    assert one == other and one.rpm_ratio == 2.0 and not one.rpm_disagrees
