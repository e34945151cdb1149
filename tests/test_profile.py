import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.config import RatePolicy
from strandline.operators import profile as pf


def test_distribution_by_hand(table):
    df = table("log_id int, v double", [(1, v) for v in (1, 2, 3, 10, None, math.nan, math.inf)] + [(2, math.nan)])
    got = {r.log_id: r.asDict() for r in pf.distribution(df, ["log_id"], "v").collect()}
    assert got[1]["finite_count"] == 4 and got[1]["median"] == 2.5 and got[1]["range"] == 9 and got[1]["mean"] == 4
    assert got[1]["p95"] == pytest.approx(8.95) and got[1]["std"] == pytest.approx(np.std([1, 2, 3, 10]))
    assert got[2]["finite_count"] == 0 and got[2]["median"] is None


def test_percentiles_are_exact(spark):
    rng = random.Random(5)
    data = [(0, rng.gauss(0, 1)) for _ in range(900)] + [(0, 0.25)] * 300 + [(None, float(rng.randint(0, 9))) for _ in range(200)]
    data += [(g, rng.random()) for g in range(1, 4) for _ in range(5)]
    df = spark.createDataFrame(data, "g int, v double")
    points = {"lo": 0.0, "p1": 0.01, "q": 0.3, "med": 0.5, "p99": 0.99, "hi": 1.0}
    got = {r.g: r for r in pf.exact_percentiles(df, ["g"], "v", points).collect()}
    for g in (0, 1, 2, 3, None):
        values = [v for h, v in data if h == g]
        for name, f in points.items():
            assert got[g][name] == pytest.approx(np.percentile(values, f * 100), rel=1e-12), (g, name)


def records(table, times, instance=None, message="ATT"):
    return table("log_id int, message string, instance int, time_us long, record_index long",
                 [(1, message, instance, None if t is None else round(t * 1e6), i) for i, t in enumerate(times)])


def test_rates_tell_span_nominal_and_active_apart(table):
    r = pf.timing_stats(records(table, [0, 0.1, 0.2, 10, 10.1]), ["log_id", "message"]).first()
    assert r.span_rate_hz == pytest.approx(4 / 10.1) and r.nominal_rate_hz == pytest.approx(10)
    assert r.active_rate_hz == pytest.approx(10) and r.active_duration_s == pytest.approx(0.3) and r.active_windows == 2


def test_clock_faults_are_counted_in_acquisition_order(table):
    r = pf.timing_stats(records(table, [1, 1, 3, 2, None, 4]), ["log_id", "message"]).first()
    assert (r.n, r.timestamped, r.duplicates, r.backwards) == (6, 5, 1, 1)
    assert r.first_time_s == 1 and r.last_time_s == 4 and r.min_dt_s == -1
    lone = pf.timing_stats(records(table, [5]), ["log_id", "message"]).first()
    assert lone.span_rate_hz is None and lone.active_windows == 1 and lone.gap_threshold_s == RatePolicy().absolute_gap_threshold_s
    none = pf.timing_stats(records(table, [None]), ["log_id", "message"]).first()
    assert (none.n, none.timestamped, none.active_windows) == (1, 0, 0)


def test_mixed_instances_withhold_rates(table):
    rows = records(table, [0, 0.1, 0.2], 0).unionByName(records(table, [0.05, 0.15], 1).withColumn("record_index", F.col("record_index") + 10))
    r = pf.message_timing(rows).first()
    assert r.rate_scope == "mixed_instances_count_only" and r.nominal_rate_hz is None and r.n == 5
    per = {x.instance: x for x in pf.instance_timing(rows).collect()}
    assert per[0].nominal_rate_hz == pytest.approx(10) and per[1].n == 2


def test_inventory_counts_three_classes_at_two_scopes(table):
    rows = table("log_id int, message string, instance int, field string, value string",
                 [(1, "A", i % 2, "f", v) for i, v in enumerate(["1", "2", "NaN", None, "x", "4"])] + [(1, "B", None, "g", "3")])
    got = {(r.message, r.inventory_scope, r.instance): r for r in pf.inventory(rows).collect()}
    a = got["A", "message", None]
    assert (a.sample_count, a.finite_count, a.invalid_count, a.nonnumeric_count) == (6, 3, 2, 1)
    assert (a.min, a.max, a.median) == (1, 4, 2)
    assert got["A", "instance", "0"].sample_count == 3 and ("B", "instance", None) not in got


def test_value_cells_sort_like_values(spark):
    values = sorted([0.0, 5e-324, 1e-300, 0.1, 0.5, 1.0, 1.5, 2.0, 1e6, 1e300] + [-v for v in (5e-324, 0.1, 1.0, 7.0, 1e300)])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", pf.value_cell(F.col("v")).alias("c")).orderBy("v").collect()
    assert [r.c for r in rows] == sorted(r.c for r in rows)


def test_missing_instances_are_a_group(table):
    rows = records(table, [0, 0.1, 0.2], 0).unionByName(records(table, [0.05, 0.15]).withColumn("record_index", F.col("record_index") + 10))
    assert pf.message_timing(rows).first().rate_scope == "mixed_instances_count_only"
    assert {r.instance: r.n for r in pf.instance_timing(rows).collect()} == {0: 3, None: 2}
    values = table("log_id int, message string, instance int, field string, value string", [(1, "A", 0, "f", "1"), (1, "A", None, "f", "2")])
    got = {(r.inventory_scope, r.instance): r.sample_count for r in pf.inventory(values).collect()}
    assert got == {("message", None): 2, ("instance", "0"): 1, ("instance", None): 1}


def test_column_stats_flag_constant_and_missing(table):
    df = table("a double, b double", [(1, 5), (2, 5), (None, 5), (3, None)])
    got = {r.field: r for r in pf.column_stats(df, ["a", "b"]).collect()}
    assert got["a"].missing_pct == 25 and not got["a"].constant and got["b"].constant and got["a"].p99 == pytest.approx(2.98)
