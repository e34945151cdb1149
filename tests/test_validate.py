from functools import reduce

import pytest
from pyspark.sql import functions as F

from strandline.config import ExtractPolicy, override
from strandline.operators import flags as fg
from strandline.operators import rules as ru
from strandline.plans.validate import find_violations, validate_dataset

S = 1_000_000
SOURCES = ("psce", "pscn", "pscd", "att", "bat", "rcou", "ctun")


@pytest.fixture(scope="module")
def dataset(spark):
    """Twenty rows at 10 Hz from t = 1, one flight."""
    t = F.col("time_us")
    df = spark.range(20).select(F.lit(1).alias("log_id"), F.lit(1).alias("flight_id"), F.col("id").alias("row_seq"),
                                (S + F.col("id") * 100_000).alias("time_us"), F.lit("ALT_HOLD").alias("mode"), F.lit(1).alias("continuity_id"))
    columns = {"time_s": t / S}
    columns.update({c: (t / S) * 0.1 for c in ("px", "py", "pz", "vx", "vy", "vz", "yaw")})
    for a in "xyz":
        columns[f"a{a}"] = F.lit(-1.0) + F.col("row_seq") * (2.0 / 19)
        columns[f"a{a}_target"] = F.lit(0.2)
        columns[f"valid_d{a}"] = F.lit(True)
    columns.update({"battery_v": F.lit(11.4), "battery_i": F.lit(5.0), "throttle": F.lit(0.5)})
    columns.update({f"motor{i}": F.lit(1500.0) for i in range(1, 5)})
    for s in SOURCES:
        columns[f"age_{s}_ms"] = F.lit(20.0)
        columns[f"source_time_{s}_us"] = t - 20_000
    for a, m in (("x", "PSCE"), ("y", "PSCN"), ("z", "PSCD")):
        columns[f"source_p{a}"], columns[f"source_v{a}"] = F.lit(m + ".P"), F.lit(m + ".V")
    df = df.withColumns(columns).withColumns({f"d{a}": F.col(f"a{a}") - F.col(f"a{a}_target") for a in "xyz"})
    return df.withColumn("outlier", F.lit(False)).cache()


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([(1, 1, 900_000, 3 * S)], "log_id int, flight_id int, start_us long, end_us long")


def with_split(df):
    return df.withColumn("split", F.when(F.col("row_seq") < 14, "train").otherwise("test"))


def rules_found(df, segments, split=None, **more):
    found, _ = find_violations(df, with_split(df) if split is None else split, segments, **more)
    return {(r.log_id, r.rule) for r in found.collect()}


def test_clean_table_passes_and_reports(dataset, segments):
    policy = override(ExtractPolicy(), minimum_samples=10, minimum_train=10, minimum_test=5)
    out = validate_dataset(dataset, with_split(dataset), segments, policy)
    assert out["violations"].count() == 0
    ready = {r.axis: r for r in out["readiness"].collect()}
    assert ready["z"].status == "READY_WITH_WARNINGS" and (ready["z"].eligible, ready["z"].train, ready["z"].test) == (20, 14, 6)
    assert ready["x"].status == "NOT_READY" and ready["xyz"].status == "NOT_READY"
    stats = {r.field: r for r in out["column_stats"].collect()}
    assert stats["battery_v"].constant and not stats["az"].constant and stats["dz"].finite_count == 20
    flight = out["quality_by_flight"].first()
    assert (flight.row_count, flight.valid_dz, flight.outlier_count, flight.state_nan_percentage) == (20, 20, 0, 0)
    _, checked = find_violations(dataset, with_split(dataset), segments)
    strict = ru.readiness(checked, with_split(checked), out["violations"], ExtractPolicy()).where("axis = 'z'").first()
    assert strict.status == "NOT_READY" and len(strict.reasons) == 2


def at(row, column, value):
    return lambda df: df.withColumn(column, F.when(F.col("row_seq") == row, F.lit(value)).otherwise(F.col(column)))


# One corruption per log; all logs are checked together.
CELLS = [
    (at(3, "dz", 5.0), "residual_identity"),
    (at(3, "valid_dz", False), "residual_without_flag"),
    (at(3, "az", None), "valid_without_values"),
    (at(3, "age_pscd_ms", 400.0), "source_age"),
    (at(3, "source_time_pscd_us", 9_000_000), "source_time"),
    (at(3, "age_bat_ms", 999.0), "used_source_age"),
    (at(3, "source_time_att_us", 0), "used_source_time"),
    (at(0, "source_time_ctun_us", 100_000), "source_outside_flight"),
    (at(3, "time_us", 1_200_000), "duplicate_time"),
    (at(3, "time_us", 1_100_000), "strictly_increasing"),
    (at(19, "time_us", 4_000_000), "inside_flight"),
    (at(3, "flight_id", 2), "unique_boundary"),
    (at(3, "flight_id", None), "flight_id"),
    (at(3, "px", float("inf")), "finite"),
    (at(3, "yaw", None), "eligibility"),
]


def fleet(dataset, segments, changes):
    rows = [change(dataset).withColumn("log_id", F.lit(100 + i)) for i, change in enumerate(changes)]
    ids = F.explode(F.sequence(F.lit(100), F.lit(99 + len(changes)))).alias("log_id")
    return reduce(lambda a, b: a.unionByName(b), rows), segments.select(ids, "flight_id", "start_us", "end_us")


def test_one_wrong_cell_per_log_is_found(dataset, segments):
    recorded = dataset.withColumn("eligible_dz", F.lit(True))
    df, known = fleet(recorded, segments, [change for change, _ in CELLS] + [lambda d: d])
    found = rules_found(df, known)
    for i, (_, rule) in enumerate(CELLS):
        assert (100 + i, rule) in found, rule
    assert not [f for f in found if f[0] == 100 + len(CELLS)]


SPLITS = [
    (lambda s: s.withColumn("split", F.lit("other")), "split_label"),
    (lambda s: s.withColumn("split", F.when(F.col("row_seq") == 19, "train").otherwise(F.col("split"))), "split_order"),
    (lambda s: s.unionByName(s.where("row_seq = 13").withColumn("split", F.lit("test"))), "split_time_shared"),
    (lambda s: s.unionByName(s.where("row_seq = 13")), "split_duplicate"),
    (lambda s: s.withColumn("time_us", F.when(F.col("row_seq") == 2, 1_234_567).otherwise(F.col("time_us"))), "split_membership"),
    (at(2, "dz", 9.0), "split_value"),
    (at(2, "valid_dx", False), "split_flag"),
]


def test_wrong_splits_are_found(dataset, segments):
    df, known = fleet(dataset, segments, [lambda d: d] * len(SPLITS))
    split, _ = fleet(with_split(dataset), segments, [change for change, _ in SPLITS])
    found = rules_found(df, known, split)
    for i, (_, rule) in enumerate(SPLITS):
        assert (100 + i, rule) in found, rule


def test_text_tables_and_missing_columns(dataset, segments):
    text = dataset.withColumn("px", F.when(F.col("row_seq") == 3, "abc").otherwise(F.col("px").cast("string")))
    text = text.withColumn("valid_dz", F.when(F.col("row_seq") == 4, "maybe").otherwise("true")).drop("vz", "age_bat_ms")
    found = {rule for _, rule in rules_found(text, segments)}
    assert {"numeric", "boolean", "required_column", "provenance_missing"} <= found


def test_recorded_counts_digests_and_frames(dataset, segments, table):
    counts = table("log_id int, valid_dx long, valid_dy long, valid_dz long", [(1, 20, 20, 19)])
    lineage = table("log_id int, column string, output_unit string, output_frame string", [(1, "ax", "m/s/s", "NED"), (1, "dz", None, "ENU"), (1, "az", "m/s/s", "ENU")])
    digests = table("log_id int, name string, digest string", [(1, "a", "x"), (1, "b", "y")])
    actual = table("log_id int, name string, digest string", [(1, "a", "x")])
    found, _ = find_violations(dataset, with_split(dataset), segments, recorded_counts=counts, lineage=lineage, expected_digests=digests, actual_digests=actual)
    got = {(r.rule, r.scope) for r in found.collect()}
    assert got == {("recorded_counts", "valid_dz"), ("output_frame", "ax"), ("output_unit", "dz"), ("artifact_digest", "b")}


def test_jumps_and_ranges_are_counted(dataset):
    df = at(5, "px", 100.0)(at(7, "battery_v", 30.0)(dataset))
    got = {r.flag: r.n_rows for r in fg.flag_counts(fg.dataset_flags(df, ExtractPolicy())).collect()}
    assert got == {"outlier_position_jump": 2, "outlier_battery_voltage": 1}


def test_empty_log_is_reported(dataset, table):
    logs = table("log_id int", [(1,), (2,)])
    assert [(r.log_id, r.rule) for r in ru.presence(dataset, logs).collect()] == [(2, "empty")]


def test_extraction_gate(table):
    logs = table("log_id int, digest string, inspected_digest string", [(1, "a", "a"), (2, "a", "b"), (3, "a", "a")])
    identity = table("log_id int, audited boolean", [(1, True), (2, True), (3, False)])
    covered = table("log_id int, status string, anomalies long", [(1, "PASS", 0), (2, "PASS_WITH_WARNINGS", 1), (3, "FAIL", 2)])
    timing = table("log_id int, message string, backwards long", [(1, "GPS", 0), (2, "GPS", 3), (3, "MSG", 5)])
    segments = table("log_id int, flight_id int", [(1, 1), (2, 1)])
    gate = lambda allow: {(r.log_id, r.rule) for r in ru.extraction_gate(logs, covered, identity, timing, segments, ("GPS",), allow).collect()}
    assert gate(False) == {(2, "content_digest"), (2, "parser"), (2, "backward_time"), (3, "firmware"), (3, "parser"), (3, "no_flight")}
    assert gate(True) == gate(False) - {(2, "parser")}
