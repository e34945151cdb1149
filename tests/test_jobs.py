"""Jobs 2 and 3 from end to end: gates, releases, ordered notices."""

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.config import ExtractPolicy, override
from strandline.operators import notices as no
from strandline.operators.ordered import first_appearances
from strandline.plans import extract as ex
from strandline.plans.jobs import JobRefused, LogInputs, extract_job, policy_from, policy_text, validate_job
from strandline.sources.releases import commit_numbers, draft, read_release
from tests.test_extract import FIELDS, MODE, inputs, us  # noqa: F401

LOGS = range(1, 7)
POLICY = override(ExtractPolicy(), minimum_samples=5, minimum_train=3, minimum_test=2)


@pytest.fixture
def fleet(spark, table, inputs):  # noqa: F811
    tables, segments, intervals, _, _ = inputs
    units = {(m, f): u[0] for m, fields in ex.FIELD_UNITS.items() for f, u in fields.items()} | {("RCOU", f"C{i}"): "us" for i in range(1, 5)}
    catalog = table("log_id int, message string, field string, unit string, factor double, unit_verified boolean",
                    [(log, m, f, u, 1.0, True) for log in LOGS for (m, f), u in units.items()])
    records = None
    for name, rows in tables.items():
        part = rows.select("log_id", F.lit(name).alias("message"), F.lit(None).cast("int").alias("instance"), "time_us", "record_index")
        records = part if records is None else records.unionByName(part)
    parm = [(log, n, f"SERVO{n}_FUNCTION", 32 + n) for log in LOGS for n in range(1, 5) if log != MODE]
    return LogInputs(
        tables | {"ESC": table("log_id int, time_us long, record_index long, Instance int, RPM double, Volt double, Curr double",
                               [(1, us(1), 1, i, 100.0 * (i + 1) ** 2, 30.0, 0.0) for i in range(2)])},
        records,
        table("log_id int, digest string, inspected_digest string", [(log, "d", "d") for log in LOGS]),
        table("log_id int, audited boolean", [(log, True) for log in LOGS]),
        table("log_id int, status string, anomalies long, trailing_kind string", [(log, "PASS", 0, None) for log in LOGS]),
        catalog,
        table("log_id int, message string, key string, definitions long", []),
        table("log_id int, record_index long, name string, value double", parm),
        segments.withColumn("open_ended", F.lit(False)), intervals,
    )


def test_release_of_a_clean_fleet_and_its_validation(spark, fleet, tmp_path):
    earlier = spark.createDataFrame([(1, 2, "backward_time", "X", "1"), (1, 1, "odd", "", ""), (1, 3, "armed_is_not_airborne", "", "")],
                                    "log_id int, place int, code string, scope string, detail string")
    release = extract_job(spark, f"{tmp_path}/r", replace(fleet, notices=earlier), POLICY)
    claims = {r.log_id: r for r in release["manifest"].collect()}
    assert sorted(claims) == list(LOGS) and claims[1].flight_ids == [1]
    assert (claims[1].n_rows, claims[1].valid_dx, claims[1].valid_dz, claims[1].eligible_dz, claims[1].split_rows) == (10, 2, 10, 10, 10)
    assert policy_from(claims[1].policy) == POLICY and policy_text(policy_from(claims[1].policy)) == claims[1].policy
    assert release.recorded["dataset"]["rows"] == 60 and release["esc"].count() == 2
    said = [(r.code, r.scope) for r in release["notices"].where("log_id = 1").orderBy("place").collect()]
    assert said == [("odd", ""), ("backward_time", "X"), ("armed_is_not_airborne", "")] + [
        (c, "") for c in no.EXTRACTION_NOTICES if c != "armed_is_not_airborne"]
    assert [r.detail for r in release["notices"].where("log_id = 2 and code = 'motor_mapping_unresolved'").collect()] == ["4"]

    reports = validate_job(spark, f"{tmp_path}/r", f"{tmp_path}/v")
    assert reports["violations"].collect() == []
    stats = {(r.log_id, r.axis): r for r in reports["residual_statistics"].collect()}
    assert stats[1, "x"].rmse == pytest.approx(2) and stats[1, "z"].count_valid == 10
    assert {r.log_id: r.median_dt_us for r in reports["sampling"].collect()}[1] == 100_000
    said = [(r.code, r.scope, r.detail) for r in reports["notices"].where("log_id = 1").orderBy("place").collect()]
    codes = [c for c, _, _ in said]
    assert codes[:3] == ["odd", "backward_time", "armed_is_not_airborne"] and len(said) == len(set(said))
    assert codes[-3:] == ["rotor_speeds_disagree", "voltages_disagree", "rotor_current_zero"]
    constant = [s for c, s, _ in said if c == "constant_column"]
    assert constant[:3] == ["px", "py", "pz"] or constant[:2] == ["pz", "vz"]
    assert reports["readiness"].where("axis = 'z' and log_id = 1").first().status == "READY_WITH_WARNINGS"


@pytest.mark.parametrize("fault,step,rule", [
    (dict(catalog=lambda t: t.withColumn("unit_verified", (F.col("log_id") != 3) | (F.col("field") != "Volt"))), "units", "unit_gate"),
    (dict(conflicts=lambda t: t.union(t.sparkSession.createDataFrame([(2, "UNIT", "s", 2)], t.schema))), "inputs", "metadata_conflict"),
    (dict(records=lambda t: t.withColumn("time_us", F.when((F.col("message") == "ATT") & (F.col("record_index") == 5), 1).otherwise(F.col("time_us")))),
     "inputs", "backward_time"),
    (dict(logs=lambda t: t.withColumn("inspected_digest", F.lit("other"))), "inputs", "content_digest"),
    (dict(identity=lambda t: t.withColumn("audited", F.col("log_id") != 4)), "inputs", "firmware"),
    (dict(covered=lambda t: t.withColumn("status", F.lit("FAIL"))), "inputs", "parser"),
    (dict(segments=lambda t: t.where("log_id <> 5")), "inputs", "no_flight"),
])
def test_a_refused_job_leaves_nothing_readable(spark, fleet, tmp_path, fault, step, rule):
    broken = replace(fleet, **{name: change(getattr(fleet, name)) for name, change in fault.items()})
    with pytest.raises(JobRefused) as refusal:
        extract_job(spark, f"{tmp_path}/r", broken, POLICY)
    assert refusal.value.step == step and {v.rule for v in refusal.value.shown} == {rule}
    assert commit_numbers(spark, f"{tmp_path}/r") == [] and list(Path(f"{tmp_path}/r/runs").iterdir()) == []
    with pytest.raises(ValueError, match="nothing is published"):
        validate_job(spark, f"{tmp_path}/r", f"{tmp_path}/v")


def test_skipping_refused_logs_and_choosing_flights(spark, fleet, tmp_path):
    unverified = fleet.catalog.withColumn("unit_verified", (F.col("log_id") != 3) | (F.col("field") != "Volt"))
    some = spark.createDataFrame([(1, 1), (3, 1)], "log_id int, flight_id long")
    release = extract_job(spark, f"{tmp_path}/r", replace(fleet, catalog=unverified), POLICY, some, skip=True)
    assert [r.log_id for r in release["manifest"].collect()] == [1]
    assert {(r.log_id, r.rule) for r in release["gate_units"].collect()} == {(3, "unit_gate")}
    with pytest.raises(JobRefused, match="flights gate"):
        extract_job(spark, f"{tmp_path}/r", fleet, POLICY, spark.createDataFrame([(1, 9)], "log_id int, flight_id long"))
    assert read_release(spark, f"{tmp_path}/r").number == 0  # the earlier release is still the one that is read


def test_changed_files_and_claims_are_found(spark, fleet, tmp_path):
    release = extract_job(spark, f"{tmp_path}/r", fleet, POLICY)
    path = f"{tmp_path}/r/runs/{release.run}/dataset"
    rows = spark.createDataFrame(release["dataset"].collect(), release["dataset"].schema)
    rows.withColumn("battery_v", F.when((F.col("log_id") == 2) & (F.col("row_seq") == 4), 12.0).otherwise(F.col("battery_v"))).write.mode("overwrite").parquet(path)
    claims = spark.createDataFrame(release["manifest"].collect(), release["manifest"].schema)
    wrong = claims.withColumn("residual_sign", F.when(F.col("log_id") == 1, "d = a_target - a_actual").otherwise(F.col("residual_sign")))
    wrong.withColumn("valid_dz", F.col("valid_dz") + (F.col("log_id") == 6).cast("int")).write.mode("overwrite").parquet(f"{tmp_path}/r/runs/{release.run}/manifest")
    found = {(r.log_id, r.rule, r.scope) for r in validate_job(spark, f"{tmp_path}/r", f"{tmp_path}/v")["violations"].collect()}
    assert {(2, "artifact_digest", "dataset"), (2, "split_value", "battery_v"), (1, "residual_sign", "manifest"), (6, "recorded_counts", "valid_dz"),
            (1, "artifact_digest", "manifest"), (6, "artifact_digest", "manifest")} == found


def test_releases_are_numbered_and_kept(spark, tmp_path):
    root = f"{tmp_path}/r"
    for n in (3, 5):
        with draft(spark, root) as run:
            run.write("t", spark.range(n).withColumn("log_id", F.col("id") % 2))
    with pytest.raises(RuntimeError, match="stop"):
        with draft(spark, root) as run:
            run.write("t", spark.range(1).withColumn("log_id", F.lit(0)))
            raise RuntimeError("stop")
    assert commit_numbers(spark, root) == [0, 1]
    assert read_release(spark, root)["t"].count() == 5 and read_release(spark, root, 0)["t"].count() == 3
    with pytest.raises(ValueError, match="not published"):
        read_release(spark, root, 7)
    with pytest.raises(KeyError):
        read_release(spark, root)["other"]


def test_first_appearances_keep_order_across_chunks(spark, table):
    rows = [(g, i, v) for g in (1, 2) for i, v in enumerate("dbadcbxaxyd" * 3)] + [(3, 0, None), (3, 5, "q"), (3, 7, None)]
    got = first_appearances(table("log_id int, record_index long, v string", rows), ["log_id"], ["v"], ["record_index"], F.floor(F.col("record_index") / 2))
    found = sorted((r.log_id, r.place, r.record_index, r.v) for r in got.collect())
    for g in (1, 2):
        firsts = list(dict.fromkeys("dbadcbxaxyd" * 3))
        assert [f[3] for f in found if f[0] == g] == firsts and [f[1] for f in found if f[0] == g] == list(range(1, len(firsts) + 1))
    assert found[-2:] == [(3, 1, 0, None), (3, 2, 5, "q")]
