"""Catalog, plot data, packets, digests, readers and writers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.config import NUMERIC_COLUMNS
from strandline.operators import catalog as cg
from strandline.operators import digest as dg
from strandline.operators import packets as pk
from strandline.operators import params as pm
from strandline.operators import series as se
from strandline.plans import inspect as ins
from strandline.sources import logs, sinks


@pytest.fixture
def metadata(table):
    fmt = table("log_id int, record_index long, type int, name string, length int, format string, columns string",
                [(1, 0, 1, "ATT", 11, "QBC", "TimeUS,I,Yaw"), (1, 1, 2, "BAT", 20, "Qff", "TimeUS,CurrTot,Raw")])
    fmtu = table("log_id int, record_index long, fmt_type int, unit_ids string, mult_ids string", [(1, 9, 1, "s#d", "F-B"), (1, 8, 2, "sa", "FC")])
    unit = table("log_id int, record_index long, id int, label string",
                 [(1, 2, ord("s"), "s"), (1, 3, ord("d"), "deg"), (1, 4, ord("#"), "instance"), (1, 5, ord("a"), "Ah"), (1, 6, ord("a"), "Ah")])
    single = float(np.float32(1e-6))
    mult = table("log_id int, record_index long, id int, mult double",
                 [(1, 2, ord("F"), single), (1, 3, ord("B"), 0.01), (1, 4, ord("-"), 0), (1, 5, ord("C"), 0.001)])
    return fmt, fmtu, unit, mult


def test_catalog_resolves_units_late_and_exactly(metadata, table):
    got = {(r.message, r.field): r for r in cg.field_catalog(*metadata).collect()}
    time = got["ATT", "TimeUS"]
    assert time.unit_verified and time.factor == 1e-6 and time.multiplier_raw != 1e-6 and time.decoded_unit == "us"
    assert got["ATT", "I"].factor == 1 and got["ATT", "I"].instance_field == "I"  # '-' with 0 means no multiplier
    assert got["ATT", "Yaw"].factor == 1 and got["ATT", "Yaw"].decoded_unit == "deg"  # 0.01 is already applied
    assert got["BAT", "CurrTot"].decoded_unit == "mAh" and got["BAT", "CurrTot"].canonical_unit == "Ah"
    assert not got["BAT", "Raw"].unit_verified and got["BAT", "Raw"].factor is None
    assert cg.metadata_conflicts(*metadata).count() == 0
    fmt, fmtu, unit, mult = metadata
    changed = unit.unionByName(table(unit.schema.simpleString()[7:-1].replace(":", " "), [(1, 99, ord("d"), "rad")]))
    assert [(r.message, r.key) for r in cg.metadata_conflicts(fmt, fmtu, changed, mult).collect()] == [("UNIT", "100")]


def test_unit_gate_and_time_gate(metadata, table):
    catalog = cg.field_catalog(*metadata)
    required = table("message string, field string, allowed array<string>", [("ATT", "Yaw", ["deg"]), ("BAT", "CurrTot", ["A"]), ("GPS", "Status", [""])])
    assert [r.scope for r in cg.unit_gate(catalog, required).collect()] == ["BAT.CurrTot"]
    rows = table("log_id int, message string, time_us long", [(1, "ATT", 5), (1, "NOPE", 6)])
    assert {r.message: r.time_us for r in cg.verified_times(rows, catalog).collect()} == {"ATT": 5, "NOPE": None}
    assert cg.time_gate(rows, catalog).count() == 0


def test_lineage_table_names_every_column(spark):
    following = {r.column: (r.message, r.output_unit) for r in cg.following_lineage(spark).collect()}
    assert following["age_gps_ms"] == ("GPS", "ms") and following["motor3"] == ("RCOU", "us") and following["valid_dx"][1] == "bool"
    origins = {(r.column, r.message): r for r in cg.lineage_rules(spark).collect()}
    assert origins["pz", "PSCD"].field == "PD" and origins["pz", "XKF1"].field == "PD" and origins["yaw", "ATT"].output_frame == "ENU"
    assert set(NUMERIC_COLUMNS) - {"time_s"} <= set(following) | {c for c, _ in origins}


def test_texts_and_calibration(table):
    msg = table("log_id int, record_index long, text string", [(1, 2, "ArduCopter late"), (1, 1, "ArduCopter V4.8 (2b5cebb9)"), (1, 3, "Pixhawk6"), (1, 4, "Frame: QUAD")])
    r = ins.profile_of(msg).first()
    assert (r.firmware, r.board, r.frame, r.verified) == ("ArduCopter V4.8 (2b5cebb9)", "Pixhawk6", "Frame: QUAD", True)
    names = table("log_id int, name string, value double", [(1, n, 0) for n in ("BATT_X", "SERVO1_FUNCTION", "SERVO1_MIN", "FRAME_TYPE", "OTHER")])
    assert {r.name for r in pm.calibration_parameters(names).collect()} == {"BATT_X", "SERVO1_FUNCTION", "FRAME_TYPE"}


def test_runs_break_at_boundaries_faults_and_gaps(table):
    rows = table("log_id int, row_seq long, time_us long, flight_id int, continuity_id int, mode string, ok boolean",
                 [(1, i, t, f, 1, m, ok) for i, (t, f, m, ok) in enumerate([
                     (0, 1, "A", True), (100, 1, "A", False), (200, 1, "A", False), (300, 1, "A", True), (900, 1, "A", False),
                     (1000, 1, "B", True), (1000, 1, "B", True), (1100, 2, "B", False)])])
    done = se.runs(rows).cache()
    assert [r.run_id for r in done.orderBy("row_seq").collect()] == [1, 1, 1, 1, 2, 3, 4, 5]
    spans = [(r.run_id, r.left_us, r.right_us) for r in se.invalid_spans(done, F.col("ok")).orderBy("left_us").collect()]
    assert spans == [(1, 50.0, 250.0), (2, 850.0, 950.0), (5, 1050.0, 1150.0)]


def test_histogram_equals_numpy(table):
    values = [0.1, 0.2, 0.2, 0.5, 0.9, 1.0, 1.7, 2.0, 2.0, 3.1]
    rows = table("log_id int, d double, ok boolean", [(1, v, True) for v in values] + [(1, 9.0, False), (1, math.nan, True), (2, 4.0, True)])
    got = se.residual_histogram(rows, "d", F.col("ok")).orderBy("log_id", "bin").collect()
    counts, edges = np.histogram(values, bins=3)
    assert [r.n_values for r in got if r.log_id == 1] == list(counts) and got[0].excluded == 2
    assert [r.left_edge for r in got if r.log_id == 1] == pytest.approx(list(edges[:-1]))
    assert [(r.n_values, r.left_edge) for r in got if r.log_id == 2] == [(1, 3.5)]


def test_mode_codes_by_first_appearance(table):
    rows = table("log_id int, time_us long, mode string", [(1, 0, "B"), (1, 1, "A"), (1, 2, "B"), (1, 3, None)])
    assert {r.mode: r.code for r in se.mode_codes(rows).collect()} == {"B": 0, "A": 1}


def test_byte_coverage_and_parser_status(table):
    packets = table("log_id int, record_index long, offset long, length long",
                    [(1, 0, 0, 10), (1, 1, 10, 5), (2, 0, 0, 10), (2, 1, 14, 6), (3, 0, 0, 10), (4, 0, 3, 7)])
    files = table("log_id int, file_bytes long, tail_expected long", [(1, 15, None), (2, 20, None), (3, 14, 20), (4, 12, 20)])
    gaps = pk.packet_gaps(packets)
    assert sorted((r.log_id, r.gap_offset, r.byte_count) for r in gaps.collect()) == [(2, 10, 4), (4, 0, 3)]
    got = {r.log_id: (r.status, r.trailing_kind, r.anomalies) for r in pk.parser_status(pk.coverage(packets, files, gaps)).collect()}
    assert got == {1: ("PASS", None, 0), 2: ("FAIL", None, 1), 3: ("PASS_WITH_WARNINGS", "truncated_message", 1), 4: ("FAIL", "unparsed_trailing_bytes", 2)}


def test_digests_ignore_order_and_see_changes(spark, table, tmp_path):
    df = table("log_id int, a int, b string", [(1, i, str(i)) for i in range(20)])
    same = dg.table_digest(df.repartition(5).orderBy(F.desc("a")).select("b", "a", "log_id")).first()
    assert dg.table_digest(df).first() == same
    assert dg.table_digest(df.withColumn("a", F.when(F.col("a") == 3, 4).otherwise(F.col("a")))).first().digest != same.digest
    moved = [table("log_id int, a int, b int", [row]) for row in ((1, None, 1), (1, 1, None))]
    assert dg.table_digest(moved[0]).first().digest != dg.table_digest(moved[1]).first().digest
    (tmp_path / "x.txt").write_bytes(b"abc")
    r = dg.file_digests(spark, str(tmp_path)).first()
    assert (r.name, r.digest) == ("x.txt", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_writers_and_readers_round_trip(spark, table, tmp_path):
    df = table("log_id int, flight_id int, time_us long, v double", [(1, 1, 5, 0.1 + 0.2), (1, 2, 6, None), (2, 1, 7, 1e-17)])
    sinks.write_flights(df, f"{tmp_path}/flights")
    assert sorted(p.name for p in (tmp_path / "flights" / "log_id=1").iterdir()) == ["flight_id=1", "flight_id=2"]
    assert spark.read.parquet(f"{tmp_path}/flights").where("log_id = 1 and flight_id = 2").count() == 1
    sinks.write_text_dataset(df, f"{tmp_path}/text")
    text = logs.read_text_table(spark, f"{tmp_path}/text", df.columns)
    got = {r.time_us: r.v for r in text.collect()}
    assert float(got["5"]) == 0.1 + 0.2 and got["6"] == "NaN" and float(got["7"]) == 1e-17
    sinks.write_reports({"a": df}, f"{tmp_path}/reports")
    assert logs.read_optional(spark, f"{tmp_path}/reports/a", df.schema).count() == 3
    assert logs.read_optional(spark, f"{tmp_path}/reports/none", df.schema).count() == 0


def test_json_and_sidecars(table):
    df = table("v double, b binary, a array<double>", [(math.nan, b"\x01\xff", [1.0, math.inf])])
    assert json.loads(sinks.json_rows(df).first().value) == {"v": None, "b": "01ff", "a": [1.0, None]}
    deep = df.sparkSession.sql("SELECT struct(double('NaN') AS v, array(double('inf'), 1D) AS a) AS s, map('k', double('NaN')) AS m, "
                               "array(struct(double('-inf') AS v)) AS r, CAST(NULL AS struct<v:double>) AS n")
    assert json.loads(sinks.json_rows(deep).first().value) == {"s": {"v": None, "a": [None, 1.0]}, "m": {"k": None}, "r": [{"v": None}], "n": None}
    one = table("log_id int, x int", [(1, 2)])
    two = table("log_id int, m map<string,int>", [(1, {"k": 3})])
    rows = sinks.sidecar([one, two])
    assert rows.columns == ["log_id", "x", "m"] and {r.m for r in rows.collect()} == {None, '{"k":3}'}


def test_manifest_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({
        "log_id": "a", "valid_counts": {"dx": 2, "dz": 4}, "file_hashes": {"f": "1"},
        "flight_segments": [{"flight_id": 1, "arm_time_s": 1.5, "end_time_s": 2.0}]}, indent=1))
    m = logs.read_manifest(spark, str(tmp_path))
    assert logs.manifest_segments(m).first()[1:] == (1, 1_500_000, 2_000_000)
    assert logs.manifest_digests(m).first()[1:] == ("f", "1") and logs.manifest_valid_counts(m).first()[1:] == (2, None, 4)
