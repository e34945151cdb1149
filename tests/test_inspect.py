from strandline.plans import inspect as ins


def board(table, **changes):
    logs = table("log_id int", [(1,), (2,)])
    parser = table("log_id int, status string, packets long", [(1, "PASS", 9), (2, "FAIL", 0)])
    catalog = table("log_id int, message string, field string, canonical_unit string",
                    [(1, m, f, u) for m in ("BAT", "ESC") for f, u in (("Volt", "V"), ("Curr", "A"))]
                    + [(1, m, f, "m/s/s") for m, f in ins.FREEZE_FIELDS] + [(2, "BAT", "Volt", None)])
    parts = {
        "catalog": catalog,
        "message_counts": table("log_id int, message string, n long", [(1, "BAT", 5), (1, "ESC", 5), (2, "BAT", 1)]),
        "metadata_conflicts": table("log_id int, message string, key string, definitions long", [(2, "FMT", "1", 2)]),
        "time_gate": table("log_id int, scope string", []),
        "unknown_units": table("log_id int, field string", [(2, "x")]),
    }
    errors = ins.critical_errors(parts, parser)
    profile = table("log_id int, verified boolean", [(1, True), (2, False)])
    segments = table("log_id int, open_ended boolean", [(1, False), (1, True)])
    evidence = table("log_id int, z_residual_candidate_us long, pscd_paired_samples long", [(1, 200_000, 3)])
    checks = table("log_id int, message string, warning boolean, sufficient_samples boolean", [(1, "BAT", False, True), (1, "ESC", True, True)])
    rows = ins.status_board(logs, parser, errors, parts, segments, profile, evidence, checks).collect()
    frozen = {r.log_id: r.freeze for r in ins.freeze(logs, errors, profile, catalog).collect()}
    return {r.log_id: r.asDict() for r in rows}, frozen, {(r.log_id, r.reason) for r in errors.collect()}


def test_status_board_and_freeze(table):
    rows, frozen, errors = board(table)
    assert rows[1] == {
        "log_id": 1, "parser": "PASS", "structural_log": "PASS", "flight_segment_detection": "PASS_WITH_WARNINGS", "unit_metadata": "PASS",
        "xy_residual_data_availability": "INSUFFICIENT", "z_residual_data_availability": "AVAILABLE",
        "battery_physical_quality": "NO_WARNING", "esc_telemetry_physical_quality": "WARNING",
    }
    assert rows[2] == {
        "log_id": 2, "parser": "FAIL", "structural_log": "FAIL", "flight_segment_detection": "UNKNOWN", "unit_metadata": "FAIL",
        "xy_residual_data_availability": "UNRESOLVED", "z_residual_data_availability": "UNRESOLVED",
        "battery_physical_quality": "UNKNOWN", "esc_telemetry_physical_quality": "UNKNOWN",
    }
    assert frozen == {1: "YES", 2: "NO"}
    assert errors == {(2, "definition changed"), (2, "parser anomalies"), (2, "no messages")}
