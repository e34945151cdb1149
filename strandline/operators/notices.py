"""Warnings of a job as one ordered list per log, each once, where it first appears.

A notice is (log_id, section, step, code, scope, detail). Sections follow each other as the job's steps do; inside a section
``step`` orders the notices, then their scope.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import first_appearances

NOTICE = ("log_id", "section", "step", "code", "scope", "detail")
SCHEMA = "section int, step bigint, code string, scope string, detail string"

# What job 2 and job 3 say about every log, in order.
EXTRACTION_NOTICES = ("horizontal_residual_is_proxy", "armed_is_not_airborne", "calibration_unverified", "reset_log_may_be_incomplete")
VALIDATION_NOTICES = (
    "armed_is_not_airborne", "chronological_split_is_not_independence", "current_calibration_unverified", "rotor_speed_unverified",
    "readiness_is_screening_only",
)


def notice(rows: DataFrame, section: int, code: Column | str, scope: Column | str = "", detail: Column | str = "", step: Column | int = 0) -> DataFrame:
    """Notices of one section out of rows with a log_id."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c.cast("string")
    step = F.lit(step) if isinstance(step, int) else step
    return rows.select("log_id", F.lit(section).alias("section"), step.cast("bigint").alias("step"), text(code).alias("code"),
                       F.coalesce(text(scope), F.lit("")).alias("scope"), F.coalesce(text(detail), F.lit("")).alias("detail"))


def fixed_notices(logs: DataFrame, section: int, codes) -> DataFrame:
    """The same notices for every log, in the order of ``codes``."""
    numbered = F.posexplode(F.array(*[F.lit(c) for c in codes])).alias("_step", "_code")
    return notice(logs.select("log_id", numbered), section, F.col("_code"), step=F.col("_step"))


def ordered_notices(parts: list[DataFrame]) -> DataFrame:
    """(log_id, place, code, scope, detail): repeats kept where they first appear, places without gaps from 1."""
    rows = reduce(DataFrame.unionByName, [p.select(*NOTICE) for p in parts])
    found = first_appearances(rows, ["log_id"], ["code", "scope", "detail"], ["section", "step"], F.col("section").cast("bigint"))
    return found.select("log_id", F.col("place").cast("bigint").alias("place"), "code", "scope", "detail")


def inspection_notices(logs: DataFrame, timing: DataFrame, screened: DataFrame, damaged: DataFrame) -> list[DataFrame]:
    """Job 1: logs without verified times, backward clocks by message then instance, sensor warnings, damaged files.

    ``timing``: log_id, message, instance, backwards and timestamped; whole-message rows have no instance. ``screened``: checks with
    a warning flag. ``damaged``: parser_status.
    """
    dark = timing.groupBy("log_id").agg(F.max("timestamped").alias("_t"))
    dark = logs.join(dark, "log_id", "left").where(F.coalesce("_t", F.lit(0)) == 0)
    who = F.concat_ws("#", "message", F.col("instance").cast("string"))
    share = F.concat_ws("/", "flagged_count", "evaluated_count")
    return [
        notice(dark, 0, "no_verified_time"),
        notice(timing.where("backwards > 0"), 1, "backward_time", who, F.col("backwards"), F.col("instance").isNotNull().cast("int")),
        notice(screened.where("warning"), 2, F.col("code"), who, share),
        notice(damaged.where("status = 'PASS_WITH_WARNINGS'"), 3, F.col("trailing_kind"), "file"),
    ]


def extraction_notices(earlier: DataFrame, damaged: DataFrame, motors: DataFrame) -> list[DataFrame]:
    """Job 2: the inspection's notices in their order, what holds for every log, the truncated-tail exception, open motor mappings.

    ``earlier``: (log_id, place, code, scope, detail) of job 1. ``motors``: one row a log with ``unresolved``, the open ones.
    """
    logs = motors.select("log_id")
    return [
        notice(earlier, 0, F.col("code"), F.col("scope"), F.col("detail"), F.col("place")),
        fixed_notices(logs, 1, EXTRACTION_NOTICES),
        notice(damaged.where("anomalies > 0"), 2, "truncated_tail_accepted", "file"),
        notice(motors.where("unresolved > 0"), 3, "motor_mapping_unresolved", "motors", F.col("unresolved")),
    ]


def validation_notices(
    earlier: DataFrame, logs: DataFrame, sampled: DataFrame, constant: DataFrame, flags: DataFrame, weak_z: DataFrame, esc: DataFrame | None,
    columns, proxy: bool = True,
) -> list[DataFrame]:
    """Job 3: the manifest's notices, gaps by flight in stored order, constant columns and raised flags in their tables' order, what
    holds for every log, the proxy, vertical coverage, disagreeing sensors."""
    at = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("field"))
    parts = [
        notice(earlier, 0, F.col("code"), F.col("scope"), F.col("detail"), F.col("place")),
        notice(sampled.where("large_gaps > 0"), 1, "grid_gaps", F.col("flight_id"), F.col("large_gaps"), F.col("first_seq")),
        notice(constant, 2, "constant_column", F.col("field"), step=at),
        notice(flags, 3, "outliers_retained", F.col("flag"), F.col("n_rows"), F.col("step")),
        fixed_notices(logs, 4, VALIDATION_NOTICES),
        *([notice(logs, 5, "horizontal_residual_is_proxy", "xyz")] if proxy else []),
        notice(weak_z, 6, "vertical_coverage_weak"),
    ]
    if esc is not None:
        parts += [
            notice(esc.where("rpm_disagrees"), 7, "rotor_speeds_disagree", step=0), notice(esc.where("voltage_disagrees"), 7, "voltages_disagree", step=1),
            notice(esc.where("zero_current"), 7, "rotor_current_zero", step=2),
        ]
    return parts
