"""Job 1: what a fleet of logs contains, how it is timed, where its flights are, and how far it can be trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import RatePolicy, ScreenPolicy
from strandline.functions.text import audited
from strandline.operators import catalog as cg
from strandline.operators import intervals as iv
from strandline.operators import params as pm
from strandline.operators import profile as pf
from strandline.operators.ordered import WHOLE_CELLS, Chunks
from strandline.session import settle

# Fields whose verified acceleration unit the inspection is frozen on.
FREEZE_FIELDS = (("PSCN", "AN"), ("PSCN", "TAN"), ("PSCE", "AE"), ("PSCE", "TAE"), ("PSCD", "AD"), ("PSCD", "TAD"))
SENSOR_UNITS = (("Volt", "V"), ("Curr", "A"))


def flights(arm: DataFrame, ev: DataFrame, modes: DataFrame, records: DataFrame, names: DataFrame,
            chunks: Chunks = WHOLE_CELLS) -> tuple[DataFrame, DataFrame]:
    """Armed segments and mode intervals, both stored for the later jobs."""
    bounds = settle(iv.log_bounds(records))
    events = iv.arm_events(arm, ev)
    segments = settle(iv.armed_segments(events, bounds, chunks))
    return segments, settle(iv.mode_intervals(bounds, iv.label_modes(modes, names), events, segments, chunks))


def inventory(records: DataFrame, values: DataFrame, metadata: tuple[DataFrame, DataFrame, DataFrame, DataFrame],
              rate: RatePolicy = RatePolicy()) -> dict[str, DataFrame]:
    """Catalog, field statistics, timing and metadata problems.

    ``records``: log_id, message, instance, time_us, record_index. ``values``: the same ids with field, value.
    """
    catalog = settle(cg.field_catalog(*metadata))
    stats = pf.with_canonical(pf.inventory(values), catalog)
    timing = pf.message_timing(records, rate)
    return {
        "catalog": catalog,
        "field_inventory": stats,
        "data_types": cg.data_types(values),
        "message_counts": pf.message_counts(records),
        "message_timing": timing,
        "instance_timing": pf.instance_timing(records, rate),
        "backward_times": pf.backward_warnings(timing),
        "metadata_conflicts": cg.metadata_conflicts(*metadata),
        "time_gate": cg.time_gate(records, catalog),
        "unknown_units": cg.unknown_units(stats.where("inventory_scope = 'message'"), catalog),
    }


def profile_of(msg: DataFrame) -> DataFrame:
    """Identity texts of a log and whether its firmware is the audited revision."""
    return pm.identity_texts(msg).withColumn("verified", audited(F.col("firmware")))


def critical_errors(parts: dict[str, DataFrame], parser: DataFrame) -> DataFrame:
    """Everything that makes a log structurally unfit: (log_id, reason)."""
    conflict = parts["metadata_conflicts"].select("log_id", F.lit("definition changed").alias("reason"))
    time = parts["time_gate"].select("log_id", F.lit("time metadata unresolved").alias("reason"))
    damage = parser.where("status = 'FAIL'").select("log_id", F.lit("parser anomalies").alias("reason"))
    empty = parser.where("packets = 0").select("log_id", F.lit("no messages").alias("reason"))
    return conflict.unionByName(time).unionByName(damage).unionByName(empty).distinct()


def fact(rows: DataFrame, name: str, on: Column | None = None, number: Column | None = None, text: Column | None = None) -> DataFrame:
    """Rows of a table as facts (log_id, name, number, text) about their logs."""
    rows = rows if on is None else rows.where(on)
    return rows.select("log_id", F.lit(name).alias("name"), (F.lit(1.0) if number is None else number.cast("double")).alias("number"),
                       (F.lit(None) if text is None else text).cast("string").alias("text"))


def has(name: str) -> Column:
    return F.max(F.col("name") == name)


def sensor_facts(message: str, catalog: DataFrame, counts: DataFrame, checks: DataFrame) -> list[DataFrame]:
    units = catalog.where(F.col("message") == message)
    own = checks.where(F.col("message") == message)
    return [
        *[fact(units, f"{message} {f}", (F.col("field") == f) & (F.col("canonical_unit") == u)) for f, u in SENSOR_UNITS],
        fact(counts, f"{message} present", (F.col("message") == message) & (F.col("n") > 0)), fact(own, f"{message} checked"),
        fact(own, f"{message} warned", F.col("warning")), fact(own, f"{message} short", ~F.col("sufficient_samples")),
    ]


def sensor_status(message: str) -> Column:
    """WARNING, NO_WARNING or UNKNOWN for one sensor: unknown without data, verified units or enough samples."""
    known = has(f"{message} present")
    for field, _ in SENSOR_UNITS:
        known = known & has(f"{message} {field}")
    return (
        F.when(~known, "UNKNOWN").when(has(f"{message} warned"), "WARNING")
        .when(has(f"{message} checked") & ~has(f"{message} short"), "NO_WARNING").otherwise("UNKNOWN")
    )


def status_board(
    logs: DataFrame, parser: DataFrame, errors: DataFrame, parts: dict[str, DataFrame], segments: DataFrame,
    profile: DataFrame, evidence: DataFrame, checks: DataFrame, policy: ScreenPolicy = ScreenPolicy(),
    arming: DataFrame | None = None,
) -> DataFrame:
    """Eight statuses per log in one row. ``arming`` lists the logs with any arm or disarm report; without it a log has such a
    source only if it has flights. All tables meet as facts in one aggregate."""
    z = F.col("z_residual_candidate_us")
    facts = [
        fact(logs, "log"), fact(parser, "parser", text=F.col("status")), fact(errors, "broken"),
        fact(errors, "metadata", F.col("reason").rlike("definition|metadata")), fact(segments if arming is None else arming, "flown"),
        fact(segments, "open", F.col("open_ended")), fact(parts["unknown_units"], "loose"), fact(profile, "verified", F.col("verified")),
        fact(evidence, "z unknown", z.isNull()), fact(evidence, "z us", z.isNotNull(), z), fact(evidence, "z pairs", number=F.col("pscd_paired_samples")),
    ]
    for message in ("BAT", "ESC"):
        facts += sensor_facts(message, parts["catalog"], parts["message_counts"], checks)
    total = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("number"))), F.lit(0.0))
    enough = (total("z us") >= policy.minimum_candidate_duration_s * 1e6) & (total("z pairs") >= policy.minimum_paired_samples)
    board = reduce(DataFrame.unionByName, facts).groupBy("log_id").agg(
        has("log").alias("_log"),
        F.max(F.when(F.col("name") == "parser", F.col("text"))).alias("parser"),
        F.when(has("broken"), "FAIL").otherwise("PASS").alias("structural_log"),
        F.when(~has("flown"), "UNKNOWN").when(has("open"), "PASS_WITH_WARNINGS").otherwise("PASS").alias("flight_segment_detection"),
        F.when(has("metadata"), "FAIL").when(has("loose"), "PASS_WITH_WARNINGS").otherwise("PASS").alias("unit_metadata"),
        F.when(has("verified"), "INSUFFICIENT").otherwise("UNRESOLVED").alias("xy_residual_data_availability"),
        F.when(~has("verified") | has("z unknown"), "UNRESOLVED").when(enough, "AVAILABLE").otherwise("INSUFFICIENT").alias("z_residual_data_availability"),
        sensor_status("BAT").alias("battery_physical_quality"), sensor_status("ESC").alias("esc_telemetry_physical_quality"),
    )
    return board.where("_log").drop("_log")


def freeze(logs: DataFrame, errors: DataFrame, profile: DataFrame, catalog: DataFrame, unit: str = "m/s/s") -> DataFrame:
    """Whether the inspection of a log may be relied on: no critical error, audited firmware, six known units. One aggregate."""
    known = catalog.where(F.col("canonical_unit") == unit)
    facts = [fact(logs, "log"), fact(errors, "broken"), fact(profile, "verified", F.col("verified"))]
    facts += [fact(known, f"{m}.{f}", (F.col("message") == m) & (F.col("field") == f)) for m, f in FREEZE_FIELDS]
    ok = has("verified") & ~has("broken")
    for m, f in FREEZE_FIELDS:
        ok = ok & has(f"{m}.{f}")
    found = reduce(DataFrame.unionByName, facts).groupBy("log_id").agg(has("log").alias("_log"), F.when(ok, "YES").otherwise("NO").alias("freeze"))
    return found.where("_log").drop("_log")
