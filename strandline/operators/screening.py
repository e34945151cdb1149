"""Sensor screening: plausibility checks, vibration by arm state, counters, activity evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import ScreenPolicy
from strandline.functions.numeric import clean, finite, outside
from strandline.operators.asof import latest_of_all, ratio_to_latest
from strandline.operators.intervals import evidence_edges, marked_steps, overlap_duration, union_duration
from strandline.operators.ordered import WHOLE_CELLS, Chunks, Scan, rank_chunk
from strandline.operators.profile import attach, distribution, gap_thresholds

CHECK = ["log_id", "code", "message", "instance"]
STATES = ("disarmed", "armed", "unknown")


def check_values(rows: DataFrame, code: str, message: str, value: Column, bad: Column, instance: Column | None = None) -> DataFrame:
    who = F.lit(None).cast("bigint") if instance is None else instance.cast("bigint")
    return rows.select(
        "log_id", F.lit(code).alias("code"), F.lit(message).alias("message"), who.alias("instance"),
        value.cast("double").alias("value"), F.coalesce(bad, F.lit(False)).alias("bad"),
    )


def screen(values: DataFrame, minimum_samples: int = 10, warning_fraction: float = 0.8) -> DataFrame:
    """One row per check, flagged or not: counts, share, sufficiency, verdict and evidence statistics. Rows without a value
    only say that there is such a check."""
    counts = values.groupBy(*CHECK).agg(
        F.count_if(F.col("bad") & F.col("value").isNotNull()).alias("flagged_count"), F.count("value").alias("evaluated_count")
    )
    share = F.try_divide(F.col("flagged_count"), F.col("evaluated_count"))
    enough = F.col("evaluated_count") >= minimum_samples
    counts = counts.select(
        "*", share.alias("fraction"), enough.alias("sufficient_samples"),
        (enough & F.coalesce(share >= F.lit(warning_fraction), F.lit(False))).alias("warning"),
    )
    return attach(counts, distribution(values, CHECK, "value"), CHECK)


def without_values(reports: DataFrame, codes, message: str) -> DataFrame:
    """One empty row per log, instance and check, so that a check nothing could be evaluated for is still reported."""
    who = reports.select("log_id", "instance").distinct().withColumn("_code", F.explode(F.array(*[F.lit(c) for c in codes])))
    return who.select(
        "log_id", F.col("_code").alias("code"), F.lit(message).alias("message"), F.col("instance").cast("bigint").alias("instance"),
        F.lit(None).cast("double").alias("value"), F.lit(False).alias("bad"),
    )


def battery_values(bat: DataFrame, policy: ScreenPolicy) -> DataFrame:
    """Voltage over the whole log, current while armed. ``bat``: log_id, instance, volt, curr, state, canonical."""
    volt = bat.where(finite(F.col("volt")))
    armed = bat.where(finite(F.col("curr")) & (F.col("state") == "armed"))
    return check_values(
        volt, "BAT_VOLTAGE_IMPLAUSIBLE", "BAT", F.col("volt"), outside(F.col("volt"), *policy.battery_voltage), F.col("instance")
    ).unionByName(check_values(
        armed, "BAT_CURRENT_SUSPICIOUS", "BAT", F.col("curr"), F.col("curr") < policy.battery_min_current_a, F.col("instance")
    )).unionByName(without_values(bat, ("BAT_VOLTAGE_IMPLAUSIBLE", "BAT_CURRENT_SUSPICIOUS"), "BAT"))


def esc_values(esc: DataFrame, bat: DataFrame, instances, policy: ScreenPolicy, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Absolute voltage, near-zero armed current, ratio to battery voltage, speed ratio across instances."""
    max_age = round(policy.comparison_max_age_s * 1e6)
    volt = esc.where(finite(F.col("volt")))
    parts = check_values(volt, "ESC_VOLTAGE_IMPLAUSIBLE", "ESC", F.col("volt"), outside(F.col("volt"), *policy.esc_voltage), F.col("instance"))
    armed = esc.where(finite(F.col("curr")) & (F.col("state") == "armed"))
    parts = parts.unionByName(check_values(
        armed, "ESC_CURRENT_UNAVAILABLE", "ESC", F.col("curr"),
        F.abs("curr") <= policy.zero_current_epsilon_a, F.col("instance"),
    ))
    base = bat.where(F.col("instance") == policy.battery_instance).select("log_id", "time_us", "record_index", "volt", "context")
    ratio = ratio_to_latest(esc.select("log_id", "time_us", "record_index", "instance", "volt", "context"), base, "volt", max_age,
                            context="context", chunks=chunks)
    parts = parts.unionByName(check_values(
        ratio, "ESC_VOLTAGE_RATIO_IMPLAUSIBLE", "ESC", F.col("ratio"), outside(F.col("ratio"), *policy.esc_voltage_ratio), F.col("instance")
    ))
    codes = ("ESC_VOLTAGE_IMPLAUSIBLE", "ESC_CURRENT_UNAVAILABLE", "ESC_VOLTAGE_RATIO_IMPLAUSIBLE")
    parts = parts.unionByName(without_values(esc, codes, "ESC"))
    if len(instances) > 1:
        several = esc.select("log_id", "instance").distinct().groupBy("log_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        seed = several.select("log_id", F.lit(None).cast("bigint").alias("instance"))
        parts = parts.unionByName(without_values(seed, ("ESC_RPM_CROSS_INSTANCE_INCONSISTENT",), "ESC"))
        reports = esc.select("log_id", "time_us", "record_index", "instance", "rpm", "context", "state")
        spread = latest_of_all(reports, instances, "rpm", max_age, policy.rpm_active_floor, context="context", chunks=chunks)
        spread = spread.where("state = 'armed'")
        parts = parts.unionByName(check_values(
            spread, "ESC_RPM_CROSS_INSTANCE_INCONSISTENT", "ESC", F.col("ratio"), F.col("ratio") > policy.rpm_ratio_warning
        ))
    return parts


def warnings(checks: DataFrame) -> DataFrame:
    return checks.where("warning")


def counter_increments(rows: DataFrame, counter: str, keys=("log_id", "instance")) -> DataFrame:
    """Growth of a cumulative counter per arm state: neighbouring rows of the same state and context, later in
    time. Falls are resets and add nothing; no usable pair leaves the total unknown."""
    keys = list(keys)
    chunked = rank_chunk(rows.select(*keys, "time_us", "record_index", "state", "context", F.col(counter).cast("double").alias("_c")))
    steps = Scan(chunked, keys, ("record_index",)).previous("_b", "time_us", "state", "context", "_c").run()
    usable = (
        (F.col("_b.state") == F.col("state")) & F.col("_b.context").eqNullSafe(F.col("context"))
        & finite(F.col("_c")) & finite(F.col("_b._c")) & (F.col("time_us") > F.col("_b.time_us"))
    )
    delta = F.when(F.coalesce(usable, F.lit(False)), F.col("_c") - F.col("_b._c"))
    return steps.withColumn("_d", delta).groupBy(*keys, "state").agg(
        F.sum(F.when(F.col("_d") >= 0, F.col("_d"))).alias("increments"),
        F.count_if(F.coalesce(F.col("_d") < 0, F.lit(False))).alias("resets"),
        F.count_if(F.coalesce(F.col("_d") >= 0, F.lit(False))).alias("pairs"),
    )


def state_distribution(rows: DataFrame, fields, keys=("log_id", "instance"), percentiles=(95, 99)) -> DataFrame:
    """Distribution of each field per instance and arm state; combinations without rows keep a zero."""
    keys = list(keys)
    long = rows.select(*keys, "state", *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(
        [*keys, "state"], list(fields), "field", "value"
    )
    group = [*keys, "state", "field"]
    counts = long.groupBy(*group).agg(F.count(F.lit(1)).alias("count"))
    every = rows.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(s) for s in STATES])).alias("state")
    ).select(*keys, "state", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    out = attach(attach(every, counts, group), distribution(long, group, "value", percentiles), group)
    return out.fillna(0, ["count", "finite_count"])


def vibration(rows: DataFrame, percentiles=(95, 99)) -> DataFrame:
    """Vibration levels and clipping per instance and arm state."""
    keys = ["log_id", "instance", "state"]
    levels = state_distribution(rows, ("vibe_x", "vibe_y", "vibe_z"), percentiles=percentiles)
    clips = attach(levels, counter_increments(rows, "clip"), keys)
    return clips.fillna(0, ["resets", "pairs"])


# Messages with an actual and a target acceleration, and their fields.
PAIRS = {"PSCN": ("TAN", "AN"), "PSCE": ("TAE", "AE"), "PSCD": ("TAD", "AD")}


def evidence(rows: DataFrame, ok: Column, keys=("log_id", "interval_id", "message")) -> DataFrame:
    """Edges between neighbouring rows of an interval, ``good`` where both ends satisfy ``ok``. The gap limit
    comes from all rows of the group."""
    keys = list(keys)
    steps = marked_steps(rows, ok, keys)
    return evidence_edges(steps, gap_thresholds(steps, keys), keys)


def usable_pair() -> Column:
    """Actual and target both finite, in verified units."""
    return F.col("paired_ok") & finite(F.col("actual")) & finite(F.col("target"))


def activity(
    intervals: DataFrame, rows: DataFrame, edges: DataFrame, messages=tuple(PAIRS), chunks: Chunks = WHOLE_CELLS,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Every interval and tracked message: samples, active time, time with a usable pair.

    ``rows``: log_id, interval_id, message, time_us, record_index, actual, target, paired_ok (units verified). ``profile`` has
    log_id and ``verified``; where it is given, pairs of logs with other firmware do not count.
    """
    keys = ["log_id", "interval_id", "message"]
    if profile is not None:
        known = profile.where("verified").select("log_id", F.lit(True).alias("_known"))
        rows = rows.join(known, "log_id", "left").withColumn("paired_ok", F.col("paired_ok") & F.col("_known").isNotNull()).drop("_known")
        edges = edges.join(known, "log_id", "left").withColumn("good", F.col("good") & F.col("_known").isNotNull()).drop("_known")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.count_if(usable_pair()).alias("paired_samples"))
    active = union_duration(edges, keys, chunks).withColumnRenamed("duration_us", "active_us")
    paired = union_duration(edges.where("good"), keys, chunks).withColumnRenamed("duration_us", "paired_us")
    every = intervals.withColumn("message", F.explode(F.array(*[F.lit(m) for m in messages])))
    out = every.join(counts, keys, "left").join(active, keys, "left").join(paired, keys, "left")
    return out.fillna(0, ["samples", "paired_samples", "active_us", "paired_us"])


def flight_evidence(
    segments: DataFrame, rows: DataFrame, edges: DataFrame, profile: DataFrame, chunks: Chunks = WHOLE_CELLS
) -> DataFrame:
    """Per flight: active time and paired samples of each message, candidate times of the residuals.

    ``edges`` carry the flight. ``profile`` has log_id and ``verified``; where the firmware is not the audited
    one the candidate times are unknown, and horizontal candidates are zero by definition since the source is
    a controller proxy.
    """
    flight = ["log_id", "flight_id"]
    tagged = rows.where("flight_id is not null")
    edges = edges.where("flight_id is not null")
    paired = edges.where("good")
    spans = union_duration(edges, [*flight, "message"], chunks).groupBy(*flight).agg(
        *[F.max(F.when(F.col("message") == m, F.col("duration_us"))).alias(f"{m.lower()}_active_us") for m in PAIRS]
    )
    counts = tagged.groupBy(*flight).agg(
        *[F.count_if(usable_pair() & (F.col("message") == m)).alias(f"{m.lower()}_paired_samples") for m in PAIRS]
    )
    proxy = overlap_duration(paired.where("message = 'PSCN'"), paired.where("message = 'PSCE'"), flight, chunks)
    z = union_duration(paired.where("message = 'PSCD'"), flight, chunks)
    units = tagged.where("message = 'PSCD'").groupBy("log_id").agg(F.bool_and("paired_ok").alias("z_units"))
    out = segments.join(spans, flight, "left").join(counts, flight, "left")  # paired samples count in audited firmware only
    out = out.join(proxy.withColumnRenamed("duration_us", "_proxy"), flight, "left")
    out = out.join(z.withColumnRenamed("duration_us", "_z"), flight, "left")
    out = out.join(profile, "log_id", "left").join(units, "log_id", "left")
    known = F.coalesce("verified", F.lit(False))
    zero = F.lit(0).cast("bigint")
    measured = [f"{m.lower()}_{k}" for m in PAIRS for k in ("active_us", "paired_samples")]
    gated = [F.when(known, F.col(c)).otherwise(zero).alias(c) if c.endswith("_paired_samples") else F.col(c) for c in measured]
    return out.fillna(0, measured).select(
        *segments.columns, *gated,
        F.when(known, F.coalesce("_proxy", zero)).alias("xy_proxy_candidate_us"),
        F.when(known, zero).alias("x_residual_candidate_us"),
        F.when(known, zero).alias("y_residual_candidate_us"),
        F.when(known & F.coalesce("z_units", F.lit(False)), F.coalesce("_z", zero)).alias("z_residual_candidate_us"),
    )


def dynamic_range(rows: DataFrame, keys=("log_id", "interval_id", "message")) -> DataFrame:
    """Acceleration distribution per interval, message and field with p1 and p99."""
    ids = list(keys)
    long = rows.select(*ids, clean(F.col("actual")).alias("actual"), clean(F.col("target")).alias("target")).unpivot(
        ids, ["actual", "target"], "field", "value"
    )
    return distribution(long, [*ids, "field"], "value", (1, 99))


def esc_reports(esc: DataFrame, dataset: DataFrame, disagreement: float = 2.0) -> DataFrame:
    """Cross-checks of logged motor controllers per log: speed disagreement, voltage ratio, dead current.

    Means and medians count to nine decimals, so that neither the order of a sum nor the way of interpolating decides a ratio.
    """
    per = esc.groupBy("log_id", "instance").agg(F.round(F.avg(clean(F.col("rpm"))), 9).alias("_m"))
    per_log = per.groupBy("log_id").agg(
        F.max(F.when(F.col("_m") > 0, F.col("_m"))).alias("_hi"), F.min(F.when(F.col("_m") > 0, F.col("_m"))).alias("_lo")
    )
    volts = distribution(esc, ["log_id"], "volt", ()).select("log_id", F.round("median", 9).alias("_esc_v"))
    bats = distribution(dataset, ["log_id"], "battery_v", ()).select("log_id", F.round("median", 9).alias("_bat_v"))
    dead = esc.groupBy("log_id").agg(F.bool_and(F.coalesce(clean(F.col("curr")), F.lit(0.0)) == 0).alias("zero_current"))
    out = per_log.join(volts, "log_id", "left").join(bats, "log_id", "left").join(dead, "log_id", "left")
    speed = F.try_divide(F.col("_hi"), F.col("_lo"))
    ratio = F.try_divide(F.col("_esc_v"), F.col("_bat_v"))
    return out.select(
        "log_id", speed.alias("rpm_ratio"), F.coalesce(speed > disagreement, F.lit(False)).alias("rpm_disagrees"),
        ratio.alias("voltage_ratio"), F.coalesce((ratio < 0.5) | (ratio > 1.5), F.lit(False)).alias("voltage_disagrees"),
        "zero_current",
    )
