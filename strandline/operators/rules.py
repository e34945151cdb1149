"""Validation rules. Every rule reports rows (log_id, rule, scope, n_bad, example).

Rules on single rows share one aggregate per log, however many there are; rules between rows use the ordered
scan or a grouped count; rules between tables are equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import NUMERIC_COLUMNS, REQUIRED_COLUMNS, SOURCES, STATE_COLUMNS, ExtractPolicy
from strandline.functions.numeric import all_of, any_of, finite, number, text_flag
from strandline.lineage import DIRECT, FRAME, MOTORS, RESIDUAL_SIGN, STAND_IN, STATES
from strandline.operators.ordered import Scan, rank_chunk
from strandline.operators.profile import attach, counted_percentiles, step_counts

VIOLATION = ("log_id", "rule", "scope", "n_bad", "example")
AGE_SLACK_MS, TIME_SLACK_US, AGREE_MS = 1e-6, 1e-3, 1e-5  # Fixed values: tolerances of the age rules.
IDENTITY_TOL = 1e-9  # Fixed value: absolute and relative tolerance of the residual identity.
EXACT_KINDS = ("double", "bigint", "int", "smallint", "tinyint")  # Fixed values: their texts read as doubles are the casts.


def violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*VIOLATION) for p in parts])


def _report(rows: DataFrame, rule: str, scope: Column | str, count: Column | str, example: Column) -> DataFrame:
    scope = F.lit(scope) if isinstance(scope, str) else scope
    count = F.col(count) if isinstance(count, str) else count
    return rows.select("log_id", F.lit(rule).alias("rule"), scope.alias("scope"), count.cast("bigint").alias("n_bad"),
                       example.cast("string").alias("example"))


def row_rules(df: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Many (rule, scope, bad, example) row checks in one pass over the table."""
    if not rules:
        text = F.lit("")
        return _report(df.where(F.lit(False)), "none", "", F.lit(0), text)
    # Only what breaks a rule goes on; most rows break none, and a sum and an example per rule would cost more than the checks.
    # The array is a column of its own, so it is made by generated code; its filter cannot move below the explosion.
    broken = F.array(*[F.when(bad, F.struct(F.lit(i).alias("_i"), ex.cast("string").alias("example"))) for i, (_, _, bad, ex) in enumerate(rules)])
    rows = df.select("log_id", broken.alias("_a")).select("log_id", F.explode("_a").alias("_r")).where("_r is not null").select("log_id", "_r.*")
    totals = rows.groupBy("log_id", "_i").agg(F.count(F.lit(1)).alias("n_bad"), F.min("example").alias("example"))
    names = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(scope).alias("scope")) for rule, scope, _, _ in rules])
    return totals.withColumn("_r", F.get(names, F.col("_i"))).select("log_id", "_r.*", "n_bad", "example")


def missing_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Add absent columns as false, '' or NULL, and report them for every log."""
    absent = [c for c in required if c not in df.columns]
    fills = {
        c: F.lit(False) if c.startswith("valid_") else F.lit("") if c == "mode" else F.lit(None).cast("double") for c in absent
    }
    logs = df.select("log_id").distinct()
    names = F.explode(F.array(*[F.lit(c) for c in absent])) if absent else F.explode(F.array().cast("array<string>"))
    found = logs.select("log_id", names.alias("scope"))
    report = _report(found, "required_column", F.col("scope"), F.lit(1), F.lit(None))
    return df.withColumns(fills) if fills else df, report


def coerce(df: DataFrame, numeric=NUMERIC_COLUMNS, flags=("valid_dx", "valid_dy", "valid_dz")) -> tuple[DataFrame, DataFrame]:
    """Numbers and flags out of a text table; what is neither is reported and becomes NULL or false."""
    checks, kinds = [], dict(df.dtypes)
    values = {c: F.col(c).cast("double") if kinds[c] in EXACT_KINDS else number(F.col(c)) for c in numeric}
    for c, value in values.items():
        if kinds[c] not in EXACT_KINDS:
            text = F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c).cast("string"))).isin("nan", "")
            checks.append(("numeric", c, text & value.isNull(), F.col(c)))
        checks.append(("finite", c, F.abs(value) == F.lit(float("inf")), F.col(c)))
    for c in flags:
        checks.append(("boolean", c, flag_of(df, c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("missing"))))
    typed = {c: F.when(~F.isnan(value), value) for c, value in values.items()}
    typed.update({c: F.coalesce(flag_of(df, c), F.lit(False)) for c in flags})
    return df.withColumns(typed), row_rules(df, checks)


def flag_of(df: DataFrame, name: str) -> Column:
    """A stored flag; text is read as by ``text_flag``, which leaves booleans as they are."""
    return F.col(name) if dict(df.dtypes)[name] == "boolean" else text_flag(F.col(name))


def presence(df: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Rows without a time or a flight; listed logs without any row."""
    out = row_rules(df, [
        ("timestamp", "time_us", F.col("time_us").isNull(), F.lit("missing")),
        ("flight_id", "flight_id", F.col("flight_id").isNull(), F.lit("missing")),
    ])
    if logs is not None:
        empty = logs.join(df.select("log_id").distinct(), "log_id", "left_anti")
        out = out.unionByName(_report(empty, "empty", "dataset", F.lit(1), F.lit(None)))
    return out


def duplicates(df: DataFrame, keys=("flight_id", "time_us"), rule: str = "duplicate_time") -> DataFrame:
    """Groups of rows with the same key, counted per log."""
    groups = df.groupBy("log_id", *keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sums = groups.groupBy("log_id").agg(F.count(F.lit(1)).alias("_g"), F.min(F.col(keys[-1])).alias("_x"))
    return _report(sums, rule, ",".join(keys), "_g", F.col("_x"))


def sampling(df: DataFrame, keys=("log_id", "flight_id"), index: str = "row_seq", rate_hz: float = 10.0) -> DataFrame:
    """Steps between stored neighbours per flight: extremes, backward or repeated steps, large gaps."""
    keys = list(keys)
    rows = Scan(rank_chunk(df.select(*keys, "time_us", index), index), keys, (index,)).previous("_b", "time_us").run()
    rows = rows.withColumn("dt_us", F.col("time_us") - F.col("_b.time_us"))
    return rows.groupBy(*keys).agg(
        F.min("dt_us").alias("min_dt_us"), F.max("dt_us").alias("max_dt_us"),
        F.count_if(F.coalesce(F.col("dt_us") <= 0, F.lit(False))).alias("n_not_rising"),
        F.count_if(F.coalesce(F.col("dt_us") > F.lit(1.5e6 / rate_hz), F.lit(False))).alias("large_gaps"),
    )


def sampling_report(df: DataFrame, keys=("log_id", "flight_id"), index: str = "row_seq", rate_hz: float = 10.0) -> DataFrame:
    """``sampling`` with the flight's first place in the table and the median step, which comes out of counted steps."""
    keys = list(keys)
    steps = step_counts(df, keys, index).where("dt is not null").select(*keys, F.col("dt").cast("double").alias("_x"), "_c")
    first = df.groupBy(*keys).agg(F.min(index).cast("bigint").alias("first_seq"))
    out = attach(sampling(df, keys, index, rate_hz), counted_percentiles(steps, keys, {"median_dt_us": 0.5}), keys)
    return attach(out, first, keys)


def monotonic(sampled: DataFrame) -> DataFrame:
    return _report(sampled.where("n_not_rising > 0"), "strictly_increasing", F.col("flight_id").cast("string"), "n_not_rising",
                   F.col("min_dt_us"))


def flight_boundaries(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Flights without exactly one recorded boundary, and rows outside it."""
    flight = ["log_id", "flight_id"]
    spans = df.groupBy(*flight).agg(F.min("time_us").alias("_a"), F.max("time_us").alias("_b"))
    known = segments.groupBy(*flight).agg(
        F.count(F.lit(1)).alias("_n"), F.min("start_us").alias("_s"), F.min("end_us").alias("_e")
    )
    rows = spans.join(known, flight, "left")
    scope = F.col("flight_id").cast("string")
    none = _report(rows.where("coalesce(_n, 0) <> 1"), "unique_boundary", scope, F.lit(1), F.col("_n"))
    out = rows.where((F.col("_n") == 1) & (F.col("_e").isNull() | (F.col("_a") < F.col("_s")) | (F.col("_b") >= F.col("_e"))))
    return none.unionByName(_report(out, "inside_flight", scope, F.lit(1), F.col("_a")))


# Names of the acceleration unit.
ACCELERATION_UNITS = ("m/s^2", "m/s/s", "m/s²")
ACCELERATION_COLUMNS = ("ax", "ay", "az", "ax_target", "ay_target", "az_target", "dx", "dy", "dz")


def frame_rules(lineage: DataFrame) -> DataFrame:
    """Acceleration columns not in the output frame or without an acceleration unit."""
    rows = lineage.where(F.col("column").isin(*ACCELERATION_COLUMNS))
    frame = rows.where(~F.coalesce(F.col("output_frame") == "ENU", F.lit(False)))
    unit = rows.where(~F.coalesce(F.col("output_unit").isin(*ACCELERATION_UNITS), F.lit(False)))
    return _report(frame, "output_frame", F.col("column"), F.lit(1), F.col("output_frame")).unionByName(
        _report(unit, "output_unit", F.col("column"), F.lit(1), F.col("output_unit")))


def claim_rules(manifest: DataFrame) -> DataFrame:
    """Releases whose manifest does not claim the output frame, or the sign of residuals, that the columns are defined in."""
    claims = (("coordinate_frame", FRAME), ("residual_sign", RESIDUAL_SIGN))
    parts = [
        _report(manifest.where(~F.col(c).eqNullSafe(F.lit(wanted))), c, "manifest", F.lit(1), F.col(c)) for c, wanted in claims
    ]
    return parts[0].unionByName(parts[1])


def mixed_units(lineage: DataFrame) -> DataFrame:
    """Columns whose unit or frame differs between logs of the fleet."""
    kinds = lineage.select("column", "input_unit", "output_unit", "output_frame").distinct()
    return kinds.groupBy("column").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def residual_rules(axis: str, source: str, hold_ms: float) -> list[tuple[str, str, Column, Column]]:
    """Flag consistency, residual identity and source age of one axis."""
    a, t, d = F.col(f"a{axis}"), F.col(f"a{axis}_target"), F.col(f"d{axis}")
    valid = F.col(f"valid_d{axis}")
    complete = all_of([finite(c) for c in (a, t, d)])
    good = valid & complete
    rules = [
        ("valid_without_values", f"d{axis}", valid & ~complete, F.col("time_us")),
        ("residual_without_flag", f"d{axis}", ~valid & d.isNotNull(), F.col("time_us")),
        ("residual_identity", f"d{axis}", good & differs(d, a - t), F.col("time_us")),
    ]
    return rules + age_rules(source, good, hold_ms, f"d{axis}")


def differs(left: Column, right: Column, atol: float = IDENTITY_TOL, rtol: float = IDENTITY_TOL) -> Column:
    """Not within atol + rtol * |right|; two missing values agree, one missing does not."""
    far = F.abs(left - right) > F.lit(atol) + F.lit(rtol) * F.abs(right)
    return (left.isNull() != right.isNull()) | F.coalesce(far, F.lit(False))


def age_rules(source: str, used: Column, hold_ms: float, scope: str) -> list[tuple[str, str, Column, Column]]:
    age, at = F.col(f"age_{source}_ms"), F.col(f"source_time_{source}_us")
    stale = ~finite(age) | (age < -AGE_SLACK_MS) | (age > hold_ms + AGE_SLACK_MS)
    gap = F.abs((F.col("time_us") - at) / 1000.0 - age)
    wrong = at.isNull() | (at > F.col("time_us") + TIME_SLACK_US) | (gap > AGREE_MS)
    return [
        ("source_age", scope, used & F.coalesce(stale, F.lit(True)), age),
        ("source_time", scope, used & F.coalesce(wrong, F.lit(True)), at),
    ]


def used_sources(df: DataFrame) -> dict[str, Column]:
    """Which rows draw on which source: it feeds a column that has a value, or a state names it in its label.

    Without labels a state may come from its stand-in. A column ``valid_<source>`` marks rows that use the source besides.
    """
    labels = [f"source_{o.column}" for o in STATES if f"source_{o.column}" in df.columns]
    fed = {s: [o.column for o in DIRECT if o.message == s] for s in SOURCES}
    fed["RCOU"] = [*MOTORS, *[c for c in df.columns if c.startswith("rcou_c")]]
    if not labels:
        fed[STAND_IN] = fed[STAND_IN] + [o.column for o in STATES]
    flag = lambda s: any_of([F.coalesce(text_flag(F.col(c)), F.lit(False)) for c in (f"valid_{s.lower()}",) if c in df.columns])
    return {
        source.lower(): any_of([F.col(c).isNotNull() for c in columns if c in df.columns])
        | any_of([F.upper(F.col(c)).startswith(source) for c in labels]) | flag(source)
        for source, columns in fed.items()
    }


# Families of intervals that a used source time has to lie in, by the columns that hold their ends.
INTERVALS = {f: (f"{f}_start_us", f"{f}_end_us") for f in ("flight", "continuity", "boundary")}


def provenance_rules(df: DataFrame, policy: ExtractPolicy, intervals: dict[str, tuple[str, str]] = INTERVALS) -> list:
    """Age, time and interval rules for every source whose signals are used. Rows carry the ends of the families of intervals
    that are known; each is judged by itself, all in the one pass of the row rules."""
    rules = []
    for source, used in used_sources(df).items():
        if f"age_{source}_ms" not in df.columns or f"source_time_{source}_us" not in df.columns:
            rules.append(("provenance_missing", source, used, F.col("time_us")))
            continue
        rules += [(f"used_{rule}", scope, bad, example) for rule, scope, bad, example in
                  age_rules(source, used, policy.hold_ms(source.upper()), source)]
        at = F.col(f"source_time_{source}_us")
        for name, (start, end) in intervals.items():
            if start in df.columns and end in df.columns:
                out = (at < F.col(start) - TIME_SLACK_US) | (at >= F.col(end))
                rules.append((f"source_outside_{name}", source, used & F.coalesce(out, F.lit(False)), at))
    return rules


def with_eligibility(df: DataFrame, policy: ExtractPolicy) -> tuple[DataFrame, list]:
    """Recompute eligibility; a recorded true that should be false is a violation, the result is both."""
    rules, columns = [], {}
    for axis, features in policy.features.items():
        name = f"eligible_d{axis}"
        absent = [c for c in features if c not in df.columns]
        parts = [F.col(f"valid_d{axis}"), *[F.lit(False) if c in absent else finite(F.col(c)) for c in features]]
        if absent:
            rules.append(("missing_feature", name, F.col(f"valid_d{axis}"), F.lit(", ".join(absent))))
        if "outlier" in df.columns:
            parts.append(~F.coalesce(flag_of(df, "outlier"), F.lit(False)))
        expected = all_of(parts)
        if name in df.columns:
            recorded = F.coalesce(flag_of(df, name), F.lit(False))
            rules.append(("eligibility", name, recorded & ~expected, F.col("time_us")))
            columns[name] = recorded & expected
        else:
            columns[name] = expected
    return df.withColumns(columns), rules


def split_rules(split: DataFrame) -> DataFrame:
    """Unknown labels, one time in two splits, training not strictly before testing."""
    labels = split.groupBy("log_id").agg(
        F.count_if(~F.coalesce(F.col("split").isin("train", "test"), F.lit(False))).alias("_bad"),
        F.max(F.when(F.col("split") == "train", F.col("time_us"))).alias("_last"),
        F.min(F.when(F.col("split") == "test", F.col("time_us"))).alias("_first"),
    )
    both = split.groupBy("log_id", "time_us").agg(F.min("split").alias("_a"), F.max("split").alias("_b")).where("_a <> _b")
    shared = both.groupBy("log_id").agg(F.count(F.lit(1)).alias("_n"), F.min("time_us").alias("_x"))
    return violations([
        _report(labels.where("_bad > 0"), "split_label", "split", "_bad", F.lit(None)),
        _report(labels.where("_last >= _first"), "split_order", "split", F.lit(1), F.col("_last")),
        _report(shared, "split_time_shared", "split", "_n", F.col("_x")),
        duplicates(split, ("flight_id", "time_us"), "split_duplicate"),
    ])


def membership(split: DataFrame, dataset: DataFrame, keys=("log_id", "flight_id", "time_us")) -> DataFrame:
    """Split rows that are not in the dataset."""
    lost = split.join(dataset.select(*keys), list(keys), "left_anti")
    sums = lost.groupBy("log_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.col(keys[-1])).alias("_x"))
    return _report(sums, "split_membership", "split", "_n", F.col("_x"))


def reconcile(split: DataFrame, dataset: DataFrame, values, flags, keys=("log_id", "flight_id", "time_us"),
              atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """Split rows whose values or flags differ from the dataset row with the same key. A flag that the split lacks is reported
    for all its rows."""
    other = dataset.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in [*values, *flags]])
    rows = split.join(other, list(keys), "left")
    lost = [c for c in flags if c not in split.columns]
    checks = [("split_flag_missing", c, F.lit(True), F.lit(None)) for c in lost]
    flags = [c for c in flags if c not in lost]
    checks += [("split_value", c, differs(F.col(c), F.col(f"_o_{c}"), atol, rtol), F.col(keys[-1])) for c in values]
    as_flag = lambda c: F.coalesce(flag_of(rows, c), F.lit(False))
    checks += [("split_flag", c, as_flag(c) != as_flag(f"_o_{c}"), F.col(keys[-1])) for c in flags]
    return row_rules(rows, checks)


def quality_by(df: DataFrame, key: str, flagged: str = "flagged", state=STATE_COLUMNS) -> DataFrame:
    """Rows, valid rows per axis, flagged rows and missing share of the state, per flight or mode."""
    nulls = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in state])
    return df.groupBy("log_id", key).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(f"valid_d{a}")).alias(f"valid_d{a}") for a in "xyz"],
        F.count_if(F.col(flagged)).alias("outlier_count"),
        (F.avg(nulls / len(state)) * 100).alias("state_nan_percentage"),
    )


def axis_statistics(df: DataFrame, axis: str) -> DataFrame:
    """RMSE of actual against target over the valid rows."""
    good = F.col(f"valid_d{axis}") & finite(F.col(f"d{axis}"))
    square = F.when(good, F.col(f"d{axis}") * F.col(f"d{axis}"))
    return df.groupBy("log_id").agg(F.sqrt(F.avg(square)).alias("rmse"), F.count(square).alias("count_valid"))


def readiness(dataset: DataFrame, split: DataFrame, problems: DataFrame, policy: ExtractPolicy, proxy_axes="xy", warned: bool = True) -> DataFrame:
    """Per log and axis: counts, reasons against learning, and the verdict; one joint row for all axes.

    ``problems`` are violations; both tables carry eligibility flags.
    """
    axes = "xyz"
    fit = {a: F.coalesce(F.col(f"eligible_d{a}"), F.lit(False)) for a in axes}
    joint = all_of(list(fit.values()))
    totals = dataset.groupBy("log_id").agg(
        *[F.count_if(fit[a]).alias(f"_all_{a}") for a in axes], F.count_if(joint).alias("_all_xyz")
    )
    per_split = split.groupBy("log_id").agg(*[
        F.count_if(cond & (F.col("split") == s)).alias(f"_{s}_{a}")
        for s in ("train", "test") for a, cond in [*fit.items(), ("xyz", joint)]
    ])
    broken = problems.select("log_id").distinct().withColumn("_broken", F.lit(True))
    rows = totals.join(per_split, "log_id", "left").join(broken, "log_id", "left").fillna(0).fillna(False, ["_broken"])
    entries = []
    for a in [*axes, "xyz"]:
        n, train, test = F.col(f"_all_{a}"), F.col(f"_train_{a}"), F.col(f"_test_{a}")
        proxy = a in proxy_axes or a == "xyz" and bool(proxy_axes)
        reasons = F.array(
            F.when(F.col("_broken"), F.lit("structural checks failed")),
            F.when(F.lit(proxy), F.lit("horizontal source is a controller proxy")),
            F.when(n < policy.minimum_samples, F.lit("too few eligible samples")),
            F.when((train < policy.minimum_train) | (test < policy.minimum_test), F.lit("too few train or test samples")),
        )
        kept = F.filter(reasons, lambda r: r.isNotNull())
        entries.append(F.struct(F.lit(a).alias("axis"), n.alias("eligible"), train.alias("train"), test.alias("test"), kept.alias("reasons")))
    out = rows.select("log_id", F.explode(F.array(*entries)).alias("_r")).select("log_id", "_r.*")
    ready = "READY_WITH_WARNINGS" if warned else "READY"
    return out.withColumn("status", F.when(F.size("reasons") > 0, F.lit("NOT_READY")).when(F.col("axis") == "xyz", F.lit("READY_WITH_WARNINGS")).otherwise(F.lit(ready)))


def coverage_warning(axis_counts: DataFrame) -> DataFrame:
    """Logs whose vertical axis is not better covered than the horizontal ones."""
    return axis_counts.where("valid_dz <= greatest(valid_dx, valid_dy)")


def extraction_gate(
    logs: DataFrame, covered: DataFrame, identity: DataFrame, timing: DataFrame, segments: DataFrame,
    consumed, allow_truncated_tail: bool = False,
) -> DataFrame:
    """Reasons against extracting a log: content changed, unaudited firmware, damage, clock faults, no flight.

    ``logs``: log_id, digest, inspected_digest. ``identity``: log_id, audited. ``covered`` from parser_status.
    """
    changed = logs.where(~F.coalesce(F.col("digest") == F.col("inspected_digest"), F.lit(False)))
    unknown = logs.join(identity.where("audited"), "log_id", "left_anti")
    accepted = F.col("status") == "PASS"
    if allow_truncated_tail:
        accepted = accepted | ((F.col("status") == "PASS_WITH_WARNINGS") & (F.col("anomalies") == 1))
    damaged = covered.where(~accepted)
    backward = timing.where(F.col("message").isin(*consumed) & (F.col("backwards") > 0))
    faults = backward.groupBy("log_id", "message").agg(F.sum("backwards").alias("_n"))
    grounded = logs.join(segments.select("log_id").distinct(), "log_id", "left_anti")
    return violations([
        _report(changed, "content_digest", "log", F.lit(1), F.col("digest")),
        _report(unknown, "firmware", "log", F.lit(1), F.lit(None)),
        _report(damaged, "parser", "log", F.col("anomalies"), F.col("status")),
        _report(faults, "backward_time", F.col("message"), "_n", F.lit(None)),
        _report(grounded, "no_flight", "log", F.lit(1), F.lit(None)),
    ])
