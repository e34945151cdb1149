"""Distributions, field inventories and timing statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import RatePolicy
from strandline.functions.numeric import clean, finite, seconds
from strandline.operators.ordered import Scan, rank_chunk

CELLS_PER_OCTAVE = 64
_SMALLEST = 1075  # no positive number lies below 2 to the power -1075


def match_keys(keys, prefix: str) -> Column:
    """Join condition key <=> prefixed key, so that missing keys meet too."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return condition


def prefixed(df: DataFrame, keys, prefix: str) -> DataFrame:
    for k in keys:
        df = df.withColumnRenamed(k, f"{prefix}{k}")
    return df


def attach(rows: DataFrame, table: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join per-group values back to rows. Spark broadcasts the table when its measured size allows it and
    otherwise sort-merges with skewed partitions split."""
    right = prefixed(table, keys, "_r_")
    return rows.join(right, match_keys(keys, "_r_"), how).drop(*[f"_r_{k}" for k in keys])


def value_cell(x: Column) -> Column:
    """Cells that sort like the values, whatever the data: 64 for each doubling, mirrored below zero."""
    size = F.floor(CELLS_PER_OCTAVE * (F.log2(F.abs(x)) + _SMALLEST)) + 1
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("bigint") * size).cast("bigint")


def counted(rows: DataFrame, keys, value: str) -> DataFrame:
    """Equal values once, as ``_x`` with their number ``_c``; missing values are left out. ``value`` is free of NaN."""
    kept = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    return kept.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))


def exact_percentiles(df: DataFrame, keys, value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group; ``points`` maps column to fraction."""
    return counted_percentiles(counted(df, keys, value), keys, points)


def counted_percentiles(counts: DataFrame, keys, points: dict[str, float]) -> DataFrame:
    """Percentiles of counted values (keys, ``_x``, ``_c``).

    Values are dealt to cells that sort like them. Running totals over the few cells of a group tell in which cells the
    wanted ranks lie; only the values of those cells are ranked, one cell a window. No group comes together in one task, and
    all sizes take the same way.
    """
    keys = list(keys)
    counts = counts.withColumn("_cell", value_cell(F.col("_x")))
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_n"))
    group = Window.partitionBy(*keys)
    cells = cells.withColumn("_total", F.sum("_n").over(group)).withColumn(
        "_below", F.sum("_n").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    )
    inside = lambda k: (k >= F.col("_below")) & (k < F.col("_below") + F.col("_n"))
    wanted = []
    for i, f in enumerate(points.values()):
        rank = F.lit(float(f)) * (F.col("_total") - 1)
        for k, share in ((F.floor(rank), F.when(F.floor(rank) == F.ceil(rank), 1.0).otherwise(F.ceil(rank) - rank)),
                         (F.ceil(rank), F.when(F.floor(rank) == F.ceil(rank), 0.0).otherwise(rank - F.floor(rank)))):
            wanted.append(F.struct(F.lit(i).alias("i"), k.cast("bigint").alias("k"), share.cast("double").alias("share")))
    cells = cells.withColumn("_wanted", F.filter(F.array(*wanted), lambda w: inside(w["k"]))).where(F.size("_wanted") > 0)
    held = attach(counts, cells.select(*keys, "_cell", "_below", "_wanted"), [*keys, "_cell"], "inner")
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_upto", F.sum("_c").over(in_cell) + F.col("_below"))
    hit = F.filter("_wanted", lambda w: (w["k"] < F.col("_upto")) & (w["k"] >= F.col("_upto") - F.col("_c")))
    found = held.select(*keys, "_x", F.explode_outer(hit).alias("_w")).where("_w is not null")
    return found.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("_w.i") == i, F.when(F.col("_w.share") == 0, 0.0).otherwise(F.col("_w.share") * F.col("_x")))).alias(name)
        for i, name in enumerate(points)
    ])


def percentile_name(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def moments(x: Column) -> list[Column]:
    """Aggregates of the finite values: one pass with partial results in every task; the spread is merged about means."""
    return [
        F.count(x).alias("finite_count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        (F.max(x) - F.min(x)).alias("range"),
    ]


def distribution(df: DataFrame, keys, value: str, percentiles=(95, 99)) -> DataFrame:
    """finite_count, min, max, median, mean, population std, range and percentiles of the finite values.

    Groups without a finite value keep a row with a zero count. The rows are read twice: for the moments, and for the counts of
    equal values that the percentiles come from.
    """
    keys = list(keys)
    rows = df.select(*keys, clean(F.col(value)).cast("double").alias("_x"))
    return with_percentiles(rows.groupBy(*keys).agg(*moments(F.col("_x"))), counted(rows, keys, "_x"), keys, percentiles)


def with_percentiles(stats: DataFrame, counts: DataFrame, keys, percentiles) -> DataFrame:
    """Median and percentiles of counted values (keys, ``_x``, ``_c``) beside other statistics of the groups: one join."""
    points = {"median": 0.5, **{percentile_name(p): p / 100 for p in percentiles}}
    return attach(stats, counted_percentiles(counts, keys, points), keys)


def message_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("log_id", "message").agg(F.count(F.lit(1)).alias("n"))


def long_fields(table: DataFrame, ids, fields) -> DataFrame:
    """Numeric columns as (ids, field, value) rows in one pass."""
    return table.select(*ids, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(list(ids), list(fields), "field", "value")


def inventory(values: DataFrame, percentiles=(1, 95, 99)) -> DataFrame:
    """Field statistics at two scopes: whole message, and per instance where the message has instances.

    ``values`` holds (log_id, message, instance, field, value) with text or numeric values. Rows without an instance are a
    group of their own in a message that has instances elsewhere. Equal values are counted once; both scopes come from the
    counts.
    """
    base = ["log_id", "message", "field"]
    keys = [*base, "inventory_scope", "instance"]
    # Every row counts in its message and in its instance; both leave a task as partial results.
    nobody = F.lit(None).cast("string")
    scopes = F.explode(F.array(
        F.struct(F.lit("message").alias("inventory_scope"), nobody.alias("instance")),
        F.struct(F.lit("instance").alias("inventory_scope"), F.col("instance").cast("string").alias("instance")),
    )).alias("_s")
    rows = values.select(*base, F.col("value").cast("string").alias("value"), scopes).select(*base, "_s.*", "value")
    num = F.col("value").try_cast("double")
    classes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("value").isNull() | (num.isNotNull() & ~finite(num))).alias("invalid_count"),
        F.count_if(F.col("value").isNotNull() & num.isNull()).alias("nonnumeric_count"), *moments(clean(num)),
    )
    named = F.max((F.col("inventory_scope") == "instance") & F.col("instance").isNotNull()).over(Window.partitionBy("log_id", "message"))
    shown = classes.withColumn("_several", named).where((F.col("inventory_scope") == "message") | F.col("_several")).drop("_several")
    return with_percentiles(shown, counted(rows.select(*keys, clean(num).alias("_x")), keys, "_x"), keys, percentiles)


def with_canonical(stats: DataFrame, catalog: DataFrame, names=("min", "max", "median", "mean", "std", "range", "p1", "p95", "p99")) -> DataFrame:
    """Statistics in canonical units: the factor is positive, so they scale instead of being computed again."""
    units = catalog.select("log_id", "message", "field", "canonical_unit", "decoded_unit", "canonical_factor")
    joined = stats.join(units, ["log_id", "message", "field"], "left")
    present = [n for n in names if n in stats.columns]
    return joined.select("*", *[(F.col(n) * F.col("canonical_factor")).alias(f"{n}_canonical") for n in present])


def column_stats(table: DataFrame, columns, keys=(), percentiles=(1, 99), epsilon: float = 1e-3) -> DataFrame:
    """Statistics, missing share and constancy of every numeric column (per key where given)."""
    group = [*keys, "field"]
    rows = long_fields(table, list(keys), columns).withColumn("_x", clean(F.col("value")))
    absent = F.col("value").isNull() | F.isnan("value")
    stats = rows.groupBy(*group).agg(*moments(F.col("_x")), (F.count_if(absent) / F.count(F.lit(1)) * 100).alias("missing_pct"))
    out = with_percentiles(stats, counted(rows, group, "_x"), group, percentiles)
    return out.withColumn("constant", F.coalesce((F.col("finite_count") > 0) & (F.col("range") < F.lit(epsilon)), F.lit(False)))


def step_counts(rows: DataFrame, keys, index: str = "record_index") -> DataFrame:
    """Time differences of consecutive timed rows in acquisition order (NULL on the first), equal ones once with ``_c``."""
    timed = rank_chunk(rows.where(F.col("time_us").isNotNull()).select(*keys, "time_us", index), index)
    steps = Scan(timed, keys, (index,)).previous("before", "time_us").run()
    return steps.groupBy(*keys, (F.col("time_us") - F.col("before.time_us")).alias("dt")).agg(F.count(F.lit(1)).alias("_c"))


def backward_steps(rows: DataFrame, keys=("log_id", "message", "instance")) -> DataFrame:
    """Steps back in time of every clock, from the number of times each step occurs; missing instances are one clock."""
    keys = list(keys)
    back = F.coalesce(F.sum(F.when(F.col("dt") < 0, F.col("_c"))), F.lit(0)).cast("bigint")
    return step_counts(rows, keys).groupBy(*keys).agg(back.alias("backwards"))


def _judged(steps: DataFrame, keys, policy: RatePolicy) -> DataFrame:
    """Counted steps (keys, dt, ``_c``) with their group's median positive step and gap threshold."""
    positive = steps.where("dt > 0").select(*keys, F.col("dt").cast("double").alias("_x"), "_c")
    floor = F.lit(policy.absolute_gap_threshold_s * 1e6)
    limit = F.greatest(floor, F.lit(policy.gap_multiplier) * F.col("median_dt_us"))
    medians = counted_percentiles(positive, keys, {"median_dt_us": 0.5})
    return attach(steps, medians, keys).withColumn("threshold_us", F.coalesce(limit, floor))


def gap_thresholds(steps: DataFrame, keys, policy: RatePolicy = RatePolicy()) -> DataFrame:
    """Median positive step and gap threshold per group of rows with a step ``dt``."""
    counts = steps.groupBy(*keys, "dt").agg(F.count(F.lit(1)).alias("_c"))
    return _judged(counts, keys, policy).select(*keys, "median_dt_us", "threshold_us").distinct()


def timing_stats(rows: DataFrame, keys, policy: RatePolicy = RatePolicy(), more: list[Column] | None = None) -> DataFrame:
    """Counts, span, rates, gaps and clock faults per group, in seconds and hertz. All but the first and last time follow
    from the number of times each step occurs. ``more`` are further aggregates of the group's rows."""
    keys, more = list(keys), more or []
    timed = F.col("time_us").isNotNull()
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("time_us").alias("timestamped"),
        F.min_by("time_us", F.when(timed, F.col("record_index"))).alias("first_us"),
        F.max_by("time_us", F.when(timed, F.col("record_index"))).alias("last_us"), *more,
    )
    judged = _judged(step_counts(rows, keys), keys, policy)
    dt, c = F.col("dt"), F.col("_c")
    within = (dt > 0) & (dt <= F.col("threshold_us"))
    number = lambda on: F.coalesce(F.sum(F.when(on, c)), F.lit(0)).cast("bigint")
    active = judged.groupBy(*keys).agg(
        F.min("dt").alias("min_dt_us"), F.max("dt").alias("max_dt_us"), number(dt == 0).alias("duplicates"),
        number(dt < 0).alias("backwards"), number(within).alias("active_steps"),
        F.coalesce(F.sum(F.when(within, dt * c)), F.lit(0)).alias("active_us"),
        (number((dt < 0) | (dt > F.col("threshold_us"))) + 1).alias("active_windows"),
        F.max("median_dt_us").alias("median_dt_us"), F.max("threshold_us").alias("threshold_us"),
    )
    out = attach(counts, active, keys)
    span = seconds(F.col("last_us") - F.col("first_us"))
    return out.select(
        *keys, "n",
        F.coalesce("timestamped", F.lit(0)).alias("timestamped"),
        seconds(F.col("first_us")).alias("first_time_s"),
        seconds(F.col("last_us")).alias("last_time_s"),
        F.when(span > 0, (F.col("timestamped") - 1) / span).alias("span_rate_hz"),
        F.try_divide(F.lit(1.0), seconds(F.col("median_dt_us"))).alias("nominal_rate_hz"),
        F.try_divide(F.col("active_steps"), seconds(F.col("active_us"))).alias("active_rate_hz"),
        seconds(F.coalesce("active_us", F.lit(0))).alias("active_duration_s"),
        F.coalesce("active_windows", F.lit(0)).alias("active_windows"),
        seconds(F.coalesce("threshold_us", F.lit(policy.absolute_gap_threshold_s * 1e6))).alias("gap_threshold_s"),
        seconds(F.col("median_dt_us")).alias("median_dt_s"),
        seconds(F.col("min_dt_us")).alias("min_dt_s"),
        seconds(F.col("max_dt_us")).alias("max_dt_s"),
        F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
        F.coalesce("backwards", F.lit(0)).alias("backwards"),
        *[c for c in counts.columns if c.startswith("_")],
    )


# Measures that mean nothing once several instances are mixed.
MIXED_NULLS = (
    "nominal_rate_hz", "active_rate_hz", "active_duration_s", "median_dt_s", "min_dt_s", "max_dt_s",
    "gap_threshold_s", "active_windows",
)


def message_timing(rows: DataFrame, policy: RatePolicy = RatePolicy()) -> DataFrame:
    """Timing per message; rate measures are withheld where a message mixes instances. Missing instances beside others are
    one more group."""
    who = F.col("instance")
    several = (F.min(who) != F.max(who)) | (F.max(who.isNull()) & F.max(who.isNotNull()))
    stats = timing_stats(rows, ["log_id", "message"], policy, [F.coalesce(several, F.lit(False)).alias("_mixed")])
    scope = F.when(F.col("_mixed"), F.lit("mixed_instances_count_only")).otherwise(F.lit("message"))
    kept = [F.when(~F.col("_mixed"), F.col(c)).alias(c) if c in MIXED_NULLS else F.col(c) for c in stats.columns if c != "_mixed"]
    return stats.select(*kept, scope.alias("rate_scope"))


def instance_timing(rows: DataFrame, policy: RatePolicy = RatePolicy()) -> DataFrame:
    """Timing per instance of the messages that have instances; rows without one are a group of their own."""
    several = rows.where("instance is not null").select("log_id", "message").distinct()
    return timing_stats(rows.join(several, ["log_id", "message"], "left_semi"), ["log_id", "message", "instance"], policy)


def instance_extremes(values: DataFrame, fields) -> DataFrame:
    """min, max and median of the named fields per instance, side by side; ``values`` is (ids, field, value)."""
    keys = ["log_id", "message", "instance"]
    stats = distribution(values.where(F.col("field").isin(*fields)), [*keys, "field"], "value", ())
    pick = [
        F.max(F.when(F.col("field") == f, F.col(m))).alias(f"{f}_{m}") for f in fields for m in ("min", "max", "median")
    ]
    return stats.groupBy(*keys).agg(*pick)


def backward_warnings(timing: DataFrame) -> DataFrame:
    return timing.where("backwards > 0")
