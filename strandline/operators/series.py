"""Tables behind diagnostic plots: runs without gaps, invalid spans, histograms, mode timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numeric import finite
from strandline.operators.ordered import WHOLE_CELLS, Chunks, Scan, changed, rank_chunk
from strandline.operators.profile import attach, exact_percentiles

GAP_FACTOR = 3  # Fixed value: a step longer than three median steps breaks a line.
DEFAULT_HALF_STEP_US = 50_000.0  # Fixed value: half width of a lone point without neighbours.
MAX_BINS = 40  # Fixed value.


def _medians(steps: DataFrame, keys) -> DataFrame:
    positive = steps.withColumn("_dt", F.col("time_us") - F.col("_before.time_us")).where("_dt > 0")
    return exact_percentiles(positive, keys, "_dt", {"median_us": 0.5})


def median_steps(rows: DataFrame, keys, index: str = "row_seq") -> DataFrame:
    """Median positive step per group."""
    steps = Scan(rank_chunk(rows.select(*keys, "time_us", index), index), keys, (index,)).previous("_before", "time_us").run()
    return _medians(steps, keys)


def runs(rows: DataFrame, keys=("log_id",), breaks=("flight_id", "continuity_id", "mode"), index: str = "row_seq",
         chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Adds ``run_id``: a new run at every declared boundary, clock fault or long gap, in stored order.

    The median and the breaks read the same shuffled steps; nothing is stored."""
    keys = list(keys)
    steps = Scan(chunks.by_rank(rows, index), keys, (index,)).previous("_before", "time_us", *breaks).run()
    steps = attach(steps, _medians(steps, keys), keys)
    dt = F.col("time_us") - F.col("_before.time_us")
    broken = changed("_before", *breaks) if breaks else F.col("_before").isNull()
    broken = broken | dt.isNull() | (dt <= 0) | (dt > F.lit(GAP_FACTOR) * F.col("median_us"))
    marked = steps.withColumn("_new", F.when(F.coalesce(broken, F.lit(False)), 1).otherwise(0))
    return Scan(marked, keys, (index,)).total("run_id", F.col("_new")).run().select(*rows.columns, "run_id")


def invalid_spans(rows: DataFrame, valid: Column, keys=("log_id",), index: str = "row_seq") -> DataFrame:
    """Stretches of invalid rows inside a run; edges lie half-way to the valid neighbour, or half a median step
    out at the ends of the run. ``rows`` carry ``run_id``."""
    keys = list(keys)
    within = [*keys, "run_id"]
    marked = rank_chunk(rows.select(*within, "time_us", index, F.coalesce(valid, F.lit(False)).alias("_ok")), index)
    near = Scan(marked, within, (index,)).previous("_before", "time_us", "_ok").following("_after", "time_us", "_ok").run()
    bad = near.where(~F.col("_ok"))
    opens = F.col("_before").isNull() | F.col("_before._ok")
    closes = F.col("_after").isNull() | F.col("_after._ok")
    ends = bad.where(opens | closes).select(
        *within, "_chunk", index, "time_us", opens.alias("_opens"), closes.alias("_closes"),
        F.col("_before.time_us").alias("_prev_us"), F.col("_after.time_us").alias("_next_us"),
    )
    ends = Scan(ends, within, (index,)).following("_end", "time_us", "_next_us").run().where("_opens")
    last = F.when(F.col("_closes"), F.struct(F.col("time_us"), F.col("_next_us"))).otherwise(F.col("_end"))
    spans = ends.select(*within, "time_us", "_prev_us", last.alias("_last"))
    spans = attach(spans, median_steps(rows, keys, index), keys)
    half = F.coalesce(F.col("median_us") / 2, F.lit(DEFAULT_HALF_STEP_US))
    left = F.when(F.col("_prev_us").isNotNull(), (F.col("_prev_us") + F.col("time_us")) / 2.0).otherwise(F.col("time_us") - half)
    right = F.when(F.col("_last._next_us").isNotNull(), (F.col("_last.time_us") + F.col("_last._next_us")) / 2.0).otherwise(
        F.col("_last.time_us") + half
    )
    return spans.select(*within, left.alias("left_us"), right.alias("right_us"))


def residual_histogram(rows: DataFrame, value: str, valid: Column, keys=("log_id",)) -> DataFrame:
    """Equal-width bins of the valid finite values, empty bins included; the last bin is closed. Also the
    number of rows left out."""
    keys = list(keys)
    used = F.coalesce(valid, F.lit(False)) & finite(F.col(value))
    shape = rows.groupBy(*keys).agg(
        F.count_if(used).alias("n"), F.count_if(~used).alias("excluded"),
        F.min(F.when(used, F.col(value))).alias("lo"), F.max(F.when(used, F.col(value))).alias("hi"),
    ).where("n > 0")
    flat = F.col("lo") == F.col("hi")
    shape = shape.select(
        *keys, "n", "excluded",
        F.least(F.lit(MAX_BINS), F.greatest(F.lit(1), F.floor(F.sqrt("n")))).cast("bigint").alias("bins"),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    inside = attach(rows.where(used).select(*keys, value), shape, keys, "inner")
    place = F.least(F.col("bins") - 1, F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")))
    counts = inside.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n_values"))
    every = shape.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)))
    counts = counts.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("bin").alias("_c_bin"), "n_values")
    match = F.col("bin") == F.col("_c_bin")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return every.join(counts, match, "left").select(
        *keys, "bin", (F.col("lo") + width * F.col("bin")).alias("left_edge"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"), "excluded",
    )


def mode_codes(rows: DataFrame, keys=("log_id",), mode: str = "mode") -> DataFrame:
    """Number of each mode label by first appearance. One row per label and log."""
    first = rows.where(F.col(mode).isNotNull()).groupBy(*keys, mode).agg(F.min("time_us").alias("first_us"))
    order = Window.partitionBy(*keys).orderBy("first_us", mode)
    return first.withColumn("code", F.row_number().over(order) - 1)


SERIES = {
    "position": ("px", "py", "pz"),
    "velocity": ("vx", "vy", "vz"),
    "acceleration": ("ax", "ay", "az"),
    "target": ("ax_target", "ay_target", "az_target"),
    "residual": ("dx", "dy", "dz"),
    "battery": ("battery_v", "battery_i"),
}


def series(rows_with_runs: DataFrame, keys=("log_id",), index: str = "row_seq") -> DataFrame:
    """Every plotted series as (keys, run, time, series, column, value), non-finite values as gaps."""
    names = [(kind, c) for kind, cs in SERIES.items() for c in cs if c in rows_with_runs.columns]
    names += [("age", c) for c in rows_with_runs.columns if c.startswith("age_") and c.endswith("_ms")]
    points = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("series"), F.lit(c).alias("column"),
                 F.when(finite(F.col(c)), F.col(c).cast("double")).alias("value"))
        for kind, c in names
    ])).alias("_p")
    return rows_with_runs.select(*keys, "run_id", index, "time_us", points).select(*keys, "run_id", index, "time_us", "_p.*")
