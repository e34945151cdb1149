"""Continuity intervals: stretches of a flight over which an old value may be held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import RESET_EVENT_IDS
from strandline.functions.numeric import clean
from strandline.operators.asof import latest_before
from strandline.operators.intervals import with_flight
from strandline.operators.ordered import WHOLE_CELLS, Chunks, Scan, changed
from strandline.session import settle

FLIGHT = ["log_id", "flight_id"]
STATUS_FIELDS = ("core", "status", "fault", "timeout", "offset_n", "offset_e")


def primary_status(rows: DataFrame, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Status rows that count for a flight: those of the primary core, and before the new primary has spoken
    the other cores' rows with their status masked, since they already announce the switch.

    ``rows`` carry a flight, ``core``, ``primary_core`` and status fields.
    """
    order = ("time_us", "record_index")
    rows = settle(Scan(chunks.add(rows), FLIGHT, order).previous("_before", "primary_core").run())
    own = F.coalesce(F.col("core") == F.col("primary_core"), F.lit(False))
    place = F.struct(*order)
    rows = (
        Scan(rows, FLIGHT, order)
        .last("_run", F.when(changed("_before", "primary_core"), place))
        .last("_spoke", F.when(own, place))
        .run()
    )
    silent = F.col("_spoke").isNull() | (F.col("_spoke") < F.col("_run"))
    kept = rows.where(own | silent).withColumn("_own", own)
    masked = [
        F.when(F.col("_own"), F.col(c)).alias(c) if c in STATUS_FIELDS else F.col(c)
        for c in kept.columns if not c.startswith("_")
    ]
    return kept.select(*masked)


def break_points(rows: DataFrame, signature, max_age_us: int, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Times at which a status source interrupts continuity: its signature changes, or it was silent for longer
    than it may be held (then at the end of the hold and again when it comes back)."""
    named = [f"_g{i}" for i in range(len(signature))]
    marked = rows.select(*FLIGHT, "time_us", "record_index", *[c.alias(n) for c, n in zip(signature, named)])
    steps = Scan(chunks.add(marked), FLIGHT, ("time_us", "record_index")).previous("_before", "time_us", *named).run()
    steps = steps.where("_before is not null")
    silent = F.col("time_us") - F.col("_before.time_us") > F.lit(max_age_us)
    points = F.array(
        F.when(changed("_before", *named) | silent, F.col("time_us")),
        F.when(silent, F.col("_before.time_us") + F.lit(max_age_us)),
    )
    return steps.select(*FLIGHT, F.explode(F.filter(points, lambda t: t.isNotNull())).alias("time_us"))


def status_signature() -> list:
    return [clean(F.col(c)) for c in ("primary_core", "status", "fault", "timeout", "offset_n", "offset_e")]


def continuity(
    segments: DataFrame,
    intervals: DataFrame,
    events: DataFrame,
    breaks: list[DataFrame],
    chunks: Chunks = WHOLE_CELLS,
) -> DataFrame:
    """Numbered half-open continuity intervals from five kinds of boundaries.

    ``events`` are event rows with an ``id``; ``breaks`` come from ``break_points``.
    """
    starts = segments.select(*FLIGHT, F.col("start_us").alias("time_us"))
    modes = intervals.where("flight_id is not null").select(*FLIGHT, F.col("start_us").alias("time_us"))
    resets = with_flight(events.where(F.col("id").isin(*RESET_EVENT_IDS)), segments, chunks).select(*FLIGHT, "time_us")
    points = starts.unionByName(modes).unionByName(resets)
    for part in breaks:
        points = points.unionByName(part)
    return number_boundaries(points.distinct(), segments, chunks)


def number_boundaries(points: DataFrame, segments: DataFrame, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Boundary points to intervals with ids that run on across the flights of a log."""
    ends = segments.select(*FLIGHT, F.col("start_us").alias("_s"), F.col("end_us").alias("_e"))
    inside = settle(chunks.add(points.join(ends, FLIGHT).where("time_us >= _s and time_us < _e")))
    rows = (
        Scan(inside, ["log_id"], ("time_us",))
        .total("continuity_id", F.lit(1)).following("_after", "time_us", "flight_id").run()
    )
    same = F.col("_after.flight_id") == F.col("flight_id")
    end = F.when(F.coalesce(same, F.lit(False)), F.col("_after.time_us")).otherwise(F.col("_e"))
    return rows.select(*FLIGHT, "continuity_id", F.col("time_us").alias("start_us"), end.alias("end_us"))


def boundary_source(intervals: DataFrame) -> DataFrame:
    """Continuity intervals in the shape of an as-of source."""
    return intervals.select(
        "log_id", F.col("start_us").alias("time_us"), F.col("continuity_id").alias("record_index"),
        "continuity_id", "flight_id", "end_us",
    )


def core_rows(states: DataFrame, status: DataFrame, intervals: DataFrame, max_age_us: int, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """State rows whose core was the fresh, reported primary at that instant, inside one continuity interval."""
    found = latest_before(states, {"_st": status.drop("flight_id"), "_bound": boundary_source(intervals)}, chunks=chunks)
    good = (
        (F.col("_st.core") == F.col("_st.primary_core")) & (F.col("core") == F.col("_st.primary_core"))
        & (F.col("_st.time_us") >= F.col("_bound.time_us")) & (F.col("time_us") < F.col("_bound.end_us"))
        & (F.col("time_us") - F.col("_st.time_us") <= F.lit(max_age_us))
    )
    return found.where(F.coalesce(good, F.lit(False))).select(*states.columns)
