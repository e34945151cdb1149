"""Events to half-open intervals, and measures on intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.health import horizontal_position_ok
from strandline.operators.asof import latest_before
from strandline.operators.ordered import WHOLE_CELLS, Chunks, Scan, changed, rank_chunk
from strandline.operators.profile import attach
from strandline.session import settle

STATUS_HOLD_US = 1_000_000  # Fixed value: longest hold of a status row in duration sums.


def log_bounds(rows: DataFrame) -> DataFrame:
    """First and last time per log and the span between them."""
    ends = rows.groupBy("log_id").agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))
    return ends.withColumn("duration_us", F.col("last_us") - F.col("first_us"))


def arm_events(arm: DataFrame, ev: DataFrame) -> DataFrame:
    """Arm states per log: the ARM message where a log has it, else event ids 10 and 11."""
    direct = arm.where(F.col("time_us").isNotNull() & F.col("arm_state").isin(0, 1)).select(
        "log_id", "time_us", "record_index", F.col("arm_state").cast("int").alias("state"), F.lit("ARM.ArmState").alias("source")
    )
    derived = ev.where(F.col("time_us").isNotNull() & F.col("id").isin(10, 11)).select(
        "log_id", "time_us", "record_index", F.when(F.col("id") == 10, 1).otherwise(0).alias("state"),
        F.lit("EV.Id (10=armed, 11=disarmed)").alias("source"),
    )
    with_arm = direct.select("log_id").distinct()
    return direct.unionByName(derived.join(with_arm, "log_id", "left_anti"))


def armed_segments(events: DataFrame, bounds: DataFrame, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """One row per armed stretch. Repeated reports change nothing; an unfinished one ends with the log."""
    rows = chunks.add(events)
    rows = Scan(rows, ["log_id"], ("time_us", "record_index")).previous("before", "state").run()
    turns = rows.where(changed("before", "state"))
    turns = (
        Scan(turns, ["log_id"], ("time_us", "record_index"))
        .following("after", "time_us")
        .total("flight_id", F.col("state").cast("bigint"))
        .run()
    )
    segments = turns.where("state = 1").join(bounds.select("log_id", "last_us"), "log_id", "left")
    return segments.select(
        "log_id", "flight_id",
        F.col("time_us").alias("start_us"),
        F.coalesce("after.time_us", "last_us").alias("end_us"),
        F.col("after").isNull().alias("open_ended"),
        "source",
        (F.coalesce("after.time_us", "last_us") - F.col("time_us")).alias("duration_us"),
    )


def repeated_arms(events: DataFrame, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Armed reports inside an armed stretch."""
    rows = chunks.add(events)
    rows = Scan(rows, ["log_id"], ("time_us", "record_index")).previous("before", "state").run()
    return rows.where((F.col("state") == 1) & (F.col("before.state") == 1)).select("log_id", "time_us", "record_index")


def label_modes(modes: DataFrame, names: DataFrame) -> DataFrame:
    """Mode events with their number (ModeNum, else Mode) and label, UNKNOWN(n) for numbers without one.

    ``names`` is the fixed table of mode numbers, a few dozen rows.
    """
    number = F.coalesce("mode_num", "mode").cast("bigint")
    events = modes.where(F.col("time_us").isNotNull()).select("log_id", "time_us", "record_index", number.alias("mode_number"))
    text = F.coalesce("label", F.concat(F.lit("UNKNOWN("), F.col("mode_number").cast("string"), F.lit(")")))
    return events.join(names, "mode_number", "left").select(
        "log_id", "time_us", "record_index", "mode_number", text.alias("mode")
    )


def boundary_points(bounds: DataFrame, modes: DataFrame, arms: DataFrame, segments: DataFrame) -> DataFrame:
    """All times at which something may change, once each."""
    at = [
        bounds.select("log_id", F.col("first_us").alias("time_us")),
        bounds.select("log_id", F.col("last_us").alias("time_us")),
        modes.select("log_id", "time_us"),
        arms.select("log_id", "time_us"),
        segments.select("log_id", F.col("start_us").alias("time_us")),
        segments.select("log_id", F.col("end_us").alias("time_us")),
    ]
    points = at[0]
    for other in at[1:]:
        points = points.unionByName(other)
    return points.where("time_us is not null").distinct()


def mode_intervals(
    bounds: DataFrame, modes: DataFrame, arms: DataFrame, segments: DataFrame, chunks: Chunks = WHOLE_CELLS
) -> DataFrame:
    """Tiles of [first, last) with constant flight, arm state and mode; equal neighbours are one tile."""
    points = boundary_points(bounds, modes, arms, segments)
    flights = segments.select(
        "log_id", F.col("start_us").alias("time_us"), F.col("flight_id").alias("record_index"), "flight_id", "end_us"
    )
    tiles = latest_before(points, {"m": modes, "a": arms, "f": flights}, chunks=chunks)
    tiles = tiles.select(
        "log_id", "time_us",
        F.when(F.col("time_us") < F.col("f.end_us"), F.col("f.flight_id")).alias("flight_id"),
        (F.col("a.state") == 1).alias("armed"),
        F.col("m.mode_number").alias("mode_number"),
        F.coalesce("m.mode", F.lit("UNKNOWN")).alias("mode"),
    )
    tiles = tiles.join(bounds.select("log_id", "last_us"), "log_id").where("time_us < last_us")
    tiles = settle(chunks.add(tiles))
    tiles = Scan(tiles, ["log_id"], ("time_us",)).previous("before", "flight_id", "armed", "mode_number").run()
    starts = tiles.where(changed("before", "flight_id", "armed", "mode_number"))
    starts = Scan(starts, ["log_id"], ("time_us",)).following("after", "time_us").total("interval_id", F.lit(1)).run()
    end = F.coalesce("after.time_us", "last_us")
    return starts.select(
        "log_id", "interval_id", F.col("time_us").alias("start_us"), end.alias("end_us"),
        (end - F.col("time_us")).alias("duration_us"), "flight_id", "armed", "mode_number", "mode",
    )


def flight_modes(intervals: DataFrame) -> DataFrame:
    """Modes of each flight in the order of first use. The list is as short as the table of modes."""
    first = intervals.where("flight_id is not null").groupBy("log_id", "flight_id", "mode").agg(F.min("start_us").alias("at"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "mode")))
    return first.groupBy("log_id", "flight_id").agg(F.transform(ordered, lambda s: s["mode"]).alias("modes"))


def locate(
    points: DataFrame,
    intervals: DataFrame,
    columns,
    alias: str = "interval",
    keys=("log_id",),
    chunks: Chunks = WHOLE_CELLS,
) -> DataFrame:
    """Range join for intervals that do not overlap: the one holding the point, as a struct, else NULL."""
    starts = intervals.select(
        *keys, F.col("start_us").alias("time_us"), F.col("start_us").alias("record_index"), "end_us", *columns
    )
    found = latest_before(points, {alias: starts}, keys, chunks=chunks)
    holds = F.col("time_us") < F.col(f"{alias}.end_us")
    return found.withColumn(alias, F.when(holds, F.col(alias)))


def arm_state(armed: Column) -> Column:
    return F.when(armed.isNull(), F.lit("unknown")).when(armed, F.lit("armed")).otherwise(F.lit("disarmed"))


def with_context(rows: DataFrame, intervals: DataFrame, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Interval number and arm state of every row's instant."""
    found = locate(rows, intervals, ["interval_id", "armed", "flight_id"], "_ctx", chunks=chunks)
    return found.select(
        *rows.columns, F.col("_ctx.interval_id").alias("context"), arm_state(F.col("_ctx.armed")).alias("state")
    )


def with_flight(rows: DataFrame, segments: DataFrame, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Rows inside an armed stretch, with its id and ends; rows outside are dropped."""
    found = locate(rows, segments, ["flight_id"], "_seg", chunks=chunks).where("_seg is not null")
    return found.select(
        *rows.columns, F.col("_seg.flight_id").alias("flight_id"),
        F.col("_seg.time_us").alias("flight_start_us"), F.col("_seg.end_us").alias("flight_end_us"),
    )


def samples_per_flight(segments: DataFrame, rows: DataFrame, messages, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Rows of each named message inside each flight; flights without rows keep a zero."""
    inside = with_flight(rows.where(F.col("message").isin(*messages)).select("log_id", "time_us", "message"), segments, chunks)
    counts = inside.groupBy("log_id", "flight_id", "message").agg(F.count(F.lit(1)).alias("samples"))
    wanted = F.explode(F.array(*[F.lit(m) for m in messages])).alias("message")
    grid = segments.select("log_id", "flight_id", wanted)
    return grid.join(counts, ["log_id", "flight_id", "message"], "left").fillna(0, ["samples"])


def gps_status_sets(segments: DataFrame, gps: DataFrame, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Fix types seen per receiver and flight, as a map of sorted lists. Fix types are a short enumeration."""
    inside = with_flight(gps.where("status is not null"), segments, chunks)
    who = F.coalesce(F.col("instance").cast("string"), F.lit("unidentified"))
    distinct = inside.select("log_id", "flight_id", who.alias("who"), "status").distinct()
    per = distinct.groupBy("log_id", "flight_id", "who").agg(F.sort_array(F.collect_list("status")).alias("seen"))
    entries = F.sort_array(F.collect_list(F.struct("who", "seen")))
    return per.groupBy("log_id", "flight_id").agg(F.map_from_entries(entries).alias("gps_status"))


def status_sets(rows: DataFrame) -> DataFrame:
    """Primary cores, solution and fault values of the primary rows of each flight (``rows`` carry a flight)."""
    primary = rows.where("core = primary_core and status is not null and fault is not null")
    distinct = primary.select("log_id", "flight_id", "primary_core", "status", "fault").distinct()
    return distinct.groupBy("log_id", "flight_id").agg(
        F.sort_array(F.collect_set("primary_core")).alias("primary_cores"),
        F.sort_array(F.collect_set("status")).alias("solution_status_values"),
        F.sort_array(F.collect_set("fault")).alias("fault_status_values"),
    )


def status_hold(
    rows: DataFrame,
    segments: DataFrame,
    hold_us: int = STATUS_HOLD_US,
    const_pos_bit: int = 128,
    chunks: Chunks = WHOLE_CELLS,
) -> DataFrame:
    """Known and valid time of the primary status per flight.

    A primary row holds until the flight ends, its hold runs out, or the next node; a change of the primary
    core is a node that ends the old core's hold at once.
    """
    keys = ["log_id", "flight_id"]
    known = rows.where("core is not null and primary_core is not null and status is not null and fault is not null")
    known = with_flight(known, segments, chunks)
    known = chunks.add(known)
    known = settle(Scan(known, keys, ("time_us", "record_index")).previous("before", "primary_core").run())
    switch = changed("before", "primary_core")
    nodes = F.array(F.when(switch, F.lit(0)), F.when(F.col("core") == F.col("primary_core"), F.lit(1)))
    nodes = known.withColumn("node", F.explode(F.filter(nodes, lambda n: n.isNotNull())))
    nodes = Scan(nodes, keys, ("time_us", "record_index", "node")).following("after", "time_us").run()
    stop = F.least("flight_end_us", F.col("time_us") + F.lit(hold_us), F.coalesce("after.time_us", "flight_end_us"))
    spans = nodes.where("node = 1").withColumn("held_us", F.greatest(F.lit(0), stop - F.col("time_us")))
    good = horizontal_position_ok(F.col("status"), F.col("fault"), const_pos_bit)
    sums = spans.groupBy(*keys).agg(
        F.sum(F.when(good, F.col("held_us")).otherwise(0)).alias("valid_us"),
        F.sum("held_us").alias("known_us"),
    )
    out = segments.select(*keys, "duration_us").join(sums, keys, "left")
    return out.select(
        *keys, "valid_us", F.coalesce("known_us", F.lit(0)).alias("known_us"),
        F.greatest(F.lit(0), F.col("duration_us") - F.coalesce("known_us", F.lit(0))).alias("unknown_us"),
    )


def marked_steps(rows: DataFrame, ok: Column, keys, index: str = "record_index") -> DataFrame:
    """Every row with the time step from the row before it and whether both satisfy ``ok``. Stored, since the
    gap limits and the edges both come from it."""
    marked = rank_chunk(rows.select(*keys, "time_us", index, F.coalesce(ok, F.lit(False)).alias("_ok")), index)
    steps = Scan(marked, keys, (index,)).previous("before", "time_us", "_ok").run()
    dt = F.col("time_us") - F.col("before.time_us")
    good = F.coalesce(F.col("_ok") & F.col("before._ok"), F.lit(False))
    return settle(steps.select(*keys, "time_us", dt.alias("dt"), good.alias("good")))


def evidence_edges(steps: DataFrame, thresholds: DataFrame, keys) -> DataFrame:
    """Steps as intervals where they are positive and within the group's limit; ``good`` says whether both
    ends carry evidence. ``thresholds`` has the keys and ``threshold_us``."""
    joined = attach(steps.where("dt > 0"), thresholds.select(*keys, "threshold_us"), keys, "inner")
    edges = joined.where(F.col("dt") <= F.col("threshold_us"))
    return edges.select(*keys, (F.col("time_us") - F.col("dt")).alias("start_us"), F.col("time_us").alias("end_us"), "good")


def union_duration(intervals: DataFrame, keys, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Time covered by at least one interval of the group; overlaps count once."""
    rows = chunks.add(intervals, "start_us")
    rows = Scan(rows, keys, ("start_us", "end_us")).peak_before("reach", F.col("end_us")).run()
    fresh = F.greatest(F.lit(0), F.col("end_us") - F.greatest("start_us", "reach"))
    return rows.groupBy(*keys).agg(F.sum(fresh).alias("duration_us"))


def common_intervals(left: DataFrame, right: DataFrame, keys, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Stretches covered by both sets, found by one sweep over the interval ends instead of all pairs."""
    def ends(df: DataFrame, side: str) -> DataFrame:
        point = F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(1).alias("d")),
                                  F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d"))))
        p = df.where("end_us > start_us").select(*keys, point.alias("p"))
        zero = F.lit(0)
        return p.select(*keys, F.col("p.at").alias("time_us"),
                        (F.col("p.d") if side == "left" else zero).alias("dl"),
                        (F.col("p.d") if side == "right" else zero).alias("dr"))

    steps = ends(left, "left").unionByName(ends(right, "right"))
    steps = steps.groupBy(*keys, "time_us").agg(F.sum("dl").alias("dl"), F.sum("dr").alias("dr"))
    steps = chunks.add(steps)
    swept = (
        Scan(steps, keys, ("time_us",))
        .total("in_left", F.col("dl")).total("in_right", F.col("dr")).following("after", "time_us").run()
    )
    return swept.where("in_left > 0 and in_right > 0").select(
        *keys, F.col("time_us").alias("start_us"), F.col("after.time_us").alias("end_us")
    )


def overlap_duration(left: DataFrame, right: DataFrame, keys, chunks: Chunks = WHOLE_CELLS) -> DataFrame:
    """Time covered by both sets of intervals."""
    both = common_intervals(left, right, keys, chunks)
    return both.groupBy(*keys).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("duration_us"))
