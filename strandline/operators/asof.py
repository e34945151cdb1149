"""Bounded causal as-of alignment.

All sources of a log and the target points go through one shuffle: they are united, cut into time chunks and
each target takes the newest row of every source at or before it. Times are integer microseconds, so a target
exactly on the deadline is decided exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import check_limit
from strandline.functions.numeric import finite
from strandline.operators.ordered import WHOLE_CELLS, Chunks, Scan, rank_chunk
from strandline.operators.profile import attach

_SIDE = "_side"
_RI = "_ri"


def latest_before(
    targets: DataFrame,
    sources: dict[str, DataFrame],
    keys=("log_id",),
    time: str = "time_us",
    index: str = "record_index",
    chunks: Chunks = WHOLE_CELLS,
) -> DataFrame:
    """Add one struct column per source: its newest row with time <= target time, NULL before the first.

    Sources hold the keys, ``time``, ``index`` and any payload. Ties in time go to the largest ``index``.
    """
    keys = list(keys)
    clash = set(sources) & set(targets.columns)
    if clash:
        raise ValueError(f"target already has columns {sorted(clash)}")
    shapes = {name: F.struct(*[c for c in source.columns if c not in keys]) for name, source in sources.items()}
    types = {name: source.select(shapes[name].alias("s")).schema["s"].dataType for name, source in sources.items()}
    empty = {name: F.lit(None).cast(kind).alias(name) for name, kind in types.items()}
    extra = [f for f in targets.schema.fields if f.name not in (*keys, time)]
    parts = [targets.select(*keys, time, F.lit(1).alias(_SIDE), F.lit(None).cast("bigint").alias(_RI), *[f.name for f in extra], *empty.values())]
    for name, source in sources.items():
        parts.append(source.where(F.col(time).isNotNull()).select(
            *keys, time, F.lit(0).alias(_SIDE), F.col(index).cast("bigint").alias(_RI),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra],
            *[shapes[name].alias(name) if other == name else empty[other] for other in sources],
        ))
    merged = reduce(DataFrame.union, parts)
    scan = Scan(chunks.add(merged, time), keys, (time, _SIDE, _RI))
    for name in sources:
        scan.last(f"_latest_{name}", F.col(name))
    found = scan.run().where(F.col(_SIDE) == 1)
    return found.select(
        *targets.columns, *[F.col(f"_latest_{name}").alias(name) for name in sources]
    )


def limit_ms(max_age_ms: float, gap_threshold_ms: float) -> float:
    """The hold is bounded by both limits; each has to be finite and non-negative."""
    return min(check_limit(max_age_ms, "max_age_ms"), check_limit(gap_threshold_ms, "gap_threshold_ms"))


def hold(
    candidate: str,
    hold_ms: float,
    boundary_start: Column | None = None,
    same_boundary: Column | None = None,
    time: str = "time_us",
) -> dict[str, Column]:
    """Judge a candidate row: is it from this interval, how old is it, is it still fresh.

    An expired candidate keeps its time and age; one from another interval leaves nothing. There is no older
    row to fall back to.
    """
    at = F.col(f"{candidate}.{time}")
    inside = at.isNotNull()
    if boundary_start is not None:
        inside = inside & (at >= boundary_start)
    if same_boundary is not None:
        inside = inside & same_boundary
    inside = F.coalesce(inside, F.lit(False))
    deadline = at + F.lit(round(hold_ms * 1000)).cast("bigint")
    return {
        "inside": inside,
        "fresh": inside & F.coalesce(F.col(time) <= deadline, F.lit(False)),
        "source_time_us": F.when(inside, at),
        "age_ms": F.when(inside, (F.col(time) - at) / F.lit(1000.0)),
    }


def asof_align(
    targets: DataFrame,
    source: DataFrame,
    fields,
    max_age_ms: float,
    gap_threshold_ms: float,
    keys=("log_id",),
    boundary: str = "boundary_id",
    method: str = "previous",
    chunks: Chunks = WHOLE_CELLS,
) -> DataFrame:
    """Previous-sample alignment of one source whose rows, like the targets, name their boundary interval.

    Adds ``source_time_us``, ``age_ms``, ``valid`` (fresh and every field finite) and the fields themselves,
    each NULL unless valid.
    """
    if method != "previous":
        raise ValueError(f"unsupported alignment method {method!r}")
    bound = limit_ms(max_age_ms, gap_threshold_ms)
    joined = latest_before(targets, {"candidate": source}, keys, chunks=chunks)
    parts = hold("candidate", bound, same_boundary=F.col(f"candidate.{boundary}") == F.col(boundary))
    complete = F.lit(True)
    for name in fields:
        complete = complete & finite(F.col(f"candidate.{name}"))
    valid = parts["fresh"] & complete
    return joined.select(
        *targets.columns,
        parts["source_time_us"].alias("source_time_us"),
        parts["age_ms"].alias("age_ms"),
        valid.alias("valid"),
        *[F.when(valid, F.col(f"candidate.{name}").cast("double")).alias(name) for name in fields],
    )


def asof_fields(
    targets: DataFrame,
    source: DataFrame,
    factors: dict[str, float | None],
    max_age_ms: float,
    gap_threshold_ms: float,
    keys=("log_id",),
    boundary: str = "boundary_id",
    chunks: Chunks = WHOLE_CELLS,
) -> DataFrame:
    """Several fields of one source: the row is picked once, each field is judged and scaled by itself."""
    bound = limit_ms(max_age_ms, gap_threshold_ms)
    joined = latest_before(targets, {"candidate": source}, keys, chunks=chunks)
    parts = hold("candidate", bound, same_boundary=F.col(f"candidate.{boundary}") == F.col(boundary))
    return joined.select(
        *targets.columns,
        parts["source_time_us"].alias("source_time_us"),
        parts["age_ms"].alias("age_ms"),
        parts["fresh"].alias("valid"),
        *[scaled(F.col(f"candidate.{name}"), factor, parts["fresh"]).alias(name) for name, factor in factors.items()],
    )


def scaled(value: Column, factor, fresh: Column) -> Column:
    """value * factor while fresh and finite; an unknown factor gives nothing."""
    if factor is None:
        return F.lit(None).cast("double")
    scale = factor if isinstance(factor, Column) else F.lit(float(factor))
    product = value.cast("double") * scale
    return F.when(fresh & finite(value), product)


def clock_faults(rows: DataFrame, keys=("log_id",), time: str = "time_us", index: str = "record_index") -> DataFrame:
    """Input guard: missing times and steps backwards in acquisition order, per key."""
    scan = Scan(rank_chunk(rows.select(*keys, time, index), index), keys, (index,))
    steps = scan.previous("before", time).run()
    return steps.groupBy(*keys).agg(
        F.count_if(F.col(time).isNull()).alias("missing_times"),
        F.count_if(F.coalesce(F.col(time) < F.col(f"before.{time}"), F.lit(False))).alias("backward_steps"),
    )


def latest_of_all(
    reports: DataFrame,
    instances,
    value: str,
    max_age_us: int,
    floor: float | None = None,
    keys=("log_id",),
    instance: str = "instance",
    context: str | None = None,
    chunks: Chunks = WHOLE_CELLS,
) -> DataFrame:
    """At every report the newest row of each instance, kept where all instances of its log are known, fresh and comparable.

    ``instances`` is the short list of labels that occur anywhere; which of them a log has is read from its reports. Logs
    with a single instance have nothing to compare. Adds ``lowest``, ``highest`` and ``ratio``.
    """
    keys = list(keys)
    timed = reports.where(F.col("time_us").isNotNull())
    names = [f"_inst{i}" for i in range(len(instances))]
    is_one = {name: F.col(instance).eqNullSafe(F.lit(label)) for name, label in zip(names, instances)}
    had = timed.groupBy(*keys).agg(*[F.max(on.cast("int")).alias(f"_has{name}") for name, on in is_one.items()])
    scan = Scan(chunks.add(timed), keys, ("time_us", "record_index"))
    columns = ["time_us", value] + ([context] if context else [])
    for name in names:
        scan.last(name, F.when(is_one[name], F.struct(*columns)))
    rows = attach(scan.run(), had, keys)
    several = F.lit(0)
    for name in names:
        several = several + F.col(f"_has{name}")
    good = several > 1 if len(names) > 1 else F.lit(True)
    for name in names:
        v = F.col(f"{name}.{value}")
        fine = finite(v) & (F.col("time_us") - F.col(f"{name}.time_us") <= F.lit(max_age_us))
        if floor is not None:
            fine = fine & (v > F.lit(floor))
        if context:
            fine = fine & F.col(f"{name}.{context}").eqNullSafe(F.col(context))
        good = good & ((F.col(f"_has{name}") == 0) | fine)
    picked = [F.col(f"{name}.{value}").cast("double") for name in names]
    low = F.least(*picked) if len(picked) > 1 else picked[0]
    high = F.greatest(*picked) if len(picked) > 1 else picked[0]
    kept = rows.where(F.coalesce(good, F.lit(False)))
    return kept.select(
        *reports.columns, low.alias("lowest"), high.alias("highest"), F.try_divide(high, low).alias("ratio")
    )


def ratio_to_latest(
    reports: DataFrame,
    base: DataFrame,
    value: str,
    max_age_us: int,
    keys=("log_id",),
    context: str | None = None,
    chunks: Chunks = WHOLE_CELLS,
) -> DataFrame:
    """value / newest base value, kept where the base row is fresh, of the same context and positive."""
    rows = reports.where(F.col("time_us").isNotNull() & finite(F.col(value)))
    usable = base.where(F.col("time_us").isNotNull() & finite(F.col(value)))
    found = latest_before(rows, {"base": usable}, keys, chunks=chunks)
    age = F.col("time_us") - F.col("base.time_us")
    good = (age >= 0) & (age <= F.lit(max_age_us)) & (F.col(f"base.{value}") > 0)
    if context:
        good = good & F.col(f"base.{context}").eqNullSafe(F.col(context))
    return found.where(F.coalesce(good, F.lit(False))).select(
        *reports.columns, F.try_divide(F.col(value), F.col(f"base.{value}")).alias("ratio")
    )
