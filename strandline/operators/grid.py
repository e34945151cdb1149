"""Fixed-rate target points inside half-open intervals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 10_000


def master_grid(
    segments: DataFrame,
    step_us: float,
    keys=("log_id", "flight_id"),
    start: str = "start_us",
    end: str = "end_us",
    block: int = BLOCK,
) -> DataFrame:
    """start + k * step for every k with a time below the end.

    Points are made in two steps, blocks first and points inside a block second, with a shuffle of the block
    rows between them. A flight of any length is therefore spread over many tasks and no row carries an array
    longer than ``block``.
    """
    if not (math.isfinite(step_us) and step_us > 0):
        raise ValueError("step_us must be finite and positive")
    step = F.lit(float(step_us))
    points = F.greatest(F.lit(0), F.ceil((F.col(end) - F.col(start)) / step)).cast("bigint")
    wide = segments.withColumn("_points", points).where("_points > 0")
    blocks = wide.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_points") - 1) / block))))
    blocks = blocks.repartition(*keys, "_block")
    first = F.col("_block") * block
    inside = F.sequence(first, F.least(first + block, F.col("_points")) - 1)
    grid = blocks.withColumn("k", F.explode(inside))
    time = (F.col(start) + F.rint(F.col("k") * step).cast("bigint")).alias("time_us")
    return grid.select(*segments.columns, "k", time).where(F.col("time_us") < F.col(end))
