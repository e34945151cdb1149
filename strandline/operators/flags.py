"""Range outliers, jumps and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import ExtractPolicy
from strandline.functions.frames import wrap_angle
from strandline.functions.numeric import all_of, any_of, finite, outside
from strandline.operators.ordered import Scan, rank_chunk

ACCELERATIONS = ("ax", "ay", "az", "ax_target", "ay_target", "az_target")
MOTORS = ("motor1", "motor2", "motor3", "motor4")


def range_limits(policy: ExtractPolicy) -> dict[str, tuple[float, float]]:
    limits = {"battery_v": policy.battery_voltage, "battery_i": policy.battery_current, "throttle": (0.0, 1.0)}
    limits.update({c: policy.acceleration for c in ACCELERATIONS})
    limits.update({c: policy.motor_output for c in MOTORS})
    return limits


def speed(vx: Column, vy: Column, vz: Column) -> Column:
    """Norm of the velocity, NULL unless all three parts are there."""
    return F.sqrt(vx * vx + vy * vy + vz * vz)


def with_outliers(df: DataFrame, limits: dict[str, tuple[float, float]], velocity=None) -> DataFrame:
    """One flag per bounded column, one for the speed norm, and any of them. Rows are kept."""
    flags = {f"outlier_{c}": outside(F.col(c), low, high) for c, (low, high) in limits.items()}
    if velocity is not None:
        flags["outlier_speed"] = outside(speed(F.col("vx"), F.col("vy"), F.col("vz")), *velocity)
    out = df.select("*", *[f.alias(n) for n, f in flags.items()])
    return out.withColumn("outlier", any_of([F.col(n) for n in flags]))


def eligible(valid: Column, features, outlier: Column, physical: bool) -> Column:
    """Fit for learning: valid, all features finite, no outlier, and an axis with a physical residual."""
    return all_of([valid, *[finite(F.col(c)) for c in features], ~F.coalesce(outlier, F.lit(False)), F.lit(physical)])


def magnitude(bounds: tuple[float, float]) -> float:
    return max(abs(bounds[0]), abs(bounds[1]))


def physical_flags(df: DataFrame, policy: ExtractPolicy) -> DataFrame:
    """The checks made on a finished table. Here velocity is judged per component, not by its norm."""
    top = magnitude(policy.velocity)
    over = lambda names, low, high: any_of([outside(F.col(c), low, high) for c in names])
    return df.select(
        "*",
        outside(F.col("battery_v"), *policy.battery_voltage).alias("outlier_battery_voltage"),
        outside(F.col("battery_i"), *policy.battery_current).alias("outlier_battery_current"),
        over(("ax", "ay", "az"), *policy.acceleration).alias("outlier_acceleration"),
        over(("vx", "vy", "vz"), -top, top).alias("outlier_velocity"),
        outside(F.col("throttle"), 0.0, 1.0).alias("outlier_throttle"),
        over(MOTORS, *policy.motor_output).alias("outlier_motor_output"),
    )


def jumps(
    df: DataFrame,
    keys,
    max_speed: float,
    max_acceleration: float,
    max_yaw_rate: float,
    index: str = "row_seq",
    time: str = "time_us",
    positions=("px", "py", "pz"),
    velocities=("vx", "vy", "vz"),
    yaw: str = "yaw",
) -> DataFrame:
    """Steps between stored neighbours of one continuity interval that are faster than physics allows."""
    watched = [*positions, *velocities, yaw]
    rows = Scan(rank_chunk(df, index), keys, (index,)).previous("_before", time, *watched).run()
    dt = F.nullif(F.greatest(F.col(time) - F.col(f"_before.{time}"), F.lit(0)), F.lit(0)) / F.lit(1e6)
    rate = lambda c: F.abs(F.col(c) - F.col(f"_before.{c}")) / dt
    turn = F.abs(wrap_angle(F.col(yaw) - F.col(f"_before.{yaw}"))) / dt
    return rows.select(
        *df.columns,
        any_of([rate(c) > max_speed for c in positions]).alias("outlier_position_jump"),
        any_of([rate(c) > max_acceleration for c in velocities]).alias("outlier_velocity_jump"),
        F.coalesce(turn > max_yaw_rate, F.lit(False)).alias("outlier_yaw_jump"),
    )


def dataset_flags(df: DataFrame, policy: ExtractPolicy, keys=("log_id", "flight_id", "continuity_id")) -> DataFrame:
    """All validator flags and their union; flags of these names that the table brings along are judged anew."""
    flagged = jumps(physical_flags(df.drop(*FLAG_COLUMNS), policy), list(keys), magnitude(policy.velocity), magnitude(policy.acceleration),
                    policy.maximum_yaw_rate_rad_s)
    return flagged.withColumn("flagged", any_of([F.col(c) for c in FLAG_COLUMNS]))


FLAG_COLUMNS = (
    "outlier_battery_voltage", "outlier_battery_current", "outlier_acceleration", "outlier_velocity",
    "outlier_throttle", "outlier_motor_output", "outlier_position_jump", "outlier_velocity_jump", "outlier_yaw_jump",
)


def flag_counts(flagged: DataFrame, columns=FLAG_COLUMNS) -> DataFrame:
    """Rows per flag and log, flags with none left out."""
    sums = flagged.groupBy("log_id").agg(*[F.count_if(F.col(c)).alias(c) for c in columns])
    return sums.unpivot(["log_id"], list(columns), "flag", "n_rows").where("n_rows > 0")
