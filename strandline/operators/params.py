"""Parameters and identity texts of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import BOARD_TOKENS, FIRMWARE_PREFIXES, clean_text

# Names of the output functions; motor n has output function n + 32; four motors; fourteen output channels.
SERVO = r"^SERVO(\d+)_FUNCTION$"
MOTOR_FUNCTION_OFFSET = 32
MOTORS = 4
MAX_CHANNEL = 14

# Parameters that matter for calibration.
CALIBRATION_PREFIXES = ("BATT", "MOT_BAT", "SERVO_BLH", "SERVO_DSHOT")
CALIBRATION_NAMES = ("MOT_THST_EXPO", "MOT_THST_HOVER", "FRAME_CLASS", "FRAME_TYPE")


def snapshot(parm: DataFrame) -> DataFrame:
    """Last value of every parameter."""
    return parm.groupBy("log_id", "name").agg(F.max_by("value", "record_index").alias("value"))


def calibration_parameters(params: DataFrame) -> DataFrame:
    keep = F.col("name").isin(*CALIBRATION_NAMES) | F.col("name").rlike(SERVO)
    for prefix in CALIBRATION_PREFIXES:
        keep = keep | F.col("name").startswith(prefix)
    return params.where(keep)


def parameter_history(parm: DataFrame, names: DataFrame) -> DataFrame:
    return parm.join(names.select("log_id", "name"), ["log_id", "name"], "left_semi")


def motor_mapping(parm: DataFrame) -> DataFrame:
    """Output channel of each motor per log, NULL unless the mapping is unique, in range and never changed.

    One aggregate per parameter, one per log; all four motors come out as rows.
    """
    servo = parm.where(F.col("name").rlike(SERVO))
    per_name = servo.groupBy("log_id", "name").agg(
        F.max_by("value", "record_index").alias("value"), F.min("value").alias("_least"), F.max("value").alias("_most")
    )
    channel = F.regexp_extract("name", SERVO, 1).cast("bigint")
    per_name = per_name.withColumn("channel", channel)
    aggregates = [F.bool_and(F.col("_least") == F.col("_most")).alias("stable")]
    for motor in range(1, MOTORS + 1):
        hit = F.col("value") == motor + MOTOR_FUNCTION_OFFSET
        aggregates += [F.count_if(hit).alias(f"_n{motor}"), F.max(F.when(hit, F.col("channel"))).alias(f"_c{motor}")]
    per_log = per_name.groupBy("log_id").agg(*aggregates)
    entries = F.array(*[
        F.struct(F.lit(m).cast("bigint").alias("motor"), F.col(f"_n{m}").alias("matches"), F.col(f"_c{m}").alias("c"))
        for m in range(1, MOTORS + 1)
    ])
    rows = per_log.select("log_id", "stable", F.explode(entries).alias("_e"))
    usable = F.col("stable") & (F.col("_e.matches") == 1) & (F.col("_e.c") <= MAX_CHANNEL)
    return rows.select(
        "log_id", F.col("_e.motor").alias("motor"), "stable", F.col("_e.matches").alias("matches"),
        F.when(usable, F.col("_e.c")).alias("channel"),
    )


def motor_map(parm: DataFrame) -> DataFrame:
    """The mapping as one map column per log: motor number -> channel."""
    rows = motor_mapping(parm).where("channel is not null")
    entries = F.collect_list(F.struct("motor", "channel"))
    return rows.groupBy("log_id").agg(F.map_from_entries(entries).alias("motors"))


def identity_texts(msg: DataFrame) -> DataFrame:
    """First firmware, board and frame line of each log. Lines end at their first NUL."""
    msg = msg.withColumn("text", clean_text(F.col("text")))
    lower = F.lower("text")
    is_firmware = F.lit(False)
    for prefix in FIRMWARE_PREFIXES:
        is_firmware = is_firmware | F.col("text").startswith(prefix)
    is_board = F.lit(False)
    for token in BOARD_TOKENS:
        is_board = is_board | lower.contains(token)
    first = lambda cond: F.min_by("text", F.when(cond, F.col("record_index")))
    return msg.groupBy("log_id").agg(
        first(is_firmware).alias("firmware"), first(is_board).alias("board"),
        first(lower.contains("frame")).alias("frame"),
    )
