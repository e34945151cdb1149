"""The test tables read as a fleet of telemetry logs.

``events`` plays the logs: a user is a log, an event a record, and event types take the part of messages:

    signup    armed report              error   disarmed report
    view      mode report and event id  click   source A, receiver status
    purchase  source B, estimator status

The field k of an event's properties (0..99) supplies mode numbers, cores, bit masks and counters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import continuity as ct
from strandline.operators import grid as gr
from strandline.operators import intervals as iv
from strandline.operators import screening as sc
from strandline.operators.ordered import Chunks
from strandline.session import configure, settle

HOUR_US = 3_600_000_000
STEP_US = 6 * HOUR_US
MAX_AGE_MS = 12 * 3_600_000
GAP_MS = 24 * 3_600_000
CONST_POS_BIT = 64  # k stays below 128, so bit 64 takes the part of the constant-position bit

# Labels of the first three mode numbers; the fourth has none on purpose.
MODE_LABELS = ((0, "STABILIZE"), (1, "ACRO"), (2, "ALT_HOLD"))


class Fleet:
    """Messages, flights and intervals of one data folder. Event-level tables are stored once per session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("log_id"), F.col("event_id").alias("record_index"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), F.col("event_type").alias("message"),
            "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    @cached_property
    def chunks(self) -> Chunks:
        return Chunks.fitting(self.records, STEP_US)

    def message(self, name: str) -> DataFrame:
        return self.records.where(F.col("message") == name).drop("message")

    @cached_property
    def bounds(self) -> DataFrame:
        return settle(iv.log_bounds(self.records))

    @cached_property
    def arms(self) -> DataFrame:
        rows = self.records.where(F.col("message").isin("signup", "error"))
        on = F.col("message") == "signup"
        arm = rows.select("log_id", "record_index", "time_us", on.cast("int").alias("arm_state"))
        ev = rows.select("log_id", "record_index", "time_us", F.when(on, 10).otherwise(11).alias("id"))
        return iv.arm_events(arm, ev)

    @cached_property
    def modes(self) -> DataFrame:
        names = self.spark.createDataFrame(MODE_LABELS, "mode_number bigint, label string")
        rows = self.message("view").select(
            "log_id", "record_index", "time_us", (F.col("k") % 4).alias("mode_num"), F.lit(None).cast("bigint").alias("mode")
        )
        return iv.label_modes(rows, names)

    @cached_property
    def segments(self) -> DataFrame:
        return settle(iv.armed_segments(self.arms, self.bounds, self.chunks))

    @cached_property
    def intervals(self) -> DataFrame:
        return settle(iv.mode_intervals(self.bounds, self.modes, self.arms, self.segments, self.chunks))

    @cached_property
    def status(self) -> DataFrame:
        """Estimator status of every purchase."""
        k = F.col("k")
        return self.message("purchase").select(
            "log_id", "record_index", "time_us", (k % 2).alias("core"), (F.floor(k / 2) % 2).alias("primary_core"),
            k.alias("status"), F.when(k % 10 == 0, 1).otherwise(0).cast("bigint").alias("fault"),
            F.lit(0).cast("bigint").alias("timeout"), F.lit(0.0).alias("offset_n"), F.lit(0.0).alias("offset_e"),
        )

    @cached_property
    def primary_status(self) -> DataFrame:
        return settle(ct.primary_status(iv.with_flight(self.status, self.segments, self.chunks), self.chunks))

    @cached_property
    def tagged(self) -> DataFrame:
        """Clicks and purchases with their mode interval; k is the actual value (from 20 up), value the target."""
        rows = self.records.where(F.col("message").isin("click", "purchase"))
        found = iv.locate(rows, self.intervals, ["interval_id", "flight_id"], "_i", chunks=self.chunks)
        return settle(found.where("_i is not null").select(
            "log_id", F.col("_i.interval_id").cast("bigint").alias("interval_id"), F.col("_i.flight_id").alias("flight_id"),
            "message", "time_us", "record_index", F.when(F.col("k") >= 20, F.col("k").cast("double")).alias("actual"),
            F.col("value").alias("target"), F.lit(True).alias("paired_ok"),
        ))

    @cached_property
    def clicks_in_context(self) -> DataFrame:
        """Clicks of the two receivers with the interval and arm state of their instant."""
        rows = iv.with_context(self.message("click"), self.intervals, self.chunks)
        return settle(rows.withColumn("instance", F.floor(F.col("k") / 50)))

    @cached_property
    def edges(self) -> DataFrame:
        return settle(sc.evidence(self.tagged, sc.usable_pair()))

    @cached_property
    def flight_edges(self) -> DataFrame:
        return settle(sc.evidence(self.tagged, sc.usable_pair(), ("log_id", "flight_id", "interval_id", "message")))

    @cached_property
    def gps(self) -> DataFrame:
        """Receiver status of every click; two receivers."""
        k = F.col("k")
        return self.message("click").select(
            "log_id", "record_index", "time_us", F.floor(k / 50).alias("instance"), (k % 9).alias("status"), "value", "k"
        )

    @cached_property
    def continuity(self) -> DataFrame:
        gps = settle(iv.with_flight(self.gps.where("instance = 0"), self.segments, self.chunks))
        limit = MAX_AGE_MS * 1000
        breaks = [
            ct.break_points(gps, [F.col("status").cast("double")], limit, self.chunks),
            ct.break_points(self.primary_status, ct.status_signature(), limit, self.chunks),
        ]
        resets = self.message("view").select("log_id", "record_index", "time_us", F.col("k").alias("id"))
        return settle(ct.continuity(self.segments, self.intervals, resets, breaks, self.chunks))

    @cached_property
    def grid(self) -> DataFrame:
        flights = self.segments.select("log_id", "flight_id", "start_us", "end_us")
        return gr.master_grid(flights, STEP_US).select("log_id", "flight_id", "k", "time_us")


_FLEETS: dict[tuple, Fleet] = {}


def _version(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of the folder's files, through Spark's own file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def forget() -> None:
    """Drop what the session keeps, so the next query makes its tables anew."""
    _FLEETS.clear()


def open_fleet(spark: SparkSession, folder: str) -> Fleet:
    """The fleet of a folder as it is now, opened once per session; rewritten data open anew and the old one is forgotten."""
    place = (spark.sparkContext.applicationId, folder)
    key = (*place, _version(spark, folder))
    if key not in _FLEETS:
        for old in [k for k in _FLEETS if k[:2] == place or k[0] != place[0]]:
            del _FLEETS[old]
        _FLEETS[key] = Fleet(configure(spark), folder)
    return _FLEETS[key]
