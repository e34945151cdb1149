"""Jobs 2 and 3 from end to end: gates, alignment, split, sidecars and manifest in one release; validation of a release in another.

Every gate is a named step whose violations are stored before the next step starts. A job stops at the first gate that reports
anything, and what it had written is taken away; with ``skip`` the refused logs are left out and the gates stay in the release.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import NUMERIC_COLUMNS, SOURCES, ExtractPolicy
from strandline.lineage import FRAME, RESIDUAL_SIGN
from strandline.operators import catalog as cg
from strandline.operators import digest as dg
from strandline.operators import flags as fg
from strandline.operators import notices as no
from strandline.operators import params as pm
from strandline.operators import profile as pf
from strandline.operators import rules as ru
from strandline.operators import screening as sc
from strandline.operators import split as sp
from strandline.operators.ordered import WHOLE_CELLS, Chunks
from strandline.plans import extract as ex
from strandline.plans.validate import validate_dataset
from strandline.sources.releases import DIGESTS, Draft, Release, draft, read_release

# Messages whose clocks job 2 depends on, besides its sources.
EVENT_MESSAGES = ("ARM", "EV", "MODE")
SIDECARS = ("BAT", "ESC")


class JobRefused(ValueError):
    """A gate reported violations; ``step`` names it and ``shown`` holds some of them."""

    def __init__(self, step: str, shown: list):
        self.step, self.shown = step, shown
        super().__init__(f"{step} gate: " + "; ".join(f"log {v.log_id}: {v.rule} {v.scope}" for v in shown))


@dataclass(frozen=True)
class LogInputs:
    """What job 2 takes of a fleet of logs.

    messages: tables by name (log_id, time_us, record_index, fields). records: log_id, message, instance, time_us, record_index of
    all messages. logs: log_id, digest now, inspected_digest. identity: log_id, audited. covered: parser_status. catalog:
    field_catalog. conflicts: metadata_conflicts. parameters: log_id, record_index, name, value. segments, intervals: job 1's flights.
    notices: job 1's ordered notices, where there are any.
    """

    messages: dict[str, DataFrame]
    records: DataFrame
    logs: DataFrame
    identity: DataFrame
    covered: DataFrame
    catalog: DataFrame
    conflicts: DataFrame
    parameters: DataFrame
    segments: DataFrame
    intervals: DataFrame
    notices: DataFrame | None = None


class Gates:
    """Violations by step, stored in a run; refused logs are left out of what comes after."""

    def __init__(self, run: Draft, skip: bool):
        self.run, self.skip, self.refused = run, skip, []

    def check(self, step: str, found: DataFrame) -> None:
        stored = self.run.write(f"gate_{step}", found.select(*ru.VIOLATION))
        if self.skip:
            self.refused.append(stored.select("log_id"))
        elif shown := stored.limit(5).collect():
            raise JobRefused(step, shown)

    def accepted(self, rows: DataFrame) -> DataFrame:
        if not self.refused:
            return rows
        return rows.join(reduce(DataFrame.unionByName, self.refused).distinct(), "log_id", "left_anti")


def conflict_rules(conflicts: DataFrame) -> DataFrame:
    """Definitions that change inside a log, as violations."""
    return conflicts.select("log_id", F.lit("metadata_conflict").alias("rule"), F.concat_ws("#", "message", "key").alias("scope"),
                            F.col("definitions").cast("bigint").alias("n_bad"), F.lit(None).cast("string").alias("example"))


def extract_job(
    spark: SparkSession, root: str, inputs: LogInputs, policy: ExtractPolicy = ExtractPolicy(), flights: DataFrame | None = None,
    allow_truncated_tail: bool = False, skip: bool = False, chunks: Chunks = WHOLE_CELLS,
) -> Release:
    """Job 2: the aligned table of all accepted logs with its split, sidecars, lineage, notices and manifest, published as one.

    ``flights`` (log_id, flight_id) selects some; one that does not exist is refused. Units are closed: a field without a verified
    factor in an allowed unit stops the job, and one that a log does not have stays empty.
    """
    with draft(spark, root) as run:
        gates = Gates(run, skip)
        times = pf.backward_steps(inputs.records)
        gates.check("inputs", ru.violations([
            ru.extraction_gate(inputs.logs, inputs.covered, inputs.identity, times, inputs.segments, (*SOURCES, *EVENT_MESSAGES), allow_truncated_tail),
            conflict_rules(inputs.conflicts), cg.time_gate(inputs.records, inputs.catalog),
        ]))
        catalog = gates.accepted(inputs.catalog)
        required = ex.required_units(spark, ex.Sources(spark, inputs.messages).channels())
        gates.check("units", cg.unit_gate(catalog, required))
        segments = inputs.segments
        if flights is not None:
            absent = sp.absent_flights(segments, flights)
            gates.check("flights", absent.select("log_id", F.lit("flight_absent").alias("rule"), F.col("flight_id").cast("string").alias("scope"),
                                                 F.lit(1).cast("bigint").alias("n_bad"), F.lit(None).cast("string").alias("example")))
            segments = sp.select_flights(segments, flights)
        segments, intervals = gates.accepted(segments), gates.accepted(inputs.intervals)
        parameters = gates.accepted(inputs.parameters)
        messages = {name: gates.accepted(table) for name, table in inputs.messages.items()}
        mapping = pm.motor_mapping(parameters)

        data = run.write("dataset", ex.aligned_dataset(
            messages, segments, intervals, policy, ex.factor_map(gates.accepted(inputs.catalog), required), pm.motor_map(parameters), chunks))
        split = run.write("split", ex.split_dataset(data, policy, chunks))
        for name in SIDECARS:
            if name in messages:
                run.write(name.lower(), messages[name])
        run.write("lineage", cg.column_lineage(gates.accepted(inputs.catalog), cg.lineage_rules(spark)))
        run.write("parameters", pm.calibration_parameters(pm.snapshot(parameters)))
        rows = data.groupBy("log_id", "flight_id").agg(F.count(F.lit(1)).alias("n_rows"))
        found = run.write("flights", segments.join(rows, ["log_id", "flight_id"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))))
        logs = found.select("log_id").distinct()
        still_open = mapping.groupBy("log_id").agg(F.count_if(F.col("channel").isNull()).alias("unresolved"))
        motors = logs.join(still_open, "log_id", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(pm.MOTORS)))
        earlier = gates.accepted(inputs.notices) if inputs.notices is not None else logs.select(
            "log_id", F.lit(0).alias("place"), F.lit("").alias("code"), F.lit("").alias("scope"), F.lit("").alias("detail")).limit(0)
        run.write("notices", no.ordered_notices(no.extraction_notices(earlier, gates.accepted(inputs.covered).join(logs, "log_id", "left_semi"), motors)))
        run.write("manifest", manifest(data, split, found, inputs.logs, policy))
    return read_release(spark, root)


def manifest(data: DataFrame, split: DataFrame, flights: DataFrame, logs: DataFrame, policy: ExtractPolicy) -> DataFrame:
    """One row a log: what the release claims of it. Flight ids are a list; a log's rows are many, its flights few hundreds."""
    counts = dg.manifest_counts(data).drop("n_flights")
    chosen = flights.groupBy("log_id").agg(F.sort_array(F.collect_list("flight_id")).alias("flight_ids"))
    learn = split.groupBy("log_id").agg(F.count(F.lit(1)).alias("split_rows"))
    rows = chosen.join(counts, "log_id", "left").join(learn, "log_id", "left").join(logs.select("log_id", F.col("digest").alias("raw_digest")), "log_id", "left")
    named = [c for c in counts.columns if c != "log_id"] + ["split_rows"]
    return rows.fillna(0, named).withColumns({
        "coordinate_frame": F.lit(FRAME), "residual_sign": F.lit(RESIDUAL_SIGN), "horizontal_proxy": F.lit(True),
        "policy": F.lit(policy_text(policy)),
    })


def policy_text(policy: ExtractPolicy) -> str:
    return json.dumps(asdict(policy), sort_keys=True)


def policy_from(text: str) -> ExtractPolicy:
    """The policy a release was made with; unknown settings are refused."""
    found = json.loads(text)
    unknown = sorted(set(found) - {f.name for f in fields(ExtractPolicy)})
    if unknown:
        raise ValueError(f"unknown policy settings: {', '.join(unknown)}")
    pairs = {k: tuple(v) if isinstance(v, list) else {a: tuple(b) if isinstance(b, list) else b for a, b in v.items()} if isinstance(v, dict) else v
             for k, v in found.items()}
    return ExtractPolicy(**pairs)


def validate_job(spark: SparkSession, root: str, reports: str, number: int | None = None) -> Release:
    """Job 3: a release against its own claims. A folder without a published release is refused; so is one without a manifest.

    The policy is the one the release was made with. Reports are published in a folder of their own, so the release stays as it is.
    """
    release = read_release(spark, root, number)
    missing = [name for name in ("dataset", "split", "flights", "manifest", DIGESTS) if name not in release.tables]
    if missing:
        raise ValueError(f"release {release.number} has no {', '.join(missing)}")
    claims = release["manifest"]
    first = claims.select("policy").limit(1).collect()
    policy = policy_from(first[0].policy) if first else ExtractPolicy()
    data = release["dataset"]
    with draft(spark, reports) as run:
        found = validate_dataset(
            data, release["split"], release["flights"], policy, recorded_counts=claims, lineage=release.get("lineage"),
            expected_digests=release[DIGESTS], actual_digests=release.actual_digests(), manifest=claims,
        )
        stored = {name: run.write(name, table) for name, table in found.items()}
        run.write("residual_statistics", residual_statistics(data))
        esc = None
        if release.get("esc") is not None:
            esc = run.write("esc_reports", sc.esc_reports(
                release["esc"].select("log_id", *[F.col(c).cast("double").alias(n) for c, n in (("RPM", "rpm"), ("Volt", "volt"), ("Curr", "curr"))],
                                      F.col("Instance").alias("instance")),
                data.select("log_id", "battery_v"), policy.esc_disagreement_ratio))
        raised = F.array_position(F.array(*[F.lit(c) for c in fg.FLAG_COLUMNS]), F.col("flag"))
        run.write("notices", no.ordered_notices(no.validation_notices(
            release["notices"], claims.select("log_id"), stored["sampling"], stored["constant_columns"],
            stored["flag_counts"].withColumn("step", raised), stored["coverage_warning"], esc, NUMERIC_COLUMNS)))
    return read_release(spark, reports)


def residual_statistics(data: DataFrame) -> DataFrame:
    """RMSE and number of valid residuals by log and axis, out of one pass over the table."""
    pairs = []
    for axis in "xyz":
        d = F.col(f"d{axis}")
        pairs.append(F.struct(F.lit(axis).alias("axis"), F.when(F.col(f"valid_d{axis}") & d.isNotNull() & ~F.isnan(d), d * d).alias("square")))
    rows = data.select("log_id", F.explode(F.array(*pairs)).alias("_p")).select("log_id", "_p.*")
    return rows.groupBy("log_id", "axis").agg(F.sqrt(F.avg("square")).alias("rmse"), F.count("square").alias("count_valid"))
