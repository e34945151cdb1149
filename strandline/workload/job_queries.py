"""Queries on whole jobs: a fleet with all ten sources goes through job 2 and job 3, with SQL twins.

The gates refuse the logs of a fleet that they should: all their reasons occur. What is published afterwards is read back.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import lineage
from strandline.config import SOURCES, ExtractPolicy, override
from strandline.operators import catalog as cg
from strandline.operators import notices as no
from strandline.operators import packets as pk
from strandline.operators import profile as pf
from strandline.operators import rules as ru
from strandline.operators import series as se
from strandline.operators.ordered import Scan, first_appearances, rank_chunk
from strandline.plans import extract as ex
from strandline.plans import inspect as inspection
from strandline.plans.inspect import FREEZE_FIELDS
from strandline.plans.jobs import EVENT_MESSAGES, LogInputs, extract_job, validate_job
from strandline.session import ensure_checkpoint_dir, settle
from strandline.workload.alignment_queries import GRID, LIMIT_US
from strandline.workload.dataset_queries import PACK
from strandline.workload.fleet import GAP_MS, MAX_AGE_MS, STEP_US, open_fleet
from strandline.workload.interval_queries import ARMS, CONT, EV, known

QUERIES, ORACLES = {}, {}
POLICY = override(ExtractPolicy(), master_rate_hz=1e6 / STEP_US, max_age_ms=dict.fromkeys(SOURCES, MAX_AGE_MS), gap_ms={"default": GAP_MS})
LATE = 13  # clicks with this k reach the log 300 records late, so some clocks step back
FACTORS = {"BAT.Curr": 0.5}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(open_fleet(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("first_appearances", f"""WITH {EV}, f AS (SELECT log_id, et AS message, k, min(ri) AS record_index FROM ev GROUP BY ALL)
SELECT log_id, message, k, record_index, row_number() OVER (PARTITION BY log_id ORDER BY record_index) AS place FROM f""")
def values_by_first_appearance(fl):
    """Message and k of every log once, in the order in which they were first recorded."""
    found = first_appearances(fl.records, ["log_id"], ["message", "k"], ["record_index"])
    return found.select("log_id", "message", "k", "record_index", F.col("place").cast("bigint").alias("place"))


# ---- ten sources out of five kinds of events ----------------------------------------------------------

def message_tables(fl) -> dict[str, DataFrame]:
    """Clicks speak for the controllers, attitude and receivers, purchases for the estimator and the battery, views for the rest."""
    k, v, ids = F.col("k"), F.col("value"), ("log_id", "time_us", "record_index")
    number = lambda c: c.cast("double")
    clicks, buys, views = (fl.message(m) for m in ("click", "purchase", "view"))
    psc = lambda rest, axis: clicks.where(k % 3 == rest).select(
        *ids, number(v).alias(f"P{axis}"), number(k).alias(f"V{axis}"), number(F.when(k >= 20, k)).alias(f"A{axis}"), number(v).alias(f"TA{axis}"))
    return {
        "PSCN": psc(0, "N"), "PSCE": psc(1, "E"), "PSCD": psc(2, "D"),
        "ATT": clicks.select(*ids, (k * 3.6).alias("Yaw")),
        "GPS": clicks.select(*ids, F.floor(k / 50).alias("I"), number(k % 9).alias("Status")),
        "XKF1": buys.select(*ids, number(k % 2).alias("C"), v.alias("PN"), (v + 1).alias("PE"), (v + 2).alias("PD"), number(k).alias("VN"),
                            number(k + 1).alias("VE"), number(k + 2).alias("VD")),
        "XKF4": buys.select(*ids, number(k % 2).alias("C"), number(F.floor(k / 2) % 2).alias("PI"), number(k).alias("SS"),
                            F.when(k % 10 == 0, 1.0).otherwise(0.0).alias("FS"), F.lit(0.0).alias("TS"), F.lit(0.0).alias("OFN"), F.lit(0.0).alias("OFE")),
        "BAT": buys.select(*ids, (k % 2).alias("Inst"), (v / 5).alias("Volt"), (v / 10).alias("Curr")),
        "CTUN": views.select(*ids, (k / 100).alias("ThO")),
        "RCOU": views.select(*ids, *[number(c).alias(f"C{i}") for i, c in enumerate((k + 1000, k + 2000, k + 3000, k), 1)]),
        "EV": views.select(*ids, k.alias("Id")),
    }


def records(fl) -> DataFrame:
    kind = F.col("message")
    name = F.when(kind == "click", "GPS").when(kind == "purchase", "XKF4").when(kind == "view", "MODE").otherwise("ARM")
    late = F.when((kind == "click") & (F.col("k") == LATE), 601).otherwise(0)
    return fl.records.select("log_id", name.alias("message"), F.when(kind == "click", F.floor(F.col("k") / 50)).alias("instance"), "time_us",
                             (F.col("record_index") * 2 + late).alias("record_index"))


def catalog(fl) -> DataFrame:
    """The fields of the policy with their first allowed unit. Some logs do not verify the battery's, some count time in seconds."""
    table = F.explode(F.array(*[
        F.struct(F.lit(m).alias("message"), F.lit(f).alias("field"), F.lit(u).alias("unit"), F.lit(x).alias("factor")) for m, f, u, x in _UNITS
    ])).alias("_u")
    rows = fl.records.select("log_id").distinct().select("log_id", table).select("log_id", "_u.*")
    verified = ~((F.col("field") == "Volt") & (F.col("log_id") % 11 == 5))
    seconds = (F.col("field") == "TimeUS") & (F.col("log_id") % 17 == 3)
    return rows.withColumn("unit_verified", verified).withColumn("factor", F.when(seconds, 1.0).otherwise(F.col("factor")))


_UNITS = [(m, f, u[0], FACTORS.get(f"{m}.{f}", 1.0)) for m, fields in ex.FIELD_UNITS.items() for f, u in fields.items()]
_UNITS += [("RCOU", f"C{i}", "us", 1.0) for i in range(1, 5)] + [("GPS", "TimeUS", "s", 1e-6)]
UNITS_SQL = f"""un(message, field, u, x) AS (VALUES {', '.join(f"('{m}', '{f}', '{u}', CAST({x!r} AS DOUBLE))" for m, f, u, x in _UNITS)}),
cat AS (SELECT log_id, message, field, u, CASE WHEN field = 'TimeUS' AND log_id % 17 = 3 THEN 1.0 ELSE x END AS factor, NOT (field = 'Volt' AND log_id % 11 = 5) AS verified
  FROM (SELECT DISTINCT log_id FROM ev), un)"""


def covered_logs(fl) -> DataFrame:
    """Documents as packets of a few logs, as in ``parser_status``."""
    docs = fl.table("documents").select((F.ascii("source") % 7).cast("bigint").alias("log_id"), F.col("doc_id").alias("record_index"), F.col("n_chars").alias("length"))
    lost = F.when(F.col("record_index") % 97 == 0, 1).otherwise(0)
    rows = Scan(rank_chunk(docs), ["log_id"], ("record_index",)).total("_end", F.col("length") + lost).run()
    rows = settle(rows.select("log_id", "record_index", "length", (F.col("_end") - F.col("length")).alias("offset")))
    files = rows.groupBy("log_id").agg(F.max(F.col("offset") + F.col("length")).alias("b")).select(
        "log_id", (F.col("b") + F.when(F.col("log_id") < 3, 5).otherwise(0)).alias("file_bytes"), F.lit(20).cast("bigint").alias("tail_expected"))
    return pk.parser_status(pk.coverage(rows, files, pk.packet_gaps(rows)))


def parameters(fl) -> DataFrame:
    """Motor m of a log on channel (log_id + m) % 4 + 1; every third log says nothing."""
    logs = fl.records.select("log_id").distinct().where(F.col("log_id") % 3 != 0)
    rows = logs.select("log_id", F.explode(F.array(*[F.lit(m).cast("bigint") for m in range(1, 5)])).alias("record_index"))
    channel = (F.col("log_id") + F.col("record_index")) % 4 + 1
    return rows.select("log_id", "record_index", F.concat(F.lit("SERVO"), channel.cast("string"), F.lit("_FUNCTION")).alias("name"),
                       (F.col("record_index") + 32).cast("double").alias("value"))


def conflicts(fl) -> DataFrame:
    """Purchases of k = 7 as definitions that should agree."""
    kinds = fl.message("purchase").where("k = 7").groupBy("log_id").agg(F.count_distinct(F.col("record_index") % 5 == 0).alias("definitions"))
    return kinds.where("definitions > 1").select("log_id", F.lit("UNIT").alias("message"), F.lit("7").alias("key"), "definitions")


def inputs(fl) -> LogInputs:
    logs = fl.records.groupBy("log_id").agg(F.max("k").alias("k"))
    return LogInputs(
        messages=message_tables(fl), records=records(fl),
        logs=logs.select("log_id", F.lit("same").alias("digest"), F.when(F.col("k") >= 98, "same").otherwise("other").alias("inspected_digest")),
        identity=logs.select("log_id", (F.col("k") >= 97).alias("audited")), covered=covered_logs(fl), catalog=catalog(fl), conflicts=conflicts(fl),
        parameters=parameters(fl), segments=fl.segments, intervals=fl.intervals,
    )


def released(fl):
    """The fleet's release, made once for a session."""
    if "released" not in fl.__dict__:
        root = f"{ensure_checkpoint_dir(fl.spark).rstrip('/')}/releases-{uuid.uuid4().hex}"
        fl.__dict__["release_root"] = root
        fl.__dict__["released"] = extract_job(fl.spark, root, inputs(fl), POLICY, allow_truncated_tail=True, skip=True, chunks=fl.chunks)
    return fl.__dict__["released"]


def validated(fl):
    if "validated" not in fl.__dict__:
        released(fl)
        fl.__dict__["validated"] = validate_job(fl.spark, fl.__dict__["release_root"], fl.__dict__["release_root"] + "-reports")
    return fl.__dict__["validated"]


PACKED = PACK.replace("p AS (SELECT source AS log_id", "p AS (SELECT CAST(ascii(source) % 7 AS BIGINT) AS log_id", 1).replace(
    "PARTITION BY source ", "PARTITION BY ascii(source) % 7 ").replace("log_id < 'f'", "log_id < 3")
GATES = f"""{PACKED},
lg AS (SELECT log_id, max(k) AS k FROM ev GROUP BY 1),
rc AS (SELECT log_id, CASE et WHEN 'click' THEN 'GPS' WHEN 'purchase' THEN 'XKF4' WHEN 'view' THEN 'MODE' ELSE 'ARM' END AS message, t,
  CASE WHEN et = 'click' THEN k // 50 END AS inst, ri * 2 + CASE WHEN et = 'click' AND k = {LATE} THEN 601 ELSE 0 END AS i FROM ev),
bk AS (SELECT log_id, message, t < lag(t) OVER (PARTITION BY log_id, message, inst ORDER BY i) AS b FROM rc),
cv AS (SELECT log_id, count(CASE WHEN gap > 0 THEN 1 END) AS r FROM g0 GROUP BY 1),
g1 AS (SELECT log_id, 'inputs' AS step, 'content_digest' AS rule, 'log' AS scope, CAST(1 AS BIGINT) AS n_bad FROM lg WHERE k < 98
  UNION ALL SELECT log_id, 'inputs', 'firmware', 'log', 1 FROM lg WHERE k < 97
  UNION ALL SELECT log_id, 'inputs', 'parser', 'log', r + CASE WHEN log_id < 3 THEN 1 ELSE 0 END FROM cv WHERE r > 0
  UNION ALL SELECT log_id, 'inputs', 'backward_time', message, count(*) FROM bk WHERE b GROUP BY 1, 4
  UNION ALL SELECT log_id, 'inputs', 'no_flight', 'log', 1 FROM lg WHERE log_id NOT IN (SELECT log_id FROM seg)
  UNION ALL SELECT log_id, 'inputs', 'metadata_conflict', 'UNIT#7', 2 FROM ev WHERE et = 'purchase' AND k = 7 GROUP BY 1 HAVING count(DISTINCT ri % 5 = 0) > 1
  UNION ALL SELECT DISTINCT log_id, 'inputs', 'time_unit', 'GPS', 1 FROM ev WHERE et = 'click' AND log_id % 17 = 3),
g2 AS (SELECT log_id, 'units' AS step, 'unit_gate' AS rule, 'BAT.Volt' AS scope, CAST(1 AS BIGINT) AS n_bad FROM lg
  WHERE log_id % 11 = 5 AND log_id NOT IN (SELECT log_id FROM g1)),
ok AS (SELECT log_id FROM lg WHERE log_id NOT IN (SELECT log_id FROM g1 UNION SELECT log_id FROM g2))"""


@query("release_gates", f"WITH {CONT}, {GATES} SELECT * FROM g1 UNION ALL SELECT * FROM g2")
def release_gates(fl):
    """Every reason for which job 2 leaves out a log, by the gate that found it."""
    gates = [released(fl)[f"gate_{step}"].withColumn("step", F.lit(step)) for step in ("inputs", "units")]
    return reduce(DataFrame.unionByName, gates).select("log_id", "step", "rule", "scope", "n_bad")


@query("extraction_gate", f"WITH {CONT}, {GATES} SELECT log_id, rule, scope, n_bad FROM g1 WHERE rule NOT IN ('metadata_conflict', 'time_unit')")
def extraction_gate(fl):
    """Largest k as content version: below 98 it changed since inspection, below 97 the firmware is not audited. Clocks are those
    of the records as they reached the log."""
    i = inputs(fl)
    found = ru.extraction_gate(i.logs, i.covered, i.identity, pf.backward_steps(i.records), i.segments, (*SOURCES, *EVENT_MESSAGES), True)
    return found.select("log_id", "rule", "scope", "n_bad")


# source: (rows, fields of the pick)
_PICKS = {
    "pscn": ("ev WHERE et = 'click' AND k % 3 = 0", "v AS p, k AS vel, CASE WHEN k >= 20 THEN k END AS a, v AS ta"),
    "psce": ("ev WHERE et = 'click' AND k % 3 = 1", "v AS p, k AS vel, CASE WHEN k >= 20 THEN k END AS a, v AS ta"),
    "pscd": ("ev WHERE et = 'click' AND k % 3 = 2", "v AS p, k AS vel, CASE WHEN k >= 20 THEN k END AS a, v AS ta"),
    "att": ("ev WHERE et = 'click'", "k * 3.6 AS yaw"),
    "gps": ("ev WHERE et = 'click' AND k < 50", "k % 9 AS st"),
    "xkf1": ("x1", "k % 2 AS c, v AS pn, v + 1 AS pe, v + 2 AS pd, k AS vn, k + 1 AS ve, k + 2 AS vd"),
    "xkf4": ("pst", "core, pi, ss, fs"),
    "bat": ("ev WHERE et = 'purchase' AND k % 2 = 0", "v / 5 AS volt, v / 10 * 0.5 AS curr"),
    "ctun": ("ev WHERE et = 'view'", "k / 100 AS tho"),
    "rcou": ("ev WHERE et = 'view'", "k + 1000 AS c1, k + 2000 AS c2, k + 3000 AS c3, k AS c4"),
}
_ROW = ", ".join(f"CASE WHEN {s}.t >= b.cs THEN {s}.t END AS st_{s}, {s} AS r_{s}" for s in _PICKS)
_JOINS = " ".join(
    f"ASOF LEFT JOIN (SELECT log_id, t, {fields} FROM {rows}) {s} ON g.log_id = {s}.log_id AND g.t >= {s}.t" for s, (rows, fields) in _PICKS.items())
_FRESH = ", ".join(f"CASE WHEN t <= st_{s} + {LIMIT_US} THEN r_{s} END AS {s}" for s in _PICKS)
TEN = CONT + GRID + f""", {GATES},
x1 AS (SELECT x.* FROM ev x ASOF LEFT JOIN pst p ON x.log_id = p.log_id AND x.t >= p.t ASOF LEFT JOIN cont b ON x.log_id = b.log_id AND x.t >= b.cs
  WHERE x.et = 'purchase' AND p.core = p.pi AND x.k % 2 = p.pi AND p.t >= b.cs AND x.t < b.ce AND x.t - p.t <= {LIMIT_US}),
t0 AS (SELECT g.log_id, g.flight_id, g.k, g.t, row_number() OVER (PARTITION BY g.log_id ORDER BY g.s, g.k) - 1 AS row_seq, b.cid,
  CASE WHEN g.t < m.e THEN m.mode ELSE 'UNKNOWN' END AS mode, {_ROW} FROM grid g SEMI JOIN ok ON ok.log_id = g.log_id
  ASOF LEFT JOIN cont b ON g.log_id = b.log_id AND g.t >= b.cs ASOF LEFT JOIN (SELECT * FROM ivs WHERE flight_id IS NOT NULL) m ON g.log_id = m.log_id AND g.t >= m.s {_JOINS}),
t1 AS (SELECT log_id, flight_id, row_seq, t, cid, mode, st_rcou, st_gps, {_FRESH} FROM t0),
t2 AS (SELECT *, coalesce(xkf4.core = xkf4.pi AND xkf4.fs = 0 AND (xkf4.ss & 1) <> 0 AND (xkf4.ss & 128) = 0, false) AS healthy FROM t1),
t3 AS (SELECT *, coalesce(healthy AND xkf1.c = xkf4.pi, false) AS may FROM t2),
ten AS (SELECT log_id, flight_id, row_seq, t, cid, mode, healthy, coalesce(gps.st IN (3, 4, 5, 6, 8), false) AS gps_ok,
  coalesce(psce.p, CASE WHEN may AND (xkf4.ss & 24) <> 0 THEN xkf1.pe END) AS px, coalesce(pscn.p, CASE WHEN may AND (xkf4.ss & 24) <> 0 THEN xkf1.pn END) AS py,
  coalesce(-pscd.p, CASE WHEN may AND (xkf4.ss & 32) <> 0 THEN -xkf1.pd END) AS pz, coalesce(psce.vel, CASE WHEN may AND (xkf4.ss & 2) <> 0 THEN xkf1.ve END) AS vx,
  coalesce(-pscd.vel, CASE WHEN may AND (xkf4.ss & 4) <> 0 THEN -xkf1.vd END) AS vz,
  CASE WHEN psce.p IS NOT NULL THEN 'PSCE.PE' WHEN may AND (xkf4.ss & 24) <> 0 AND xkf1.pe IS NOT NULL THEN 'XKF1.PE[C=' || xkf1.c || ']' ELSE '' END AS source_px,
  psce.a - psce.ta AS dx, pscn.a - pscn.ta AS dy, pscd.ta - pscd.a AS dz, att.yaw AS yaw, bat.volt AS bv, bat.curr AS bi, ctun.tho AS tho,
  (t - st_rcou) / 1000.0 AS age_rcou, st_gps, CASE WHEN log_id % 3 <> 0 THEN CASE (log_id + 1) % 4 WHEN 0 THEN rcou.c1 WHEN 1 THEN rcou.c2 WHEN 2 THEN rcou.c3 ELSE rcou.c4 END END AS m1
  FROM t3)"""


@query("ten_sources", f"""WITH {TEN} SELECT log_id, flight_id, row_seq, t AS time_us, cid AS continuity_id, mode, healthy AS ekf_healthy, gps_ok AS gps_valid,
CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, CAST(pz AS DOUBLE) AS pz, CAST(vx AS DOUBLE) AS vx, CAST(vz AS DOUBLE) AS vz, source_px, dx, dy, dz,
dx IS NOT NULL AS valid_dx, dy IS NOT NULL AS valid_dy, dz IS NOT NULL AS valid_dz, round(sin(pi() / 2 - radians(yaw)), 9) + 0.0 AS sin_yaw, bv AS battery_v, bi AS battery_i,
tho AS throttle, CAST(m1 AS DOUBLE) AS motor1, age_rcou AS age_rcou_ms, coalesce(st_gps, -1) AS source_time_gps_us FROM ten""")
def ten_sources(fl):
    """The published table of the accepted logs: all ten sources on one grid, channels by each log's own motor mapping."""
    rows = released(fl)["dataset"]
    same = ("log_id", "flight_id", "row_seq", "time_us", "continuity_id", "mode", "ekf_healthy", "gps_valid", "px", "py", "pz", "vx", "vz", "source_px",
            "dx", "dy", "dz", "valid_dx", "valid_dy", "valid_dz", "battery_v", "battery_i", "throttle", "motor1", "age_rcou_ms")
    return rows.select(*same, (F.round(F.sin("yaw"), 9) + 0.0).alias("sin_yaw"), known("source_time_gps_us"))


@query("release_manifest", f"""WITH {TEN}, f AS (SELECT log_id, count(*) AS n, string_agg(CAST(flight_id AS VARCHAR), ',' ORDER BY flight_id) AS ids FROM seg SEMI JOIN ok USING (log_id) GROUP BY 1),
c AS (SELECT log_id, count(*) AS n, count(dx) AS x, count(dy) AS y, count(dz) AS z, count(CASE WHEN coalesce(dx, dy, dz) IS NOT NULL THEN 1 END) AS s FROM ten GROUP BY 1)
SELECT f.log_id, ids AS flight_ids, coalesce(c.n, 0) AS n_rows, coalesce(x, 0) AS valid_dx, coalesce(y, 0) AS valid_dy, coalesce(z, 0) AS valid_dz, coalesce(s, 0) AS split_rows,
'same' AS raw_digest, true AS verified FROM f LEFT JOIN c USING (log_id)""")
def release_manifest(fl):
    """What the release claims of each log, and that the stored tables still have the digests it was published with."""
    release = released(fl)
    rows = release["manifest"].select("log_id", F.array_join(F.col("flight_ids").cast("array<string>"), ",").alias("flight_ids"),
                                      "n_rows", "valid_dx", "valid_dy", "valid_dz", "split_rows", "raw_digest")
    changed = release["digests"].exceptAll(release.actual_digests()).select("log_id").distinct().withColumn("verified", F.lit(False))
    return rows.join(changed, "log_id", "left").withColumn("verified", F.coalesce("verified", F.lit(True)))


@query("release_notices", f"""WITH {CONT}, {GATES},
w AS (SELECT log_id, 1 AS s, unnest([{', '.join(f"'{c}'" for c in no.EXTRACTION_NOTICES)}]) AS code, unnest(range({len(no.EXTRACTION_NOTICES)})) AS i, '' AS scope, '' AS detail FROM ok
  UNION ALL SELECT log_id, 2, 'truncated_tail_accepted', 0, 'file', '' FROM ok SEMI JOIN (SELECT log_id FROM cv WHERE log_id < 3) USING (log_id)
  UNION ALL SELECT log_id, 3, 'motor_mapping_unresolved', 0, 'motors', '4' FROM ok WHERE log_id % 3 = 0)
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY s, i) AS place, code, scope, detail FROM w""")
def release_notices(fl):
    return released(fl)["notices"]


@query("release_violations", f"""WITH {TEN} SELECT log_id, 'empty' AS rule, 'dataset' AS scope, CAST(1 AS BIGINT) AS n_bad FROM seg SEMI JOIN ok USING (log_id)
WHERE log_id NOT IN (SELECT log_id FROM ten) GROUP BY 1""")
def release_violations(fl):
    """Job 3 on the release of job 2: what it claims holds."""
    return validated(fl)["violations"].select("log_id", "rule", "scope", "n_bad")


@query("release_residuals", f"""WITH {TEN}, u AS (SELECT log_id, 'x' AS axis, dx AS d FROM ten UNION ALL SELECT log_id, 'y', dy FROM ten UNION ALL SELECT log_id, 'z', dz FROM ten)
SELECT log_id, axis, round(sqrt(avg(d * d)), 6) AS rmse, count(d) AS count_valid FROM u GROUP BY 1, 2""")
def release_residuals(fl):
    return validated(fl)["residual_statistics"].withColumn("rmse", F.round("rmse", 6))


@query("release_sampling", f"""WITH {TEN}, l AS (SELECT log_id, flight_id, row_seq, t - lag(t) OVER (PARTITION BY log_id, flight_id ORDER BY row_seq) AS dt FROM ten)
SELECT log_id, flight_id, min(dt) AS min_dt_us, max(dt) AS max_dt_us, count(CASE WHEN dt <= 0 THEN 1 END) AS n_not_rising,
count(CASE WHEN dt > 1.5 * {STEP_US} THEN 1 END) AS large_gaps, median(dt) AS median_dt_us, min(row_seq) AS first_seq FROM l GROUP BY 1, 2""")
def release_sampling(fl):
    return validated(fl)["sampling"]


@query("release_runs", f"""WITH {TEN}, l AS (SELECT *, t - lag(t) OVER w AS dt, lag(flight_id) OVER w AS pf, lag(cid) OVER w AS pc, lag(mode) OVER w AS pm FROM ten WINDOW w AS (PARTITION BY log_id ORDER BY row_seq)),
m AS (SELECT log_id, median(CASE WHEN dt > 0 THEN dt END) AS md FROM l GROUP BY 1)
SELECT log_id, row_seq, CAST(sum(CASE WHEN dt IS NULL OR pf IS DISTINCT FROM flight_id OR pc IS DISTINCT FROM cid OR pm IS DISTINCT FROM mode OR dt <= 0 OR coalesce(dt > 3 * md, false) THEN 1 ELSE 0 END)
  OVER (PARTITION BY log_id ORDER BY row_seq) AS BIGINT) AS run_id FROM l JOIN m USING (log_id)""")
def release_runs(fl):
    """Runs without gaps of the published table, in its own row numbers."""
    return se.runs(released(fl)["dataset"], chunks=fl.chunks).select("log_id", "row_seq", F.col("run_id").cast("bigint").alias("run_id"))


@query("inspection_notices", f"""WITH {EV}, {GATES.split('g1 AS')[0].split('lg AS')[0].rstrip().rstrip(',')},
rc AS (SELECT log_id, CASE et WHEN 'click' THEN 'GPS' WHEN 'purchase' THEN 'XKF4' WHEN 'view' THEN 'MODE' ELSE 'ARM' END AS message, t,
  CASE WHEN et = 'click' THEN k // 50 END AS inst, ri * 2 + CASE WHEN et = 'click' AND k = {LATE} THEN 601 ELSE 0 END AS i FROM ev),
b1 AS (SELECT log_id, message, inst, t < lag(t) OVER (PARTITION BY log_id, message, inst ORDER BY i) AS b FROM rc),
cv AS (SELECT log_id, count(CASE WHEN gap > 0 THEN 1 END) AS r FROM g0 GROUP BY 1),
w AS (SELECT log_id, 1 AS s, CASE WHEN inst IS NULL THEN 0 ELSE 1 END AS i, 'backward_time' AS code, message || coalesce('#' || inst, '') AS scope, CAST(count(*) AS VARCHAR) AS detail
  FROM b1 WHERE b GROUP BY log_id, message, inst
  UNION ALL SELECT log_id, 2, 0, 'CURRENT_LOW', 'click', count(CASE WHEN k < 60 THEN 1 END) || '/' || count(*) FROM ev WHERE et = 'click' GROUP BY 1 HAVING count(CASE WHEN k < 60 THEN 1 END) >= 0.7 * count(*)
  UNION ALL SELECT log_id, 3, 0, 'truncated_message', 'file', '' FROM cv WHERE r = 0 AND log_id < 3)
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY s, i, code, scope, detail) AS place, code, scope, detail FROM w""")
def inspection_notices(fl):
    """Job 1's list: backward clocks by message, then instance, a sensor check that warns, files cut off at the end."""
    timing = pf.backward_steps(records(fl)).withColumn("timestamped", F.lit(1))
    low = F.count_if(F.col("k") < 60)
    checks = fl.message("click").groupBy("log_id").agg(low.alias("flagged_count"), F.count(F.lit(1)).alias("evaluated_count")).select(
        "log_id", F.lit("CURRENT_LOW").alias("code"), F.lit("click").alias("message"), F.lit(None).cast("bigint").alias("instance"), "flagged_count",
        "evaluated_count", (F.col("flagged_count") >= 0.7 * F.col("evaluated_count")).alias("warning"))
    return no.ordered_notices(no.inspection_notices(fl.records.select("log_id").distinct(), timing, checks, covered_logs(fl)))


# ---- job 1's board ------------------------------------------------------------------------------------

def board_inputs(fl) -> dict:
    """What the inspection found, out of the events: every status occurs."""
    k, log = F.col("k"), F.col("log_id")
    logs = fl.records.groupBy("log_id").agg(F.max("k").alias("top"), F.min("k").alias("low"))
    buys, clicks = fl.message("purchase"), fl.message("click")
    count = lambda rows, name: rows.groupBy("log_id").agg(F.count(F.lit(1)).alias("n")).withColumn("message", F.lit(name))
    units = F.explode(F.array(*[F.struct(F.lit(m).alias("message"), F.lit(f).alias("field"), F.lit(u).alias("canonical_unit"))
                                for m, f, u in [(m, f, u) for m in ("BAT", "ESC") for f, u in (("Volt", "V"), ("Curr", "A"))] + [(*p, "m/s/s") for p in FREEZE_FIELDS]]))
    stated = logs.select("log_id", units.alias("_u")).select("log_id", "_u.*").where(~((F.col("field") == "Curr") & (log % 5 == 1)) & ~((F.col("field") == "TAD") & (log % 4 == 2)))
    checked = lambda rows, name, limit: rows.groupBy("log_id").agg(
        (F.max("k") >= limit).alias("warning"), (F.count(F.lit(1)) >= 10).alias("sufficient_samples")).withColumn("message", F.lit(name))
    low = logs.where("low > 2").select("log_id", F.lit("definition changed").alias("reason"))
    return dict(
        logs=logs.select("log_id"), parser=logs.select("log_id", F.when(F.col("top") == 99, "PASS").when(F.col("top") == 98, "PASS_WITH_WARNINGS").otherwise("FAIL").alias("status")),
        errors=low.unionByName(logs.where("log_id % 7 = 0").select("log_id", F.lit("parser anomalies").alias("reason"))),
        parts={"unknown_units": logs.where("log_id % 4 = 1").select("log_id"), "catalog": stated,
               "message_counts": count(buys.where(k < 90), "BAT").unionByName(count(clicks.where(k >= 90), "ESC"))},
        segments=fl.segments, profile=logs.select("log_id", (log % 5 != 0).alias("verified")),
        evidence=buys.groupBy("log_id").agg(F.when(F.col("log_id") % 6 != 0, F.sum(k) * 1000).alias("z_residual_candidate_us"), F.count_if(k >= 85).alias("pscd_paired_samples")),
        checks=checked(buys, "BAT", 98).unionByName(checked(clicks, "ESC", 97)), arming=fl.arms.where(log % 9 != 4),
    )


BOARD = f"""{ARMS},
lg AS (SELECT log_id, max(k) AS top, min(k) AS low FROM ev GROUP BY 1),
bu AS (SELECT log_id, max(k) AS mx, count(*) AS n, count(CASE WHEN k < 90 THEN 1 END) AS n90, sum(k) AS s, count(CASE WHEN k >= 85 THEN 1 END) AS pairs FROM ev WHERE et = 'purchase' GROUP BY 1),
cl AS (SELECT log_id, max(k) AS mx, count(*) AS n, count(CASE WHEN k >= 90 THEN 1 END) AS n90 FROM ev WHERE et = 'click' GROUP BY 1),
j AS (SELECT lg.*, bu.n IS NOT NULL AS hb, bu.mx AS bm, bu.n AS bn, bu.n90 AS b90, bu.s, bu.pairs, cl.mx AS cm, cl.n AS cn, cl.n90 AS c90, log_id % 5 <> 0 AS ver, low > 2 AS def
  FROM lg LEFT JOIN bu USING (log_id) LEFT JOIN cl USING (log_id))"""


@query("status_board", f"""WITH {BOARD}
SELECT log_id, CASE top WHEN 99 THEN 'PASS' WHEN 98 THEN 'PASS_WITH_WARNINGS' ELSE 'FAIL' END AS parser, CASE WHEN def OR log_id % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS structural_log,
CASE WHEN log_id NOT IN (SELECT log_id FROM arm WHERE log_id % 9 <> 4) THEN 'UNKNOWN' WHEN log_id IN (SELECT log_id FROM seg WHERE open_ended) THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS flight_segment_detection,
CASE WHEN def THEN 'FAIL' WHEN log_id % 4 = 1 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS unit_metadata, CASE WHEN ver THEN 'INSUFFICIENT' ELSE 'UNRESOLVED' END AS xy_residual_data_availability,
CASE WHEN NOT ver OR hb AND log_id % 6 = 0 THEN 'UNRESOLVED' WHEN coalesce(s * 1000 >= 100000 AND pairs >= 2, false) THEN 'AVAILABLE' ELSE 'INSUFFICIENT' END AS z_residual_data_availability,
CASE WHEN log_id % 5 = 1 OR coalesce(b90, 0) = 0 THEN 'UNKNOWN' WHEN bm >= 98 THEN 'WARNING' WHEN bn >= 10 THEN 'NO_WARNING' ELSE 'UNKNOWN' END AS battery_physical_quality,
CASE WHEN log_id % 5 = 1 OR coalesce(c90, 0) = 0 THEN 'UNKNOWN' WHEN cm >= 97 THEN 'WARNING' WHEN cn >= 10 THEN 'NO_WARNING' ELSE 'UNKNOWN' END AS esc_telemetry_physical_quality FROM j""")
def status_board(fl):
    return inspection.status_board(**board_inputs(fl))


@query("freeze", f"WITH {BOARD} SELECT log_id, CASE WHEN ver AND NOT def AND log_id % 7 <> 0 AND log_id % 4 <> 2 THEN 'YES' ELSE 'NO' END AS freeze FROM j")
def freeze(fl):
    found = board_inputs(fl)
    return inspection.freeze(found["logs"], found["errors"], found["profile"], found["parts"]["catalog"])


# ---- lineage ------------------------------------------------------------------------------------------

def _text(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()


_EDGES = ", ".join(f"({', '.join(map(_text, e))})" for e in lineage.edges(ExtractPolicy().features))
GRAPH = f"""e(col, parent, message, field, how, fb) AS (VALUES {_EDGES}),
r AS (SELECT DISTINCT col, col AS at, 1 AS depth, false AS fb FROM e UNION SELECT r.col, e.parent, r.depth + 1, r.fb OR e.fb FROM r JOIN e ON e.col = r.at WHERE e.parent IS NOT NULL),
cl AS (SELECT r.col, message, field, min(depth) AS depth, bool_and(r.fb OR e.fb) AS fb FROM r JOIN e ON e.col = r.at WHERE message IS NOT NULL GROUP BY 1, 2, 3)"""


@query("explained_columns", f"""WITH RECURSIVE {EV.strip()}, {GRAPH}, {UNITS_SQL}
SELECT log_id, col AS "column", message, field, CAST(depth AS BIGINT) AS depth, fb AS fallback, u AS input_unit, factor, verified AS unit_verified FROM cat JOIN cl USING (message, field)""")
def explained_columns(fl):
    """Every column of the published table, down to the fields each log states a unit for."""
    closure = cg.lineage_closure(cg.lineage_edges(fl.spark))
    return cg.explain_columns(closure, catalog(fl)).withColumn("depth", F.col("depth").cast("bigint"))
