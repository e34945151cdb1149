"""Queries on profiles, catalogs and parameters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.config import AUDITED_REVISION, RatePolicy, ScreenPolicy, override
from strandline.functions.text import audited, commit_hash
from strandline.operators import catalog as cg
from strandline.operators import intervals as iv
from strandline.operators import params as pm
from strandline.operators import profile as pf
from strandline.operators import screening as sc
from strandline.workload.fleet import MAX_AGE_MS, open_fleet
from strandline.workload.interval_queries import EV, MODES, known

QUERIES, ORACLES = {}, {}
POLICY = RatePolicy(gap_multiplier=2.0, absolute_gap_threshold_s=3600.0)


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(open_fleet(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


@query("message_counts", f"WITH {EV} SELECT log_id, et AS message, count(*) AS n FROM ev GROUP BY 1, 2")
def message_counts(fl):
    return pf.message_counts(fl.records)


def stats_sql(x, extra=("0.95 p95", "0.99 p99")):
    points = ", ".join(f"round(quantile_cont({x}, {p.split()[0]}), 6) AS {p.split()[1]}" for p in extra)
    return (f"count({x}) AS finite_count, min({x}) AS min, max({x}) AS max, round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std, "
            f"round(max({x}) - min({x}), 6) AS range, round(median({x}), 6) AS median, {points}")


STAT_COLUMNS = ("mean", "std", "range", "median", "p1", "p95", "p99")


@query("field_distribution", f"WITH {EV} SELECT log_id, et AS message, {stats_sql('v')} FROM ev GROUP BY 1, 2")
def field_distribution(fl):
    return rounded(pf.distribution(fl.records, ["log_id", "message"], "value"), STAT_COLUMNS)


def line_values(fl):
    """Two line fields as long values: the status is the log, the return flag the message, the line number the
    instance. Discounts are shown as text with two kinds of bad values."""
    rows = fl.table("lineitem").select(
        F.col("l_linestatus").alias("log_id"), F.col("l_returnflag").alias("message"), F.col("l_linenumber").alias("instance"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.when(F.col("l_tax") == 0.0, "none").when(F.col("l_tax") == 0.01, "NaN").otherwise(F.col("l_discount").cast("string")).alias("discount"),
    )
    return rows.unpivot(["log_id", "message", "instance"], ["quantity", "discount"], "field", "value")


LINE_VALUES = """u AS (SELECT l_linestatus AS log_id, l_returnflag AS message, l_linenumber AS inst, 'quantity' AS field, l_quantity AS x, 0 AS bad, 0 AS nn FROM lineitem
 UNION ALL SELECT l_linestatus, l_returnflag, l_linenumber, 'discount', CASE WHEN l_tax > 0.011 THEN l_discount END,
 CASE WHEN l_tax = 0.01 THEN 1 ELSE 0 END, CASE WHEN l_tax = 0.0 THEN 1 ELSE 0 END FROM lineitem)"""


@query("inventory_scopes", f"""WITH {LINE_VALUES}
SELECT log_id, message, field, CASE WHEN grouping(inst) = 1 THEN 'message' ELSE 'instance' END AS inventory_scope,
       CAST(inst AS VARCHAR) AS instance, count(*) AS sample_count, CAST(sum(bad) AS BIGINT) AS invalid_count,
       CAST(sum(nn) AS BIGINT) AS nonnumeric_count, {stats_sql('x', ('0.01 p1', '0.95 p95', '0.99 p99'))}
FROM u GROUP BY GROUPING SETS ((log_id, message, field), (log_id, message, field, inst))""")
def inventory_scopes(fl):
    return rounded(pf.inventory(line_values(fl)), STAT_COLUMNS)


@query("data_types", """WITH u AS (SELECT l_linestatus AS log_id, l_returnflag AS message, 'quantity' AS field, 'float' AS kind FROM lineitem
 UNION ALL SELECT l_linestatus, l_returnflag, 'discount', CASE WHEN l_tax = 0.0 THEN 'str' ELSE 'float' END FROM lineitem)
SELECT log_id, message, field, string_agg(DISTINCT kind, '|' ORDER BY kind) AS decoded_dtype FROM u GROUP BY 1, 2, 3""")
def data_types(fl):
    return cg.data_types(line_values(fl))


def with_receivers(fl):
    """Records with an instance on clicks only, so some messages mix instances and some have none."""
    who = F.when(F.col("message") == "click", F.floor(F.col("k") / 50))
    return fl.records.select("log_id", "message", "time_us", "record_index", who.alias("instance"))


def timing_sql(keys, where=""):
    k = ", ".join(keys)
    return f"""r AS (SELECT log_id, et AS message, CASE WHEN et = 'click' THEN k // 50 END AS instance, t, ri FROM ev),
q AS (SELECT * FROM r {where}),
st AS (SELECT *, t - lag(t) OVER (PARTITION BY {k} ORDER BY ri) AS dt FROM q),
th AS (SELECT {k}, median(CASE WHEN dt > 0 THEN dt END) AS md, greatest(3600e6, 2.0 * coalesce(median(CASE WHEN dt > 0 THEN dt END), 0)) AS thr FROM st GROUP BY ALL),
ag AS (SELECT {k}, count(*) AS n, min(md) AS md, min(thr) AS thr, arg_min(t, ri) AS f, arg_max(t, ri) AS l, min(dt) AS mn, max(dt) AS mx,
  count(CASE WHEN dt = 0 THEN 1 END) AS dup, count(CASE WHEN dt < 0 THEN 1 END) AS back, count(DISTINCT instance) AS ni,
  count_if(dt > 0 AND dt <= thr) AS act, coalesce(sum(CASE WHEN dt > 0 AND dt <= thr THEN dt END), 0) AS actus,
  1 + count(CASE WHEN dt < 0 OR dt > thr THEN 1 END) AS win FROM st JOIN th USING ({k}) GROUP BY {k}),
tm AS (SELECT {k}, ni, n, n AS timestamped, f / 1e6 AS first_time_s, l / 1e6 AS last_time_s,
  CASE WHEN l > f THEN round((n - 1) / ((l - f) / 1e6), 12) END AS span_rate_hz, round(1.0 / (md / 1e6), 12) AS nominal_rate_hz,
  CASE WHEN actus > 0 THEN round(act / (actus / 1e6), 12) END AS active_rate_hz, round(actus / 1e6, 7) AS active_duration_s, win AS active_windows,
  round(thr / 1e6, 7) AS gap_threshold_s, round(md / 1e6, 7) AS median_dt_s, mn / 1e6 AS min_dt_s, mx / 1e6 AS max_dt_s,
  dup AS duplicates, back AS backwards FROM ag)"""


RATES = ("span_rate_hz", "nominal_rate_hz", "active_rate_hz")
TIMES = ("active_duration_s", "gap_threshold_s", "median_dt_s")
MIX = ", ".join(f"CASE WHEN ni <= 1 THEN {c} END AS {c}" for c in pf.MIXED_NULLS if c != "active_windows")


@query("timing_stats", f"""WITH {EV}, {timing_sql(['log_id', 'message'])}
SELECT log_id, message, n, timestamped, first_time_s, last_time_s, span_rate_hz, {MIX},
       coalesce(CASE WHEN ni <= 1 THEN active_windows END, -1) AS active_windows, duplicates, backwards,
       CASE WHEN ni > 1 THEN 'mixed_instances_count_only' ELSE 'message' END AS rate_scope FROM tm""")
def timing_stats(fl):
    out = pf.message_timing(with_receivers(fl), POLICY)
    return rounded(rounded(out, RATES, 12), TIMES, 7).withColumn("active_windows", known("active_windows"))


@query("timing_instances", f"WITH {EV}, {timing_sql(['log_id', 'message', 'instance'], 'WHERE instance IS NOT NULL')} SELECT * EXCLUDE (ni) FROM tm")
def timing_instances(fl):
    return rounded(rounded(pf.instance_timing(with_receivers(fl), POLICY), RATES, 12), TIMES, 7)


@query("instance_extremes", f"""WITH {EV}
SELECT log_id, 'click' AS message, k // 50 AS instance, min(v) AS value_min, max(v) AS value_max, round(median(v), 6) AS value_median,
       CAST(min(k) AS DOUBLE) AS k_min, CAST(max(k) AS DOUBLE) AS k_max, median(k) AS k_median FROM ev WHERE et = 'click' GROUP BY 1, 2, 3""")
def instance_extremes(fl):
    rows = fl.message("click").withColumn("message", F.lit("click")).withColumn("instance", F.floor(F.col("k") / 50))
    long = pf.long_fields(rows, ["log_id", "message", "instance"], ["value", "k"])
    return rounded(pf.instance_extremes(long, ("value", "k")), ("value_median",))


@query("backward_warnings", """WITH l AS (SELECT l_linestatus AS log_id, l_returnflag AS message, epoch_us(l_shipdate) AS t, l_orderkey * 8 + l_linenumber AS ri, l_partkey AS p, l_suppkey AS q FROM lineitem),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY log_id, message ORDER BY ri, t, p, q) AS dt FROM l)
SELECT log_id, message, count(*) AS n, min(dt) / 1e6 AS min_dt_s FROM g GROUP BY 1, 2 HAVING count_if(dt < 0) > 0""")
def backward_warnings(fl):
    """Line items in order of their keys are far from rising in ship date."""
    ships = fl.table("lineitem").select(
        F.col("l_linestatus").alias("log_id"), F.col("l_returnflag").alias("message"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("time_us"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_index"), "l_partkey", "l_suppkey",
    )
    rows = pf.rank_chunk(ships)
    steps = pf.Scan(rows, ["log_id", "message"], ("record_index", "time_us", "l_partkey", "l_suppkey")).previous("b", "time_us").run()
    dt = F.col("time_us") - F.col("b.time_us")
    sums = steps.groupBy("log_id", "message").agg(
        F.count(F.lit(1)).alias("n"), (F.min(dt) / 1e6).alias("min_dt_s"), F.count_if(F.coalesce(dt < 0, F.lit(False))).alias("backwards")
    )
    return pf.backward_warnings(sums).drop("backwards")


@query("column_stats", f"""WITH u AS (SELECT 'l_quantity' AS field, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
 UNION ALL SELECT 'l_linenumber', nullif(l_linenumber, 3) FROM lineitem UNION ALL SELECT 'l_flat', 7.0 FROM lineitem)
SELECT field, {stats_sql('x', ('0.01 p1', '0.99 p99'))}, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_pct,
       max(x) - min(x) < 0.001 AS constant FROM u GROUP BY 1""")
def column_stats(fl):
    rows = fl.table("lineitem").select(
        "l_quantity", "l_extendedprice", F.nullif(F.col("l_linenumber"), F.lit(3)).alias("l_linenumber"), F.lit(7.0).alias("l_flat")
    )
    return rounded(pf.column_stats(rows, rows.columns), (*STAT_COLUMNS, "missing_pct"))


@query("missing_pct", """SELECT o_orderpriority AS log_id, 'o_totalprice' AS field, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_pct
FROM orders GROUP BY 1""")
def missing_pct(fl):
    rows = fl.table("orders").select(
        F.col("o_orderpriority").alias("log_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("o_totalprice")
    )
    return rounded(pf.column_stats(rows, ["o_totalprice"], ["log_id"]), ("missing_pct",)).select("log_id", "field", "missing_pct")


@query("state_distribution", f"""WITH {MODES},
x AS (SELECT v.log_id, v.k // 50 AS instance, v.v AS value, CASE WHEN i.armed IS NULL THEN 'unknown' WHEN i.armed THEN 'armed' ELSE 'disarmed' END AS state
      FROM ev v LEFT JOIN ivs i ON v.log_id = i.log_id AND v.t >= i.s AND v.t < i.e WHERE v.et = 'click'),
d AS (SELECT log_id, instance, unnest(['disarmed', 'armed', 'unknown']) AS state FROM (SELECT DISTINCT log_id, instance FROM x))
SELECT d.log_id, d.instance, d.state, 'value' AS field, count(x.state) AS count, {stats_sql('value')} FROM d
LEFT JOIN x ON x.log_id = d.log_id AND x.instance = d.instance AND x.state = d.state GROUP BY 1, 2, 3""")
def state_distribution(fl):
    return rounded(sc.state_distribution(fl.clicks_in_context, ("value",)), STAT_COLUMNS)


@query("counter_increments", f"""WITH {MODES},
x AS (SELECT v.log_id, v.k // 50 AS instance, v.t, v.ri, v.k, i.interval_id AS c, CASE WHEN i.armed IS NULL THEN 'unknown' WHEN i.armed THEN 'armed' ELSE 'disarmed' END AS state
      FROM ev v LEFT JOIN ivs i ON v.log_id = i.log_id AND v.t >= i.s AND v.t < i.e WHERE v.et = 'click'),
l AS (SELECT *, lag(k) OVER w AS pk, lag(c) OVER w AS pc, lag(state) OVER w AS ps, lag(t) OVER w AS pt FROM x WINDOW w AS (PARTITION BY log_id, instance ORDER BY ri)),
d AS (SELECT *, CASE WHEN ps = state AND pc IS NOT DISTINCT FROM c AND t > pt THEN k - pk END AS d FROM l)
SELECT log_id, instance, state, CAST(sum(CASE WHEN d >= 0 THEN d END) AS DOUBLE) AS increments, count(CASE WHEN d < 0 THEN 1 END) AS resets,
       count(CASE WHEN d >= 0 THEN 1 END) AS pairs FROM d GROUP BY 1, 2, 3""")
def counter_increments(fl):
    return sc.counter_increments(fl.clicks_in_context, "k")


@query("sensor_screen", f"""WITH {MODES},
x AS (SELECT v.log_id, v.k // 50 AS instance, v.v, CASE WHEN i.armed THEN 'armed' ELSE 'x' END AS state
      FROM ev v LEFT JOIN ivs i ON v.log_id = i.log_id AND v.t >= i.s AND v.t < i.e WHERE v.et = 'click'),
c AS (SELECT log_id, 'VOLTAGE' AS code, instance, v, v < 5 OR v > 60 AS bad FROM x
      UNION ALL SELECT log_id, 'CURRENT', instance, v, v < 30 FROM x WHERE state = 'armed')
SELECT log_id, code, 'click' AS message, instance, CAST(count_if(bad) AS BIGINT) AS flagged_count, count(*) AS evaluated_count,
       round(count_if(bad) / count(*), 6) AS fraction, count(*) >= 5 AS sufficient_samples, count(*) >= 5 AND count_if(bad) / count(*) >= 0.3 AS warning,
       {stats_sql('v')} FROM c GROUP BY 1, 2, 4""")
def sensor_screen(fl):
    rows = fl.clicks_in_context
    v, who = F.col("value"), F.col("instance")
    checks = sc.check_values(rows, "VOLTAGE", "click", v, (v < 5) | (v > 60), who).unionByName(
        sc.check_values(rows.where("state = 'armed'"), "CURRENT", "click", v, v < 30, who))
    return rounded(sc.screen(checks, 5, 0.3), (*STAT_COLUMNS, "fraction"))


PARM = """pr AS (SELECT log_id, ri, 'SERVO' || k || '_FUNCTION' AS name, 33 + (CASE WHEN v > 60 THEN k + 1 ELSE k END) % 4 AS value FROM ev WHERE et = 'view')"""


def parameters(fl):
    """Views as parameter reports: k is the output channel; a large value announces the next function, so a
    channel reported twice may have changed."""
    k = F.col("k")
    return fl.message("view").select(
        "log_id", "record_index", F.concat(F.lit("SERVO"), k.cast("string"), F.lit("_FUNCTION")).alias("name"),
        (33 + F.when(F.col("value") > 60, k + 1).otherwise(k) % 4).alias("value"),
    )


@query("param_snapshot", f"WITH {EV}, {PARM} SELECT log_id, name, arg_max(value, ri) AS value FROM pr GROUP BY 1, 2")
def param_snapshot(fl):
    return pm.snapshot(parameters(fl))


@query("motor_mapping", f"""WITH {EV}, {PARM},
n AS (SELECT log_id, name, CAST(regexp_extract(name, '[0-9]+') AS BIGINT) AS ch, arg_max(value, ri) AS value, count(DISTINCT value) AS c FROM pr GROUP BY 1, 2),
s AS (SELECT log_id, max(c) = 1 AS stable FROM n GROUP BY 1),
m AS (SELECT log_id, stable, unnest([1, 2, 3, 4]) AS motor FROM s)
SELECT m.log_id, CAST(motor AS BIGINT) AS motor, stable, count(n.ch) AS matches,
       coalesce(CASE WHEN stable AND count(n.ch) = 1 AND max(n.ch) <= 14 THEN max(n.ch) END, -1) AS channel
FROM m LEFT JOIN n ON n.log_id = m.log_id AND n.value = motor + 32 GROUP BY 1, 2, 3""")
def motor_mapping(fl):
    return pm.motor_mapping(parameters(fl)).withColumn("channel", known("channel"))


@query("parameter_history", f"""WITH {EV}, {PARM}, c AS (SELECT log_id, name FROM pr GROUP BY 1, 2 HAVING count(DISTINCT value) > 1)
SELECT log_id, ri AS record_index, name, value FROM pr SEMI JOIN c USING (log_id, name)""")
def parameter_history(fl):
    rows = parameters(fl)
    return pm.parameter_history(pm.calibration_parameters(rows), cg.conflicts(rows, ["name"], ["value"]))


@query("metadata_conflicts", """SELECT l_linestatus AS log_id, l_orderkey, count(DISTINCT l_returnflag) AS definitions FROM lineitem
GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1""")
def metadata_conflicts(fl):
    rows = fl.table("lineitem").select(F.col("l_linestatus").alias("log_id"), "l_orderkey", "l_returnflag")
    return cg.conflicts(rows, ["l_orderkey"], ["l_returnflag"])


# Metadata messages out of events. Type and ids come from k, so definitions repeat, change and arrive late.
META = """
f AS (SELECT log_id, ri, k % 10 AS type, 'M' || (k % 10) AS name, CASE WHEN k >= 50 THEN 'QBf' ELSE 'QCL' END AS fmt, 'TimeUS,I,X' || (k // 10) AS cols FROM ev WHERE et = 'view'),
u AS (SELECT log_id, ri, k % 10 AS type, CASE WHEN k >= 60 THEN 's#m' WHEN k >= 30 THEN 's-v' ELSE 's' END AS uids, CASE WHEN k >= 40 THEN 'F-B' ELSE 'F??' END AS mids FROM ev WHERE et = 'click'),
n AS (SELECT log_id, ri, CASE k % 4 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'v' ELSE '#' END AS id, CASE k % 4 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'V' ELSE 'instance' END AS label FROM ev WHERE et = 'purchase'),
mu AS (SELECT log_id, ri, CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'B' ELSE '-' END AS id, CASE k % 3 WHEN 0 THEN CAST(1e-6 AS FLOAT) WHEN 1 THEN CAST(0.01 AS FLOAT) ELSE 0 END AS mult FROM ev WHERE et = 'error'),
fd AS (SELECT log_id, type, arg_max(name, ri) AS name, arg_max(fmt, ri) AS fmt, arg_max(cols, ri) AS cols FROM f GROUP BY 1, 2),
ud AS (SELECT log_id, type, arg_max(uids, ri) AS uids, arg_max(mids, ri) AS mids FROM u GROUP BY 1, 2),
nd AS (SELECT log_id, id, arg_max(label, ri) AS unit FROM n GROUP BY 1, 2),
md AS (SELECT log_id, id, round(CAST(arg_max(mult, ri) AS DOUBLE), 9) AS multiplier FROM mu GROUP BY 1, 2),
x AS (SELECT fd.log_id, fd.name AS message, unnest(string_split(cols, ',')) AS field, unnest(range(3)) AS pos, fmt, uids, mids FROM fd LEFT JOIN ud ON ud.log_id = fd.log_id AND ud.type = fd.type),
y AS (SELECT x.log_id, message, field, pos, CASE WHEN strpos(uids, '#') > 0 THEN 'I' END AS instance_field, substr(fmt, pos + 1, 1) AS fc,
             nullif(substr(uids, pos + 1, 1), '') AS unit_id, nullif(substr(mids, pos + 1, 1), '') AS mult_id FROM x),
z AS (SELECT y.*, nd.unit, md.multiplier, CASE fc WHEN 'C' THEN 0.01 WHEN 'L' THEN 1e-7 ELSE 1.0 END AS scale,
             nd.unit IS NOT NULL AND coalesce(mult_id = '-' AND multiplier = 0 OR mult_id <> '?' AND multiplier > 0, false) AS unit_verified
      FROM y LEFT JOIN nd ON nd.log_id = y.log_id AND nd.id = unit_id LEFT JOIN md ON md.log_id = y.log_id AND md.id = mult_id),
cat AS (SELECT *, CASE WHEN unit_verified THEN CASE WHEN multiplier = 0 THEN 1.0 ELSE multiplier / scale END END AS factor FROM z)"""


def metadata(fl):
    k = F.col("k")
    pick = lambda base, *pairs: _choose(k % base, pairs)
    fmt = fl.message("view").select(
        "log_id", "record_index", (k % 10).alias("type"), F.concat(F.lit("M"), (k % 10).cast("string")).alias("name"), F.lit(16).alias("length"),
        F.when(k >= 50, "QBf").otherwise("QCL").alias("format"), F.concat(F.lit("TimeUS,I,X"), F.floor(k / 10).cast("string")).alias("columns"),
    )
    fmtu = fl.message("click").select(
        "log_id", "record_index", (k % 10).alias("fmt_type"), F.when(k >= 60, "s#m").when(k >= 30, "s-v").otherwise("s").alias("unit_ids"),
        F.when(k >= 40, "F-B").otherwise("F??").alias("mult_ids"),
    )
    unit = fl.message("purchase").select(
        "log_id", "record_index", pick(4, ord("s"), ord("m"), ord("v"), ord("#")).alias("id"), pick(4, "s", "m", "V", "instance").alias("label"))
    mult = fl.message("error").select(
        "log_id", "record_index", pick(3, ord("F"), ord("B"), ord("-")).alias("id"), pick(3, 1e-6, 0.01, 0.0).cast("float").alias("mult"))
    return fmt, fmtu, unit, mult


def _choose(code, values):
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(code == i, F.lit(v)).otherwise(out)
    return out


@query("field_catalog", f"""WITH {EV}, {META} SELECT log_id, message, field, pos, instance_field, unit_id, mult_id, unit, multiplier, unit_verified,
round(CASE WHEN abs(factor - round(factor)) <= 1e-6 * greatest(abs(factor), abs(round(factor))) THEN round(factor) ELSE factor END, 9) AS factor,
CASE WHEN factor IS NULL THEN NULL WHEN abs(factor - 1) < 1e-9 THEN unit WHEN unit = 's' AND abs(factor - 1e-6) < 1e-14 THEN 'us'
     WHEN abs(factor - 0.01) < 1e-9 THEN '0.01 ' || unit WHEN abs(factor - 100000) < 1e-3 THEN '100000 ' || unit WHEN abs(factor - 1e-4) < 1e-12 THEN '0.0001 ' || unit
     ELSE '10 ' || unit END AS decoded_unit FROM cat""")
def field_catalog(fl):
    out = cg.field_catalog(*metadata(fl))
    return out.select("log_id", "message", "field", F.col("pos").cast("bigint").alias("pos"), "instance_field", "unit_id", "mult_id", "unit",
                      F.round("multiplier", 9).alias("multiplier"), "unit_verified", F.round("factor", 9).alias("factor"), "decoded_unit")


@query("unit_gate", f"""WITH {EV}, {META} SELECT log_id, 'unit_gate' AS rule, message || '.' || field AS scope, CAST(1 AS BIGINT) AS n_bad, unit AS example
FROM cat WHERE field = 'TimeUS' AND NOT coalesce(unit_verified AND unit = 's', false)""")
def unit_gate(fl):
    catalog = cg.field_catalog(*metadata(fl))
    names = catalog.select("message").distinct().select("message", F.lit("TimeUS").alias("field"), F.array(F.lit("s")).alias("allowed"))
    return cg.unit_gate(catalog, names)


@query("metadata_report", f"""WITH {EV}, {META}
SELECT log_id, 'FMT' AS message, CAST(type AS VARCHAR) AS key, count(DISTINCT name || fmt || cols) AS definitions FROM f GROUP BY 1, 3 HAVING count(DISTINCT name || fmt || cols) > 1
UNION ALL SELECT log_id, 'FMTU', CAST(type AS VARCHAR), count(DISTINCT uids || '/' || mids) FROM u GROUP BY 1, 3 HAVING count(DISTINCT uids || '/' || mids) > 1""")
def metadata_report(fl):
    """The fleet redefines formats freely; units and multipliers never change, so they add no rows."""
    return cg.metadata_conflicts(*metadata(fl))


@query("unknown_units", f"""WITH {EV}, {META}, s AS (SELECT log_id, 'M' || (k % 10) AS message, 'X' || (k // 10) AS field, count(*) AS n FROM ev GROUP BY 1, 2, 3)
SELECT s.log_id, s.message, s.field, unit_id, mult_id, n AS finite_count FROM s JOIN cat USING (log_id, message, field) WHERE factor IS NULL""")
def unknown_units(fl):
    k = F.col("k")
    stats = fl.records.groupBy("log_id", F.concat(F.lit("M"), (k % 10).cast("string")).alias("message"),
                               F.concat(F.lit("X"), F.floor(k / 10).cast("string")).alias("field")).agg(F.count("value").alias("finite_count"))
    return cg.unknown_units(stats, cg.field_catalog(*metadata(fl)))


@query("verified_times", f"""WITH {EV}, {META}, t AS (SELECT log_id, message, coalesce(unit = 's' AND abs(factor - 1e-6) < 1e-12, false) AS ok FROM cat WHERE field = 'TimeUS'),
r AS (SELECT log_id, ri, t, 'M' || (k % 10) AS message FROM ev)
SELECT r.log_id, r.ri AS record_index, coalesce(CASE WHEN ok THEN t END, -1) AS time_us FROM r LEFT JOIN t USING (log_id, message)""")
def verified_times(fl):
    rows = fl.records.withColumn("message", F.concat(F.lit("M"), (F.col("k") % 10).cast("string")))
    out = cg.verified_times(rows, cg.field_catalog(*metadata(fl)))
    return out.select("log_id", "record_index", known("time_us"))


@query("canonical_stats", f"""WITH {EV}, {META}, s AS (SELECT log_id, 'M' || (k % 10) AS message, 'X' || (k // 10) AS field, min(v) AS mn, max(v) AS mx FROM ev GROUP BY 1, 2, 3)
SELECT s.log_id, s.message, s.field, mn AS min, mx AS max, unit AS canonical_unit, round(mn * factor, 6) AS min_canonical, round(mx * factor, 6) AS max_canonical
FROM s JOIN (SELECT log_id, message, field, CASE WHEN factor IS NOT NULL THEN unit END AS unit, factor FROM cat) c USING (log_id, message, field)""")
def canonical_stats(fl):
    k = F.col("k")
    stats = fl.records.groupBy("log_id", F.concat(F.lit("M"), (k % 10).cast("string")).alias("message"),
                               F.concat(F.lit("X"), F.floor(k / 10).cast("string")).alias("field")).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    catalog = cg.field_catalog(*metadata(fl))
    out = pf.with_canonical(stats.join(catalog.select("log_id", "message", "field"), ["log_id", "message", "field"]), catalog, ("min", "max"))
    return rounded(out.drop("decoded_unit", "canonical_factor"), ("min_canonical", "max_canonical"))


_STATED = "nullif(regexp_extract(firmware, '\\(([0-9a-f]{8,40})\\)', 1), '')"
# Firmware lines of the audited vehicle and revision, of another vehicle, of another revision, and without one.
FIRMWARE = ("ArduCopter V4.8 (2b5cebb9)", "ArduPlane V4.8 (2b5cebb9)", "ArduCopter V4.8 (deadbeef00)", "ArduCopter V4.8")


# Lines that a log says of itself, by k: firmware, boards, frames; all others say nothing of these.
LINES = (*FIRMWARE[:3], "SpeedyBee F405", "Frame: QUAD/X", "CUBE orange", "frame class 1")


@query("identity_texts", f"""WITH {EV}, x AS (SELECT log_id, ri, CASE k % 20 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(LINES))} ELSE 'EKF3 IMU0' END AS text FROM ev)
SELECT log_id,
 arg_min(text, ri) FILTER (starts_with(text, 'ArduCopter') OR starts_with(text, 'ArduPlane') OR starts_with(text, 'ArduRover') OR starts_with(text, 'ArduSub')) AS firmware,
 arg_min(text, ri) FILTER (lower(text) LIKE '%speedybee%' OR lower(text) LIKE '%pixhawk%' OR lower(text) LIKE '%cube%' OR lower(text) LIKE '%matek%') AS board,
 arg_min(text, ri) FILTER (lower(text) LIKE '%frame%') AS frame FROM x GROUP BY 1""")
def identity_texts(fl):
    """First lines of their kind; behind a NUL each carries what its fixed-width field held before, which does not count."""
    text = F.coalesce(*[F.when(F.col("k") % 20 == i, t) for i, t in enumerate(LINES)], F.lit("EKF3 IMU0"))
    rows = fl.records.select("log_id", "record_index", F.concat(text, F.lit("\u0000pixhawk frame")).alias("text"))
    return pm.identity_texts(rows)


@query("firmware_audit", f"""WITH {EV}, x AS (SELECT log_id, ri, CASE k % 5 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FIRMWARE))} END AS firmware FROM ev)
SELECT log_id, ri AS record_index, {_STATED} AS commit_hash,
       coalesce(firmware LIKE 'ArduCopter %' AND starts_with('{AUDITED_REVISION}', {_STATED}), false) AS audited FROM x""")
def firmware_audit(fl):
    text = F.coalesce(*[F.when(F.col("k") % 5 == i, t) for i, t in enumerate(FIRMWARE)])
    return fl.records.select("log_id", "record_index", commit_hash(text).alias("commit_hash"), audited(text).alias("audited"))


@query("battery_screen", f"""WITH {MODES},
x AS (SELECT v.log_id, v.k // 50 AS instance, v.v / 5 AS volt, v.v / 10 AS curr, coalesce(i.armed, false) AS armed
      FROM ev v LEFT JOIN ivs i ON v.log_id = i.log_id AND v.t >= i.s AND v.t < i.e WHERE v.et = 'click'),
c AS (SELECT log_id, 'BAT_VOLTAGE_IMPLAUSIBLE' AS code, instance, volt AS v, volt < 9 OR volt > 13 AS bad FROM x
      UNION ALL SELECT log_id, 'BAT_CURRENT_SUSPICIOUS', instance, CASE WHEN armed THEN curr END, armed AND curr < 3 FROM x)
SELECT log_id, code, 'BAT' AS message, instance, CAST(count_if(bad) AS BIGINT) AS flagged_count, count(v) AS evaluated_count,
       round(count_if(bad) / nullif(count(v), 0), 6) AS fraction, count(v) >= 10 AS sufficient_samples,
       coalesce(count(v) >= 10 AND count_if(bad) / nullif(count(v), 0) >= 0.8, false) AS warning, {stats_sql('v')} FROM c GROUP BY 1, 2, 4""")
def battery_screen(fl):
    """Most logs have a receiver that never reports while armed: its current check stays, without values."""
    bat = fl.clicks_in_context.select("log_id", "instance", (F.col("value") / 5).alias("volt"), (F.col("value") / 10).alias("curr"), "state")
    return rounded(sc.screen(sc.battery_values(bat, ScreenPolicy())), (*STAT_COLUMNS, "fraction"))


ESC_POLICY = override(ScreenPolicy(), minimum_samples=4, warning_fraction=0.3, comparison_max_age_s=MAX_AGE_MS / 1000, rpm_active_floor=300.0)
_AGE = MAX_AGE_MS * 1000


@query("esc_screen", f"""WITH {MODES},
x AS (SELECT v.*, v.k // 50 AS inst, i.interval_id AS c, coalesce(i.armed, false) AS armed FROM ev v LEFT JOIN ivs i ON v.log_id = i.log_id AND v.t >= i.s AND v.t < i.e
  WHERE v.et IN ('click', 'purchase')),
e AS (SELECT log_id, inst, t, ri, v / 3 AS volt, CASE WHEN k % 5 < 2 THEN 0.0 ELSE k END AS curr, v * 30 AS rpm, c, armed FROM x WHERE et = 'click'),
b AS (SELECT log_id, t AS bt, v / 5 AS bv, c AS bc FROM x WHERE et = 'purchase' AND k % 2 = 0),
q AS (SELECT e.*, volt / bv AS ratio FROM e ASOF LEFT JOIN b ON e.log_id = b.log_id AND e.t >= b.bt WHERE e.t - bt <= {_AGE} AND bv > 0 AND bc IS NOT DISTINCT FROM c),
n AS (SELECT log_id FROM e GROUP BY 1 HAVING count(DISTINCT inst) > 1),
h AS (SELECT *, {', '.join(f"last_value(CASE WHEN inst = {i} THEN {c} END IGNORE NULLS) OVER w AS {c}{i}" for i in (0, 1) for c in ('t', 'rpm', 'c'))}
  FROM e SEMI JOIN n USING (log_id) WINDOW w AS (PARTITION BY log_id ORDER BY t, ri ROWS UNBOUNDED PRECEDING)),
p AS (SELECT log_id, 'ESC_VOLTAGE_IMPLAUSIBLE' AS code, inst, volt AS y, volt < 5 OR volt > 60 AS bad FROM e
  UNION ALL SELECT log_id, 'ESC_CURRENT_UNAVAILABLE', inst, curr, abs(curr) <= 0.01 FROM e WHERE armed
  UNION ALL SELECT log_id, 'ESC_VOLTAGE_RATIO_IMPLAUSIBLE', inst, ratio, ratio < 0.5 OR ratio > 1.5 FROM q
  UNION ALL SELECT log_id, 'ESC_RPM_CROSS_INSTANCE_INCONSISTENT', NULL, greatest(rpm0, rpm1) / least(rpm0, rpm1), greatest(rpm0, rpm1) / least(rpm0, rpm1) > 3 FROM h
    WHERE armed AND t - t0 <= {_AGE} AND t - t1 <= {_AGE} AND rpm0 > 300 AND rpm1 > 300 AND c0 IS NOT DISTINCT FROM c AND c1 IS NOT DISTINCT FROM c
  UNION ALL SELECT DISTINCT log_id, unnest(['ESC_VOLTAGE_IMPLAUSIBLE', 'ESC_CURRENT_UNAVAILABLE', 'ESC_VOLTAGE_RATIO_IMPLAUSIBLE']), inst, CAST(NULL AS DOUBLE), false FROM e
  UNION ALL SELECT log_id, 'ESC_RPM_CROSS_INSTANCE_INCONSISTENT', NULL, NULL, false FROM n),
s AS (SELECT log_id, code, inst, count(CASE WHEN bad THEN y END) AS f, count(y) AS c FROM p GROUP BY 1, 2, 3)
SELECT log_id, code, coalesce(inst, -1) AS instance, f AS flagged_count, c AS evaluated_count, round(f / nullif(c, 0), 6) AS fraction, c >= 4 AS sufficient_samples,
       coalesce(c >= 4 AND f / nullif(c, 0) >= 0.3, false) AS warning FROM s""")
def esc_screen(fl):
    """Clicks as motor controllers of two instances, even purchases as the battery they are compared with."""
    k, v = F.col("k"), F.col("value")
    esc = fl.clicks_in_context.withColumns({"volt": v / 3, "curr": F.when(k % 5 < 2, 0.0).otherwise(k.cast("double")), "rpm": v * 30})
    bat = iv.with_context(fl.message("purchase"), fl.intervals, fl.chunks).withColumns({"instance": k % 2, "volt": v / 5})
    found = sc.screen(sc.esc_values(esc, bat, (0, 1), ESC_POLICY, fl.chunks), ESC_POLICY.minimum_samples, ESC_POLICY.warning_fraction)
    return found.select("log_id", "code", known("instance"), "flagged_count", "evaluated_count", F.round("fraction", 6).alias("fraction"), "sufficient_samples", "warning")
