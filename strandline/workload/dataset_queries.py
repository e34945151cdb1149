"""Queries on finished tables: splits, validation rules, plot data, packets and digests, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.config import ExtractPolicy, override
from strandline.operators import catalog as cg
from strandline.operators import digest as dg
from strandline.operators import flags as fg
from strandline.operators import packets as pk
from strandline.operators import rules as ru
from strandline.operators import screening as sc
from strandline.operators import series as se
from strandline.operators import split as sp
from strandline.session import settle
from strandline.workload.alignment_queries import WIDE, orders_as_log, wide
from strandline.workload.fleet import HOUR_US, open_fleet
from strandline.workload.interval_queries import ARMS, EV
from strandline.workload.profile_queries import META, metadata, rounded

QUERIES, ORACLES = {}, {}
FLIGHT = ["log_id", "flight_id"]
HOLD_MS = 6 * 3_600_000.0
LEARN = override(ExtractPolicy(), minimum_samples=10, minimum_train=6, minimum_test=3)


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(open_fleet(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# ---- splits -------------------------------------------------------------------------------------------

ORD = """o AS (SELECT o_orderpriority AS log_id, o_orderkey AS ri, epoch_us(o_orderdate) AS t, o_custkey, o_totalprice, o_orderstatus, year(o_orderdate) AS y FROM orders)"""
CUT = """d AS (SELECT DISTINCT log_id, t FROM o),
c AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY t) AS rn, count(*) OVER (PARTITION BY log_id) AS n FROM d),
cut AS (SELECT log_id, t AS ft FROM c WHERE rn = CAST(floor(n * 0.7) AS BIGINT) + 1)"""


@query("split_times", f"WITH {ORD}, {CUT} SELECT log_id, ft AS test_from_us FROM cut")
def split_times(fl):
    return sp.split_times(orders_as_log(fl), 0.7)


@query("split_chronological", f"""WITH {ORD}, {CUT} SELECT log_id, CASE WHEN t < ft THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(t) AS first_us, max(t) AS last_us
FROM o JOIN cut USING (log_id) GROUP BY 1, 2""")
def split_chronological(fl):
    rows = sp.split_chronological(orders_as_log(fl), 0.7)
    return rows.groupBy("log_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))


def orders_by_year(fl):
    return orders_as_log(fl).withColumn("flight_id", F.year(F.timestamp_micros("time_us")).cast("bigint"))


@query("split_holdout", f"""WITH {ORD}, m AS (SELECT max(y) AS y FROM o)
SELECT log_id, CASE WHEN o.y = 2001 THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(t) AS first_us, max(t) AS last_us FROM o GROUP BY 1, 2""")
def split_holdout(fl):
    rows = sp.split_holdout(orders_by_year(fl), 2001)
    return rows.groupBy("log_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))


@query("holdout_problems", f"""WITH {ORD}, s AS (SELECT log_id, bool_or(o_orderstatus = 'F') AS p, bool_or(o_orderstatus <> 'F') AS q,
max(CASE WHEN o_orderstatus <> 'F' THEN t END) AS l, min(CASE WHEN o_orderstatus = 'F' THEN t END) AS f FROM o GROUP BY 1)
SELECT log_id, CASE WHEN NOT p THEN 'holdout flight absent' WHEN NOT q THEN 'no other flight' ELSE 'training rows not before the holdout flight' END AS reason
FROM s WHERE NOT p OR NOT q OR l >= f""")
def holdout_problems(fl):
    """Statuses overlap in time, so holding one out is refused."""
    return sp.holdout_problems(orders_as_log(fl).withColumn("flight_id", F.col("o_orderstatus")), "F")


@query("split_candidates", f"WITH {WIDE} SELECT log_id, flight_id, k FROM wide WHERE a_k >= 20 AND b_k IS NOT NULL OR a_k IS NOT NULL AND b_k IS NOT NULL")
def split_candidates(fl):
    return sp.candidates(dataset(fl)).where("valid_dx").select("log_id", "flight_id", "k")


@query("select_flights", f"WITH {ARMS} SELECT log_id, flight_id, s AS start_us FROM seg WHERE e - s > {24 * HOUR_US}")
def select_flights(fl):
    wanted = fl.segments.where(F.col("duration_us") > 24 * HOUR_US)
    return sp.select_flights(fl.segments, wanted).select("log_id", "flight_id", F.col("start_us"))


@query("absent_flights", f"""WITH {ARMS} SELECT log_id, flight_id + 1 AS flight_id FROM seg a
WHERE NOT EXISTS (SELECT 1 FROM seg b WHERE b.log_id = a.log_id AND b.flight_id = a.flight_id + 1)""")
def absent_flights(fl):
    return sp.absent_flights(fl.segments, fl.segments.select("log_id", (F.col("flight_id") + 1).alias("flight_id")))


# ---- a finished table with known faults ---------------------------------------------------------------

def dataset(fl):
    """The aligned grid as a finished table. High values of k break the identity and the flags on purpose."""
    if "dataset" not in fl.__dict__:
        w = wide(fl)
        a = F.when(F.col("a_k") >= 20, F.col("a_value"))
        b = F.col("b_value")
        paired, both = a.isNotNull() & b.isNotNull(), F.col("a_k").isNotNull() & F.col("b_k").isNotNull()
        none = F.lit(None).cast("double")
        fl.__dict__["dataset"] = settle(w.select(
            "log_id", "flight_id", "k", "time_us", "continuity_id", "mode",
            F.when(paired, a).alias("az"), F.when(paired, b).alias("az_target"),
            F.when(paired, a - b + F.when(F.col("a_k") >= 90, 1.0).otherwise(0.0)).alias("dz"),
            (paired | F.coalesce(F.col("b_k") >= 95, F.lit(False))).alias("valid_dz"),
            F.when(both, F.col("a_k").cast("double")).alias("ax"), F.when(both, F.col("b_k").cast("double")).alias("ax_target"),
            F.when(both, (F.col("a_k") - F.col("b_k")).cast("double")).alias("dx"), both.alias("valid_dx"),
            none.alias("ay"), none.alias("ay_target"), none.alias("dy"), F.lit(False).alias("valid_dy"),
            F.col("age_a_ms").alias("age_pscd_ms"), F.col("source_time_a_us").alias("source_time_pscd_us"),
            F.col("age_b_ms").alias("age_psce_ms"), F.col("source_time_b_us").alias("source_time_psce_us"),
            a.alias("pz"), b.alias("vz"), (F.col("status") / 16.0).alias("yaw"),
            (F.coalesce(F.col("a_value") > 60, F.lit(False))).alias("outlier"),
            (paired | F.coalesce(F.col("b_k") >= 90, F.lit(False))).alias("eligible_dz"),
        ))
    return fl.__dict__["dataset"]


DS = WIDE + """,
ds0 AS (SELECT *, CASE WHEN a_k >= 20 THEN a_value END AS a, b_value AS b FROM wide),
ds AS (SELECT log_id, flight_id, k, t, cid, mode, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS az,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS azt, CASE WHEN a_k >= 90 THEN a - b + 1 ELSE a - b END AS dz,
  a IS NOT NULL AND b IS NOT NULL OR coalesce(b_k >= 95, false) AS vz_ok, a_k IS NOT NULL AND b_k IS NOT NULL AS vx_ok,
  CAST(a_k - b_k AS DOUBLE) AS dx, (t - sa) / 1000.0 AS ga, (t - sb) / 1000.0 AS gb, sa, sb, a AS pz, b AS vz, ss / 16.0 AS yaw,
  coalesce(a_value > 60, false) AS outlier, a IS NOT NULL AND b IS NOT NULL OR coalesce(b_k >= 90, false) AS rec FROM ds0)"""


def counted(rows):
    return rows.select("log_id", "rule", "scope", "n_bad")


def rule_sql(parts):
    return " UNION ALL ".join(
        f"SELECT log_id, '{rule}' AS rule, '{scope}' AS scope, count(*) AS n_bad FROM ds WHERE {bad} GROUP BY 1" for rule, scope, bad in parts)


GOOD_Z = "vz_ok AND az IS NOT NULL AND dz IS NOT NULL"


@query("rule_residual", f"WITH {DS} " + rule_sql([
    ("valid_without_values", "dz", "vz_ok AND (az IS NULL OR dz IS NULL)"),
    ("residual_without_flag", "dz", "NOT vz_ok AND dz IS NOT NULL"),
    ("residual_identity", "dz", f"{GOOD_Z} AND abs(dz - (az - azt)) > 1e-9 + 1e-9 * abs(az - azt)"),
    ("source_age", "dz", f"{GOOD_Z} AND ga > {HOLD_MS}"),
    ("source_age", "dx", f"vx_ok AND gb > {HOLD_MS}"),
]))
def rule_residual(fl):
    rules = ru.residual_rules("z", "pscd", HOLD_MS) + ru.residual_rules("x", "psce", HOLD_MS) + ru.residual_rules("y", "psce", HOLD_MS)
    return counted(ru.row_rules(dataset(fl), rules))


@query("rule_provenance", f"WITH {DS} " + rule_sql([
    ("provenance_missing", "att", "yaw IS NOT NULL"),
    ("provenance_missing", "xkf1", "pz IS NOT NULL OR vz IS NOT NULL"),
    ("used_source_age", "pscd", f"(az IS NOT NULL OR dz IS NOT NULL) AND ga > {HOLD_MS}"),
    ("used_source_age", "psce", f"dx IS NOT NULL AND gb > {HOLD_MS}"),
]))
def rule_provenance(fl):
    policy = override(ExtractPolicy(), max_age_ms={**ExtractPolicy().max_age_ms, "PSCD": HOLD_MS, "PSCE": HOLD_MS}, gap_ms={"default": HOLD_MS})
    flights = fl.segments.select(*FLIGHT, F.col("start_us").alias("flight_start_us"), F.col("end_us").alias("flight_end_us"))
    rows = dataset(fl).join(flights, FLIGHT)
    return counted(ru.row_rules(rows, ru.provenance_rules(rows, policy)))


DAY_US = 24 * HOUR_US


@query("rule_intervals", f"""WITH {DS}, x AS (SELECT ds.*, g.s + {12 * HOUR_US} AS fs, g.e AS fe, t - t % {DAY_US} AS bs, t - t % {DAY_US} + {18 * HOUR_US} AS be, k % 2 = 0 AS vp
FROM ds JOIN seg g ON g.log_id = ds.log_id AND g.flight_id = ds.flight_id),
u AS (SELECT log_id, 'pscd' AS scope, sa AS st, fs, fe, bs, be FROM x WHERE az IS NOT NULL OR dz IS NOT NULL OR vp UNION ALL SELECT log_id, 'psce', sb, fs, fe, bs, be FROM x WHERE dx IS NOT NULL)
SELECT log_id, 'source_outside_flight' AS rule, scope, count(*) AS n_bad FROM u WHERE st < fs - 0.001 OR st >= fe GROUP BY 1, 3
UNION ALL SELECT log_id, 'source_outside_boundary', scope, count(*) FROM u WHERE st < bs - 0.001 OR st >= be GROUP BY 1, 3""")
def rule_intervals(fl):
    """Sources against two families of intervals: flights that begin late, and the first 18 hours of every day. Every other row
    says by a flag that it uses the vertical source."""
    day = F.col("time_us") - F.pmod("time_us", F.lit(DAY_US))
    flights = fl.segments.select(*FLIGHT, (F.col("start_us") + 12 * HOUR_US).alias("flight_start_us"), F.col("end_us").alias("flight_end_us"))
    rows = dataset(fl).join(flights, FLIGHT).withColumns({
        "boundary_start_us": day, "boundary_end_us": day + 18 * HOUR_US, "valid_pscd": F.col("k") % 2 == 0,
    })
    rules = [r for r in ru.provenance_rules(rows, ExtractPolicy()) if r[0].startswith("source_outside")]
    return counted(ru.row_rules(rows, rules))


@query("rule_eligibility", f"WITH {DS} " + rule_sql([
    ("eligibility", "eligible_dz", "rec AND NOT (vz_ok AND pz IS NOT NULL AND vz IS NOT NULL AND yaw IS NOT NULL AND NOT outlier)")]))
def rule_eligibility(fl):
    policy = override(ExtractPolicy(), features={"z": ("pz", "vz", "yaw")})
    rows, rules = ru.with_eligibility(dataset(fl), policy)
    return counted(ru.row_rules(dataset(fl), rules))


@query("rule_duplicates", f"""WITH {ORD}, g AS (SELECT log_id, o_custkey, t, count(*) AS c FROM o GROUP BY ALL HAVING count(*) > 1)
SELECT log_id, 'duplicate_time' AS rule, 'o_custkey,time_us' AS scope, count(*) AS n_bad FROM g GROUP BY 1""")
def rule_duplicates(fl):
    return counted(ru.duplicates(orders_as_log(fl), ("o_custkey", "time_us")))


@query("sampling", f"""WITH {ORD}, l AS (SELECT log_id, o_orderstatus AS flight_id, t - lag(t) OVER (PARTITION BY log_id, o_orderstatus ORDER BY ri) AS dt FROM o)
SELECT log_id, flight_id, min(dt) AS min_dt_us, max(dt) AS max_dt_us, count(CASE WHEN dt <= 0 THEN 1 END) AS n_not_rising, count(CASE WHEN dt > 1.5e6 * 86400 * 365 THEN 1 END) AS large_gaps FROM l GROUP BY 1, 2""")
def sampling(fl):
    rows = orders_as_log(fl).withColumn("flight_id", F.col("o_orderstatus"))
    return ru.sampling(rows, index="record_index", rate_hz=1 / (86400 * 365))


@query("rule_monotonic", f"""WITH {ORD}, l AS (SELECT log_id, o_orderstatus AS f, t - lag(t) OVER (PARTITION BY log_id, o_orderstatus ORDER BY ri) AS dt FROM o)
SELECT log_id, 'strictly_increasing' AS rule, f AS scope, count(*) AS n_bad FROM l WHERE dt <= 0 GROUP BY 1, 3""")
def rule_monotonic(fl):
    rows = orders_as_log(fl).withColumn("flight_id", F.col("o_orderstatus"))
    return counted(ru.monotonic(ru.sampling(rows, index="record_index")))


@query("rule_boundaries", f"""WITH {DS}, x AS (SELECT log_id, flight_id, min(t) AS a, max(t) AS b FROM ds GROUP BY 1, 2),
j AS (SELECT x.*, g.s, g.s + {60 * HOUR_US} AS e, g.flight_id AS gf FROM x LEFT JOIN seg g ON g.log_id = x.log_id AND g.flight_id = x.flight_id AND g.e - g.s > {12 * HOUR_US})
SELECT log_id, 'unique_boundary' AS rule, CAST(flight_id AS VARCHAR) AS scope, CAST(1 AS BIGINT) AS n_bad FROM j WHERE gf IS NULL
UNION ALL SELECT log_id, 'inside_flight', CAST(flight_id AS VARCHAR), 1 FROM j WHERE gf IS NOT NULL AND (a < s OR b >= e)""")
def rule_boundaries(fl):
    """Against a boundary table without short flights and with long ones cut."""
    recorded = fl.segments.where(F.col("duration_us") > 12 * HOUR_US).withColumn("end_us", F.col("start_us") + 60 * HOUR_US)
    return counted(ru.flight_boundaries(dataset(fl), recorded))


@query("rule_late_shipments", f"""SELECT o_orderpriority AS log_id, 'source_age' AS rule, 'ship' AS scope, count(*) AS n_bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE epoch_us(l_shipdate) > epoch_us(o_orderdate) OR (epoch_us(o_orderdate) - epoch_us(l_shipdate)) / 1000.0 > {86400000.0 * 365} GROUP BY 1
UNION ALL SELECT o_orderpriority, 'source_time', 'ship', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate GROUP BY 1""")
def rule_late_shipments(fl):
    """Ship dates as source times of orders: those after the order are in the future, old ones expired."""
    ships = fl.table("lineitem").select("l_orderkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("source_time_ship_us"))
    rows = orders_as_log(fl).join(ships, F.col("record_index") == F.col("l_orderkey"))
    rows = rows.withColumn("age_ship_ms", (F.col("time_us") - F.col("source_time_ship_us")) / 1000.0)
    return counted(ru.row_rules(rows, ru.age_rules("ship", F.lit(True), 86400000.0 * 365, "ship")))


@query("rule_membership", """SELECT o_orderpriority AS log_id, 'split_membership' AS rule, 'split' AS scope, count(*) AS n_bad FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""")
def rule_membership(fl):
    rows = orders_as_log(fl).withColumnRenamed("record_index", "order")
    lines = fl.table("lineitem").select(F.col("l_orderkey").alias("order")).distinct()
    return counted(ru.membership(rows, lines, ("order",)))


@query("rule_reconcile", """WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS p, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
j AS (SELECT o_orderpriority AS log_id, o_totalprice AS a, p, o_orderstatus = 'F' AS f, coalesce(r, false) AS r FROM orders LEFT JOIN s ON o_orderkey = k)
SELECT log_id, 'split_value' AS rule, 'price' AS scope, count(*) AS n_bad FROM j WHERE p IS NULL OR abs(a - p) > 1e-8 + 0.5 * abs(p) GROUP BY 1
UNION ALL SELECT log_id, 'split_flag', 'returned', count(*) FROM j WHERE f <> r GROUP BY 1""")
def rule_reconcile(fl):
    """Order totals against the sum of their lines, within half; finished orders against returned lines."""
    left = orders_as_log(fl).select("log_id", F.col("record_index").alias("key"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").alias("returned"))
    right = fl.table("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum("l_extendedprice").alias("price"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    return counted(ru.reconcile(left, right, ["price"], ["returned"], ("key",), 1e-8, 0.5))


@query("rule_leakage", f"""WITH {ORD}, s AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' ELSE 'hold' END AS sp FROM o),
b AS (SELECT log_id, t FROM s GROUP BY 1, 2 HAVING min(sp) <> max(sp)), g AS (SELECT log_id, o_custkey, t FROM s GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT log_id, 'split_label' AS rule, 'split' AS scope, count(*) AS n_bad FROM s WHERE sp = 'hold' GROUP BY 1
UNION ALL SELECT log_id, 'split_order', 'split', 1 FROM s GROUP BY 1 HAVING max(CASE WHEN sp = 'train' THEN t END) >= min(CASE WHEN sp = 'test' THEN t END)
UNION ALL SELECT log_id, 'split_time_shared', 'split', count(*) FROM b GROUP BY 1
UNION ALL SELECT log_id, 'split_duplicate', 'flight_id,time_us', count(*) FROM g GROUP BY 1""")
def rule_leakage(fl):
    label = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "test").otherwise("hold")
    return counted(ru.split_rules(orders_as_log(fl).withColumn("split", label).withColumn("flight_id", F.col("o_custkey"))))


@query("rule_frames", f"""WITH {EV}, {META},
r AS (SELECT * FROM (VALUES ('az', 'X1', 'm/s/s', 'ENU'), ('dz', 'X2', 'm', 'ENU'), ('ax', 'X3', 'm/s/s', NULL)) v(col, field, u, fr)),
l AS (SELECT cat.log_id, r.* FROM cat JOIN r ON cat.field = r.field AND cat.message = 'M' || (length(r.col) + 1))
SELECT log_id, 'output_frame' AS rule, col AS scope, CAST(1 AS BIGINT) AS n_bad FROM l WHERE fr IS NULL UNION ALL SELECT log_id, 'output_unit', col, 1 FROM l WHERE u = 'm'""")
def rule_frames(fl):
    return counted(ru.frame_rules(lineage(fl)))


def lineage(fl):
    rules = fl.spark.createDataFrame(
        [("az", "M3", "X1", "m/s/s", "ENU"), ("dz", "M3", "X2", "m", "ENU"), ("ax", "M3", "X3", "m/s/s", None)],
        "column string, message string, field string, output_unit string, output_frame string")
    return cg.column_lineage(cg.field_catalog(*metadata(fl)), rules)


LINEAGE_SQL = f"""WITH {EV}, {META},
r AS (SELECT * FROM (VALUES ('az', 'X1', 'm/s/s', 'ENU'), ('dz', 'X2', 'm', 'ENU'), ('ax', 'X3', 'm/s/s', NULL)) v(col, field, u, fr)),
l AS (SELECT cat.log_id, r.col, cat.message, cat.field, cat.unit, r.u, r.fr, cat.factor, cat.unit_verified FROM cat JOIN r ON cat.field = r.field AND cat.message = 'M3')"""


@query("column_lineage", LINEAGE_SQL + ' SELECT log_id, col AS "column", message, field, unit AS input_unit, u AS output_unit, fr AS output_frame, round(factor, 9) AS factor, unit_verified FROM l')
def column_lineage(fl):
    return rounded(lineage(fl), ("factor",), 9)


@query("mixed_units", LINEAGE_SQL + ' , d AS (SELECT DISTINCT col, unit, u, fr FROM l) SELECT col AS "column", count(*) AS variants FROM d GROUP BY 1 HAVING count(*) > 1')
def mixed_units(fl):
    return ru.mixed_units(lineage(fl))


DSPLIT = DS + """,
dd AS (SELECT DISTINCT log_id, t FROM ds WHERE vz_ok OR vx_ok),
dc AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY t) AS rn, count(*) OVER (PARTITION BY log_id) AS n FROM dd),
dcut AS (SELECT log_id, t AS ft FROM dc WHERE rn = CAST(floor(n * 0.7) AS BIGINT) + 1),
dsp AS (SELECT ds.*, CASE WHEN t < ft THEN 'train' ELSE 'test' END AS sp FROM ds JOIN dcut USING (log_id) WHERE vz_ok OR vx_ok)"""


@query("readiness", f"""WITH {DSPLIT},
a AS (SELECT ds.log_id, x.axis, count(CASE WHEN CASE x.axis WHEN 'x' THEN vx_ok WHEN 'z' THEN rec ELSE false END THEN 1 END) AS eligible FROM ds CROSS JOIN (SELECT unnest(['x', 'y', 'z', 'xyz']) AS axis) x GROUP BY 1, 2),
b AS (SELECT dsp.log_id, x.axis, count(CASE WHEN sp = 'train' AND CASE x.axis WHEN 'x' THEN vx_ok WHEN 'z' THEN rec ELSE false END THEN 1 END) AS train,
      count(CASE WHEN sp = 'test' AND CASE x.axis WHEN 'x' THEN vx_ok WHEN 'z' THEN rec ELSE false END THEN 1 END) AS test FROM dsp CROSS JOIN (SELECT unnest(['x', 'y', 'z', 'xyz']) AS axis) x GROUP BY 1, 2),
br AS (SELECT DISTINCT log_id FROM ds WHERE vz_ok AND (az IS NULL OR dz IS NULL)),
j AS (SELECT a.log_id, a.axis, eligible, coalesce(train, 0) AS train, coalesce(test, 0) AS test, br.log_id IS NOT NULL AS broken FROM a LEFT JOIN b ON a.log_id = b.log_id AND a.axis = b.axis LEFT JOIN br ON br.log_id = a.log_id),
r AS (SELECT *, concat_ws('; ', CASE WHEN broken THEN 'structural checks failed' END, CASE WHEN axis <> 'z' THEN 'horizontal source is a controller proxy' END,
      CASE WHEN eligible < 10 THEN 'too few eligible samples' END, CASE WHEN train < 6 OR test < 3 THEN 'too few train or test samples' END) AS reasons FROM j)
SELECT log_id, axis, eligible, train, test, reasons, CASE WHEN reasons <> '' THEN 'NOT_READY' ELSE 'READY_WITH_WARNINGS' END AS status FROM r""")
def readiness(fl):
    data = dataset(fl).withColumn("eligible_dx", F.col("valid_dx")).withColumn("eligible_dy", F.col("valid_dy"))
    split = sp.split_chronological(sp.candidates(data), 0.7, fl.chunks)
    rules = [r for r in ru.residual_rules("z", "pscd", HOLD_MS) if r[0] == "valid_without_values"]
    out = ru.readiness(data, split, ru.row_rules(data, rules), LEARN)
    return out.withColumn("reasons", F.array_join("reasons", "; "))


@query("manifest_counts", f"""WITH {DS} SELECT log_id, count(*) AS n_rows, count(CASE WHEN vx_ok THEN 1 END) AS valid_dx, CAST(0 AS BIGINT) AS valid_dy,
count(CASE WHEN vz_ok THEN 1 END) AS valid_dz, count(CASE WHEN rec THEN 1 END) AS eligible_dz, count(DISTINCT flight_id) AS n_flights FROM ds GROUP BY 1""")
def manifest_counts(fl):
    return dg.manifest_counts(dataset(fl))


@query("reconcile_counts", f"""WITH {DS}, n AS (SELECT log_id, count(CASE WHEN vx_ok THEN 1 END) AS vx, count(CASE WHEN vz_ok THEN 1 END) AS vz FROM ds GROUP BY 1),
e AS (SELECT log_id, count(CASE WHEN et = 'click' THEN 1 END) AS c FROM ev GROUP BY 1), j AS (SELECT e.log_id, c, vx, vz FROM e LEFT JOIN n USING (log_id))
SELECT log_id, 'recorded_counts' AS rule, 'valid_dx' AS scope, CAST(1 AS BIGINT) AS n_bad FROM j WHERE c IS DISTINCT FROM vx UNION ALL SELECT log_id, 'recorded_counts', 'valid_dz', 1 FROM j WHERE c IS DISTINCT FROM vz""")
def reconcile_counts(fl):
    """The number of clicks as the recorded count; it is right for few logs."""
    n = F.count_if(F.col("message") == "click")
    recorded = fl.records.groupBy("log_id").agg(n.alias("valid_dx"), n.alias("valid_dz"))
    return counted(dg.reconcile_counts(recorded, dg.manifest_counts(dataset(fl)), ("valid_dx", "valid_dz")))


@query("coverage_warning", f"""WITH {DS} SELECT log_id FROM ds GROUP BY 1 HAVING count(CASE WHEN vz_ok THEN 1 END) <= count(CASE WHEN vx_ok THEN 1 END)""")
def coverage_warning(fl):
    return ru.coverage_warning(dg.manifest_counts(dataset(fl))).select("log_id")


@query("axis_statistics", f"WITH {DS} SELECT log_id, round(sqrt(avg(dz * dz) FILTER (WHERE vz_ok)), 6) AS rmse, count(dz) FILTER (WHERE vz_ok) AS count_valid FROM ds GROUP BY 1")
def axis_statistics(fl):
    return rounded(ru.axis_statistics(dataset(fl), "z"), ("rmse",))


@query("quality_by_mode", f"""WITH {DS} SELECT log_id, mode, count(*) AS row_count, count(CASE WHEN vx_ok THEN 1 END) AS valid_dx, CAST(0 AS BIGINT) AS valid_dy,
count(CASE WHEN vz_ok THEN 1 END) AS valid_dz, count(CASE WHEN outlier THEN 1 END) AS outlier_count,
round(avg((CASE WHEN pz IS NULL THEN 1.0 ELSE 0.0 END + CASE WHEN vz IS NULL THEN 1.0 ELSE 0.0 END + CASE WHEN yaw IS NULL THEN 1.0 ELSE 0.0 END) / 3) * 100, 6) AS state_nan_percentage FROM ds GROUP BY 1, 2""")
def quality_by_mode(fl):
    return rounded(ru.quality_by(dataset(fl), "mode", "outlier", ("pz", "vz", "yaw")), ("state_nan_percentage",))


@query("flag_counts", """WITH f AS (SELECT l_linestatus AS log_id, l_quantity < 5 AS a, l_discount > 0.08 AS b, l_quantity > 1000 AS c FROM lineitem)
SELECT * FROM (SELECT log_id, 'outlier_quantity' AS flag, count(CASE WHEN a THEN 1 END) AS n_rows FROM f GROUP BY 1
UNION ALL SELECT log_id, 'outlier_discount', count(CASE WHEN b THEN 1 END) FROM f GROUP BY 1 UNION ALL SELECT log_id, 'outlier_huge', count(CASE WHEN c THEN 1 END) FROM f GROUP BY 1) WHERE n_rows > 0""")
def flag_counts(fl):
    rows = fl.table("lineitem").select(F.col("l_linestatus").alias("log_id"), (F.col("l_quantity") < 5).alias("outlier_quantity"),
                                       (F.col("l_discount") > 0.08).alias("outlier_discount"), (F.col("l_quantity") > 1000).alias("outlier_huge"))
    return fg.flag_counts(rows, ("outlier_quantity", "outlier_discount", "outlier_huge"))


@query("esc_reports", f"""WITH {DS},
m AS (SELECT log_id, k // 25 AS i, round(avg(v), 9) AS m FROM ev WHERE et = 'click' GROUP BY 1, 2), s AS (SELECT log_id, max(CASE WHEN m > 0 THEN m END) AS hi, min(CASE WHEN m > 0 THEN m END) AS lo FROM m GROUP BY 1),
e AS (SELECT log_id, round(median(v), 9) AS ev_v, bool_and(k < 20) AS z FROM ev WHERE et = 'click' GROUP BY 1), b AS (SELECT log_id, round(median(vz), 9) AS bv FROM ds GROUP BY 1)
SELECT log_id, floor(hi / lo * 1e6 + 0.5) / 1e6 AS rpm_ratio, coalesce(hi / lo > 2, false) AS rpm_disagrees, floor(ev_v / bv * 1e6 + 0.5) / 1e6 AS voltage_ratio,
       coalesce(ev_v / bv < 0.5 OR ev_v / bv > 1.5, false) AS voltage_disagrees, z AS zero_current FROM s LEFT JOIN e USING (log_id) LEFT JOIN b USING (log_id)""")
def esc_reports(fl):
    """Ratios to six decimals, halves up. Said as a floor: the engines' own rounding of doubles takes halves either way."""
    esc = fl.message("click").select("log_id", F.floor(F.col("k") / 25).alias("instance"), F.col("value").alias("rpm"), F.col("value").alias("volt"),
                                     F.when(F.col("k") >= 20, F.col("value")).alias("curr"))
    out = sc.esc_reports(esc, dataset(fl).select("log_id", F.col("vz").alias("battery_v")))
    return out.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / F.lit(1e6) for c in ("rpm_ratio", "voltage_ratio")})


# ---- plot data ----------------------------------------------------------------------------------------

RUNS = DS + """,
rl AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY t) AS seq, t - lag(t) OVER w AS dt, lag(flight_id) OVER w AS pf, lag(cid) OVER w AS pc, lag(mode) OVER w AS pm FROM ds WINDOW w AS (PARTITION BY log_id ORDER BY t)),
rm AS (SELECT log_id, median(CASE WHEN dt > 0 THEN dt END) AS md FROM rl GROUP BY 1),
rr AS (SELECT rl.*, md, sum(CASE WHEN dt IS NULL OR pf <> flight_id OR pc <> cid OR pm <> mode OR dt <= 0 OR dt > 3 * md THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY t) AS run FROM rl JOIN rm USING (log_id))"""


def numbered(fl):
    """Rows of the dataset with their place in the log; the grid already numbers rows inside a flight."""
    if "numbered" not in fl.__dict__:
        rows = ru.Scan(fl.chunks.add(dataset(fl)), ["log_id"], ("time_us",)).total("row_seq", F.lit(1)).run()
        fl.__dict__["numbered"] = settle(rows.drop("_chunk"))
    return fl.__dict__["numbered"]


def with_runs(fl):
    if "with_runs" not in fl.__dict__:
        fl.__dict__["with_runs"] = settle(se.runs(numbered(fl), chunks=fl.chunks))
    return fl.__dict__["with_runs"]


@query("runs", f"WITH {RUNS} SELECT log_id, flight_id, k, CAST(run AS BIGINT) AS run_id FROM rr")
def runs(fl):
    return se.runs(numbered(fl), chunks=fl.chunks).select("log_id", "flight_id", "k", "run_id")


@query("invalid_spans", f"""WITH {RUNS},
i AS (SELECT *, lag(vx_ok) OVER w AS pv, lag(t) OVER w AS pt, lead(t) OVER w AS nt, lead(vx_ok) OVER w AS nv FROM rr WINDOW w AS (PARTITION BY log_id, run ORDER BY t)),
s AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, run ORDER BY t) AS g FROM i WHERE NOT vx_ok)
SELECT log_id, CAST(run AS BIGINT) AS run_id, coalesce((CASE WHEN max(CASE WHEN pt IS NULL THEN 1 ELSE 0 END) = 0 THEN arg_min(pt, t) END + min(t)) / 2.0, min(t) - min(md) / 2) AS left_us,
 coalesce((CASE WHEN max(CASE WHEN nt IS NULL THEN 1 ELSE 0 END) = 0 THEN arg_max(nt, t) END + max(t)) / 2.0, max(t) + min(md) / 2) AS right_us FROM s GROUP BY log_id, run, g""")
def invalid_spans(fl):
    return se.invalid_spans(with_runs(fl), F.col("valid_dx"))


@query("residual_histogram", f"""WITH li AS (SELECT l_linestatus AS log_id, l_extendedprice - l_quantity * 1000 AS d, l_linenumber <> 3 AS ok FROM lineitem),
sh AS (SELECT log_id, count(CASE WHEN ok THEN 1 END) AS n, count(CASE WHEN NOT ok THEN 1 END) AS excluded, min(CASE WHEN ok THEN d END) AS lo, max(CASE WHEN ok THEN d END) AS hi FROM li GROUP BY 1),
b AS (SELECT *, least(40, greatest(1, CAST(floor(sqrt(n)) AS BIGINT))) AS bins FROM sh),
c AS (SELECT li.log_id, least(bins - 1, CAST(floor((d - lo) / (hi - lo) * bins) AS BIGINT)) AS bin, count(*) AS c FROM li JOIN b USING (log_id) WHERE ok GROUP BY ALL),
g AS (SELECT b.*, unnest(generate_series(0, bins - 1)) AS bin FROM b)
SELECT g.log_id, g.bin, round(lo + (hi - lo) / bins * g.bin, 6) AS left_edge, coalesce(c, 0) AS n_values, excluded FROM g LEFT JOIN c ON c.log_id = g.log_id AND c.bin = g.bin""")
def residual_histogram(fl):
    rows = fl.table("lineitem").select(F.col("l_linestatus").alias("log_id"), (F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("d"), (F.col("l_linenumber") != 3).alias("ok"))
    return rounded(se.residual_histogram(rows, "d", F.col("ok")), ("left_edge",))


@query("mode_codes", f"WITH {DS}, m AS (SELECT log_id, mode, min(t) AS f FROM ds GROUP BY 1, 2) SELECT log_id, mode, f AS first_us, row_number() OVER (PARTITION BY log_id ORDER BY f, mode) - 1 AS code FROM m")
def mode_codes(fl):
    return se.mode_codes(dataset(fl)).withColumn("code", F.col("code").cast("bigint"))


@query("series", f"""WITH {RUNS}, u AS (
 SELECT log_id, run, t, 'position' AS series, 'pz' AS "column", pz AS value FROM rr UNION ALL SELECT log_id, run, t, 'velocity', 'vz', vz FROM rr
 UNION ALL SELECT log_id, run, t, 'acceleration', 'az', az FROM rr UNION ALL SELECT log_id, run, t, 'target', 'az_target', azt FROM rr
 UNION ALL SELECT log_id, run, t, 'residual', 'dz', dz FROM rr UNION ALL SELECT log_id, run, t, 'age', 'age_pscd_ms', ga FROM rr)
SELECT log_id, CAST(run AS BIGINT) AS run_id, series, "column", count(*) AS points, count(value) AS present, round(sum(value), 3) AS total FROM u GROUP BY 1, 2, 3, 4""")
def series(fl):
    rows = with_runs(fl).select("log_id", "run_id", "row_seq", "time_us", "pz", "vz", "az", "az_target", "dz", "age_pscd_ms")
    return se.series(rows).groupBy("log_id", "run_id", "series", "column").agg(
        F.count(F.lit(1)).alias("points"), F.count("value").alias("present"), F.round(F.sum("value"), 3).alias("total"))


# ---- packets and digests ------------------------------------------------------------------------------

PACK = """p AS (SELECT source AS log_id, doc_id AS ri, n_chars AS length,
 sum(n_chars + CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS offset_ FROM documents),
g0 AS (SELECT *, offset_ - coalesce(lag(offset_ + length) OVER (PARTITION BY log_id ORDER BY ri), 0) AS gap FROM p),
fs AS (SELECT log_id, CAST(max(offset_ + length) AS BIGINT) + CASE WHEN log_id < 'f' THEN 5 ELSE 0 END AS fb FROM p GROUP BY 1)"""


def packets(fl):
    """Documents as packets of a log per source; a skipped byte precedes some of them."""
    docs = fl.table("documents").select(F.col("source").alias("log_id"), F.col("doc_id").alias("record_index"), F.col("n_chars").alias("length"))
    lost = F.when(F.col("record_index") % 97 == 0, 1).otherwise(0)
    rows = ru.Scan(ru.rank_chunk(docs), ["log_id"], ("record_index",)).total("_end", F.col("length") + lost).run()
    return rows.select("log_id", "record_index", "length", (F.col("_end") - F.col("length")).alias("offset"))


@query("packet_gaps", f"WITH {PACK} SELECT log_id, CAST(offset_ - gap AS BIGINT) AS gap_offset, CAST(gap AS BIGINT) AS byte_count FROM g0 WHERE gap > 0")
def packet_gaps(fl):
    return pk.packet_gaps(packets(fl))


@query("parser_status", f"""WITH {PACK}, a AS (SELECT log_id, CAST(max(offset_ + length) AS BIGINT) AS le, count(*) AS n, count(CASE WHEN gap > 0 THEN 1 END) AS r, CAST(coalesce(sum(CASE WHEN gap > 0 THEN gap END), 0) AS BIGINT) AS b FROM g0 GROUP BY 1)
SELECT log_id, n AS packets, fb AS file_bytes, le AS last_end, r AS skipped_regions, b AS skipped_bytes, fb - le AS trailing_bytes, CASE WHEN fb > le THEN 'truncated_message' END AS trailing_kind,
fb AS accounted_bytes, r + CASE WHEN fb > le THEN 1 ELSE 0 END AS anomalies, CASE WHEN r = 0 AND fb = le THEN 'PASS' WHEN r = 0 THEN 'PASS_WITH_WARNINGS' ELSE 'FAIL' END AS status FROM a JOIN fs USING (log_id)""")
def parser_status(fl):
    rows = settle(packets(fl))
    files = rows.groupBy("log_id").agg(F.max(F.col("offset") + F.col("length")).alias("file_bytes")).select(
        "log_id", (F.col("file_bytes") + F.when(F.col("log_id") < "f", 5).otherwise(0)).alias("file_bytes"), F.lit(20).cast("bigint").alias("tail_expected"))
    return pk.parser_status(pk.coverage(rows, files, pk.packet_gaps(rows)))


@query("content_digest", "SELECT page_id, sha256(html) AS digest, CAST(strlen(html) AS BIGINT) AS length FROM pages")
def content_digest(fl):
    return dg.content_digest(fl.table("pages"), ["page_id"], "html")


@query("reconcile_digests", """WITH e AS (SELECT page_id, sha256(html) AS d, sha256(replace(html, '&amp;', '&')) AS n FROM pages)
SELECT CAST(page_id AS VARCHAR) AS log_id, 'artifact_digest' AS rule, 'html' AS scope, CAST(1 AS BIGINT) AS n_bad FROM e WHERE d <> n""")
def reconcile_digests(fl):
    """Digests of the raw pages against digests of pages with one entity resolved."""
    pages = fl.table("pages").select(F.col("page_id").cast("string").alias("log_id"), F.lit("html").alias("name"), "html")
    expected = dg.content_digest(pages, ["log_id", "name"], "html")
    actual = dg.content_digest(pages.withColumn("html", F.replace("html", F.lit("&amp;"), F.lit("&"))), ["log_id", "name"], "html")
    return counted(dg.reconcile_digests(expected, actual))


@query("presence", """WITH e AS (SELECT user_id AS log_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
SELECT log_id, 'flight_id' AS rule, 'flight_id' AS scope, count(*) AS n_bad FROM e WHERE k < 5 GROUP BY 1
UNION ALL SELECT c_custkey, 'empty', 'dataset', 1 FROM customer WHERE c_custkey NOT IN (SELECT log_id FROM e)""")
def presence(fl):
    """Records without a flight, and customers who left no record at all."""
    rows = fl.records.withColumn("flight_id", F.when(F.col("k") >= 5, F.col("k")))
    return counted(ru.presence(rows, fl.table("customer").select(F.col("c_custkey").alias("log_id"))))


@query("table_digest", """WITH r AS (SELECT o_orderpriority, md5(""" + " || ".join(
    f"coalesce('=' || CAST({c} AS VARCHAR) || chr(31), '-' || chr(31))" for c in ("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
) + """) AS h FROM orders)
SELECT o_orderpriority, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM r GROUP BY 1""")
def table_digest(fl):
    """The orders of each priority."""
    return dg.table_digest(fl.table("orders"), ["o_orderpriority"])
