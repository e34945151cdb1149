"""Queries on grids, as-of alignment and row-level derivations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import frames as fr
from strandline.functions import health as he
from strandline.functions.numeric import all_of, finite, text_flag, number
from strandline.operators import asof as af
from strandline.operators import flags as fg
from strandline.operators import grid as gr
from strandline.operators import intervals as iv
from strandline.workload.fleet import CONST_POS_BIT, GAP_MS, HOUR_US, MAX_AGE_MS, STEP_US, open_fleet
from strandline.workload.interval_queries import ARMS, CONT, EV, known

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(open_fleet(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


GRID = f""",
grid AS (SELECT log_id, flight_id, s, e, k, s + k * {STEP_US} AS t FROM (
  SELECT *, unnest(generate_series(0, CAST(ceil((e - s) / {STEP_US}.0) AS BIGINT) - 1)) AS k FROM seg WHERE e > s))"""
LIMIT_US = min(MAX_AGE_MS, GAP_MS) * 1000


@query("grid", f"WITH {ARMS}{GRID} SELECT log_id, flight_id, k, t AS time_us FROM grid")
def grid(fl):
    return gr.master_grid(fl.segments.select("log_id", "flight_id", "start_us", "end_us"), STEP_US).select(
        "log_id", "flight_id", "k", "time_us"
    )


SRC = ARMS + GRID + """,
src AS (SELECT c.log_id, c.ri, c.t, g.flight_id AS b, CASE WHEN k >= 20 THEN v END AS v1, k FROM ev c
        JOIN seg g ON c.log_id = g.log_id AND c.t >= g.s AND c.t < g.e WHERE et = 'click'),
al AS (SELECT g.log_id, g.flight_id, g.k, g.t, CASE WHEN c.b = g.flight_id THEN c.t END AS st, v1, c.k AS v2
       FROM grid g ASOF LEFT JOIN src c ON g.log_id = c.log_id AND g.t >= c.t)"""


def click_source(fl):
    rows = iv.with_flight(fl.message("click"), fl.segments, fl.chunks)
    return rows.select("log_id", "time_us", "record_index", F.col("flight_id").alias("boundary_id"),
                       F.when(F.col("k") >= 20, F.col("value")).alias("v1"), F.col("k").alias("v2"))


@query("asof_bounded", f"""WITH {SRC}, j AS (SELECT *, coalesce(t <= st + {LIMIT_US} AND v1 IS NOT NULL, false) AS valid FROM al)
SELECT log_id, flight_id, k, t AS time_us, coalesce(st, -1) AS source_time_us, (t - st) / 1000.0 AS age_ms, valid,
       CASE WHEN valid THEN v1 END AS v1, CASE WHEN valid THEN CAST(v2 AS DOUBLE) END AS v2 FROM j""")
def asof_bounded(fl):
    targets = fl.grid.withColumn("boundary_id", F.col("flight_id"))
    out = af.asof_align(targets, click_source(fl), ["v1", "v2"], MAX_AGE_MS, GAP_MS, chunks=fl.chunks)
    return out.drop("boundary_id").withColumn("source_time_us", known("source_time_us"))


@query("asof_multifield", f"""WITH {SRC}, j AS (SELECT *, coalesce(t <= st + {LIMIT_US}, false) AS valid FROM al)
SELECT log_id, flight_id, k, t AS time_us, coalesce(st, -1) AS source_time_us, (t - st) / 1000.0 AS age_ms, valid,
       CASE WHEN valid THEN v1 * 2.0 END AS v1, CASE WHEN valid THEN CAST(v2 * 0.5 AS DOUBLE) END AS v2 FROM j""")
def asof_multifield(fl):
    targets = fl.grid.withColumn("boundary_id", F.col("flight_id"))
    out = af.asof_fields(targets, click_source(fl), {"v1": 2.0, "v2": 0.5}, MAX_AGE_MS, GAP_MS, chunks=fl.chunks)
    return out.drop("boundary_id").withColumn("source_time_us", known("source_time_us"))


def wide(fl):
    """All sources, boundaries and modes in one pass over the grid."""
    sources = {
        "a": fl.message("click"),
        "b": fl.message("purchase"),
        "st": fl.primary_status.select("log_id", "time_us", "record_index", "core", "primary_core", "status", "fault"),
        "bound": fl.continuity.select("log_id", F.col("start_us").alias("time_us"), F.col("continuity_id").alias("record_index"), "continuity_id"),
        "m": fl.intervals.select("log_id", F.col("start_us").alias("time_us"), F.col("interval_id").alias("record_index"), "mode"),
    }
    rows = af.latest_before(fl.grid, sources, chunks=fl.chunks)
    start = F.col("bound.time_us")
    a, b, st = (af.hold(n, min(MAX_AGE_MS, GAP_MS), boundary_start=start) for n in ("a", "b", "st"))
    pick = lambda name, parts: F.when(parts["fresh"], F.col(name))
    rows = rows.select(
        "log_id", "flight_id", "k", "time_us", F.col("bound.continuity_id").cast("bigint").alias("continuity_id"),
        F.col("m.mode").alias("mode"),
        a["age_ms"].alias("age_a_ms"), a["source_time_us"].alias("source_time_a_us"),
        b["age_ms"].alias("age_b_ms"), b["source_time_us"].alias("source_time_b_us"),
        st["age_ms"].alias("age_st_ms"),
        pick("a.value", a).alias("a_value"), pick("a.k", a).alias("a_k"), pick("b.value", b).alias("b_value"), pick("b.k", b).alias("b_k"),
        *[pick(f"st.{c}", st).alias(c) for c in ("core", "primary_core", "status", "fault")],
    )
    status = [F.col(c) for c in ("core", "primary_core", "status", "fault")]
    return rows.withColumn("known", he.status_known(*status)).withColumn("healthy", he.healthy(*status, CONST_POS_BIT))


WIDE = CONT + GRID + f""",
w0 AS (SELECT g.log_id, g.flight_id, g.k, g.t, b.cid, b.cs, m.mode, a.t AS ta, a.v AS av, a.k AS ak, p.t AS bt, p.v AS bv, p.k AS bk,
              z.t AS zt, z.core, z.pi, z.ss, z.fs
       FROM grid g ASOF LEFT JOIN cont b ON g.log_id = b.log_id AND g.t >= b.cs
       ASOF LEFT JOIN ivs m ON g.log_id = m.log_id AND g.t >= m.s
       ASOF LEFT JOIN (SELECT * FROM ev WHERE et = 'click') a ON g.log_id = a.log_id AND g.t >= a.t
       ASOF LEFT JOIN (SELECT * FROM ev WHERE et = 'purchase') p ON g.log_id = p.log_id AND g.t >= p.t
       ASOF LEFT JOIN pst z ON g.log_id = z.log_id AND g.t >= z.t),
w1 AS (SELECT *, CASE WHEN ta >= cs THEN ta END AS sa, CASE WHEN bt >= cs THEN bt END AS sb, CASE WHEN zt >= cs THEN zt END AS sz FROM w0),
w2 AS (SELECT *, coalesce(t <= sa + {LIMIT_US}, false) AS fa, coalesce(t <= sb + {LIMIT_US}, false) AS fb, coalesce(t <= sz + {LIMIT_US}, false) AS fz FROM w1),
w3 AS (SELECT log_id, flight_id, k, t, cid, mode, sa, sb, sz, CASE WHEN fa THEN av END AS a_value, CASE WHEN fa THEN ak END AS a_k,
              CASE WHEN fb THEN bv END AS b_value, CASE WHEN fb THEN bk END AS b_k, CASE WHEN fz THEN core END AS core,
              CASE WHEN fz THEN pi END AS pi, CASE WHEN fz THEN ss END AS ss, CASE WHEN fz THEN fs END AS fs FROM w2),
wide AS (SELECT *, coalesce(core = pi AND ss IS NOT NULL AND fs IS NOT NULL, false) AS known,
                coalesce(core = pi AND fs = 0 AND (ss & 1) <> 0 AND (ss & {CONST_POS_BIT}) = 0, false) AS healthy FROM w3)"""


@query("aligned_wide", f"""WITH {WIDE} SELECT log_id, flight_id, k, t AS time_us, cid AS continuity_id, mode, (t - sa) / 1000.0 AS age_a_ms,
coalesce(sa, -1) AS source_time_a_us, (t - sb) / 1000.0 AS age_b_ms, coalesce(sb, -1) AS source_time_b_us, (t - sz) / 1000.0 AS age_st_ms,
a_value, coalesce(a_k, -1) AS a_k, b_value, coalesce(b_k, -1) AS b_k, coalesce(core, -1) AS core, coalesce(pi, -1) AS primary_core,
coalesce(ss, -1) AS status, CAST(coalesce(fs, -1) AS BIGINT) AS fault, known, healthy FROM wide""")
def aligned_wide(fl):
    ints = ("source_time_a_us", "source_time_b_us", "a_k", "b_k", "core", "primary_core", "status", "fault")
    rows = wide(fl)
    return rows.select(*[known(c) if c in ints else c for c in rows.columns])


@query("aligned_quality", f"""WITH {WIDE} SELECT log_id, count(*) AS points, CAST(count_if(a_value IS NOT NULL) AS BIGINT) AS valid_a,
CAST(count_if(b_value IS NOT NULL) AS BIGINT) AS valid_b, CAST(count_if(a_value IS NOT NULL AND b_value IS NOT NULL) AS BIGINT) AS paired,
CAST(count_if(healthy) AS BIGINT) AS healthy, round(avg((t - sa) / 1000.0), 4) AS mean_age_a_ms FROM wide GROUP BY 1""")
def aligned_quality(fl):
    a, b = F.col("a_value").isNotNull(), F.col("b_value").isNotNull()
    return wide(fl).groupBy("log_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(a).alias("valid_a"), F.count_if(b).alias("valid_b"),
        F.count_if(a & b).alias("paired"), F.count_if("healthy").alias("healthy"),
        F.round(F.avg("age_a_ms"), 4).alias("mean_age_a_ms"),
    )


@query("fallback_lineage", f"""WITH {WIDE}, p AS (SELECT *, CASE WHEN a_k >= 20 THEN a_value END AS first,
       healthy AND (ss & 24) <> 0 AND b_k % 2 = pi AND b_value IS NOT NULL AS ok FROM wide)
SELECT log_id, flight_id, k, coalesce(first, CASE WHEN ok THEN b_value END) AS value,
       CASE WHEN first IS NOT NULL THEN 'A.value' WHEN ok THEN 'B.value[C=' || (b_k % 2) || ']' ELSE '' END AS source FROM p""")
def fallback_lineage(fl):
    core = F.col("b_k") % 2
    first = F.when(F.col("a_k") >= 20, F.col("a_value"))
    ok = F.col("healthy") & he.has_bit(F.col("status"), he.HORIZ_POS_REL | he.HORIZ_POS_ABS) & (core == F.col("primary_core"))
    return wide(fl).select(
        "log_id", "flight_id", "k", he.prefer(first, F.col("b_value"), ok).alias("value"),
        he.lineage(first, "A.value", F.col("b_value"), ok, "B.value", core).alias("source"),
    )


ALL_US = 72 * HOUR_US
KINDS = ("click", "error", "purchase", "signup", "view")


@query("latest_all_instances", f"""WITH {EV},
h AS (SELECT *, """ + ", ".join(
    f"last_value(CASE WHEN et = '{n}' THEN t END IGNORE NULLS) OVER w AS t{i}, last_value(CASE WHEN et = '{n}' THEN v END IGNORE NULLS) OVER w AS v{i}"
    for i, n in enumerate(KINDS)) + """ FROM ev WINDOW w AS (PARTITION BY log_id ORDER BY t, ri ROWS UNBOUNDED PRECEDING))
SELECT log_id, ri AS record_index, least(v0, v1, v2, v3, v4) AS lowest, greatest(v0, v1, v2, v3, v4) AS highest,
       round(greatest(v0, v1, v2, v3, v4) / least(v0, v1, v2, v3, v4), 6) AS ratio FROM h WHERE """ + " AND ".join(
    f"t - t{i} <= {ALL_US} AND v{i} > 0" for i in range(5)))
def latest_all_instances(fl):
    out = af.latest_of_all(fl.records, KINDS, "value", ALL_US, 0.0, instance="message", chunks=fl.chunks)
    return out.select("log_id", "record_index", "lowest", "highest", F.round("ratio", 6).alias("ratio"))


@query("latest_own_instances", f"""WITH {EV}, e2 AS (SELECT * FROM ev WHERE NOT (log_id % 2 = 0 AND et IN ('signup', 'error'))),
ha AS (SELECT log_id, count(DISTINCT et) AS kinds, """ + ", ".join(f"bool_or(et = '{n}') AS h{i}" for i, n in enumerate(KINDS)) + """ FROM e2 GROUP BY 1),
h AS (SELECT *, """ + ", ".join(
    f"last_value(CASE WHEN et = '{n}' THEN t END IGNORE NULLS) OVER w AS t{i}, last_value(CASE WHEN et = '{n}' THEN v END IGNORE NULLS) OVER w AS v{i}"
    for i, n in enumerate(KINDS)) + """ FROM e2 WINDOW w AS (PARTITION BY log_id ORDER BY t, ri ROWS UNBOUNDED PRECEDING))
SELECT log_id, ri AS record_index, least(v0, v1, v2, v3, v4) AS lowest, greatest(v0, v1, v2, v3, v4) AS highest,
       round(greatest(v0, v1, v2, v3, v4) / least(v0, v1, v2, v3, v4), 6) AS ratio FROM h JOIN ha USING (log_id) WHERE kinds > 1 AND """ + " AND ".join(
    f"(NOT h{i} OR (t - t{i} <= {ALL_US} AND v{i} > 0))" for i in range(5)))
def latest_own_instances(fl):
    """Every second log lacks two of the five kinds; each log is judged by those it has."""
    rows = fl.records.where(~((F.col("log_id") % 2 == 0) & F.col("message").isin("signup", "error")))
    out = af.latest_of_all(rows, KINDS, "value", ALL_US, 0.0, instance="message", chunks=fl.chunks)
    return out.select("log_id", "record_index", "lowest", "highest", F.round("ratio", 6).alias("ratio"))


@query("ratio_asof", f"""WITH {EV}, j AS (SELECT c.log_id, c.ri, c.t, c.v, p.t AS pt, p.v AS pv FROM (SELECT * FROM ev WHERE et = 'click') c
       ASOF LEFT JOIN (SELECT * FROM ev WHERE et = 'purchase') p ON c.log_id = p.log_id AND c.t >= p.t)
SELECT log_id, ri AS record_index, round(v / pv, 6) AS ratio FROM j WHERE t - pt <= {LIMIT_US} AND pv > 0""")
def ratio_asof(fl):
    out = af.ratio_to_latest(fl.message("click"), fl.message("purchase"), "value", LIMIT_US, chunks=fl.chunks)
    return out.select("log_id", "record_index", F.round("ratio", 6).alias("ratio"))


@query("clock_faults", f"""WITH o AS (SELECT o_orderpriority AS log_id, o_orderkey AS ri, epoch_us(o_orderdate) AS t FROM orders),
l AS (SELECT *, lag(t) OVER (PARTITION BY log_id ORDER BY ri) AS pt FROM o)
SELECT log_id, CAST(count_if(t IS NULL) AS BIGINT) AS missing_times, CAST(count_if(t < pt) AS BIGINT) AS backward_steps FROM l GROUP BY 1""")
def clock_faults(fl):
    return af.clock_faults(orders_as_log(fl))


def orders_as_log(fl):
    """Orders as records: the priority is the log, the date the time, the key the acquisition order."""
    return fl.table("orders").select(
        F.col("o_orderpriority").alias("log_id"), F.col("o_orderkey").alias("record_index"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("time_us"), "o_custkey", "o_totalprice", "o_orderstatus",
    )


PAIR_SQL = """li AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 1000 END AS t FROM lineitem)"""


def priced(fl):
    """Line prices as actual values, a price list as target; every third line number has no target."""
    return fl.table("lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_extendedprice").alias("a"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 1000).alias("t"),
    )


@query("residual", f"WITH {PAIR_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(a - t, 6) AS d FROM li")
def residual(fl):
    return priced(fl).select("l_orderkey", "l_linenumber", F.round(fr.residual(F.col("a"), F.col("t")), 6).alias("d"))


@query("paired_flags", f"""WITH {PAIR_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, t IS NOT NULL AND a IS NOT NULL AS valid,
CASE WHEN t IS NOT NULL THEN a END AS actual, CASE WHEN a IS NOT NULL THEN t END AS target,
CASE WHEN t IS NOT NULL AND a IS NOT NULL THEN 'lineitem.price' ELSE '' END AS source FROM li""")
def paired_flags(fl):
    paired = all_of([finite(F.col("a")), finite(F.col("t"))])
    return priced(fl).select(
        "l_orderkey", "l_linenumber", paired.alias("valid"), F.when(paired, F.col("a")).alias("actual"),
        F.when(paired, F.col("t")).alias("target"), F.when(paired, F.lit("lineitem.price")).otherwise(F.lit("")).alias("source"),
    )


@query("frame_rotate", """SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y, -CAST(embedding[3] AS DOUBLE) AS z,
CAST(embedding[1] AS DOUBLE) AS north, CAST(embedding[2] AS DOUBLE) AS east, CAST(embedding[3] AS DOUBLE) AS down FROM embeddings""")
def frame_rotate(fl):
    n, e, d = (F.col("embedding")[i].cast("double") for i in range(3))
    x, y, z = fr.ned_to_enu(n, e, d)
    north, east, down = fr.enu_to_ned(x, y, z)
    return fl.table("embeddings").select("vec_id", x.alias("x"), y.alias("y"), z.alias("z"), north.alias("north"), east.alias("east"), down.alias("down"))


@query("frame_vectors", """WITH x AS (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 3)) AS part FROM embeddings)
SELECT vec_id, part, CAST(embedding[3 * part + 2] AS DOUBLE) AS x, CAST(embedding[3 * part + 1] AS DOUBLE) AS y, -CAST(embedding[3 * part + 3] AS DOUBLE) AS z FROM x""")
def frame_vectors(fl):
    """All parts of every vector, three by three, as north, east and down."""
    part = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1), lambda i: F.slice("embedding", i * 3 + 1, 3)))
    rows = fl.table("embeddings").where(F.size("embedding") >= 3).select("vec_id", part.alias("part", "v"))
    turned = rows.select("vec_id", F.col("part").cast("bigint").alias("part"), fr.vector_ned_to_enu(F.col("v").cast("array<double>")).alias("v"))
    return turned.select("vec_id", "part", *[F.col("v")[i].alias(n) for i, n in enumerate("xyz")])


@query("heading_wrap", f"""WITH {EV}, a AS (SELECT log_id, ri, pi() / 2 - radians(k * 7.2) + pi() AS r FROM ev)
SELECT log_id, ri AS record_index, round(r - floor(r / (2 * pi())) * 2 * pi() - pi(), 9) AS yaw FROM a""")
def heading_wrap(fl):
    return fl.records.select("log_id", "record_index", F.round(fr.heading_to_enu(F.col("k") * 7.2), 9).alias("yaw"))


@query("bitmask_health", f"""WITH {EV}, s AS (SELECT log_id, ri, k % 2 AS c, (k // 2) % 2 AS p, k AS ss, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS fs FROM ev)
SELECT log_id, ri AS record_index, c = p AS known, c = p AND fs = 0 AND (ss & 1) <> 0 AND (ss & {CONST_POS_BIT}) = 0 AS healthy,
       fs = 0 AND (ss & 1) <> 0 AND (ss & 24) <> 0 AND (ss & {CONST_POS_BIT}) = 0 AS xy_ok FROM s""")
def bitmask_health(fl):
    k = F.col("k")
    c, p, ss, fs = k % 2, F.floor(k / 2) % 2, k, F.when(k % 10 == 0, 1).otherwise(0)
    return fl.records.select(
        "log_id", "record_index", he.status_known(c, p, ss, fs).alias("known"), he.healthy(c, p, ss, fs, CONST_POS_BIT).alias("healthy"),
        he.horizontal_position_ok(ss, fs, CONST_POS_BIT).alias("xy_ok"),
    )


@query("enum_valid", f"""WITH {EV} SELECT log_id, ri AS record_index, k % 12 <= 8 AS known, k % 12 IN (3, 4, 5, 6, 8) AS valid FROM ev""")
def enum_valid(fl):
    status = F.col("k") % 12
    return fl.records.select("log_id", "record_index", he.gps_known(status).alias("known"), he.gps_valid(status).alias("valid"))


@query("text_coercion", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN CAST(o_totalprice AS VARCHAR)
WHEN 4 THEN o_orderpriority WHEN 5 THEN '0' ELSE '2.5e3' END AS c FROM orders)
SELECT o_orderkey, CASE WHEN lower(c) IN ('true', '1') THEN true WHEN lower(c) IN ('false', '0') THEN false END AS flag, TRY_CAST(c AS DOUBLE) AS number FROM x""")
def text_coercion(fl):
    """Whole texts: flags in words and digits, prices, numbers with exponents, and priorities, which are neither."""
    kinds = (F.lit("TRUE"), F.lit("false"), F.lit("1"), F.col("o_totalprice").cast("string"), F.col("o_orderpriority"), F.lit("0"), F.lit("2.5e3"))
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 7 == i, c) for i, c in enumerate(kinds)])
    return fl.table("orders").select("o_orderkey", text_flag(text).alias("flag"), number(text).alias("number"))


LIMITS = {"l_quantity": (5.0, 45.0), "l_extendedprice": (2000.0, 80000.0), "l_discount": (0.0, 0.08)}


@query("outlier_flags", """WITH f AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  l_quantity < 5 OR l_quantity > 45 AS outlier_l_quantity, l_extendedprice < 2000 OR l_extendedprice > 80000 AS outlier_l_extendedprice,
  l_discount < 0 OR l_discount > 0.08 AS outlier_l_discount,
  coalesce(sqrt(l_quantity * l_quantity + (l_discount * 100) * (l_discount * 100) + (l_tax * 100) * (l_tax * 100)) > 40, false) AS outlier_speed FROM lineitem)
SELECT *, outlier_l_quantity OR outlier_l_extendedprice OR outlier_l_discount OR outlier_speed AS outlier,
       NOT (outlier_l_quantity OR outlier_l_extendedprice OR outlier_l_discount OR outlier_speed) AND l_linenumber <> 3 AS eligible FROM f""")
def outlier_flags(fl):
    rows = fl.table("lineitem").withColumns({
        "vx": F.col("l_quantity"), "vy": F.col("l_discount") * 100, "vz": F.col("l_tax") * 100,
        "l_linenumber": F.col("l_linenumber").cast("bigint"),
    })
    rows = fg.with_outliers(rows, LIMITS, (0.0, 40.0))
    fit = fg.eligible(F.col("l_linenumber") != 3, ("l_quantity", "vx"), F.col("outlier"), True)
    return rows.select("l_orderkey", "l_linenumber", *[f"outlier_{c}" for c in LIMITS], "outlier_speed", "outlier", fit.alias("eligible"))


@query("jump_flags", f"""WITH {EV}, l AS (SELECT *, (t - lag(t) OVER w) / 3.6e9 AS dt, lag(v) OVER w AS pv, lag(k) OVER w AS pk FROM ev
       WINDOW w AS (PARTITION BY log_id, et ORDER BY ri)),
x AS (SELECT *, (k - pk) * 7.2 / 57.29577951308232 + pi() AS r FROM l)
SELECT log_id, ri AS record_index, coalesce(dt > 0 AND abs(v - pv) / dt > 5, false) AS outlier_position_jump,
       coalesce(dt > 0 AND abs(k - pk) / dt > 2, false) AS outlier_velocity_jump,
       coalesce(dt > 0 AND abs(r - floor(r / (2 * pi())) * 2 * pi() - pi()) / dt > 0.05, false) AS outlier_yaw_jump FROM x""")
def jump_flags(fl):
    hour = F.floor(F.col("time_us"))  # one hour counts as one second here
    rows = fl.records.select("log_id", "message", "record_index", (hour / 3600.0).alias("t"), "value", "k", (F.col("k") * 7.2 / 57.29577951308232).alias("yaw"))
    out = fg.jumps(rows, ["log_id", "message"], 5.0, 2.0, 0.05, "record_index", "t", ("value",), ("k",), "yaw")
    return out.select("log_id", "record_index", "outlier_position_jump", "outlier_velocity_jump", "outlier_yaw_jump")
