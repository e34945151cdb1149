"""Queries on events, intervals and status, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import continuity as ct
from strandline.operators import intervals as iv
from strandline.operators import screening as sc
from strandline.workload.fleet import CONST_POS_BIT, HOUR_US, MAX_AGE_MS, open_fleet

FLIGHT = ["log_id", "flight_id"]
QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(open_fleet(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def known(column):
    """Missing integers as -1, so that both engines return plain BIGINT columns."""
    return F.coalesce(F.col(column), F.lit(-1)).cast("bigint").alias(column)


EV = """
ev AS (SELECT user_id AS log_id, event_id AS ri, epoch_us(ts) AS t, event_type AS et, value AS v,
              CAST(props->>'$.k' AS BIGINT) AS k FROM events),
bnd AS (SELECT log_id, min(t) AS f, max(t) AS l FROM ev GROUP BY 1)"""

ARMS = EV + """,
arm AS (SELECT log_id, ri, t, CASE WHEN et = 'signup' THEN 1 ELSE 0 END AS st FROM ev WHERE et IN ('signup', 'error')),
turn AS (SELECT * FROM (SELECT *, lag(st) OVER (PARTITION BY log_id ORDER BY t, ri) AS ps FROM arm)
         WHERE ps IS NULL OR ps <> st),
seg0 AS (SELECT *, lead(t) OVER (PARTITION BY log_id ORDER BY t, ri) AS nt FROM turn),
seg AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY t) AS flight_id, t AS s,
               coalesce(nt, l) AS e, nt IS NULL AS open_ended
        FROM seg0 JOIN bnd USING (log_id) WHERE st = 1)"""

MODES = ARMS + """,
md AS (SELECT log_id, ri, t, k % 4 AS mn FROM ev WHERE et = 'view'),
pts AS (SELECT log_id, f AS t FROM bnd UNION SELECT log_id, l FROM bnd UNION SELECT log_id, t FROM md
        UNION SELECT log_id, t FROM arm UNION SELECT log_id, s FROM seg UNION SELECT log_id, e FROM seg),
tile0 AS (SELECT p.log_id, p.t, m.mn, a.st, g.flight_id AS fid, g.e AS fe
          FROM pts p ASOF LEFT JOIN md m ON p.log_id = m.log_id AND p.t >= m.t
          ASOF LEFT JOIN arm a ON p.log_id = a.log_id AND p.t >= a.t
          ASOF LEFT JOIN seg g ON p.log_id = g.log_id AND p.t >= g.s),
tile AS (SELECT t0.log_id, t, mn, st, CASE WHEN t < fe THEN fid END AS fid FROM tile0 t0 JOIN bnd USING (log_id) WHERE t < l),
isl AS (SELECT *, lag(t) OVER w AS pt, lag(mn) OVER w AS pm, lag(st) OVER w AS ps, lag(fid) OVER w AS pf
        FROM tile WINDOW w AS (PARTITION BY log_id ORDER BY t)),
ivs AS (SELECT i.log_id, row_number() OVER w AS interval_id, t AS s, coalesce(lead(t) OVER w, l) AS e,
               fid AS flight_id, st = 1 AS armed, mn AS mode_number,
               CASE mn WHEN 0 THEN 'STABILIZE' WHEN 1 THEN 'ACRO' WHEN 2 THEN 'ALT_HOLD'
                       ELSE coalesce('UNKNOWN(' || mn || ')', 'UNKNOWN') END AS mode
        FROM isl i JOIN bnd USING (log_id)
        WHERE pt IS NULL OR pm IS DISTINCT FROM mn OR ps IS DISTINCT FROM st OR pf IS DISTINCT FROM fid
        WINDOW w AS (PARTITION BY i.log_id ORDER BY t))"""

STATUS = MODES + """,
stx AS (SELECT p.log_id, g.flight_id, g.s, g.e, p.ri, p.t, k % 2 AS c, (k // 2) % 2 AS pi, k AS ss,
               CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS fs
        FROM ev p JOIN seg g ON p.log_id = g.log_id AND p.t >= g.s AND p.t < g.e WHERE p.et = 'purchase'),
stc AS (SELECT *, lag(pi) OVER (PARTITION BY log_id, flight_id ORDER BY t, ri) AS ppi FROM stx),
strun AS (SELECT *, sum(CASE WHEN ppi IS NULL OR ppi <> pi THEN 1 ELSE 0 END)
                 OVER (PARTITION BY log_id, flight_id ORDER BY t, ri ROWS UNBOUNDED PRECEDING) AS run FROM stc),
stseen AS (SELECT *, coalesce(max(CASE WHEN c = pi THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, flight_id, run
                  ORDER BY t, ri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM strun),
pst AS (SELECT log_id, flight_id, s, e, ri, t, pi, CASE WHEN c = pi THEN c END AS core, CASE WHEN c = pi THEN ss END AS ss,
               CASE WHEN c = pi THEN fs END AS fs FROM stseen WHERE c = pi OR seen = 0)"""

CONT = STATUS + f""",
gp AS (SELECT c.log_id, g.flight_id, c.t, c.ri, c.k % 9 AS sig FROM ev c
       JOIN seg g ON c.log_id = g.log_id AND c.t >= g.s AND c.t < g.e WHERE et = 'click' AND c.k // 50 = 0),
gpl AS (SELECT *, lag(t) OVER w AS pt, lag(sig) OVER w AS psig FROM gp
        WINDOW w AS (PARTITION BY log_id, flight_id ORDER BY t, ri)),
psl AS (SELECT *, lag(t) OVER w AS pt, lag(pi) OVER w AS lpi, lag(ss) OVER w AS lss, lag(fs) OVER w AS lfs,
               CASE WHEN core IS NULL THEN 1 ELSE 0 END AS mk, lag(CASE WHEN core IS NULL THEN 1 ELSE 0 END) OVER w AS lmk
        FROM pst WINDOW w AS (PARTITION BY log_id, flight_id ORDER BY t, ri)),
cp AS (
  SELECT log_id, flight_id, s AS t FROM seg
  UNION SELECT log_id, flight_id, s FROM ivs WHERE flight_id IS NOT NULL
  UNION SELECT v.log_id, g.flight_id, v.t FROM ev v JOIN seg g ON v.log_id = g.log_id AND v.t >= g.s AND v.t < g.e
        WHERE et = 'view' AND k IN (60, 62, 85, 86, 87)
  UNION SELECT log_id, flight_id, t FROM gpl WHERE pt IS NOT NULL AND (sig <> psig OR t - pt > {MAX_AGE_MS * 1000})
  UNION SELECT log_id, flight_id, pt + {MAX_AGE_MS * 1000} FROM gpl WHERE t - pt > {MAX_AGE_MS * 1000}
  UNION SELECT log_id, flight_id, t FROM psl WHERE pt IS NOT NULL AND (pi <> lpi OR ss IS DISTINCT FROM lss
        OR fs IS DISTINCT FROM lfs OR mk <> lmk OR t - pt > {MAX_AGE_MS * 1000})
  UNION SELECT log_id, flight_id, pt + {MAX_AGE_MS * 1000} FROM psl WHERE t - pt > {MAX_AGE_MS * 1000}),
cont AS (SELECT c.log_id, c.flight_id, row_number() OVER (PARTITION BY c.log_id ORDER BY t) AS cid, t AS cs,
                coalesce(lead(t) OVER (PARTITION BY c.log_id, c.flight_id ORDER BY t), e) AS ce
         FROM cp c JOIN seg g ON c.log_id = g.log_id AND c.flight_id = g.flight_id WHERE t >= s AND t < e)"""


@query("log_bounds", f"WITH {EV} SELECT log_id, f AS first_us, l AS last_us, l - f AS duration_us FROM bnd")
def log_bounds(fl):
    return iv.log_bounds(fl.records)


@query("armed_segments", f"WITH {ARMS} SELECT log_id, flight_id, s AS start_us, e AS end_us, open_ended, e - s AS duration_us FROM seg")
def armed_segments(fl):
    return iv.armed_segments(fl.arms, fl.bounds, fl.chunks).drop("source")


@query("repeated_arms", f"""WITH {ARMS}, rep AS (SELECT *, lag(st) OVER (PARTITION BY log_id ORDER BY t, ri) AS ps FROM arm)
SELECT log_id, t AS time_us, ri AS record_index FROM rep WHERE st = 1 AND ps = 1""")
def repeated_arms(fl):
    return iv.repeated_arms(fl.arms, fl.chunks)


@query("mode_intervals", f"WITH {MODES} SELECT log_id, interval_id, s AS start_us, e AS end_us, e - s AS duration_us, "
       "coalesce(flight_id, -1) AS flight_id, CASE WHEN armed IS NULL THEN 'unknown' WHEN armed THEN 'armed' ELSE 'disarmed' END "
       "AS state, coalesce(mode_number, -1) AS mode_number, mode FROM ivs")
def mode_intervals(fl):
    rows = iv.mode_intervals(fl.bounds, fl.modes, fl.arms, fl.segments, fl.chunks)
    return rows.select("log_id", F.col("interval_id").cast("bigint").alias("interval_id"), "start_us", "end_us", "duration_us",
                       known("flight_id"), iv.arm_state(F.col("armed")).alias("state"), known("mode_number"), "mode")


@query("flight_modes", f"""WITH {MODES}, fm AS (SELECT log_id, flight_id, mode, min(s) AS a FROM ivs WHERE flight_id IS NOT NULL GROUP BY ALL)
SELECT log_id, flight_id, string_agg(mode, '>' ORDER BY a) AS modes FROM fm GROUP BY 1, 2""")
def flight_modes(fl):
    return iv.flight_modes(fl.intervals).withColumn("modes", F.array_join("modes", ">"))


@query("flight_samples", f"""WITH {ARMS}, msg AS (SELECT unnest(['click', 'purchase', 'view']) AS message)
SELECT g.log_id, g.flight_id, m.message, count(v.ri) AS samples FROM seg g CROSS JOIN msg m
LEFT JOIN ev v ON v.log_id = g.log_id AND v.et = m.message AND v.t >= g.s AND v.t < g.e GROUP BY 1, 2, 3""")
def flight_samples(fl):
    return iv.samples_per_flight(fl.segments, fl.records, ("click", "purchase", "view"), fl.chunks)


@query("flight_gps_status", f"""WITH {ARMS},
d AS (SELECT DISTINCT c.log_id, g.flight_id, CAST(c.k // 50 AS VARCHAR) AS who, c.k % 9 AS st FROM ev c
      JOIN seg g ON c.log_id = g.log_id AND c.t >= g.s AND c.t < g.e WHERE et = 'click'),
w AS (SELECT log_id, flight_id, who, string_agg(CAST(st AS VARCHAR), ',' ORDER BY st) AS seen FROM d GROUP BY 1, 2, 3)
SELECT log_id, flight_id, string_agg(who || ':' || seen, ';' ORDER BY who) AS gps_status FROM w GROUP BY 1, 2""")
def flight_gps_status(fl):
    sets = iv.gps_status_sets(fl.segments, fl.gps, fl.chunks)
    text = F.transform(F.array_sort(F.map_entries("gps_status")), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"].cast("array<string>"), ",")))
    return sets.select(*FLIGHT, F.array_join(text, ";").alias("gps_status"))


@query("flight_status_sets", f"""WITH {STATUS}, p AS (SELECT * FROM stx WHERE c = pi)
SELECT log_id, flight_id, array_to_string(list_sort(list(DISTINCT pi)), ',') AS primary_cores,
       array_to_string(list_sort(list(DISTINCT ss)), ',') AS solution_status_values,
       array_to_string(list_sort(list(DISTINCT fs)), ',') AS fault_status_values FROM p GROUP BY 1, 2""")
def flight_status_sets(fl):
    sets = iv.status_sets(iv.with_flight(fl.status, fl.segments, fl.chunks))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return sets.select(*FLIGHT, text("primary_cores"), text("solution_status_values"), text("fault_status_values"))


HOLD_US = 6 * HOUR_US


@query("status_hold", f"""WITH {STATUS},
nodes AS (SELECT log_id, flight_id, s, e, t, ri, 0 AS node, ss, fs FROM stc WHERE ppi IS NULL OR ppi <> pi
          UNION ALL SELECT log_id, flight_id, s, e, t, ri, 1, ss, fs FROM stc WHERE c = pi),
nx AS (SELECT *, lead(t) OVER (PARTITION BY log_id, flight_id ORDER BY t, ri, node) AS nt FROM nodes),
du AS (SELECT log_id, flight_id, greatest(0, least(e, t + {HOLD_US}, coalesce(nt, e)) - t) AS d,
              fs = 0 AND (ss & 1) <> 0 AND (ss & 24) <> 0 AND (ss & {CONST_POS_BIT}) = 0 AS ok FROM nx WHERE node = 1),
a AS (SELECT log_id, flight_id, CAST(sum(CASE WHEN ok THEN d ELSE 0 END) AS BIGINT) AS v, CAST(sum(d) AS BIGINT) AS kn FROM du GROUP BY 1, 2)
SELECT g.log_id, g.flight_id, coalesce(v, -1) AS valid_us, coalesce(kn, 0) AS known_us, greatest(0, e - s - coalesce(kn, 0)) AS unknown_us
FROM seg g LEFT JOIN a ON a.log_id = g.log_id AND a.flight_id = g.flight_id""")
def status_hold(fl):
    rows = iv.status_hold(fl.status, fl.segments, HOLD_US, CONST_POS_BIT, fl.chunks)
    return rows.select(*FLIGHT, known("valid_us"), "known_us", "unknown_us")


@query("primary_status", f"WITH {STATUS} SELECT log_id, flight_id, ri AS record_index, t AS time_us, pi AS primary_core, "
       "coalesce(core, -1) AS core, coalesce(ss, -1) AS status, CAST(coalesce(fs, -1) AS BIGINT) AS fault FROM pst")
def primary_status(fl):
    rows = ct.primary_status(iv.with_flight(fl.status, fl.segments, fl.chunks), fl.chunks)
    return rows.select(*FLIGHT, "record_index", "time_us", "primary_core", known("core"), known("status"), known("fault"))


@query("continuity", f"WITH {CONT} SELECT log_id, flight_id, cid AS continuity_id, cs AS start_us, ce AS end_us FROM cont")
def continuity(fl):
    return fl.continuity.withColumn("continuity_id", F.col("continuity_id").cast("bigint"))


@query("core_rows", f"""WITH {CONT},
x AS (SELECT *, v.k % 2 AS xc FROM ev v WHERE et = 'click'),
j AS (SELECT x.log_id, x.ri, x.t, x.xc, p.t AS pt, p.core AS pc, p.pi AS ppi, b.cs, b.ce
      FROM x ASOF LEFT JOIN pst p ON x.log_id = p.log_id AND x.t >= p.t
      ASOF LEFT JOIN cont b ON x.log_id = b.log_id AND x.t >= b.cs)
SELECT log_id, ri AS record_index, t AS time_us, xc AS core FROM j
WHERE pc = ppi AND xc = ppi AND pt >= cs AND t < ce AND t - pt <= {MAX_AGE_MS * 1000}""")
def core_rows(fl):
    states = fl.message("click").select("log_id", "record_index", "time_us", (F.col("k") % 2).alias("core"))
    return ct.core_rows(states, fl.primary_status, fl.continuity, MAX_AGE_MS * 1000, fl.chunks)


# Activity: clicks and purchases inside mode intervals, k as actual and value as target.
TAGGED = MODES + """,
tg AS (SELECT v.log_id, i.interval_id, i.flight_id, v.et AS message, v.t, v.ri, v.k, v.v, v.k >= 20 AS ok FROM ev v
       JOIN ivs i ON v.log_id = i.log_id AND v.t >= i.s AND v.t < i.e WHERE v.et IN ('click', 'purchase')),
tl AS (SELECT *, t - lag(t) OVER w AS dt, lag(t) OVER w AS pt, lag(ok) OVER w AS pok FROM tg
       WINDOW w AS (PARTITION BY log_id, interval_id, message ORDER BY ri)),
th AS (SELECT log_id, interval_id, message, greatest(500000.0, 5.0 * coalesce(median(CASE WHEN dt > 0 THEN dt END), 0)) AS thr
       FROM tl GROUP BY 1, 2, 3),
edge AS (SELECT tl.log_id, tl.interval_id, tl.flight_id, tl.message, pt AS s, t AS e, ok AND pok AS good FROM tl JOIN th
         ON tl.log_id = th.log_id AND tl.interval_id = th.interval_id AND tl.message = th.message WHERE dt > 0 AND dt <= thr)"""


@query("evidence_edges", f"WITH {TAGGED} SELECT log_id, interval_id, message, s AS start_us, e AS end_us FROM edge WHERE good")
def evidence_edges(fl):
    edges = sc.evidence(fl.tagged, sc.usable_pair())
    return edges.where("good").drop("good")


@query("activity", f"""WITH {TAGGED},
c AS (SELECT log_id, interval_id, message, count(*) AS n, CAST(count_if(ok) AS BIGINT) AS p FROM tg GROUP BY 1, 2, 3),
d AS (SELECT log_id, interval_id, message, CAST(sum(e - s) AS BIGINT) AS a, CAST(sum(CASE WHEN good THEN e - s ELSE 0 END) AS BIGINT) AS q
      FROM edge GROUP BY 1, 2, 3),
m AS (SELECT unnest(['click', 'purchase']) AS message)
SELECT i.log_id, i.interval_id, m.message, coalesce(n, 0) AS samples, coalesce(p, 0) AS paired_samples,
       coalesce(a, 0) AS active_us, coalesce(q, 0) AS paired_us
FROM ivs i CROSS JOIN m LEFT JOIN c ON c.log_id = i.log_id AND c.interval_id = i.interval_id AND c.message = m.message
LEFT JOIN d ON d.log_id = i.log_id AND d.interval_id = i.interval_id AND d.message = m.message""")
def activity(fl):
    every = fl.intervals.select("log_id", F.col("interval_id").cast("bigint").alias("interval_id"))
    return sc.activity(every, fl.tagged, fl.edges, ("click", "purchase"), fl.chunks)


SPAN_SQL = f"""WITH {EV},
s AS (SELECT log_id, ri, et, t AS a, t + (k + 1) * {HOUR_US} AS b FROM ev WHERE et IN ('click', 'purchase'))"""


def spans(fl, message):
    return fl.message(message).select("log_id", F.col("time_us").alias("start_us"),
                                      (F.col("time_us") + (F.col("k") + 1) * F.lit(HOUR_US)).alias("end_us"))


@query("union_duration", SPAN_SQL + """,
m AS (SELECT log_id, a, b, max(b) OVER (PARTITION BY log_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
      FROM s WHERE et = 'click')
SELECT log_id, CAST(sum(greatest(0, b - greatest(a, coalesce(r, a)))) AS BIGINT) AS duration_us FROM m GROUP BY 1""")
def union_duration(fl):
    return iv.union_duration(spans(fl, "click"), ["log_id"], fl.chunks)


@query("overlap_duration", SPAN_SQL + """,
o AS (SELECT x.log_id, greatest(x.a, y.a) AS a, least(x.b, y.b) AS b FROM s x JOIN s y ON x.log_id = y.log_id
      AND x.et = 'click' AND y.et = 'purchase' AND x.a < y.b AND y.a < x.b),
m AS (SELECT log_id, a, b, max(b) OVER (PARTITION BY log_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM o)
SELECT log_id, CAST(sum(greatest(0, b - greatest(a, coalesce(r, a)))) AS BIGINT) AS duration_us FROM m GROUP BY 1""")
def overlap_duration(fl):
    return iv.overlap_duration(spans(fl, "click"), spans(fl, "purchase"), ["log_id"], fl.chunks)


@query("flight_evidence", f"""WITH {TAGGED},
n AS (SELECT log_id, flight_id, CAST(count_if(message = 'click' AND ok) AS BIGINT) AS pn, CAST(count_if(message = 'purchase' AND ok) AS BIGINT) AS pe FROM tg
      WHERE flight_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT log_id, flight_id, CAST(sum(CASE WHEN message = 'click' THEN e - s END) AS BIGINT) AS an,
             CAST(sum(CASE WHEN message = 'purchase' THEN e - s END) AS BIGINT) AS ae FROM edge WHERE flight_id IS NOT NULL GROUP BY 1, 2),
o AS (SELECT x.log_id, x.flight_id, CAST(sum(greatest(0, least(x.e, y.e) - greatest(x.s, y.s))) AS BIGINT) AS xy FROM edge x JOIN edge y
      ON x.log_id = y.log_id AND x.flight_id = y.flight_id AND x.message = 'click' AND y.message = 'purchase' AND x.good AND y.good
      AND x.s < y.e AND y.s < x.e GROUP BY 1, 2)
SELECT g.log_id, g.flight_id, coalesce(an, 0) AS pscn_active_us, coalesce(pn, 0) AS pscn_paired_samples,
       coalesce(ae, 0) AS psce_active_us, coalesce(pe, 0) AS psce_paired_samples, coalesce(xy, 0) AS xy_proxy_candidate_us
FROM seg g LEFT JOIN n ON n.log_id = g.log_id AND n.flight_id = g.flight_id
LEFT JOIN a ON a.log_id = g.log_id AND a.flight_id = g.flight_id LEFT JOIN o ON o.log_id = g.log_id AND o.flight_id = g.flight_id""")
def flight_evidence(fl):
    as_psc = F.when(F.col("message") == "click", "PSCN").otherwise("PSCE")
    rows, edges = fl.tagged.withColumn("message", as_psc), fl.flight_edges.withColumn("message", as_psc)
    profile = fl.segments.select("log_id").distinct().withColumn("verified", F.lit(True))
    out = sc.flight_evidence(fl.segments.select(*FLIGHT), rows, edges, profile, fl.chunks)
    return out.select(*FLIGHT, "pscn_active_us", "pscn_paired_samples", "psce_active_us", "psce_paired_samples", "xy_proxy_candidate_us")


@query("dynamic_range", f"""WITH {TAGGED},
u AS (SELECT log_id, interval_id, message, 'actual' AS field, CASE WHEN ok THEN CAST(k AS DOUBLE) END AS x FROM tg
      UNION ALL SELECT log_id, interval_id, message, 'target', v FROM tg)
SELECT log_id, interval_id, message, field, count(x) AS finite_count, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean,
       round(stddev_pop(x), 6) AS std, round(max(x) - min(x), 6) AS range, median(x) AS median,
       round(quantile_cont(x, 0.01), 6) AS p1, round(quantile_cont(x, 0.99), 6) AS p99 FROM u GROUP BY 1, 2, 3, 4""")
def dynamic_range(fl):
    out = sc.dynamic_range(fl.tagged)
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean", "std", "range", "p1", "p99") else c for c in out.columns])


@query("sample_context", f"""WITH {MODES}
SELECT v.log_id, v.ri AS record_index, coalesce(i.interval_id, -1) AS context,
       CASE WHEN i.armed IS NULL THEN 'unknown' WHEN i.armed THEN 'armed' ELSE 'disarmed' END AS state
FROM ev v LEFT JOIN ivs i ON v.log_id = i.log_id AND v.t >= i.s AND v.t < i.e WHERE v.et = 'click'""")
def sample_context(fl):
    rows = iv.with_context(fl.message("click"), fl.intervals, fl.chunks)
    return rows.select("log_id", "record_index", known("context"), "state")
