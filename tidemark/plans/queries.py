"""Registered queries of the generic operators on the provided tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import outliers as O
from tidemark.operators import ranks as K
from tidemark.operators import tables as R
from tidemark.operators import temporal as T
from tidemark.plans import clinical as C
from tidemark.plans import statistics as X
from tidemark.plans.registry import ALL, SQL, Query
from tidemark.plans.registry import events as _events
from tidemark.plans.registry import query as _query
from tidemark.plans.registry import read as _read
from tidemark.plans.registry import rounded as _r



@_query("""
SELECT p.user_id, p.event_id, p.ts, CASE WHEN p.ts - v.ts <= INTERVAL 24 HOUR THEN v.ts END AS r_ts,
       CASE WHEN p.ts - v.ts <= INTERVAL 24 HOUR THEN v.value END AS r_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_backward(spark, d):
    p, v = _events(spark, d, "purchase").select("user_id", "event_id", "ts"), _events(spark, d, "view")
    return T.asof_join(p, v, ["user_id"], "ts", "ts", ["value"], hours=24)


@_query("""
SELECT p.user_id, p.event_id, p.ts, CASE WHEN v.ts - p.ts <= INTERVAL 72 HOUR THEN v.ts END AS r_ts,
       CASE WHEN v.ts - p.ts <= INTERVAL 72 HOUR THEN v.value END AS r_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts <= v.ts""")
def asof_forward(spark, d):
    p, v = _events(spark, d, "purchase").select("user_id", "event_id", "ts"), _events(spark, d, "view")
    return T.asof_join(p, v, ["user_id"], "ts", "ts", ["value"], forward=True, hours=72)


_PAIRS = """
pairs AS (
 SELECT a.user_id, a.ts AS a_time, b.ts AS b_time, least(a.ts, b.ts) AS infect_time FROM (SELECT * FROM events WHERE event_type = 'purchase') a
 ASOF JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts <= b.ts WHERE b.ts - a.ts <= INTERVAL 24 HOUR
 UNION
 SELECT a.user_id, a.ts, b.ts, least(a.ts, b.ts) FROM (SELECT * FROM events WHERE event_type = 'purchase') a
 ASOF JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.ts - b.ts <= INTERVAL 72 HOUR),
inf AS (SELECT user_id, a_time, b_time, infect_time FROM pairs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY infect_time, a_time, b_time) = 1)"""


def _infect(spark, d):
    a = _events(spark, d, "purchase").select("user_id", F.col("ts").alias("a_t"))
    b = _events(spark, d, "error").select("user_id", F.col("ts").alias("b_t"))
    return C.nearest_pairs(a, b, "user_id", "a_t", "b_t", 72, 24)


@_query(f"WITH {_PAIRS} SELECT user_id, a_time, b_time, infect_time FROM inf")
def infection_pairs(spark, d):
    return _infect(spark, d)


@_query("""
SELECT l.event_id AS left_id, count(*) AS n, round(sum(r.value), 6) AS total
FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 6 HOUR AND l.ts + INTERVAL 6 HOUR
WHERE l.event_type = 'error' AND r.event_type = 'click' GROUP BY 1""")
def band_symmetric(spark, d):
    l = _events(spark, d, "error").select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("lt"))
    r = _events(spark, d, "click").select("user_id", "ts", "value")
    return T.band_join(l, r, ["user_id"], "lt", "ts", 6, 6).groupBy("left_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@_query("""
SELECT l.event_id AS left_id, r.event_id, r.value
FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 6 HOUR AND l.ts + INTERVAL 48 HOUR
WHERE l.event_type = 'error' AND r.event_type = 'purchase'""")
def band_bucketed(spark, d):
    l = _events(spark, d, "error").select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("lt"))
    r = _events(spark, d, "purchase").select("user_id", "event_id", "ts", "value")
    return T.band_join(l, r, ["user_id"], "lt", "ts", 6, 48, bucket=True).select("left_id", "event_id", "value")


_FEATURES = {"max_click_24h": ("click", "max", 24), "min_view_12h": ("view", "min", 12), "mean_error_48h": ("error", "mean", 48), "n_view_24h": ("view", "count", 24), "sum_purchase_72h": ("purchase", "sum", 72), "last_click_8h": ("click", "last", 8)}
_FSQL = ", ".join(
    f"{'last(e.value ORDER BY e.ts, e.value)' if a == 'last' else {'mean': 'avg'}.get(a, a) + '(e.value)'} FILTER (WHERE e.event_type = '{g}' AND e.ts >= t.ts - INTERVAL {h} HOUR) AS {n}" for n, (g, a, h) in _FEATURES.items()
)
_AGG = f"agg AS (SELECT t.user_id, t.ts, {_FSQL} FROM (SELECT DISTINCT user_id, ts FROM events) t JOIN events e ON e.user_id = t.user_id AND e.ts <= t.ts AND e.ts >= t.ts - INTERVAL 72 HOUR GROUP BY 1, 2)"


def _agg(spark, d):
    e = _events(spark, d)
    return T.lookback(e, e, "user_id", "ts", "event_type", "value", _FEATURES)


@_query(f"WITH {_AGG} SELECT user_id, ts, round(max_click_24h, 6) AS max_click_24h, round(min_view_12h, 6) AS min_view_12h, round(mean_error_48h, 6) AS mean_error_48h, n_view_24h, round(sum_purchase_72h, 6) AS sum_purchase_72h, round(last_click_8h, 6) AS last_click_8h FROM agg")
def lookback_features(spark, d):
    return _agg(spark, d).select("user_id", "ts", "n_view_24h", *_r("max_click_24h", "min_view_12h", "mean_error_48h", "sum_purchase_72h", "last_click_8h"))


@_query("""
WITH x AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'view' THEN value END AS v FROM events),
y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS pt, last_value(v IGNORE NULLS) OVER w AS pv FROM x
      WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN ts - pt <= INTERVAL 12 HOUR THEN pv END AS filled FROM y""")
def expiring_fill(spark, d):
    e = _events(spark, d).withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return T.fill_forward(e, ["user_id"], "ts", "v", "filled", hours=12).select("event_id", "filled")


@_query("""
WITH x AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS forward,
       first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM x""")
def fill_both_ways(spark, d):
    e = _events(spark, d).withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    e = T.fill_forward(e, ["user_id"], "ts", "v", "forward")
    return T.fill_forward(e, ["user_id"], "ts", "v", "backward", backward=True).select("event_id", "forward", "backward")


@_query("""
SELECT event_id, round(stddev_samp(value) OVER a, 6) AS sd5, round(avg(value) OVER b, 6) AS mean_around, count(value) OVER b AS n_around, max(value) OVER c AS max24 FROM events
WINDOW a AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 18000000000 PRECEDING AND 1 PRECEDING),
 b AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 9000000000 PRECEDING AND 9000000000 FOLLOWING),
 c AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def rolling_windows(spark, d):
    e = T.rolling(_events(spark, d), ["user_id"], "ts", {"sd5": F.stddev_samp("value")}, 5, left_closed=True)
    e = T.rolling(e, ["user_id"], "ts", {"mean_around": F.avg("value"), "n_around": F.count("value")}, 2.5, 2.5)
    e = T.rolling(e, ["user_id"], "ts", {"max24": F.max("value")}, 24)
    return e.select("event_id", *_r("sd5", "mean_around"), "n_around", "max24")


@_query("""
SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600000000.0, 6) AS gap_hours, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_lead(spark, d):
    e = T.shifted(_events(spark, d), ["user_id"], "ts", {"_p": ("ts", -1), "before": ("event_type", -1), "after": ("event_type", 1)}, ["event_id"])
    return e.select("event_id", F.round(S.hours_between("_p", "ts"), 6).alias("gap_hours"), "before", "after")


@_query("SELECT event_id, CASE WHEN event_type = 'click' AND (value < 5 OR value > 60) THEN NULL WHEN event_type = 'view' AND (value < 0 OR value > 80) THEN NULL ELSE value END AS value FROM events")
def bounds_nulled(spark, d):
    return _events(spark, d).select("event_id", O.bounded("event_type", "value", {"click": (5, 60), "view": (0, 80)}).alias("value"))


@_query("""
WITH x AS (SELECT event_id, value, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60e6 AS m, abs(value - lag(value) OVER w) AS dv FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts))
SELECT event_id, coalesce(m <= 1440 AND dv / (m + 1e-6::DOUBLE) > 0.05 AND dv / (m + 1e-6::DOUBLE) < 1e6, false) AS too_fast, coalesce(m <= 1440 AND dv > 20, false) AS too_far FROM x""")
def velocity_outliers(spark, d):
    return O.velocity_flags(_events(spark, d), ["user_id", "event_type"], "ts", "value", 0.05, 20, 1440).select("event_id", "too_fast", "too_far")


@_query("""
WITH m AS (SELECT a.event_id, a.user_id, a.ts, a.value, quantile_cont(b.value, 0.5) AS med FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 86399999999 AND epoch_us(a.ts) + 86400000000 GROUP BY ALL),
x AS (SELECT a.event_id, a.value, a.med, 1.4826 * quantile_cont(abs(b.value - b.med), 0.5) AS mad FROM m a JOIN m b ON a.user_id = b.user_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 86399999999 AND epoch_us(a.ts) + 86400000000 GROUP BY ALL)
SELECT event_id, round(CASE WHEN mad = 0 THEN 0.0 ELSE (value - med) / mad END, 4) AS robust_z FROM x""")
def robust_z_scores(spark, d):
    return O.robust_z(_events(spark, d), ["user_id"], "ts", "value", 24, 24).select("event_id", *_r("robust_z", n=4))


@_query("""
WITH c AS (SELECT user_id, count(value) AS n FROM events GROUP BY 1),
m AS (SELECT a.event_id, a.user_id, a.value, count(b.value) AS k, quantile_cont(b.value, 0.5) AS med FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 28800000000 GROUP BY ALL),
x AS (SELECT m.event_id, m.user_id, m.value, m.k, m.med, quantile_cont(abs(b.value - m.med), 0.5) AS mad FROM m JOIN events a USING (event_id) LEFT JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 28800000000 GROUP BY ALL)
SELECT x.event_id, coalesce(c.n >= 5 AND k >= 2 AND abs(value - med) / greatest(1.4826 * mad, 0.01) > 3.0, false) AS outlier FROM x JOIN c USING (user_id)""")
def mad_removal(spark, d):
    return O.mad_outliers(_events(spark, d), ["user_id"], "ts", "value").select("event_id", "outlier")


_SPELL = """
x AS (SELECT user_id, ts, CASE WHEN value >= 30 THEN 1 ELSE 0 END AS state FROM events),
y AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS c FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, state)),
z AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, state ROWS UNBOUNDED PRECEDING) AS spell FROM y),
s AS (SELECT user_id, CAST(spell AS BIGINT) AS spell, any_value(state) AS state, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM z GROUP BY 1, 2)"""


def _state(spark, d):
    return _events(spark, d).select("user_id", "ts", F.when(F.col("value") >= 30, 1).otherwise(0).alias("state"))


@_query(f'WITH {_SPELL} SELECT user_id, spell, state, "start", "end", n, round((epoch_us("end") - epoch_us("start")) / 3600000000.0, 6) AS hours FROM s')
def state_spells(spark, d):
    return T.spells(_state(spark, d), ["user_id"], "ts", "state").withColumn("hours", F.round("hours", 6))


@_query(f"""
WITH {_SPELL},
b AS (SELECT *, CASE WHEN epoch_us("end") - epoch_us("start") < 21600000000 AND lag(state) OVER w = lead(state) OVER w THEN lag(state) OVER w ELSE state END AS st FROM s WINDOW w AS (PARTITION BY user_id ORDER BY spell)),
c AS (SELECT *, CASE WHEN lag(st) OVER w IS DISTINCT FROM st THEN 1 ELSE 0 END AS ch FROM b WINDOW w AS (PARTITION BY user_id ORDER BY spell)),
e AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY spell ROWS UNBOUNDED PRECEDING) AS sp FROM c)
SELECT user_id, CAST(sp AS BIGINT) AS spell, any_value(st) AS state, min("start") AS "start", max("end") AS "end", CAST(sum(n) AS BIGINT) AS n, round((epoch_us(max("end")) - epoch_us(min("start"))) / 3600000000.0, 6) AS hours FROM e GROUP BY 1, 2""")
def bridged(spark, d):
    return T.bridged_spells(_state(spark, d), ["user_id"], "ts", "state", 6).withColumn("hours", F.round("hours", 6))


@_query(f"""
WITH {_SPELL}, r AS (SELECT *, lead("start") OVER (PARTITION BY user_id ORDER BY spell) AS nx FROM s)
SELECT state, count_if(nx IS NULL) AS n_censored, count(*) AS n, round(quantile_cont((epoch_us(coalesce(nx, "end")) - epoch_us("start")) / 3600000000.0, 0.5), 6) AS median_hours FROM r GROUP BY 1""")
def run_duration_table(spark, d):
    r = T.run_durations(_state(spark, d), ["user_id"], "ts", "state")
    n = r.groupBy("state").agg(F.count_if("censored").alias("n_censored"), F.count("*").alias("n"))
    return R.join_groups(n, K.quantiles(r, ["state"], "hours", {"median_hours": 0.5}), ["state"]).withColumn("median_hours", F.round("median_hours", 6))


@_query("""
WITH m AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS p FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
t AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM m WHERE p IS NULL OR p <> event_type)
SELECT user_id, ts AS "start", e AS "end", CASE WHEN e IS NULL THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM t WHERE event_type = 'signup'""")
def on_off_episodes(spark, d):
    return T.episodes(_events(spark, d), ["user_id"], "ts", F.col("event_type") == "signup", F.col("event_type") == "error")


@_query("""
WITH t AS (SELECT event_type AS from_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS to_state FROM events),
n AS (SELECT from_state, to_state, count(*) AS n FROM t WHERE to_state IS NOT NULL AND from_state <> to_state GROUP BY 1, 2)
SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS share FROM n""")
def transition_matrix(spark, d):
    return T.transitions(_events(spark, d), ["user_id"], "ts", "event_type").withColumn("share", F.round("share", 6))


@_query("""
WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS p FROM events),
s AS (SELECT event_type AS from_state, lead(event_type) OVER w AS to_state, row_number() OVER w AS step FROM c WHERE p IS NULL OR p <> event_type WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type))
SELECT CAST(step AS INTEGER) AS step, from_state, to_state, count(*) AS n FROM s WHERE to_state IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def path_steps(spark, d):
    return T.path_edges(_events(spark, d), ["user_id"], "ts", "event_type", 2)


@_query("""
WITH x AS (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)) - epoch_us(ts)) / 3600000000.0 AS h FROM events)
SELECT event_type, count(*) AS n, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, round(min(h), 6) AS min, round(max(h), 6) AS max, round(quantile_cont(h, 0.25), 6) AS p25, round(quantile_cont(h, 0.5), 6) AS p50, round(quantile_cont(h, 0.75), 6) AS p75, round(quantile_cont(h, 0.9), 6) AS p90
FROM x WHERE h > 0 GROUP BY 1""")
def sojourn_summary(spark, d):
    s = R.summary(T.sojourns(_events(spark, d), ["user_id"], "ts", "event_type"), ["event_type"], "hours")
    return s.select("event_type", "n", *_r(*[c for c in s.columns if c not in ("event_type", "n")]))


@_query("""
WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS st FROM events),
o AS (SELECT unnest([0.0, 1.0, 6.0, 24.0, 72.0]::DOUBLE[]) AS "offset"),
l AS (SELECT f.user_id, o."offset", last(f.value ORDER BY f.ts, f.value) AS v FROM f JOIN o ON (epoch_us(f.ts) - epoch_us(f.st)) <= o."offset" * 3600000000 GROUP BY 1, 2)
SELECT "offset", count(v) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM l GROUP BY 1""")
def trajectories(spark, d):
    e = R.with_group(_events(spark, d), ["user_id"], {"st": F.min("ts")})
    return T.trajectory(e, ["user_id"], "ts", "st", "value", [0, 1, 6, 24, 72]).select("offset", "n", *_r("median", "p25", "p75"))


@_query("""
WITH s AS (SELECT user_id, ts AS s, ts + INTERVAL 24 HOUR AS e, event_type FROM events WHERE event_type IN ('error', 'purchase')),
b AS (SELECT DISTINCT user_id, t FROM (SELECT user_id, s AS t FROM s UNION ALL SELECT user_id, e FROM s)),
g AS (SELECT user_id, t AS seg_start, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS seg_end FROM b),
h AS (SELECT g.*, max(CASE WHEN event_type = 'error' THEN s END) AS sa, max(CASE WHEN event_type = 'purchase' THEN s END) AS sb FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.s <= g.seg_start WHERE seg_end IS NOT NULL GROUP BY 1, 2, 3)
SELECT user_id, seg_start, seg_end, CASE WHEN seg_start < sa + INTERVAL 24 HOUR THEN 'error' END AS a_state, CASE WHEN seg_start < sb + INTERVAL 24 HOUR THEN 'purchase' END AS b_state FROM h""")
def segmentation(spark, d):
    iv = lambda k: _events(spark, d, k).select("user_id", F.col("ts").alias("s"), S.plus_hours("ts", 24).alias("e"), "event_type")
    return T.segment(iv("error"), iv("purchase"), ["user_id"], "s", "e", "event_type")


@_query("""
SELECT event_id, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 4 HOUR""")
def thinned(spark, d):
    return T.thin(_events(spark, d), ["user_id"], "ts", 4).select("event_id", "ts")


@_query("""
WITH f AS (SELECT user_id, CAST(floor(value / 20) AS BIGINT) AS level, min(ts) AS first_time FROM events GROUP BY 1, 2)
SELECT user_id, level, first_time, round((epoch_us(first_time) - epoch_us(lag(first_time) OVER (PARTITION BY user_id ORDER BY level))) / 3600000000.0, 6) AS gap_hours FROM f""")
def levels_reached(spark, d):
    e = _events(spark, d).withColumn("level", F.floor(F.col("value") / 20))
    return T.level_gaps(e, ["user_id"], "ts", "level").withColumn("gap_hours", F.round("gap_hours", 6))


@_query("""
SELECT coalesce(CAST(l_returnflag AS VARCHAR), 'TOTAL') AS l_returnflag, count_if(l_linestatus = 'F') AS F, count_if(l_linestatus = 'O') AS O, count_if(l_linestatus = 'F') + count_if(l_linestatus = 'O') AS total
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def crosstab_margins(spark, d):
    return R.crosstab(_read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@_query("""
WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS row_share, round(n / sum(n) OVER (PARTITION BY l_linestatus), 6) AS col_share, round(n / sum(n) OVER (), 6) AS all_share FROM n""")
def matrix_shares(spark, d):
    return R.shares(_read(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", "n", *_r("row_share", "col_share", "all_share"))


@_query("""
WITH t AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 5)
SELECT CASE WHEN t.l_suppkey IS NULL THEN 'Other' ELSE CAST(l.l_suppkey AS VARCHAR) END AS bucket, count(*) AS n FROM lineitem l LEFT JOIN t USING (l_suppkey) GROUP BY 1""")
def top_n_bucket(spark, d):
    l = _read(spark, d, "lineitem").select("l_suppkey")
    top = R.top_n_other(l.withColumn("bucket", F.col("l_suppkey")), "l_suppkey", 5, "bucket")
    return top.groupBy(F.col("bucket").cast("string").alias("bucket")).agg(F.count("*").alias("n"))


@_query("""
WITH x AS (SELECT user_id, ts, CAST(floor(value / 25) AS BIGINT) AS score FROM events)
SELECT user_id, max(score) AS max_score, arg_min(ts, (-score, ts)) AS max_time, min(ts) AS first_time, arg_min(score, (ts, -score)) AS first_score FROM x GROUP BY 1""")
def severity_rollup(spark, d):
    e = _events(spark, d).withColumn("score", F.floor(F.col("value") / 25))
    return R.highest(e, ["user_id"], "score", "ts").join(R.earliest(e, ["user_id"], "score", "ts"), "user_id")


@_query("""
WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, l_partkey ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS running FROM n)
SELECT l_partkey, n, round(running, 6) AS running FROM r WHERE running <= 0.5""")
def pareto_parts(spark, d):
    return R.pareto(_read(spark, d, "lineitem"), "l_partkey", 0.5).withColumn("running", F.round("running", 6))


@_query("""
WITH b AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, b WHERE o_totalprice BETWEEN lo AND hi""")
def trimmed_orders(spark, d):
    return R.trim_quantiles(_read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.05)


_FLAGS = {"big": "l_quantity > 25", "cheap": "l_extendedprice < 30000", "late": "l_discount > 0.05"}


@_query("WITH f AS (SELECT " + ", ".join(f"({c})::INT AS {n}" for n, c in _FLAGS.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count_if({a} = 1 AND {b} = 1) AS n, round(count_if({a} = 1 AND {b} = 1) / count_if({a} = 1), 6) AS share FROM f" for a in _FLAGS for b in _FLAGS))
def flag_cooccurrence(spark, d):
    f = _read(spark, d, "lineitem").select(*[F.expr(c).cast("int").alias(n) for n, c in _FLAGS.items()])
    return R.cooccurrence(f, list(_FLAGS)).withColumn("share", F.round("share", 6))


@_query("""
WITH a AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b FROM a FULL JOIN b ON a.k = b.k""")
def backbone(spark, d):
    n = lambda t: _events(spark, d, t).groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n"))
    return R.backbone_join(n("error"), n("purchase"), ["k"], "_a", "_b")


@_query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def anti_and_semi(spark, d):
    c, o, e = _read(spark, d, "customer"), _read(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"), _read(spark, d, "events")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").join(e, c["c_custkey"] == e["user_id"], "left_semi").select("c_custkey", "c_mktsegment")


@_query("""
SELECT l_orderkey, l_linenumber, CASE WHEN (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0 <= 960 THEN 'POA' ELSE 'NPOA' END || '-' || split_part(o_orderpriority, '-', 1) AS label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def poa_labels(spark, d):
    j = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(_read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", C.poa("l_shipdate", "o_orderdate", 960, S.category(F.col("o_orderpriority"))).alias("label"))


_AB = "ab AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS a, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS b FROM lineitem)"


def _ab(spark, d):
    return _read(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("a"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("b"))


@_query(f"""
WITH {_AB}, t AS (SELECT count(*) AS n, count_if(a = b) / count(*) AS po, count_if(b > a) / count(*) AS up, count_if(b < a) / count(*) AS down FROM ab),
e AS (SELECT sum(na::DOUBLE * nb) AS e FROM (SELECT a, count(*) AS na FROM ab GROUP BY 1) JOIN (SELECT b, count(*) AS nb FROM ab GROUP BY 1) ON a = b)
SELECT n, round(po, 6) AS exact, round(up, 6) AS upgraded, round(down, 6) AS downgraded, round((po - e / (n::DOUBLE * n)) / (1 - e / (n::DOUBLE * n)), 6) AS kappa FROM t, e""")
def agreement_stats(spark, d):
    return X.agreement(_ab(spark, d), "a", "b").select("n", *_r("exact", "upgraded", "downgraded", "kappa"))


@_query("""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 40)
SELECT count_if(b.user_id IS NULL) AS only_a, count_if(a.user_id IS NULL) AS only_b, count_if(a.user_id = b.user_id) AS "both", count(*) AS either, round(count_if(a.user_id = b.user_id) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.user_id = b.user_id""")
def detection_overlap(spark, d):
    return X.overlap(_events(spark, d, "error"), _events(spark, d, "purchase").where("value > 40"), "user_id").withColumn("jaccard", F.round("jaccard", 6))


@_query("""
WITH c AS (SELECT o_orderpriority AS f, o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT f, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT g, sum(n) AS cn FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
s AS (SELECT sum(n::DOUBLE * n / (rn * cn)) AS s FROM c JOIN r USING (f) JOIN k USING (g)), x AS (SELECT t * (s - 1) AS chi, t, (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM k) AS k FROM s, t)
SELECT round(chi, 4) AS chi2, (r - 1) * (k - 1) AS dof, round(sqrt(chi / (t * (least(r, k) - 1))), 6) AS cramers_v FROM x""")
def chi_square_test(spark, d):
    return X.chi_square(_read(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("chi2", 4).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"))


@_query("""
WITH v AS (SELECT event_type AS g, round(value, 0) AS value FROM events), k AS (SELECT *, rank() OVER (ORDER BY value) AS r, count(*) OVER (PARTITION BY value) AS t FROM v),
s AS (SELECT g, count(*) AS n, sum(r + (t - 1) / 2.0) AS rs FROM k GROUP BY 1), ties AS (SELECT sum(t::DOUBLE ** 3 - t) AS ties FROM (SELECT count(*) AS t FROM v GROUP BY value)),
a AS (SELECT sum(n)::DOUBLE AS n, sum(rs * rs / n) AS s, count(*) AS k FROM s)
SELECT round(h, 4) AS h, dof, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h, k - 1 AS dof FROM a, ties)""")
def kruskal_test(spark, d):
    e = _events(spark, d).select("event_type", F.round("value", 0).alias("value"))
    return X.kruskal_wallis(e, "event_type", "value").withColumn("h", F.round("h", 4)).withColumn("p", F.round("p", 6))


@_query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity * 4 AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(l_linenumber * 20 AS BIGINT) AS VARCHAR) AS bp FROM lineitem),
y AS (SELECT *, TRY_CAST(split_part(bp, '/', 1) AS DOUBLE) AS s, TRY_CAST(split_part(bp, '/', 2) AS DOUBLE) AS d FROM x)
SELECT l_orderkey, l_linenumber, s AS sbp, CASE WHEN s > 0 AND d > 0 AND s >= d THEN round((s + 2 * d) / 3, 1) END AS map FROM y""")
def blood_pressure(spark, d):
    bp = F.concat((F.col("l_quantity") * 4).cast("long").cast("string"), F.lit("/"), (F.col("l_linenumber") * 20).cast("long").cast("string"))
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.systolic(bp).alias("sbp"), S.mean_arterial(bp).alias("map"))


@_query("""
SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS part1, TRY_CAST(regexp_extract(replace(o_orderpriority, '-', ' - '), '^([0-9]+)', 1) AS INTEGER) AS severity,
 regexp_replace(trim(replace(o_orderpriority, '-', ' - ')), '\\s*-\\s*', '-', 'g') AS code, CASE WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') THEN 1 ELSE 0 END AS pressing, date_diff('hour', TIMESTAMP '1992-01-01', o_orderdate) AS whole_hours
FROM orders""")
def category_codes(spark, d):
    spaced = F.regexp_replace("o_orderpriority", "-", " - ")
    o = _read(spark, d, "orders").withColumn("_z", F.expr("timestamp_ntz'1992-01-01'"))
    return o.select("o_orderkey", S.category(F.col("o_orderpriority")).alias("part1"), F.regexp_extract(spaced, "^([0-9]+)", 1).try_cast("int").alias("severity"), S.normal_code(spaced).alias("code"), S.contains_any(F.col("o_orderpriority"), ["urgent", "high"]).cast("int").alias("pressing"), S.whole_hours_between("_z", "o_orderdate").alias("whole_hours"))


@_query(f"""
WITH {_AGG}, f AS (SELECT user_id, ts, CASE WHEN max_click_24h < 10 OR max_click_24h > 40 THEN 1 ELSE 0 END AS a, CASE WHEN mean_error_48h > 20 THEN 1 ELSE 0 END AS b, CASE WHEN n_view_24h > 1 THEN 1 ELSE 0 END AS c, CASE WHEN last_click_8h < 10 OR last_click_8h > 30 THEN 1 ELSE 0 END AS e FROM agg)
SELECT user_id, ts, a AS "Temp_Abnormal_Flag", b AS "HR_High_Flag", c AS "Resp_Rate_High_Flag", e AS "WBC_Abnormal_Flag", a + b + c + e AS sirs_score FROM f""")
def sirs_flags(spark, d):
    s = C.sirs(_agg(spark, d), "max_click_24h", "mean_error_48h", "n_view_24h", "last_click_8h", low=10, high=40, hr=20, rr=1, wbc_low=10, wbc_high=30)
    return s.select("user_id", "ts", "Temp_Abnormal_Flag", "HR_High_Flag", "Resp_Rate_High_Flag", "WBC_Abnormal_Flag", "sirs_score")


@_query(f"""
WITH {_PAIRS}, {_AGG}, f AS (SELECT user_id, ts, (CASE WHEN max_click_24h < 10 OR max_click_24h > 40 THEN 1 ELSE 0 END) + (CASE WHEN mean_error_48h > 20 THEN 1 ELSE 0 END) + (CASE WHEN n_view_24h > 1 THEN 1 ELSE 0 END) + (CASE WHEN last_click_8h < 10 OR last_click_8h > 30 THEN 1 ELSE 0 END) AS sirs_score FROM agg)
SELECT i.user_id, i.infect_time, f.ts, f.sirs_score, least(i.infect_time, f.ts) AS earliest_sepsis1_instance FROM inf i JOIN f ON f.user_id = i.user_id AND f.ts BETWEEN i.infect_time - INTERVAL 24 HOUR AND i.infect_time + INTERVAL 24 HOUR WHERE f.sirs_score >= 2""")
def sepsis1_table(spark, d):
    inf = _infect(spark, d).select("user_id", "infect_time")
    hit = T.band_join(inf, sirs_flags(spark, d).select("user_id", "ts", "sirs_score").where("sirs_score >= 2"), ["user_id"], "infect_time", "ts", 24, 24)
    return hit.withColumn("earliest_sepsis1_instance", F.least("infect_time", "ts"))


@_query("""
SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value < 5 THEN 4 WHEN value < 15 THEN 3 WHEN value < 30 THEN 2 WHEN value < 45 THEN 1 ELSE 0 END AS points FROM events""")
def threshold_ladder(spark, d):
    return _events(spark, d).select("event_id", S.ladder(F.col("value"), [(5, 4), (15, 3), (30, 2), (45, 1)], below=True).alias("points"))


@_query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def top_k_per_group(spark, d):
    return R.first_rows(_read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@_query("SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_rows(spark, d):
    return R.duplicates(_events(spark, d).select("user_id", "event_type"))


@_query("""
WITH a AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 4 <> 0),
j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'only_a' WHEN a.c_custkey IS NULL THEN 'only_b' WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'changed' END AS kind, a.c_nationkey AS a_value, b.c_nationkey AS b_value FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)
SELECT * FROM j WHERE kind IS NOT NULL""")
def extract_diff(spark, d):
    c = _read(spark, d, "customer")
    a = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_nationkey")
    b = c.where("c_custkey % 4 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    return R.table_diff(a, b, ["c_custkey"], "c_nationkey")


@_query("""
SELECT c_mktsegment, count_if(o_orderkey IS NOT NULL) AS n_orders, count_if(l_orderkey IS NOT NULL) AS n_lines, round(quantile_cont(CASE WHEN l_orderkey IS NOT NULL THEN (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0 END, 0.5), 6) AS median_hours
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1""")
def funnel(spark, d):
    c, o = _read(spark, d, "customer").select("c_custkey", "c_mktsegment"), _read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    l = _read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_shipdate")
    j = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    n = j.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"), F.count("l_orderkey").alias("n_lines"))
    q = K.quantiles(j.withColumn("_h", S.hours_between("o_orderdate", "l_shipdate")), ["c_mktsegment"], "_h", {"median_hours": 0.5})
    return R.join_groups(n, q, ["c_mktsegment"]).withColumn("median_hours", F.round("median_hours", 6))


#: Stand-ins for the columns of a feature table, in expressions that Spark and DuckDB share.
_LABS = {
    "last_lactate_6h": "l_tax * 75", "last_inr_12h": "l_discount * 20", "last_aptt_24h": "l_quantity * 1.25", "last_platelets_24h": "l_quantity * 4",
    "last_bilirubin_12h": "l_discount * 40", "last_creatinine_12h": "l_tax * 50", "last_egfr_12h": "l_quantity * 2", "last_gcs_12h": "CASE WHEN l_returnflag <> 'N' THEN l_quantity END",
    "Baseline_Platelets": "CASE WHEN l_linenumber > 2 THEN l_linenumber * 100 END", "Baseline_Bilirubin": "CASE WHEN l_linenumber <> 3 THEN l_tax * 20 END",
    "Baseline_Creatinine": "CASE WHEN l_linenumber > 1 THEN l_discount * 30 END", "Baseline_eGFR": "CASE WHEN l_linenumber < 6 THEN l_linenumber * 25 END",
    "last_sbp_8h": "l_quantity * 4", "last_map_8h": "CASE WHEN l_returnflag <> 'A' THEN l_quantity * 2 + 20 END", "Baseline_SBP": "CASE WHEN l_linenumber > 3 THEN 110 + l_linenumber * 10 END",
    "last_vasopressin_24h": "CASE WHEN l_linestatus = 'F' THEN l_discount - 0.05 END", "last_phenylephrine_24h": "CAST(NULL AS DOUBLE)",
    "last_norepinephrine_24h": "CASE WHEN l_linenumber = 7 THEN l_tax END", "last_epinephrine_24h": "l_tax * 0",
}
_LAB = "lab AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f'{e} AS "{n}"' for n, e in _LABS.items()) + " FROM lineitem)"


def _lab(spark, d):
    return _read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _LABS.items()])


@_query(f"""
WITH {_LAB}, f AS (SELECT l_orderkey, l_linenumber, CASE WHEN last_lactate_6h > 2 THEN 1 ELSE 0 END AS cardiovascular_dysfunction,
 CASE WHEN last_inr_12h > 1.5 OR last_aptt_24h > 60 OR (last_platelets_24h < 100 AND ("Baseline_Platelets" IS NULL OR (last_platelets_24h < 0.5 * "Baseline_Platelets" AND "Baseline_Platelets" > 100))) THEN 1 ELSE 0 END AS coagulation_dysfunction,
 CASE WHEN last_bilirubin_12h > 2 AND ("Baseline_Bilirubin" IS NULL OR last_bilirubin_12h > 2 * "Baseline_Bilirubin") THEN 1 ELSE 0 END AS hepatic_dysfunction,
 CASE WHEN ("Baseline_Creatinine" IS NULL AND last_creatinine_12h > 2) OR last_creatinine_12h > 2 * "Baseline_Creatinine" OR last_egfr_12h < 0.5 * "Baseline_eGFR" THEN 1 ELSE 0 END AS renal_dysfunction,
 CAST(last_gcs_12h < 15 AS INTEGER) AS neurological_dysfunction FROM lab)
SELECT *, cardiovascular_dysfunction + coagulation_dysfunction + hepatic_dysfunction + renal_dysfunction + coalesce(neurological_dysfunction, 0) AS organ_dysfunction_total FROM f""")
def organ_flags(spark, d):
    return C.organ_dysfunction(_lab(spark, d)).drop(*_LABS)


_SHOCK = f"""
WITH {_LAB}, f AS (SELECT l_orderkey, l_linenumber, CASE WHEN last_sbp_8h < 90 AND "Baseline_SBP" IS NULL THEN 1 WHEN NOT (last_sbp_8h < 90 AND "Baseline_SBP" IS NULL) THEN 0 END AS sbp90_flag,
 CAST("Baseline_SBP" - last_sbp_8h > 40 AS INTEGER) AS sbpdelta40_flag, CAST(last_map_8h < 65 AS INTEGER) AS map65_flag, CAST(last_lactate_6h > 4 AS INTEGER) AS lactate4_flag,
 CASE WHEN last_vasopressin_24h > 0 OR last_phenylephrine_24h > 0 OR last_norepinephrine_24h > 0 OR last_epinephrine_24h > 0 THEN 1 ELSE 0 END AS vasopressor_flag FROM lab)
SELECT *, {{}} AS septic_shock_flag FROM f"""
_SHOCK_FLAGS = ("sbp90_flag", "sbpdelta40_flag", "map65_flag", "lactate4_flag", "vasopressor_flag")


@_query(_SHOCK.format(f"greatest({', '.join(f'coalesce({x}, 0)' for x in _SHOCK_FLAGS)})"))
def shock_flags(spark, d):
    return C.septic_shock(_lab(spark, d)).drop(*_LABS)


@_query(_SHOCK.format(f"coalesce({' | '.join(_SHOCK_FLAGS)}, 0)"))
def shock_flags_null_propagating(spark, d):
    return C.septic_shock(_lab(spark, d), "propagate").drop(*_LABS)


_VENT = {
    "user_id": "user_id", "ts": "ts", "nam": "event_type",
    "grp": "CASE event_type WHEN 'click' THEN 'Vent On/Off' WHEN 'view' THEN 'PAO2' WHEN 'error' THEN 'FIO2' WHEN 'purchase' THEN CASE WHEN value > 40 THEN 'O2 Delivery Mechanical Ventilation' ELSE 'O2 Delivery Room Air' END ELSE CASE WHEN value > 20 THEN 'Vent On Documentation' ELSE 'Vent Off Documentation' END END",
    "txt": "CASE WHEN event_type = 'click' AND value > 60 THEN 'Initial' WHEN event_type = 'click' AND value > 30 THEN 'Standby' WHEN event_type = 'click' AND value > 20 THEN 'Check' WHEN event_type = 'click' AND value < 0.3 THEN '$ Home Vent Used' WHEN event_type = 'purchase' AND value > 60 THEN 'ventilator' WHEN event_type = 'purchase' THEN 'Mask' WHEN event_type = 'signup' AND value > 250 THEN 'Z99.11' END",
    "num": "value",
}


@_query(f"""
WITH e AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _VENT.items())} FROM events),
x AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e h WHERE h.user_id = e.user_id AND (h.txt = 'Z99.11' OR (h.grp = 'Vent On/Off' AND h.txt = '$ Home Vent Used')))),
pf AS (SELECT p.user_id, p.ts, p.nam, p.num / (q.num / 100) AS pf_ratio FROM x p JOIN x q ON p.user_id = q.user_id AND p.grp = 'PAO2' AND q.grp = 'FIO2' AND q.ts > p.ts - INTERVAL 48 HOUR AND q.ts < p.ts + INTERVAL 48 HOUR)
SELECT x.user_id, x.ts, grp, round(pf_ratio, 6) AS pf_ratio, CASE
 WHEN grp IN ('Vent Off Documentation', 'O2 Delivery Room Air') OR (grp = 'Vent On/Off' AND (txt IS NULL OR txt = 'Standby')) OR pf_ratio > 200 THEN 0
 WHEN (grp = 'Vent On/Off' AND txt = 'Initial') OR grp = 'Vent On Documentation' OR pf_ratio < 200 OR (grp = 'O2 Delivery Mechanical Ventilation' AND txt = 'ventilator') THEN 1 END AS pulmonary_dysfunction_flag
FROM x LEFT JOIN pf ON x.user_id = pf.user_id AND x.ts = pf.ts AND x.nam = pf.nam""")
def pulmonary_flags(spark, d):
    p = C.pulmonary(_vents(spark, d), _VENT_COLUMNS, C.Ventilation(pf_hours=48))
    return p.select("user_id", "ts", "grp", F.round("pf_ratio", 6).alias("pf_ratio"), "pulmonary_dysfunction_flag")


_VENT_COLUMNS = C.Columns(key="user_id", ts="ts", group="grp", name="nam", text="txt", number="num")


def _vents(spark, d):
    return _read(spark, d, "events").selectExpr(*[f"{x} AS {n}" for n, x in _VENT.items()])


@_query("""
WITH i AS (SELECT DISTINCT user_id, ts AS infect_dt FROM events WHERE event_type = 'error'), hit AS (SELECT i.*, e.ts, e.event_type, e.value FROM i JOIN events e ON e.user_id = i.user_id AND e.ts BETWEEN infect_dt - INTERVAL 96 HOUR AND infect_dt + INTERVAL 96 HOUR),
two AS (SELECT * FROM hit WHERE event_type = 'view' AND floor(value / 10) >= 1), three AS (SELECT hit.* FROM hit JOIN (SELECT DISTINCT user_id, infect_dt FROM two) USING (user_id, infect_dt) WHERE event_type = 'purchase' AND value > 30)
SELECT user_id, 1 AS score, min(least(infect_dt, ts)) AS instant FROM hit WHERE event_type = 'click' AND ts BETWEEN infect_dt - INTERVAL 24 HOUR AND infect_dt + INTERVAL 24 HOUR AND floor(value / 10) >= 2 GROUP BY 1
UNION ALL SELECT user_id, 2, min(least(infect_dt, ts)) FROM two GROUP BY 1 UNION ALL SELECT user_id, 3, min(least(infect_dt, ts)) FROM three GROUP BY 1""")
def severity_instants(spark, d):
    e = lambda k, x, n: _events(spark, d, k).select("user_id", "ts", F.expr(x).alias(n))
    inf = _events(spark, d, "error").select("user_id", F.col("ts").alias("infect_dt"))
    labels = C.sepsis_labels(inf, e("click", "floor(value / 10)", "sirs_score"), e("view", "floor(value / 10)", "organ_dysfunction_total"), e("purchase", "cast(value > 30 as int)", "septic_shock_flag"), "user_id", "ts", C.Scenario(organ_hours=96, shock_hours=96))
    return C.stacked(labels, "user_id")


@_query("""
WITH i AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1),
w AS (SELECT e.user_id, e.event_type, max(CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 50 THEN 2 ELSE 3 END) AS p FROM i JOIN events e ON e.user_id = i.user_id AND e.ts BETWEEN t - INTERVAL 240 HOUR AND t + INTERVAL 240 HOUR WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT user_id, sum(p)::BIGINT AS sofa FROM w GROUP BY 1 HAVING sum(p) >= 2""")
def organ_scores(spark, d):
    i = _events(spark, d, "error").groupBy("user_id").agg(F.min("ts").alias("t"))
    e = _events(spark, d).where("value is not null").select("user_id", "ts", "event_type", S.ladder(F.col("value"), [(50, 3), (20, 2), (5, 1)], below=False).alias("points"))
    return C.sofa_worst(T.band_join(i, e, ["user_id"], "t", "ts", 240, 240), "user_id", "event_type", "points")


@_query("""
WITH a AS (SELECT user_id, max(ts) AS act FROM events WHERE event_type = 'purchase' GROUP BY 1),
f AS (SELECT user_id, ts, event_type FROM events WHERE value > 20 AND event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) = 1)
SELECT f.user_id, event_type AS first_organ, ts AS first_time, act, round((epoch_us(act) - epoch_us(ts)) / 3600000000.0, 6) AS lag_hours FROM f LEFT JOIN a ON f.user_id = a.user_id""")
def first_failed_organ(spark, d):
    a = _events(spark, d, "purchase").groupBy("user_id").agg(F.max("ts").alias("act"))
    e = _events(spark, d).where("value > 20 and event_type <> 'purchase'").join(a, "user_id", "left")
    return C.first_organ(e, "user_id", "event_type", "ts", "act").withColumn("lag_hours", F.round("lag_hours", 6))


_LABELS = {"ours": "CASE WHEN l_quantity > 40 THEN NULL WHEN l_returnflag = 'N' THEN 'NPOA-' || (l_linenumber % 3 + 1) ELSE 'POA-' || (l_linenumber % 3 + 1) END", "theirs": "CASE WHEN l_discount > 0.08 THEN NULL WHEN l_linestatus = 'O' THEN 'NPOA-' || (l_linenumber % 2 + 1) ELSE 'POA-' || (l_linenumber % 2 + 1) END"}


@_query(f"""
WITH x AS (SELECT bin, {', '.join(f'{e} AS {n}' for n, e in _LABELS.items())} FROM (SELECT *, l_suppkey % 7 AS bin FROM lineitem)),
y AS (SELECT bin AS factor, CASE WHEN ours IS NULL AND theirs IS NULL THEN 'none' WHEN theirs IS NULL THEN 'only_ours' WHEN ours IS NULL THEN 'only_theirs' WHEN ours = theirs THEN 'agree' WHEN split_part(ours, '-', 1) = split_part(theirs, '-', 1) THEN 'other_severity' ELSE 'other_class' END AS match_class FROM x)
SELECT factor, match_class, count(*) AS n FROM y GROUP BY 1, 2""")
def agreement_classes(spark, d):
    x = _read(spark, d, "lineitem").selectExpr("l_suppkey % 7 AS factor", *[f"{e} AS {n}" for n, e in _LABELS.items()])
    return X.factor_classes(x, "ours", "theirs").groupBy("factor", "match_class").agg(F.count("*").alias("n"))


@_query("""
SELECT o_custkey, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(avg(o_totalprice), 6) AS mean_price, round(stddev_samp(o_totalprice), 6) AS sd FROM orders GROUP BY 1""")
def group_aggregates(spark, d):
    return _read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.percentile("o_totalprice", 0.5), 6).alias("p50"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"), F.round(F.stddev_samp("o_totalprice"), 6).alias("sd"))


def queries() -> dict[str, Query]:
    from tidemark.plans import cohort_queries, source_queries  # noqa: F401  register their own

    return dict(ALL)


def oracle_sql() -> dict[str, str]:
    from tidemark.plans import cohort_queries, source_queries  # noqa: F401  register their own

    return dict(SQL)
