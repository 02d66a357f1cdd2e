"""Registered queries of encounter, cohort and comparison plans on the provided tables, each with its SQL.

The tables lack clinical columns, so orders stand for encounters, ship dates of a return flag for the
instants of a severity, and events for measurements; the stand-ins are expressions that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import outliers as O
from tidemark.operators import ranks as K
from tidemark.operators import scan as N
from tidemark.operators import tables as R
from tidemark.operators import temporal as T
from tidemark.plans import clinical as C
from tidemark.plans import cohorts as H
from tidemark.plans import statistics as X
from tidemark.plans.registry import events, query, read, rounded
from tidemark.sources.shared import cut, scratch

#: An order as an encounter.
_ENC = {
    "k": "o_orderkey", "patient": "o_custkey", "arrival": "o_orderdate", "los": "o_totalprice / 10000", "age": "o_totalprice / 5000",
    "death": "CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END", "ed": "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END", "origin": "o_orderpriority",
    "ours": "CASE WHEN o_totalprice > 250000 THEN 'POA' ELSE 'NPOA' END || '-' || CAST(1 + o_orderkey % 2 AS STRING)",
    "billing": "CASE o_orderstatus WHEN 'F' THEN 'POA' WHEN 'O' THEN 'NPOA' ELSE 'UPOA' END || '-' || CAST(1 + o_orderkey % 3 AS STRING)",
    "cancer": "CASE WHEN o_orderkey % 5 = 0 THEN 'Y' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'N' END", "hiv": "CASE WHEN o_custkey % 9 = 0 THEN 'Y' ELSE 'N' END",
}
_E = "enc AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in _ENC.items()) + " FROM orders)"
_F = "fi AS (SELECT l_orderkey AS k, min(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS s1, min(CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS s2, min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS s3 FROM lineitem GROUP BY 1)"
_H = "(epoch_us({1}) - epoch_us({0})) / 3600000000.0"


def _enc(spark, d):
    return read(spark, d, "orders").selectExpr(*[f"{x} AS {n}" for n, x in _ENC.items()])


def _labels(spark, d):
    l = read(spark, d, "lineitem")
    return {f"sepsis{i}": l.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias(f"earliest_sepsis{i}_instance")) for i, f in ((1, "A"), (2, "N"), (3, "R"))}


def _firsts(spark, d):
    l = read(spark, d, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("k")).agg(*[F.min(F.when(F.col("l_returnflag") == f, F.col("l_shipdate"))).alias(s) for s, f in (("s1", "A"), ("s2", "N"), ("s3", "R"))])


@query(f"""
WITH {_E}, st AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS score, min(l_shipdate) AS instant FROM lineitem GROUP BY 1, 2),
a AS (SELECT k, min(instant) AS first_sepsis_instant, arg_min(score, (instant, -score)) AS sepsis_score, max(score) AS sepsis_score_at_max, arg_min(instant, (-score, instant)) AS first_sepsis_instant_at_max FROM st GROUP BY 1)
SELECT a.*, round(los, 6) AS los, death FROM a JOIN enc USING (k)""")
def encounter_labels(spark, d):
    return H.encounter_table(_labels(spark, d), _enc(spark, d).select("k", F.round("los", 6).alias("los"), "death"), "k")


@query(f"""
WITH {_E}, {_F} SELECT k, CASE WHEN s2 <= arrival + INTERVAL 26280 HOUR THEN 'POA-2' ELSE 'NPOA-2' END AS "POA_arrival", CASE WHEN s2 <= arrival + INTERVAL 240 HOUR THEN 'POA-2' ELSE 'NPOA-2' END AS "POA_inpatient"
FROM enc JOIN fi USING (k) WHERE s2 IS NOT NULL""")
def poa_by_reference(spark, d):
    e = _enc(spark, d).withColumn("inpatient", S.plus_hours("arrival", 192))
    return H.poa_by_level(_labels(spark, d)["sepsis2"], e, "k", 2, "earliest_sepsis2_instance", {"arrival": 26280, "inpatient": 48}).select("k", "POA_arrival", "POA_inpatient")


@query(f"""
WITH {_E}, {_F}, a AS (SELECT k, unnest([1, 2, 3]) AS n, unnest([s1, s2, s3]) AS s, arrival FROM enc JOIN fi USING (k)),
l AS (SELECT k, n, CASE WHEN s <= arrival + INTERVAL 26280 HOUR THEN 'POA' ELSE 'NPOA' END || '-' || n AS l FROM a WHERE s IS NOT NULL)
SELECT k, arg_max(l, (n, l)) AS "POA_arrival" FROM l GROUP BY 1""")
def highest_poa(spark, d):
    l = read(spark, d, "lineitem")
    at = l.select(F.col("l_orderkey").alias("k"), *[F.when(F.col("l_returnflag") == f, F.col("l_shipdate")).alias(s) for s, f in (("s1", "A"), ("s2", "N"), ("s3", "R"))])
    return H.highest_poa(at, _enc(spark, d), "k", {1: "s1", 2: "s2", 3: "s3"}, "arrival", 26280, "POA_arrival")


@query(f"""
WITH {_E}, {_F}, m AS (SELECT *, least(s1, s2, s3) AS first_time FROM enc JOIN fi USING (k)),
w AS (SELECT *, CASE WHEN s1 = first_time THEN 1 WHEN s2 = first_time THEN 2 ELSE 3 END AS first_level FROM m WHERE first_time IS NOT NULL)
SELECT k, first_time, first_level, round({_H.format('arrival', 'first_time')}, 6) AS hours_to_first, CASE WHEN first_time <= arrival + INTERVAL 26280 HOUR THEN 'POA' ELSE 'NPOA' END || '-' || first_level AS label FROM w""")
def first_level(spark, d):
    e = _enc(spark, d).join(_firsts(spark, d), "k")
    return H.first_level(e, "k", ["s1", "s2", "s3"], "arrival", 26280).withColumn("hours_to_first", F.round("hours_to_first", 6))


@query(f"WITH {_E} SELECT k, billing FROM enc WHERE cancer = 'N' AND hiv = 'N'")
def without_confounders(spark, d):
    return H.exclude_confounders(_enc(spark, d), ["cancer", "hiv"]).select("k", "billing")


@query(f"WITH {_E} SELECT CASE WHEN billing = 'POA-2' THEN 'Matched POA-2' ELSE 'Mismatched POA-2' END AS agreement_group, count(*) AS n FROM enc WHERE ours = 'POA-2' GROUP BY 1")
def matched_labels(spark, d):
    return H.matches(_enc(spark, d), "ours", "billing", "POA-2").groupBy("agreement_group").agg(F.count("*").alias("n"))


_SOURCE = f"{_E}, so AS (SELECT *, CASE WHEN ours = 'NPOA-1' AND billing = 'NPOA-1' THEN 'both' WHEN ours = 'NPOA-1' AND billing <> 'NPOA-1' THEN 'ours' WHEN billing = 'NPOA-1' AND ours <> 'NPOA-1' THEN 'theirs' END AS source FROM enc)"


@query(f"WITH {_SOURCE} SELECT source, count(*) AS n, round(avg(los), 6) AS mean, round(stddev_samp(los), 6) AS std, round(min(los), 6) AS min, round(max(los), 6) AS max, round(quantile_cont(los, 0.25), 6) AS p25, round(quantile_cont(los, 0.5), 6) AS p50, round(quantile_cont(los, 0.75), 6) AS p75 FROM so WHERE source IS NOT NULL GROUP BY 1")
def stay_by_agreement(spark, d):
    s = R.summary(H.discordance(_enc(spark, d), "ours", "billing", "NPOA-1"), ["source"], "los", (0.25, 0.5, 0.75))
    return s.select("source", "n", *rounded("mean", "std", "min", "max", "p25", "p50", "p75"))


@query(f"WITH {_SOURCE} SELECT source, death, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS row_share, round(count(*) / sum(count(*)) OVER (PARTITION BY death), 6) AS col_share, round(count(*) / sum(count(*)) OVER (), 6) AS all_share FROM so WHERE source IS NOT NULL GROUP BY 1, 2")
def deaths_by_agreement(spark, d):
    s = R.shares(H.discordance(_enc(spark, d), "ours", "billing", "NPOA-1"), "source", "death")
    return s.select("source", "death", "n", *rounded("row_share", "col_share", "all_share"))


@query(f"WITH {_E}, l AS (SELECT 'ours' AS source, ours AS c FROM enc UNION ALL SELECT 'billing', billing FROM enc) SELECT regexp_replace(c, '-[0-9]+', '') AS category, source, count(*) AS n FROM l GROUP BY 1, 2")
def label_counts(spark, d):
    return H.label_counts(_enc(spark, d), ["ours", "billing"], strip_suffix=True)


@query(f"""
WITH {_E}, l AS (SELECT 'ours' AS source, ours AS category FROM enc UNION ALL SELECT 'billing', billing FROM enc), n AS (SELECT category, source, count(*) AS n FROM l GROUP BY 1, 2),
g AS (SELECT c.category, s.source, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT category FROM l) c CROSS JOIN (SELECT DISTINCT source FROM l) s LEFT JOIN n USING (category, source))
SELECT category, source, n, round(n * 100.0 / sum(n) OVER (PARTITION BY source), 6) AS pct_of_source, round(n * 100.0 / sum(n) OVER (PARTITION BY category), 6) AS pct_of_category FROM g""")
def aligned_label_counts(spark, d):
    return H.aligned_counts(_enc(spark, d), ["ours", "billing"]).select("category", "source", "n", *rounded("pct_of_source", "pct_of_category"))


@query(f"WITH {_E}, l AS (SELECT k, los, 'ours' AS source, ours AS category FROM enc UNION ALL SELECT k, los, 'billing', billing FROM enc) SELECT k, round(los, 6) AS los, source, category FROM l")
def labels_long(spark, d):
    return H.long_labels(_enc(spark, d), ["k", "los"], ["ours", "billing"]).withColumn("los", F.round("los", 6))


@query(f"WITH {_E} SELECT ours, count_if(ours = billing) AS n_matches, count_if(ours <> billing) AS n_mismatches, count(*) AS total, round(count_if(ours = billing) / count(*), 6) AS match_share, round(count_if(ours <> billing) / count(*), 6) AS mismatch_share FROM enc GROUP BY 1")
def match_rates(spark, d):
    return H.match_rates(_enc(spark, d), "ours", "billing").select("ours", "n_matches", "n_mismatches", "total", *rounded("match_share", "mismatch_share"))


_CLASSES = ("POA", "NPOA", "UPOA")
_CELL = ", ".join(f"count_if(split_part(billing, '-', 1) = '{v}')::VARCHAR || ' (' || round(100.0 * count_if(split_part(billing, '-', 1) = '{v}') / count(*), 1)::VARCHAR || '%)' AS \"{v}\"" for v in _CLASSES)


@query(f"WITH {_E} SELECT coalesce(ours, 'Total') AS ours, {_CELL}, count(*)::VARCHAR AS \"Total\" FROM enc GROUP BY GROUPING SETS ((ours), ())")
def text_crosstab(spark, d):
    e = _enc(spark, d).withColumn("billing", S.category(F.col("billing")))
    return H.text_crosstab(e, "ours", "billing", _CLASSES)


_TOP = "t AS (SELECT origin FROM enc GROUP BY 1 ORDER BY count(*) DESC, origin LIMIT 3)"


@query(f"WITH {_E}, {_TOP}, g AS (SELECT CASE WHEN t.origin IS NULL THEN 'Other' ELSE enc.origin END AS factor, billing FROM enc LEFT JOIN t USING (origin)) SELECT factor, billing, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY factor) AS BIGINT) AS total, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY factor), 1) AS pct FROM g GROUP BY 1, 2")
def factor_distribution(spark, d):
    return H.factor_distribution(_enc(spark, d), "origin", "billing", 3)


@query(f"""
WITH {_E}, {_TOP}, p AS (SELECT CASE WHEN t.origin IS NULL THEN 'Other' ELSE enc.origin END AS factor, split_part(ours, '-', 1) AS a, split_part(billing, '-', 1) AS b FROM enc LEFT JOIN t USING (origin)),
g AS (SELECT factor, CASE WHEN b = 'UPOA' THEN 'UPOA, ours ' || a WHEN a = b THEN b || ' agrees' ELSE b || ' disagrees' END AS agreement FROM p)
SELECT factor, agreement, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY factor) AS BIGINT) AS total, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY factor), 1) AS pct FROM g GROUP BY 1, 2""")
def agreement_by_factor(spark, d):
    return H.agreement_by_factor(_enc(spark, d), "origin", "ours", "billing", 3)


_RATE = ", ".join(f"count_if({c} = '{v}') AS {n}_{v.lower()}, round(100.0 * count_if({c} = '{v}') / count(*), 1) AS {n}_{v.lower()}_pct" for n, c in (("ours", "a"), ("theirs", "b")) for v in ("POA", "NPOA"))


@query(f"""
WITH {_E}, o AS (SELECT patient, max((ours, billing, origin)) AS r FROM enc GROUP BY 1), u AS (SELECT patient, r[3] AS origin, split_part(r[1], '-', 1) AS a, split_part(r[2], '-', 1) AS b FROM o),
t AS (SELECT origin FROM u GROUP BY 1 ORDER BY count(*) DESC, origin LIMIT 3), g AS (SELECT CASE WHEN t.origin IS NULL THEN 'Other' ELSE u.origin END AS factor, a, b FROM u LEFT JOIN t USING (origin))
SELECT factor, count(*) AS n, {_RATE} FROM g GROUP BY 1""")
def poa_rates_by_factor(spark, d):
    return H.poa_rates(_enc(spark, d), "patient", "origin", "ours", "billing", 3)


_CELLS = ", ".join(f"round(100.0 * count_if(starts_with({c}, 'POA')) / count(*), 1)::VARCHAR || '% (n=' || count_if(starts_with({c}, 'POA'))::VARCHAR || ')' AS {c}" for c in ("ours", "billing"))


@query(f"WITH {_E}, {_TOP}, g AS (SELECT CASE WHEN t.origin IS NULL THEN 'Other' ELSE enc.origin END AS factor, ours, billing FROM enc LEFT JOIN t USING (origin)) SELECT factor, count(*) AS n, {_CELLS} FROM g GROUP BY 1")
def poa_rate_cells(spark, d):
    return H.poa_rate_cells(_enc(spark, d), "origin", ["ours", "billing"], 3)


_ORDER = [f"{p}-{n}" for p in ("UPOA", "NPOA", "POA") for n in (1, 2, 3, 4)]


@query(f"""
WITH {_E}, {_F}, h AS (SELECT billing, {_H.format('arrival', 's1')} AS h FROM enc JOIN fi USING (k)), n AS (SELECT billing, count_if(h < 100) AS early, count_if(h >= 100) AS late FROM h WHERE h IS NOT NULL GROUP BY 1),
c AS (SELECT unnest([{', '.join(f"'{x}'" for x in _ORDER)}]) AS billing, unnest(range({len(_ORDER)}))::INTEGER AS place)
SELECT billing, place, coalesce(early, 0) AS early, coalesce(late, 0) AS late, coalesce(early + late, 0) AS total, round(coalesce(early / (early + late), 0), 6) AS early_share, round(coalesce(late / (early + late), 0), 6) AS late_share FROM c LEFT JOIN n USING (billing)""")
def early_and_late(spark, d):
    e = _enc(spark, d).join(_firsts(spark, d), "k").withColumn("h", S.hours_between("arrival", "s1"))
    return H.early_late(e, "billing", "h", 100, _ORDER).select("billing", "place", "early", "late", "total", *rounded("early_share", "late_share"))


@query(f"""
WITH {_E}, n AS (SELECT origin, split_part(billing, '-', 1) AS b, count(*) AS n FROM enc GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 12)
SELECT origin, {', '.join(f"CAST(coalesce(sum(n) FILTER (WHERE b = '{v}'), 0) AS BIGINT) AS {v}" for v in _CLASSES)}, CAST(sum(n) AS BIGINT) AS total, CASE WHEN origin IS NULL THEN 99 WHEN origin = '*Unspecified' THEN 98 WHEN origin ILIKE '%ICU%' THEN 0 ELSE 2 END AS rank FROM n GROUP BY 1""")
def labels_by_department(spark, d):
    return H.by_department(_enc(spark, d).withColumn("billing", S.category(F.col("billing"))), "origin", "billing", _CLASSES, 12)


@query(f"WITH {_E}, m AS (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_returnflag = 'R') AS found FROM enc) SELECT billing, count(*) AS total, count_if(NOT found) AS missed, round(count_if(NOT found) / count(*), 6) AS share FROM m GROUP BY 1")
def missed_by_rule(spark, d):
    return H.missed_share(_enc(spark, d), _labels(spark, d)["sepsis3"], "k", "billing").withColumn("share", F.round("share", 6))


@query(f"""
WITH {_E}, {_F}, b AS (SELECT CASE WHEN age < 18 THEN 'Pediatric' WHEN age < 65 THEN 'Adult' ELSE 'Elderly' END AS age_group, s1 > arrival + INTERVAL 48 HOUR AS acquired, death FROM enc JOIN fi USING (k))
SELECT age_group, acquired, count(*) AS n, CAST(sum(death) AS BIGINT) AS deaths, round(avg(death) * 100, 1) AS death_pct FROM b GROUP BY 1, 2""")
def deaths_by_age(spark, d):
    e = _enc(spark, d).join(_firsts(spark, d), "k").withColumns({"age_group": H.age_band(F.col("age")), "acquired": H.hospital_acquired("s1", "arrival")})
    return H.death_rates(e, ["age_group", "acquired"], "death")


@query(f"""
WITH {_E}, {_F}, c AS (SELECT CASE WHEN h >= 480 THEN 'delayed' WHEN h <= 72 THEN 'timely' ELSE 'average' END AS cohort, age, ed FROM (SELECT *, {_H.format('s1', 's2')} AS h FROM enc JOIN fi USING (k) WHERE s1 IS NOT NULL AND s2 IS NOT NULL))
SELECT cohort, count(*) AS n, round(avg(age), 6) AS mean_age, round(quantile_cont(age, 0.5), 6) AS median_age, round(avg(ed), 6) AS ed_share FROM c GROUP BY 1""")
def delay_cohorts(spark, d):
    e = _enc(spark, d).join(_firsts(spark, d), "k").where("s1 is not null and s2 is not null").withColumn("cohort", H.delay_cohort(S.hours_between("s1", "s2"), 480, 72))
    n = e.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("age"), 6).alias("mean_age"), F.round(F.avg("ed"), 6).alias("ed_share"))
    return R.join_groups(n, K.quantiles(e, ["cohort"], "age", {"median_age": 0.5}), ["cohort"]).withColumn("median_age", F.round("median_age", 6))


@query("""
WITH o AS (SELECT user_id, min(ts) AS onset FROM events WHERE event_type = 'error' GROUP BY 1), f AS (SELECT user_id, min(ts) AS fever FROM events WHERE event_type = 'click' AND value > 90 GROUP BY 1),
p AS (SELECT CASE WHEN fever IS NULL THEN 'no fever' WHEN fever < onset THEN 'fever first' ELSE 'failure first' END AS pattern FROM o LEFT JOIN f USING (user_id))
SELECT pattern, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY 1""")
def fever_before_failure(spark, d):
    o = events(spark, d, "error").groupBy("user_id").agg(F.min("ts").alias("onset"))
    f = events(spark, d, "click").where("value > 90").groupBy("user_id").agg(F.min("ts").alias("fever"))
    n = o.join(f, "user_id", "left").groupBy(H.fever_pattern(F.col("fever"), F.col("onset")).alias("pattern")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row per pattern


_EP = "ep AS (SELECT e.event_id, e.user_id, e.ts, e.value, floor(e.value / 20)::BIGINT AS score, a.ts AS episode_start FROM events e ASOF JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error') a ON e.user_id = a.user_id AND e.ts >= a.ts)"


def _episodes(spark, d):
    e = events(spark, d).withColumn("score", F.floor(F.col("value") / 20))
    return H.anchor_episodes(e, events(spark, d, "error").withColumnRenamed("ts", "a_ts"), "user_id", "ts", "a_ts")


@query(f"WITH {_EP} SELECT event_id, episode_start, user_id || '_' || strftime(episode_start, '%Y-%m-%d %H:%M:%S') AS episode FROM ep")
def anchored_episodes(spark, d):
    return _episodes(spark, d).select("event_id", "episode_start", F.concat_ws("_", "user_id", F.date_format("episode_start", "yyyy-MM-dd HH:mm:ss")).alias("episode"))


@query(f"""
WITH {_EP}, p AS (SELECT user_id, episode_start, count(*) AS n, arg_min(score, (ts, score)) AS first, max(score) AS peak FROM ep GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT user_id) FROM ep) AS n_keys, (SELECT count(*) FROM ep) AS n_events, count(*) AS n_episodes, count_if(peak >= 1) AS reach_1, count_if(peak >= 2) AS reach_2, quantile_cont(n, 0.25) AS p25_events, quantile_cont(n, 0.5) AS median_events, quantile_cont(n, 0.75) AS p75_events,
 quantile_cont(first, 0.5) AS median_first, quantile_cont(peak, 0.5) AS median_peak FROM p""")
def cohort_summary(spark, d):
    return H.cohort_summary(_episodes(spark, d), "user_id", "episode_id", "ts", "score")


@query(f"""
WITH {_EP}, p AS (SELECT user_id, episode_start, arg_min(score, (ts, score)) AS first, max(score) AS peak FROM ep GROUP BY 1, 2)
SELECT 'events' AS kind, score, count(*) AS n FROM ep GROUP BY 2 UNION ALL SELECT 'peak', peak, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'first', first, count(*) FROM p GROUP BY 2""")
def score_distributions(spark, d):
    return H.score_distributions(_episodes(spark, d), "episode_id", "ts", "score")


@query(f"""
WITH {_EP}, f AS (SELECT *, CASE WHEN value > 40 THEN 1 ELSE 0 END AS big, CASE WHEN value < 5 THEN 1 ELSE 0 END AS small FROM ep), g AS (SELECT user_id, episode_start, arg_min(big, (ts, big, small)) AS b1, arg_min(small, (ts, big, small)) AS s1, max(big) AS b2, max(small) AS s2 FROM f GROUP BY 1, 2)
SELECT 'big' AS flag, round((SELECT avg(big) FROM f), 6) AS events, round(avg(b1), 6) AS first, round(avg(b2), 6) AS peak FROM g UNION ALL SELECT 'small', round((SELECT avg(small) FROM f), 6), round(avg(s1), 6), round(avg(s2), 6) FROM g""")
def flag_prevalence(spark, d):
    e = _episodes(spark, d).withColumns({"big": (F.col("value") > 40).cast("int"), "small": (F.col("value") < 5).cast("int")})
    return H.flag_prevalence(e, "episode_id", "ts", ["big", "small"]).select("flag", *rounded("events", "first", "peak"))


_SP = """
sx AS (SELECT user_id, ts, CASE WHEN value >= 30 THEN 'high' ELSE 'low' END AS state FROM events),
sy AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS c FROM sx WINDOW w AS (PARTITION BY user_id ORDER BY ts, state)),
sz AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, state ROWS UNBOUNDED PRECEDING) AS spell FROM sy),
sp AS (SELECT user_id, spell, any_value(state) AS state, min(ts) AS s, max(ts) AS e, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS hours FROM sz GROUP BY 1, 2)"""


def _spells(spark, d):
    e = events(spark, d).select("user_id", "ts", F.when(F.col("value") >= 30, "high").otherwise("low").alias("state"))
    return e, T.spells(e, ["user_id"], "ts", "state")


@query(f"""
WITH {_SP}, r AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY spell) AS nx FROM sp), h AS (SELECT state, nx IS NULL AS cens, (epoch_us(coalesce(nx, e)) - epoch_us(s)) / 3600000000.0 AS h FROM r)
SELECT state, count_if(cens) AS n_censored, count_if(NOT cens AND h <= 72) AS n, round(quantile_cont(h, 0.5) FILTER (WHERE NOT cens AND h <= 72), 6) AS median, round(quantile_cont(h, 0.25) FILTER (WHERE NOT cens AND h <= 72), 6) AS p25, round(quantile_cont(h, 0.75) FILTER (WHERE NOT cens AND h <= 72), 6) AS p75, round(quantile_cont(h, 0.9) FILTER (WHERE NOT cens AND h <= 72), 6) AS p90 FROM h GROUP BY 1""")
def capped_durations(spark, d):
    r = T.run_durations(_spells(spark, d)[0], ["user_id"], "ts", "state")
    return H.durations_by_state(r, "state", "hours", 72, "censored").select("state", "n_censored", "n", *rounded("median", "p25", "p75", "p90"))


_AROUND = ", ".join(f"count_if(state = '{s}') AS n_{s}, round(coalesce(sum(hours) FILTER (WHERE state = '{s}'), 0), 6) AS total_{s}, round(max(hours) FILTER (WHERE state = '{s}'), 6) AS longest_{s}, round(min(hours) FILTER (WHERE state = '{s}'), 6) AS shortest_{s}" for s in ("high", "low"))


@query(f"WITH {_SP} SELECT a.user_id, a.ts AS anchor, {_AROUND} FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error') a JOIN sp ON sp.user_id = a.user_id AND sp.s BETWEEN a.ts - INTERVAL 72 HOUR AND a.ts + INTERVAL 72 HOUR WHERE sp.hours > 0 GROUP BY 1, 2")
def spells_around_infection(spark, d):
    a = events(spark, d, "error").select("user_id", F.col("ts").alias("anchor"))
    out = H.spells_around(_spells(spark, d)[1], a, "user_id", "state", ["high", "low"], "anchor")
    return out.select("user_id", "anchor", "n_high", "n_low", *rounded(*[f"{k}_{s}" for s in ("high", "low") for k in ("total", "longest", "shortest")]))


_MARK = "mk AS (SELECT user_id, CASE WHEN value < 25 THEN 'x' ELSE 'y' END AS drug, ts, event_type FROM events WHERE event_type IN ('purchase', 'signup'))"


def _marks(spark, d):
    return events(spark, d, "purchase", "signup").select("user_id", F.when(F.col("value") < 25, "x").otherwise("y").alias("drug"), "ts", "event_type")


@query(f"""
WITH {_MARK}, n AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, drug ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS course FROM mk),
g AS (SELECT user_id, drug, course, min(ts) FILTER (WHERE event_type = 'purchase') AS first_time, min(ts) FILTER (WHERE event_type = 'signup') AS last_time FROM n GROUP BY 1, 2, 3)
SELECT *, round({_H.format('first_time', 'last_time')}, 6) AS hours FROM g WHERE first_time IS NOT NULL AND last_time IS NOT NULL""")
def treatment_courses(spark, d):
    return H.courses(_marks(spark, d), ["user_id", "drug"], "ts", F.col("event_type") == "purchase", F.col("event_type") == "signup").withColumn("hours", F.round("hours", 6))


@query(f"""
WITH {_MARK} SELECT a.user_id, a.drug, a.ts, b.ts AS r_ts, round({_H.format('a.ts', 'b.ts')}, 6) AS hours FROM (SELECT * FROM mk WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM mk WHERE event_type = 'signup') b ON a.user_id = b.user_id AND a.drug = b.drug AND a.ts <= b.ts""")
def courses_by_asof(spark, d):
    m = _marks(spark, d)
    out = T.asof_join(m.where("event_type = 'purchase'").drop("event_type"), m.where("event_type = 'signup'"), ["user_id", "drug"], "ts", "ts", [], forward=True)
    return out.withColumn("hours", F.round(S.hours_between("ts", "r_ts"), 6))


@query(f"""
WITH {_SP}, g AS (SELECT *, round((epoch_us(lead(s) OVER w) - epoch_us(e)) / 3600000000.0, 6) AS gap_hours, CASE WHEN hours >= 6 THEN state END AS kept FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY s, e, state))
SELECT user_id, s AS "start", state, round(hours, 6) AS hours, gap_hours, coalesce(last_value(kept IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, e, state ROWS UNBOUNDED PRECEDING), first_value(kept IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, e, state ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS kept_state FROM g""")
def short_states_suppressed(spark, d):
    s = _spells(spark, d)[1].drop("hours")
    return H.state_gaps(s, ["user_id"], "start", "end", "state", 6).select("user_id", "start", "state", *rounded("hours", "gap_hours"), "kept_state")


_IV = "iv AS (SELECT event_id, user_id, event_type, ts AS s, ts + CAST(floor(value) + 1 AS INTEGER) * INTERVAL 1 HOUR AS e FROM events)"


def _intervals(spark, d, kind, names):
    e = events(spark, d, kind).withColumn("_e", F.col("ts") + F.make_dt_interval(F.lit(0), (F.floor("value") + 1).cast("int")))
    return e.select("user_id", *[F.col(c).alias(n) for c, n in zip(("event_id", "ts", "_e"), names, strict=True)])


@query(f"""
WITH {_IV} SELECT a.event_id AS a_id, b.event_id AS b_id, CASE WHEN a.s <= b.s AND a.e >= b.e THEN 'a_contains_b' WHEN b.s <= a.s AND b.e >= a.e THEN 'b_contains_a' WHEN a.s < b.s THEN 'a_first_b_last' ELSE 'b_first_a_last' END AS pattern
FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND a.s < b.e AND b.s < a.e AND b.s BETWEEN a.s - INTERVAL 72 HOUR AND a.s + INTERVAL 72 HOUR""")
def overlap_patterns(spark, d):
    a, b = _intervals(spark, d, "error", ("a_id", "a_s", "a_e")), _intervals(spark, d, "purchase", ("b_id", "b_s", "b_e"))
    near = T.band_join(a, b, ["user_id"], "a_s", "b_s", 72, 72)
    return near.withColumn("pattern", H.overlap_pattern("a_s", "a_e", "b_s", "b_e")).where("pattern is not null").select("a_id", "b_id", "pattern")


_SEG = """
gs AS (SELECT user_id, ts AS s, ts + INTERVAL 24 HOUR AS e, event_type FROM events WHERE event_type IN ('error', 'purchase')),
gb AS (SELECT DISTINCT user_id, t FROM (SELECT user_id, s AS t FROM gs UNION ALL SELECT user_id, e FROM gs)), gg AS (SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e FROM gb),
gh AS (SELECT gg.user_id, gg.s, gg.e, max(CASE WHEN event_type = 'error' THEN gs.s END) AS sa, max(CASE WHEN event_type = 'purchase' THEN gs.s END) AS sb FROM gg LEFT JOIN gs ON gs.user_id = gg.user_id AND gs.s <= gg.s WHERE gg.e IS NOT NULL GROUP BY 1, 2, 3),
gt AS (SELECT *, 'a_state=' || CASE WHEN s < sa + INTERVAL 24 HOUR THEN 'error' ELSE 'none' END || '|b_state=' || CASE WHEN s < sb + INTERVAL 24 HOUR THEN 'purchase' ELSE 'none' END AS state FROM gh),
gc AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY user_id ORDER BY s) IS DISTINCT FROM state THEN 1 ELSE 0 END AS c FROM gt),
gn AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS episode FROM gc),
ge AS (SELECT user_id, episode, any_value(state) AS state, sum(epoch_us(e) - epoch_us(s)) / 3600000000.0 AS hours FROM gn GROUP BY 1, 2)"""


def _combined(spark, d):
    iv = lambda k: events(spark, d, k).select("user_id", F.col("ts").alias("s"), S.plus_hours("ts", 24).alias("e"), "event_type")
    seg = T.segment(iv("error"), iv("purchase"), ["user_id"], "s", "e", "event_type")
    return H.combined_states(seg, ["user_id"], "seg_start", "seg_end", "a_state", "b_state")


@query(f"WITH {_SEG} SELECT state, count(*) AS n, round(sum(hours), 4) AS total_hours, round(avg(hours), 4) AS mean_hours, round(quantile_cont(hours, 0.5), 4) AS median_hours FROM ge GROUP BY 1")
def combined_state_time(spark, d):
    return H.state_time(_combined(spark, d)).select("state", "n", *rounded("total_hours", "mean_hours", "median_hours", n=4))


@query(f"WITH {_SEG}, t AS (SELECT *, lead(state) OVER (PARTITION BY user_id ORDER BY episode) AS next_state FROM ge) SELECT state, next_state, count(*) AS n, round(sum(hours), 4) AS total_hours, round(avg(hours), 4) AS mean_hours FROM t WHERE next_state IS NOT NULL GROUP BY 1, 2")
def combined_state_transitions(spark, d):
    return H.state_transitions(_combined(spark, d), ["user_id"]).select("state", "next_state", "n", *rounded("total_hours", "mean_hours", n=4))


_DUE = {"Big": "value > 40", "Late": "hour(ts) >= 12", "Even": "event_id % 2 = 0"}


@query("SELECT event_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _DUE.items()) + ") AS due_to FROM events")
def score_due_to(spark, d):
    e = events(spark, d).select("event_id", *[F.expr(f"CAST({c} AS INT)").alias(n) for n, c in _DUE.items()])
    return e.select("event_id", H.due_to([(n, n) for n in _DUE]).alias("due_to"))


@query("""
WITH a AS (SELECT user_id, min(ts) AS instant FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT a.user_id, a.instant, min(e.ts) FILTER (WHERE e.event_type = 'view' AND e.value > 60) AS organ_time, min(e.ts) FILTER (WHERE e.event_type = 'click' AND e.value > 90) AS shock_time
FROM a LEFT JOIN events e ON e.user_id = a.user_id AND e.ts BETWEEN a.instant AND a.instant + INTERVAL 336 HOUR GROUP BY 1, 2""")
def escalation(spark, d):
    a = events(spark, d, "error").groupBy("user_id").agg(F.min("ts").alias("instant"))
    on = lambda k, v: (events(spark, d, k).withColumn("flag", (F.col("value") > v).cast("int")), "flag")
    return H.escalation(a, "user_id", "instant", {"organ": on("view", 60), "shock": on("click", 90)}, "ts")


@query("""
WITH p AS (SELECT i.user_id, i.ts AS infect_dt, o.ts AS organ_time, s.ts AS shock_time FROM events i JOIN events o ON o.user_id = i.user_id AND o.ts BETWEEN i.ts - INTERVAL 48 HOUR AND i.ts + INTERVAL 48 HOUR JOIN events s ON s.user_id = i.user_id AND s.ts BETWEEN o.ts - INTERVAL 6 HOUR AND o.ts + INTERVAL 24 HOUR
 WHERE i.event_type = 'error' AND o.event_type = 'view' AND s.event_type = 'click'), m AS (SELECT user_id, min((shock_time, organ_time, infect_dt)) AS r FROM p GROUP BY 1)
SELECT user_id, r[1] AS shock_time, r[2] AS organ_time, r[3] AS infect_dt, least(r[1], r[2], r[3]) AS earliest FROM m""")
def chained_shock(spark, d):
    i = events(spark, d, "error").select("user_id", F.col("ts").alias("infect_dt"))
    return H.chained_shock(i, events(spark, d, "view"), events(spark, d, "click"), "user_id", "infect_dt", "ts")


_CRIT = {"pulse": ("click", 6), "temp": ("view", 8), "wbc": ("purchase", 24)}


@query(f"""
WITH c AS (SELECT t.user_id, t.ts, {', '.join(f"CASE WHEN count_if(e.event_type = '{g}' AND e.ts >= t.ts - INTERVAL {h} HOUR) > 0 THEN 1 ELSE 0 END AS {n}_flag" for n, (g, h) in _CRIT.items())} FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error') t
 LEFT JOIN (SELECT * FROM events WHERE value > 20) e ON e.user_id = t.user_id AND e.ts <= t.ts AND e.ts >= t.ts - INTERVAL 24 HOUR GROUP BY 1, 2)
SELECT user_id, ts AS at, pulse_flag, temp_flag, wbc_flag, pulse_flag + temp_flag + wbc_flag AS criteria, CASE WHEN pulse_flag + temp_flag + wbc_flag >= 2 THEN 1 ELSE 0 END AS positive FROM c""")
def criteria_at_suspicion(spark, d):
    a = events(spark, d, "error").select("user_id", F.col("ts").alias("at"))
    return H.criteria_at(a, events(spark, d).where("value > 20"), "user_id", "at", "ts", "event_type", "value", _CRIT)


@query("SELECT event_id, ts, value FROM events WHERE user_id = 3 AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 96 HOUR AND TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 120 HOUR")
def drill_down(spark, d):
    return H.drill_down(events(spark, d), "user_id", 3, "ts", "2024-01-10 00:00:00", 96, 120).select("event_id", "ts", "value")


@query("""
WITH f AS (SELECT t.user_id, t.ts, max(e.value) AS top FROM events t JOIN events e ON e.user_id = t.user_id AND e.event_type = 'click' AND e.ts <= t.ts AND e.ts >= t.ts - INTERVAL 24 HOUR WHERE t.event_type = 'click' GROUP BY 1, 2)
SELECT c.user_id, c.ts, c.value, f.top FROM events c JOIN f USING (user_id, ts) WHERE c.event_type = 'click' AND c.value <> f.top""")
def conflicting_values(spark, d):
    c = events(spark, d, "click")
    return H.conflicts(c, T.lookback(c, c, "user_id", "ts", "event_type", "value", {"top": ("click", "max", 24)}), ["user_id", "ts"], "value", "top")


@query("SELECT event_type, count_if((event_type = 'click' AND (value < 5 OR value > 60)) OR (event_type = 'view' AND value > 80)) AS nulled, count(value) AS \"values\" FROM events GROUP BY 1")
def values_nulled(spark, d):
    e = events(spark, d)
    return H.value_changes(e, e.withColumn("value", O.bounded("event_type", "value", {"click": (5, 60), "view": (0, 80)})), "event_id", "event_type", "value")


@query("""
WITH a AS (SELECT user_id, count(*) AS n_error FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1), b AS (SELECT user_id, count(*) AS n_view FROM events WHERE event_type = 'view' AND value > 60 GROUP BY 1), c AS (SELECT user_id, max(ts) AS last_click FROM events WHERE event_type = 'click' AND value > 60 GROUP BY 1)
SELECT user_id, coalesce(n_error, 0) AS n_error, coalesce(n_view, 0) AS n_view, last_click FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id)""")
def outer_joined(spark, d):
    n = lambda k: events(spark, d, k).where("value > 60").groupBy("user_id")
    frames = [n("error").agg(F.count("*").alias("n_error")), n("view").agg(F.count("*").alias("n_view")), n("click").agg(F.max("ts").alias("last_click"))]
    return H.outer_all(frames, ["user_id"], {"n_error": 0, "n_view": 0})


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) + (CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) + (CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS total FROM lineitem")
def flags_by_suffix(spark, d):
    f = read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity > 25 AS INT) AS big_Flag", "CAST(l_discount > 0.05 AS INT) AS cheap_Flag", "CAST(l_tax > 0.04 AS INT) AS taxed_Flag")
    return f.select("l_orderkey", "l_linenumber", sum((F.col(c) for c in H.columns_like(f, suffix="_Flag")), F.lit(0)).alias("total"))


#: Events as clinical measurements.
_CL = {
    "k": "user_id", "ts": "ts", "nam": "event_type", "type": "CASE WHEN event_type = 'purchase' THEN 'IV Antibiotics - First' ELSE 'Flowsheet' END",
    "grp": "CASE event_type WHEN 'click' THEN CASE event_id % 6 WHEN 0 THEN 'Temperature' WHEN 1 THEN 'Pulse' WHEN 2 THEN 'Respirations' WHEN 3 THEN 'WBC' WHEN 4 THEN 'Lactate' ELSE 'Creatinine' END WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 'Platelets' WHEN 1 THEN 'INR' WHEN 2 THEN 'Glasgow Coma Score' ELSE 'Norepinephrine' END WHEN 'error' THEN 'Blood Culture Order' WHEN 'purchase' THEN 'Antibiotics' ELSE CASE event_id % 3 WHEN 0 THEN 'Code Sepsis Page' WHEN 1 THEN 'Suspected Infection' ELSE 'Blood Pressure' END END",
    "txt": "CASE WHEN event_type = 'signup' AND event_id % 3 = 1 THEN CASE WHEN value > 30 THEN 'Yes' ELSE 'No' END WHEN event_type = 'signup' AND event_id % 3 = 2 THEN CASE WHEN value < 4 THEN 'error' ELSE CAST(floor(60 + value) AS STRING) || '/' || CAST(floor(40 + value / 2) AS STRING) END END",
    "num": "CASE event_type WHEN 'click' THEN CASE event_id % 6 WHEN 0 THEN 95 + value / 10 WHEN 1 THEN 60 + value / 2 WHEN 2 THEN 12 + value / 5 WHEN 3 THEN value / 4 ELSE value / 25 END WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN value * 3 WHEN 1 THEN value / 40 WHEN 2 THEN 15 - floor(value / 40) ELSE floor(value / 80) END END",
}
_CC = C.Columns(key="k", ts="ts", kind="type", group="grp", name="nam", number="num", text="txt")
_CLS = "cl AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in _CL.items()) + " FROM events)"


def _clinical(spark, d):
    return read(spark, d, "events").selectExpr(*[f"{x} AS {n}" for n, x in _CL.items()])


@query(f"""
WITH {_CLS} SELECT DISTINCT k, ts, c AS event_class FROM (SELECT k, ts, unnest([CASE WHEN grp IN ('Code Sepsis Page', 'Blood Culture Order', 'Lactate') OR (grp = 'Suspected Infection' AND txt = 'Yes') THEN 'suspected_infection' END,
 CASE WHEN grp IN ('WBC', 'Temperature', 'Pulse', 'Respirations') THEN 'sirs_events' END, CASE WHEN grp IN ('Creatinine', 'Platelets', 'Lactate', 'INR') THEN 'organ_dysf' END, CASE WHEN grp IN ('Lactate', 'Norepinephrine') THEN 'septic_shock' END]) AS c FROM cl) WHERE c IS NOT NULL""")
def event_timeline(spark, d):
    return H.timeline(_clinical(spark, d), "k", "ts", "grp", "type", "txt")


#: Names of events with the classes that each belongs to: one for every classifier, and near misses that it excludes.
_NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Order Result__BLOOD CULTURE: STAPH detected__Labs", ("culture_positive",)), ("Order Result__Blood culture: staph, probable CONTAMINATION__Labs", ()), ("Order Result__Blood culture: no growth__Labs", ()),
    ("Procedure Order__Blood Culture, Routine__Orders", ("culture_order",)), ("Order__Blood Culture, Routine__Orders", ()),
    ("Meds__CEFEPIME 2 g IV push__Antibiotics", ("antibiotic_iv",)), ("Meds__Vancomycin lock solution IV__Antibiotics", ()), ("Meds__Amoxicillin 500 mg tablet__Antibiotics", ()), ("Meds__Ceftriaxone IV__Other", ()),
    ("Procedure__INCISION of abscess__Surgery", ("incision", "sepsis_after_all")), ("Procedure__Debridement of wound__Surgery", ("incision",)), ("Note__incision is clean__Nursing", ()),
    ("Procedure__Drain placement__Radiology", ("drain",)), ("Flowsheet__Drain output__Nursing", ()),
    ("Meds__NOREPINEPHRINE drip__Pressors", ("vasopressor",)), ("Meds__phenylephrine push dose__Pressors", ()), ("Meds__Epinephrine 1 mg syringe__Pressors", ()), ("Meds__epinephrine 11 mg in 250 mL__Pressors", ("vasopressor",)),
    ("Diagnosis__Candida glabrata fungemia__ICD", ("fungal",)), ("Diagnosis__Candidate for aspergillus vaccine__ICD", ("noise",)), ("Diagnosis__Pneumocystis prophylaxis__ICD", ("noise",)),
    ("Diagnosis__Acute pulmonary embolism__ICD", ("mimic",)), ("Diagnosis__Metastatic neoplasm of lung, history of__ICD", ("mimic", "noise")),
    ("Diagnosis__Elevated PSA__ICD", ("noise",)), ("Diagnosis__Mother with hx of asthma__ICD", ("noise",)), ("Diagnosis__Hxyz syndrome__ICD", ()),
    ("Diagnosis__Septic arthritis__ICD", ("sepsis_after_all",)), ("Diagnosis__Infection of dialysis CATHETER__ICD", ("mimic", "sepsis_after_all")), ("Diagnosis__Dialysis dependence__ICD", ("mimic",)), ("Diagnosis__Graft failure with infection__ICD", ("sepsis_after_all",)),
)
_NAME = "CASE event_id % {n} {cases} END".format(n=len(_NAMES) + 1, cases=" ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(_NAMES)))


@query("SELECT event_id, " + ", ".join(f"CASE WHEN event_id % {len(_NAMES) + 1} IN ({', '.join(str(i) for i, (_, k) in enumerate(_NAMES) if c in k)}) THEN 1 ELSE 0 END AS {c}" for c in H.CLASSIFIERS) + " FROM events")
def classified_names(spark, d):
    e = events(spark, d).select("event_id", F.expr(_NAME).alias("name"))
    return e.select("event_id", *[c.alias(n) for n, c in H.classify(F.col("name")).items()])


@query("SELECT o_orderkey, CAST(max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS BIGINT) AS top_of_instant, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS so_far, round(max(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS top_of_key FROM orders")
def running_and_broadcast(spark, d):
    o = N.running_sum(read(spark, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderdate", "o_orderkey"], F.col("o_totalprice"), "so_far")
    o = R.with_group(o, ["o_custkey", "o_orderdate"], {"top_of_instant": F.max("o_orderkey")})
    o = R.with_group(o, ["o_custkey"], {"top_of_key": F.max("o_totalprice")})
    return o.select("o_orderkey", "top_of_instant", *rounded("so_far", "top_of_key", n=2))


@query("SELECT event_id, " + ", ".join(f"lag(value, {i}) OVER w AS prev_{i}, lead(value, {i}) OVER w AS next_{i}" for i in range(10)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY value > 150")
def rows_around_outliers(spark, d):
    return O.neighbours(events(spark, d), ["user_id"], "ts", "value", 10, tie=["event_id"]).where("value > 150").select("event_id", *[f"{p}_{i}" for i in range(10) for p in ("prev", "next")])


@query("SELECT a.event_id, count(*) AS n, round(max(b.value), 6) AS top FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'click' AND b.ts <= a.ts AND a.ts - b.ts <= INTERVAL 8 HOUR GROUP BY 1")
def recent_pairs(spark, d):
    c = events(spark, d, "click")
    pairs = T.band_join(c.select("user_id", "event_id", "ts"), c.select("user_id", F.col("ts").alias("r_ts"), F.col("value").alias("r_value")), ["user_id"], "ts", "r_ts", 8, 0)
    return pairs.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.max("r_value"), 6).alias("top"))


@query("SELECT DISTINCT b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.value > 150 AND b.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts + INTERVAL 12 HOUR")
def near_flagged_rows(spark, d):
    e = events(spark, d)
    hot = e.where("value > 150").select("user_id", "event_type", F.col("ts").alias("f_ts"))
    return T.band_join(hot, e.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "f_ts", "ts", 12, 12).select("event_id").distinct()


@query("""
WITH p AS (SELECT * FROM (VALUES ('click', 5.0, 60.0), ('view', 0.0, 80.0), ('error', 1.0, 100.0)) t(event_type, low, high))
SELECT event_id, value < low OR value > high AS outside, CASE WHEN value BETWEEN low AND high THEN value END AS inside FROM events JOIN p USING (event_type)""")
def bounds_by_table(spark, d):
    p = spark.createDataFrame([("click", 5.0, 60.0), ("view", 0.0, 80.0), ("error", 1.0, 100.0)], "event_type string, low double, high double")
    return O.against_bounds(events(spark, d), p, "event_type", "value", "low", "high").select("event_id", "outside", F.when(~F.col("outside"), F.col("value")).alias("inside"))


@query("""
WITH t AS (SELECT DISTINCT user_id AS k, ts FROM events), v AS (SELECT user_id AS k, ts AS st, CASE event_type WHEN 'click' THEN 'Vent on Documentation' ELSE 'Vent off Documentation' END AS s FROM events WHERE event_type IN ('click', 'view')), o AS (SELECT user_id AS k, ts AS st FROM events WHERE event_type = 'signup')
SELECT t.k, t.ts, v.st AS status_time, coalesce(v.s, 'Vent off Documentation') AS status FROM t ASOF LEFT JOIN v ON t.k = v.k AND t.ts >= v.st UNION SELECT t.k, t.ts, o.st, 'O2 Delivery High-Flow' FROM t ASOF JOIN o ON t.k = o.k AND t.ts >= o.st""")
def latest_vent_status(spark, d):
    e = events(spark, d).withColumn("g", F.expr("CASE event_type WHEN 'click' THEN 'Vent on Documentation' WHEN 'view' THEN 'Vent off Documentation' WHEN 'signup' THEN 'O2 Delivery High-Flow' ELSE event_type END"))
    return C.latest_status(e, e, C.Columns(key="user_id", ts="ts", group="g"), "Vent on Documentation", "Vent off Documentation", "O2 Delivery High-Flow").withColumnRenamed("user_id", "k")


@query("SELECT b.user_id, min(least(a.ts, b.ts)) AS infect_time FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND a.ts BETWEEN b.ts - INTERVAL 24 HOUR AND b.ts + INTERVAL 72 HOUR GROUP BY 1")
def infection_by_band(spark, d):
    a, b = events(spark, d, "purchase").select("user_id", F.col("ts").alias("a_t")), events(spark, d, "error").select("user_id", F.col("ts").alias("b_t"))
    return C.infections_by_band(a, b, "user_id", "a_t", "b_t", 24, 72)


_INF = f"""{_CLS}, cu AS (SELECT k, ts FROM cl WHERE grp = 'Blood Culture Order'), ab AS (SELECT k, ts FROM cl WHERE type = 'IV Antibiotics - First'),
ap AS (SELECT ab.k, ab.ts AS iv, cu.ts AS c FROM ab ASOF JOIN cu ON ab.k = cu.k AND ab.ts <= cu.ts WHERE cu.ts - ab.ts <= INTERVAL 24 HOUR UNION SELECT ab.k, ab.ts, cu.ts FROM ab ASOF JOIN cu ON ab.k = cu.k AND ab.ts >= cu.ts WHERE ab.ts - cu.ts <= INTERVAL 72 HOUR),
am AS (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY k ORDER BY least(iv, c), iv, c) = 1),
lm AS (SELECT cu.k, cu.ts AS c, l.ts AS l FROM cu JOIN cl l ON l.k = cu.k AND l.grp = 'Lactate' AND l.ts BETWEEN cu.ts - INTERVAL 6 HOUR AND cu.ts + INTERVAL 6 HOUR QUALIFY row_number() OVER (PARTITION BY cu.k ORDER BY least(cu.ts, l.ts), cu.ts, l.ts) = 1),
inf AS (SELECT k, 'iv_dt' AS criterion, iv AS infect_dt, 'IV+Culture' AS suspicion_infection_type FROM am UNION ALL SELECT k, 'culture_dt', c, 'IV+Culture' FROM am UNION ALL SELECT k, 'culture_dt', c, 'LACTATE+CULTURE' FROM lm UNION ALL SELECT k, 'lactate_dt', l, 'LACTATE+CULTURE' FROM lm
 UNION ALL SELECT k, 'first_ev_time_codesepsis', ts, 'CODE_SEPSIS_ORDER' FROM cl WHERE grp = 'Code Sepsis Page' UNION ALL SELECT k, 'first_ev_time_flowsheet', ts, 'FLOWSHEET_SUSPECTED_INFECTION' FROM cl WHERE grp = 'Suspected Infection' AND txt = 'Yes')"""


@query(f"WITH {_INF} SELECT * FROM inf")
def infections_long(spark, d):
    return C.infections(_clinical(spark, d), C.Scenario(columns=_CC))


@query(f"""
WITH {_INF}, n AS (SELECT k, infect_dt, CASE suspicion_infection_type WHEN 'IV+Culture' THEN 'antibiotic_culture' WHEN 'LACTATE+CULTURE' THEN 'lactate_culture' WHEN 'CODE_SEPSIS_ORDER' THEN 'sepsis_diagnosis_code' ELSE 'suspected_infection_flowsheet' END AS e FROM inf)
SELECT k, min(infect_dt) AS infection_time, arg_min(e, (infect_dt, e)) AS first_ev_type, string_agg(DISTINCT e, '__' ORDER BY e) AS infection_ev_type FROM n GROUP BY 1""")
def infections_wide(spark, d):
    return C.infections_wide(C.infections(_clinical(spark, d), C.Scenario(columns=_CC)), "k")


@query("WITH f AS (SELECT *, CASE WHEN event_type = 'click' THEN CASE WHEN value > 30 THEN 1 ELSE 0 END END AS f FROM events) SELECT event_id, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS flag FROM f")
def flags_carried(spark, d):
    e = events(spark, d).withColumn("flag", F.when(F.col("event_type") == "click", (F.col("value") > 30).cast("int")))
    return C.sirs_carried(e, "user_id", "ts", ["flag"]).select("event_id", "flag")


@query("""
WITH g AS (SELECT user_id, max(floor(value / 25)) AS top FROM events GROUP BY 1), t AS (SELECT e.user_id, list(e.event_id ORDER BY e.event_id) AS ids FROM events e JOIN g ON g.user_id = e.user_id AND floor(e.value / 25) = g.top GROUP BY 1)
SELECT e.user_id, count(DISTINCT event_type) AS n_types, bool_or(value > 200) AS any_high, array_to_string(any_value(ids), ',') AS top_ids FROM events e JOIN t USING (user_id) GROUP BY 1""")
def distinct_any_and_ties(spark, d):
    e = events(spark, d)
    g = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n_types"), F.bool_or(F.col("value") > 200).alias("any_high"))
    top = R.at_maximum(e.withColumn("score", F.floor(F.col("value") / 25)), ["user_id"], "score")
    return g.join(top.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("top_ids")), "user_id")


@query("SELECT count(*) AS n, round(avg(CASE WHEN x = y THEN 1 ELSE 0 END), 6) AS match_rate, round(corr(x, y), 6) AS correlation, round(avg(abs(x - y)), 6) AS difference FROM (SELECT floor(l_quantity / 10) AS x, floor(l_extendedprice / 20000) AS y FROM lineitem)")
def column_agreement(spark, d):
    l = read(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 10).alias("x"), F.floor(F.col("l_extendedprice") / 20000).alias("y"))
    return X.column_agreement(l, "x", "y").select("n", *rounded("match_rate", "correlation", "difference"))


_STEPS = "st AS (SELECT o_orderstatus AS c, o_orderdate AS t0, s1 AS t1, CASE WHEN s1 IS NOT NULL THEN s2 END AS t2, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN s3 END AS t3 FROM orders LEFT JOIN fi ON k = o_orderkey)"
_LINK = " UNION ALL ".join(f"SELECT c, '{a}' AS source, '{b}' AS target, count(*) AS n, round(quantile_cont((epoch_us({y}) - epoch_us({x})) / 3600000000.0, 0.5), 6) AS median_hours FROM st WHERE {y} IS NOT NULL GROUP BY 1 UNION ALL SELECT c, '{a}', 'No {b}', count(*), NULL FROM st WHERE {x} IS NOT NULL AND {y} IS NULL GROUP BY 1" for a, b, x, y in (("Admit", "S1", "t0", "t1"), ("S1", "S2", "t1", "t2"), ("S2", "S3", "t2", "t3")))


@query(f"WITH {_F}, {_STEPS} {_LINK}")
def funnel_links(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("c"), F.col("o_orderdate").alias("t0"))
    s = o.join(_firsts(spark, d), "k", "left")
    return R.funnel(s, "c", [("Admit", "t0"), ("S1", "s1"), ("S2", "s2"), ("S3", "s3")]).withColumn("median_hours", F.round("median_hours", 6))


@query("""
WITH x AS (SELECT event_id, user_id, event_type, ts, CASE WHEN value > 12 THEN value END AS v FROM events), y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS pt, last_value(v IGNORE NULLS) OVER w AS pv FROM x WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN ts - pt <= CASE event_type WHEN 'click' THEN INTERVAL 48 HOUR WHEN 'view' THEN INTERVAL 96 HOUR END THEN pv ELSE v END AS filled FROM y""")
def fill_by_group_limit(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("value") > 12, F.col("value")))
    return T.fill_expiring(e, ["user_id"], "event_type", "ts", "v", "filled", {"click": 48, "view": 96}).select("event_id", "filled")


@query("""
WITH x AS (SELECT event_id, user_id, ts, CASE WHEN value > 30 THEN value END AS v FROM events),
y AS (SELECT *, epoch_us(ts) - last_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b AS ba, last_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER f - epoch_us(ts) AS fa, first_value(v IGNORE NULLS) OVER f AS fv FROM x
 WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN coalesce(ba, 1e18) <= coalesce(fa, 1e18) THEN CASE WHEN ba <= 28800000000 THEN bv END ELSE CASE WHEN fa <= 28800000000 THEN fv END END AS filled FROM y""")
def fill_from_nearest(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("value") > 30, F.col("value")))
    return T.fill_nearest(e, ["user_id"], "ts", "v", "filled", 8).select("event_id", "filled")


def _z_sql(window: int, floor: float, kind: str = "") -> str:
    """event_id, value, m, s: the rolling median and floored deviation behind `rolling_z`."""
    return f"""SELECT event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND {(window - 2) * 3600000000} FOLLOWING) AS m,
 greatest(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {window * 3600000000} PRECEDING AND 1 PRECEDING), {floor}) AS s FROM events {kind and f"WHERE event_type = '{kind}'"}"""


@query(f"SELECT event_id, round((value - m) / s, 4) AS z FROM ({_z_sql(24, 0.9)})")
def rolling_z_scores(spark, d):
    return O.rolling_z(events(spark, d), ["user_id"], "ts", "value", 24, 0.9).select("event_id", F.round("z", 4).alias("z"))


@query("SELECT event_id, round(avg(value) OVER b, 6) AS mean_before, round(avg(value) OVER a, 6) AS mean_after, round(avg(value) OVER a - avg(value) OVER b, 6) AS asymmetry FROM events WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)")
def outlier_context(spark, d):
    return O.context(events(spark, d), ["user_id"], "ts", "value").select("event_id", *rounded("mean_before", "mean_after", "asymmetry"))


_PE = f"""{_CLS}, pe AS (SELECT k, ts, grp, num FROM cl WHERE num IS NOT NULL AND grp <> 'Blood Pressure'
 UNION ALL SELECT k, ts, 'Systolic Blood Pressure', TRY_CAST(split_part(txt, '/', 1) AS DOUBLE) FROM cl WHERE grp = 'Blood Pressure' AND TRY_CAST(split_part(txt, '/', 1) AS DOUBLE) IS NOT NULL
 UNION ALL SELECT k, ts, 'Arterial Blood Pressure Mean', CASE WHEN TRY_CAST(split_part(txt, '/', 1) AS DOUBLE) >= TRY_CAST(split_part(txt, '/', 2) AS DOUBLE) AND TRY_CAST(split_part(txt, '/', 2) AS DOUBLE) > 0 THEN round((TRY_CAST(split_part(txt, '/', 1) AS DOUBLE) + 2 * TRY_CAST(split_part(txt, '/', 2) AS DOUBLE)) / 3, 1) END FROM cl WHERE grp = 'Blood Pressure')"""


def _features_sql(features) -> str:
    how = {"last": "last(e.num ORDER BY e.ts, e.num)", "max": "max(e.num)", "min": "min(e.num)"}
    cols = ", ".join(f"{how[a]} FILTER (WHERE e.grp = '{g}' AND e.ts >= t.ts - INTERVAL {round(h * 60)} MINUTE) AS {n}" for n, (g, a, h) in features.items())
    return f"fe AS (SELECT t.k, t.ts, {cols} FROM (SELECT DISTINCT k, ts FROM cl) t LEFT JOIN pe e ON e.k = t.k AND e.ts <= t.ts AND e.ts >= t.ts - INTERVAL 24 HOUR GROUP BY 1, 2)"


@query(f"WITH {_PE}, {_features_sql(C.DAY_FEATURES)} SELECT k, ts, {', '.join(f'round({n}, 6) AS {n}' for n in C.DAY_FEATURES)} FROM fe")
def day_features(spark, d):
    e = _clinical(spark, d)
    return T.lookback(e, C.pressures(e, _CC), "k", "ts", "grp", "num", C.DAY_FEATURES).select("k", "ts", *rounded(*C.DAY_FEATURES))


@query(f"WITH {_CLS} SELECT k, ts, grp, CASE WHEN grp = 'Blood Pressure' AND txt IS NOT NULL THEN TRY_CAST(split_part(txt, '/', 1) AS DOUBLE) ELSE num END AS num FROM cl")
def numbers_from_pressures(spark, d):
    return C.number_from_pressure(_clinical(spark, d), _CC).select("k", "ts", "grp", "num")


#: Baselines of the run, in expressions over customer.
_BASE = {"Baseline_Creatinine": "CASE WHEN c_custkey % 3 = 0 THEN 0.8 END", "Baseline_Platelets": "CASE WHEN c_custkey % 2 = 0 THEN 250.0 END", "Baseline_SBP": "CASE WHEN c_custkey % 4 <> 0 THEN 120.0 END", "Baseline_Bilirubin": "CAST(NULL AS DOUBLE)", "Baseline_eGFR": "CAST(NULL AS DOUBLE)"}
_LAST = ("last_lactate_6h", "last_creatinine_12h", "last_platelets_24h", "last_inr_12h", "last_gcs_12h", "last_map_8h", "last_sbp_8h", "last_norepinephrine_24h")
_FLAGS = f"""{_INF}, {_PE.removeprefix(_CLS + ', ')}, {_features_sql(C.FEATURES)}, ba AS (SELECT c_custkey AS k, {', '.join(f'{x} AS "{n}"' for n, x in _BASE.items())} FROM customer), fb AS (SELECT fe.*, ba.* EXCLUDE (k) FROM fe LEFT JOIN ba USING (k)),
fl AS (SELECT k, ts, (CASE WHEN last_temp_8h < 96.8 OR last_temp_8h > 100.4 THEN 1 ELSE 0 END) + (CASE WHEN last_pulse_8h > 90 THEN 1 ELSE 0 END) + (CASE WHEN last_resp_8h > 20 THEN 1 ELSE 0 END) + (CASE WHEN last_wbc_12h < 4 OR last_wbc_12h > 12 THEN 1 ELSE 0 END) AS sirs,
 (CASE WHEN last_lactate_6h > 2 THEN 1 ELSE 0 END) + (CASE WHEN last_inr_12h > 1.5 OR (last_platelets_24h < 100 AND ("Baseline_Platelets" IS NULL OR (last_platelets_24h < 0.5 * "Baseline_Platelets" AND "Baseline_Platelets" > 100))) THEN 1 ELSE 0 END) + (CASE WHEN ("Baseline_Creatinine" IS NULL AND last_creatinine_12h > 2) OR last_creatinine_12h > 2 * "Baseline_Creatinine" THEN 1 ELSE 0 END) + (CASE WHEN last_gcs_12h < 15 THEN 1 ELSE 0 END) AS organ,
 CASE WHEN (last_sbp_8h < 90 AND "Baseline_SBP" IS NULL) OR "Baseline_SBP" - last_sbp_8h > 40 OR last_map_8h < 65 OR last_lactate_6h > 4 OR last_norepinephrine_24h > 0 THEN 1 ELSE 0 END AS shock FROM fb),
id AS (SELECT DISTINCT k, infect_dt FROM inf), hi AS (SELECT id.*, fl.* EXCLUDE (k) FROM id JOIN fl ON fl.k = id.k AND fl.ts BETWEEN infect_dt - INTERVAL 48 HOUR AND infect_dt + INTERVAL 48 HOUR),
tw AS (SELECT * FROM hi WHERE organ >= 1)"""


@query(f"""
WITH {_FLAGS} SELECT k, 1 AS score, min(least(infect_dt, ts)) AS instant FROM hi WHERE sirs >= 2 AND ts BETWEEN infect_dt - INTERVAL 24 HOUR AND infect_dt + INTERVAL 24 HOUR GROUP BY 1
UNION ALL SELECT k, 2, min(least(infect_dt, ts)) FROM tw GROUP BY 1 UNION ALL SELECT k, 3, min(least(infect_dt, ts)) FROM hi JOIN (SELECT DISTINCT k, infect_dt FROM tw) USING (k, infect_dt) WHERE shock = 1 GROUP BY 1""")
def labelling_run(spark, d):
    e = read(spark, d, "customer").selectExpr("c_custkey AS k", *[f"{x} AS {n}" for n, x in _BASE.items()])
    # a stage that several others read is written once
    shared = ("bounded", "infect_long", "agg", "organdysfunction", "sepsis2")
    keep = lambda name, make: cut(make()) if name in shared else make()
    return C.stacked(C.run(spark, _clinical(spark, d), e, C.Scenario(columns=_CC), keep), "k")


def _labels_sql(sirs: float, organ: float, shock: float) -> str:
    """k, score of each label of a scenario, over the tables of `_FLAGS`."""
    near = lambda h: f"ts BETWEEN infect_dt - INTERVAL {h} HOUR AND infect_dt + INTERVAL {h} HOUR"
    two = f"SELECT DISTINCT k, infect_dt FROM hi WHERE organ >= 1 AND {near(organ)}"
    return f"""SELECT k, 1 AS score FROM hi WHERE sirs >= 2 AND {near(sirs)} UNION SELECT k, 2 FROM ({two})
 UNION SELECT k, 3 FROM hi JOIN ({two}) USING (k, infect_dt) WHERE shock = 1 AND {near(shock)}"""


@query(f"""
WITH {_FLAGS}, a AS (SELECT k, max(score) AS a FROM ({_labels_sql(24, 48, 48)}) GROUP BY k), b AS (SELECT k, max(score) AS b FROM ({_labels_sql(1, 3, 3)}) GROUP BY k),
j AS (SELECT a, b FROM a FULL JOIN b USING (k)), c AS (SELECT count_if(b IS NULL) AS only_a, count_if(a IS NULL) AS only_b, count_if(a = b OR a <> b) AS "both", count(*) AS either, count_if(a = b) AS same, count_if(b > a) AS up, count_if(b < a) AS down FROM j),
e AS (SELECT sum((SELECT count(*) FROM j WHERE a = s AND b IS NOT NULL) * (SELECT count(*) FROM j WHERE b = s AND a IS NOT NULL))::DOUBLE AS e FROM range(1, 4) t(s))
SELECT only_a, only_b, "both", either, round("both" / either, 6) AS jaccard, "both" AS n, round(same / "both", 6) AS exact, round(up / "both", 6) AS upgraded, round(down / "both", 6) AS downgraded, round((same / "both" - e / ("both" * "both")) / (1 - e / ("both" * "both")), 6) AS kappa FROM c, e""")
def scenarios_compared(spark, d):
    e = read(spark, d, "customer").selectExpr("c_custkey AS k", *[f"{x} AS {n}" for n, x in _BASE.items()])
    usual, strict = C.Scenario(name="usual", columns=_CC), C.Scenario(name="strict", columns=_CC, sirs_hours=1, organ_hours=3, shock_hours=3)
    out = C.run_and_compare(spark, _clinical(spark, d), e, usual, strict, scratch(spark))
    agreed = out["agreement_sepsis_score_at_max"].select("n", *rounded("exact", "upgraded", "downgraded", "kappa"))
    return out["overlap"].withColumn("jaccard", F.round("jaccard", 6)).crossJoin(agreed)  # one row each


@query(f"""
WITH {_E}, m AS (SELECT *, CASE WHEN billing = ours THEN 'Matched' ELSE 'Mismatched' END AS g FROM enc), l AS (SELECT g, 'origin' AS factor, origin AS v FROM m UNION ALL SELECT g, 'billing', billing FROM m UNION ALL SELECT g, 'ed', ed::VARCHAR FROM m),
c AS (SELECT factor, v, g, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2, 3), x AS (SELECT *, sum(n) OVER (PARTITION BY factor, v) AS r, sum(n) OVER (PARTITION BY factor, g) AS k, sum(n) OVER (PARTITION BY factor) AS t FROM c),
s AS (SELECT factor, any_value(t) AS t, count(DISTINCT v) AS nr, count(DISTINCT g) AS nc, any_value(t) * (sum(n * n / (r * k)) - 1) AS chi, any_value(greatest(abs(n - r * k / t) - 0.5, 0)) AS off, any_value(r * (t - r) * k * (t - k)) AS den FROM x GROUP BY 1),
y AS (SELECT *, CASE WHEN nr = 2 AND nc = 2 THEN off * off * t * t * t / den ELSE chi END AS chi2 FROM s)
SELECT factor, round(chi2, 4) AS chi2, (nr - 1) * (nc - 1) AS dof, round(sqrt(chi2 / t), 6) AS cramers_v FROM y""")
def factor_tests(spark, d):
    e = _enc(spark, d).withColumn("g", F.when(F.col("billing") == F.col("ours"), "Matched").otherwise("Mismatched"))
    return X.factor_tests(e, ["origin", "billing", "ed"], "g").select("factor", F.round("chi2", 4).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"))


@query(f"""
WITH {_E}, m AS (SELECT 'ed' AS factor, ed AS f, ours = billing AS g FROM enc UNION ALL SELECT 'death', death, ours = billing FROM enc)
SELECT factor, count_if(f = 1 AND g) AS a, count_if(f = 1 AND NOT g) AS b, count_if(f = 0 AND g) AS c, count_if(f = 0 AND NOT g) AS d, CASE WHEN least(count_if(f = 1 AND g), count_if(f = 1 AND NOT g), count_if(f = 0 AND g), count_if(f = 0 AND NOT g)) < 5 THEN 'Fisher''s exact' ELSE 'Chi-square' END AS test,
 round(count_if(f = 1 AND g) * count_if(f = 0 AND NOT g) / (count_if(f = 1 AND NOT g) * count_if(f = 0 AND g)), 6) AS odds_ratio FROM m GROUP BY 1""")
def binary_factor_tests(spark, d):
    e = _enc(spark, d).withColumn("g", F.when(F.col("billing") == F.col("ours"), "yes").otherwise("no"))
    return X.binary_factors(e, ["ed", "death"], "g", "yes").drop("p").withColumn("odds_ratio", F.round("odds_ratio", 6))


@query(f"""
WITH {_E}, v AS (SELECT CASE WHEN ed = 1 THEN 'a' ELSE 'b' END AS g, round(age, 0) AS v FROM enc), k AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM v),
s AS (SELECT count_if(g = 'a')::DOUBLE AS n, count_if(g = 'b')::DOUBLE AS m, sum(r) FILTER (WHERE g = 'a') AS rs FROM k), t AS (SELECT sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM v GROUP BY v))
SELECT rs - n * (n + 1) / 2 AS u, round(greatest(abs(rs - n * (n + 1) / 2 - n * m / 2) - 0.5, 0) / sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))), 6) AS z FROM s, t""")
def mann_whitney_test(spark, d):
    e = _enc(spark, d).select(F.when(F.col("ed") == 1, "a").otherwise("b").alias("g"), F.round("age", 0).alias("v"))
    return X.mann_whitney(e, "g", "v").select("u", F.round("z", 6).alias("z"))


@query(f"WITH {_E}, {_F}, g AS (SELECT CASE WHEN ours = billing THEN 1 ELSE 0 END AS m, los, ours FROM enc) SELECT ours, m, count(los) AS n, round(avg(los), 4) AS mean, round(stddev_samp(los), 4) AS std, round(min(los), 4) AS min, round(max(los), 4) AS max, round(quantile_cont(los, 0.25), 4) AS p25, round(quantile_cont(los, 0.5), 4) AS p50, round(quantile_cont(los, 0.75), 4) AS p75 FROM g GROUP BY 1, 2")
def numeric_factor_stats(spark, d):
    e = _enc(spark, d).withColumn("m", (F.col("ours") == F.col("billing")).cast("int"))
    return R.summary(e, ["ours", "m"], "los", (0.25, 0.5, 0.75)).select("ours", "m", "n", *rounded("mean", "std", "min", "max", "p25", "p50", "p75", n=4))


@query(f"""
WITH {_E}, m AS (SELECT *, CASE WHEN billing = ours THEN 'Matched' ELSE 'Mismatched' END AS g FROM enc WHERE ours IN ('POA-1', 'POA-2', 'NPOA-1', 'NPOA-2')), c AS (SELECT ours, origin AS v, g, count(*)::DOUBLE AS n FROM m GROUP BY 1, 2, 3),
x AS (SELECT *, sum(n) OVER (PARTITION BY ours, v) AS r, sum(n) OVER (PARTITION BY ours, g) AS k, sum(n) OVER (PARTITION BY ours) AS t FROM c), s AS (SELECT ours, any_value(t) AS t, count(DISTINCT v) AS nr, count(DISTINCT g) AS nc, any_value(t) * (sum(n * n / (r * k)) - 1) AS chi FROM x GROUP BY 1),
v AS (SELECT *, CASE WHEN nc = 1 THEN 0 ELSE sqrt(chi / t) END AS v FROM s)
SELECT ours, 'origin' AS factor, 'Categorical' AS type, round(v, 6) AS effect, CASE WHEN v < 0.1 THEN 'Negligible' WHEN v < 0.3 THEN 'Small' WHEN v < 0.5 THEN 'Medium' ELSE 'Large' END AS interpretation, 1 AS place FROM v""")
def factor_summary_by_label(spark, d):
    e = _enc(spark, d).withColumn("g", F.when(F.col("billing") == F.col("ours"), "Matched").otherwise("Mismatched"))
    s = X.factor_summary(X.factor_tests(e, ["origin"], "g", by=["ours"]), X.binary_factors(e, ["ed", "death"], "g", "Matched", by=["ours"]), by=["ours"])
    return s.where("type = 'Categorical'").select("ours", "factor", "type", F.round("effect", 6).alias("effect"), "interpretation", "place")


_RUNS = "a AS (SELECT o_orderkey AS k, CAST(1 + o_orderkey % 3 AS INTEGER) AS score FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey AS k, CAST(1 + (o_orderkey // 2) % 2 AS INTEGER) AS score FROM orders WHERE o_orderpriority <> '5-LOW')"


def _runs(spark, d):
    o = read(spark, d, "orders")
    return (o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 3).cast("int").alias("score")), o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), (1 + F.floor(F.col("o_orderkey") / 2) % 2).cast("int").alias("score")))


@query(f"WITH {_RUNS}, j AS (SELECT a.score AS a_score, b.score AS b FROM a JOIN b USING (k)) SELECT v AS a_score, count_if(b = 1) AS b_1, count_if(b = 2) AS b_2, count_if(b = 3) AS b_3 FROM (SELECT unnest([1, 2, 3]) AS v) LEFT JOIN j ON a_score = v GROUP BY 1")
def run_agreement_matrix(spark, d):
    a, b = _runs(spark, d)
    return X.compare_runs(a, b, "k", ["score"])["matrix_score"]


@query(f"WITH {_RUNS} SELECT k, score, run, o_orderpriority FROM (SELECT *, 'a' AS run FROM a UNION ALL SELECT *, 'b' FROM b) JOIN orders ON o_orderkey = k")
def runs_stacked(spark, d):
    meta = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return X.stack_runs(*_runs(spark, d), "k", ["score"], meta)


@query(f"""
WITH {_RUNS}, {_E}, o AS (SELECT a.score, death, los FROM a JOIN enc USING (k) WHERE k NOT IN (SELECT k FROM b)), s AS (SELECT string_agg(score || ':' || n, ',' ORDER BY score) AS scores FROM (SELECT score, count(*) AS n FROM o GROUP BY 1))
SELECT count(*) AS n, round(avg(death) * 100, 2) AS death_pct, round(avg(los), 2) AS mean_stay, round(quantile_cont(los, 0.5), 6) AS median_stay, any_value(scores) AS scores FROM o, s""")
def only_in_one_run(spark, d):
    a, b = _runs(spark, d)
    return X.unique_profile(a.join(_enc(spark, d), "k"), b, "k", "death", "los", "score").withColumn("median_stay", F.round("median_stay", 6))


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 200), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value < 1) SELECT 'both' AS kind, user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'a only', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def id_sets(spark, d):
    e = events(spark, d)
    a, b = e.where("value > 200").select("user_id").distinct(), e.where("event_type = 'click' and value < 1").select("user_id").distinct()
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "user_id")
    return kind(a.intersect(b), "both").union(kind(a.exceptAll(b), "a only"))


@query("SELECT 'head' AS part, event_id FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 5) UNION ALL SELECT 'tail', event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)")
def head_and_tail(spark, d):
    e = events(spark, d)
    return R.ends(e, [F.col("ts"), F.col("event_id")], [F.desc("ts"), F.desc("event_id")], 5).select("part", "event_id")


@query("SELECT event_id, user_id FROM events JOIN (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL ORDER BY md5(concat('3:', user_id)), user_id LIMIT 5) USING (user_id)")
def sampled_users(spark, d):
    return R.sample_keys(events(spark, d), "user_id", 5, seed=3).select("event_id", "user_id")


@query("SELECT dayofweek(ts) AS weekday, hour(ts) AS hour, count(*) AS n FROM (SELECT ts FROM events) GROUP BY 1, 2")
def events_by_hour(spark, d):
    return events(spark, d).groupBy((F.dayofweek("ts") - 1).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


_TXT = "CASE o_orderkey % 5 WHEN 0 THEN '>488' WHEN 1 THEN '<30' WHEN 2 THEN 'Yes' WHEN 3 THEN '12.5% (n=45)' ELSE CAST(o_orderkey AS STRING) END"


@query(f"""
WITH x AS (SELECT o_orderkey, {_TXT} AS t FROM orders)
SELECT o_orderkey, CASE WHEN t = '>488' THEN 490.0 WHEN t = '<30' THEN 29.0 ELSE TRY_CAST(t AS DOUBLE) END AS number, CASE WHEN t = 'Yes' THEN 1 ELSE 0 END AS yes, CASE WHEN t LIKE '%n=%' THEN 12.5 ELSE 0.0 END AS pct, CASE WHEN t LIKE '%n=%' THEN 45 ELSE 0 END AS n, concat_ws('__', t, CASE WHEN t = 'Yes' THEN 'y' END, 'z') AS joined,
 CASE WHEN t IN ('>488') THEN NULL ELSE t END AS without_token FROM x""")
def text_values(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.expr(_TXT).alias("t"))
    pct, n = S.percent_text(F.col("t"))
    return o.select("o_orderkey", S.censored_number(F.col("t"), 2, 1).alias("number"), S.yes_no(F.col("t")).alias("yes"), pct.alias("pct"), n.alias("n"), F.concat_ws("__", "t", F.when(F.col("t") == "Yes", "y"), F.lit("z")).alias("joined"), S.null_tokens(F.col("t"), [">488"]).alias("without_token"))


@query("SELECT o_orderkey, CAST(split_part(c, '-', 2) AS INTEGER) AS severity, replace(c, 'UPOA', 'NPOA') AS folded FROM (SELECT o_orderkey, " + _ENC["billing"] + " AS c FROM orders)")
def severity_codes(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.expr(_ENC["billing"]).alias("c"))
    return o.select("o_orderkey", S.severity(F.col("c")).alias("severity"), S.normal_code(F.col("c"), {"UPOA": "NPOA"}).alias("folded"))


@query(f"""
WITH {_IV} SELECT p.event_id, CASE WHEN p.ts <= iv.e THEN iv.event_id END AS within FROM (SELECT * FROM events WHERE event_type = 'click') p ASOF LEFT JOIN (SELECT * FROM iv WHERE event_type = 'error') iv ON p.user_id = iv.user_id AND p.ts >= iv.s""")
def state_at_event(spark, d):
    iv = _intervals(spark, d, "error", ("within", "s", "e"))
    return T.interval_lookup(events(spark, d, "click"), iv, ["user_id"], "ts", "s", "e", ["within"]).select("event_id", "within")


@query("""
WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS st FROM events), o AS (SELECT unnest([0.0, 6.0, 24.0]::DOUBLE[]) AS "offset"), l AS (SELECT f.user_id, o."offset", last(floor(f.value / 20)::BIGINT ORDER BY f.ts, f.value) AS state FROM f JOIN o ON (epoch_us(f.ts) - epoch_us(f.st)) <= o."offset" * 3600000000 GROUP BY 1, 2)
SELECT "offset", state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY "offset"), 6) AS share FROM l GROUP BY 1, 2""")
def state_shares_at(spark, d):
    e = R.with_group(events(spark, d), ["user_id"], {"st": F.min("ts")}).withColumn("state", F.floor(F.col("value") / 20))
    return T.state_shares(e, ["user_id"], "ts", "st", "state", [0, 6, 24]).withColumn("share", F.round("share", 6))


@query("SELECT user_id, ts, max(score) AS score FROM (SELECT user_id, ts, floor(value / 50)::BIGINT AS score FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL) GROUP BY 1, 2 QUALIFY lag(max(score)) OVER (PARTITION BY user_id ORDER BY ts) IS DISTINCT FROM max(score)")
def score_changes(spark, d):
    e = events(spark, d).dropna(subset=["value", "user_id"]).withColumn("score", F.floor(F.col("value") / 50))
    return H.instant_spells(e, ["user_id"], "ts", "score").select("user_id", F.col("start").alias("ts"), "score")


@query("""
WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS p FROM events), s AS (SELECT event_type AS from_state, lead(event_type) OVER w AS to_state, row_number() OVER w AS step FROM c WHERE p IS NULL OR p <> event_type WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type))
SELECT step::INTEGER AS step, from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY step), 6) AS share FROM (SELECT step, from_state, to_state, count(*) AS n FROM s WHERE to_state IS NOT NULL GROUP BY ALL)""")
def path_step_shares(spark, d):
    return T.path_edges(events(spark, d), ["user_id"], "ts", "event_type", normalise=True).withColumn("share", F.round("share", 6))


@query("SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3 AS among_top FROM events QUALIFY among_top")
def top_values_per_user(spark, d):
    e = R.first_rows(events(spark, d), ["user_id"], [F.desc("value"), F.col("event_id")], 3)
    return e.select("event_id", F.lit(True).alias("among_top"))


_ZP = {"click": (24, 0.9, 2.0), "view": (72, 5.0, 1.5)}


@query(" UNION ALL ".join(f"SELECT event_id, coalesce(abs((value - m) / s) > {limit}, false) AS outlier FROM ({_z_sql(h, floor, g)})" for g, (h, floor, limit) in _ZP.items()))
def rolling_z_by_group(spark, d):
    return O.rolling_z_by_group(events(spark, d), ["user_id"], "ts", "value", "event_type", _ZP).select("event_id", "outlier")


@query("SELECT event_type, 'only_a' AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 UNION ALL SELECT event_type, 'only_b', count(*) FROM events WHERE event_type = 'signup' GROUP BY 1")
def new_and_missing_groups(spark, d):
    return R.group_diff(events(spark, d, "click", "view", "error"), events(spark, d, "error", "signup"), "event_type")


@query("""
WITH f AS (SELECT user_id, ts, max(CASE WHEN event_type = 'click' THEN value END) AS top_click FROM events GROUP BY 1, 2), g AS (SELECT user_id, ts, CASE WHEN max(value) > 60 THEN 1 ELSE 0 END AS high FROM events GROUP BY 1, 2)
SELECT event_id, f.top_click, g.high, CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE 0 END AS supported FROM events JOIN f USING (user_id, ts) JOIN g USING (user_id, ts)""")
def joined_back(spark, d):
    e = events(spark, d)
    per = lambda *c: e.groupBy("user_id", "ts").agg(*c)
    parts = [per(F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("top_click")), per((F.max("value") > 60).cast("int").alias("high"))]
    return R.join_all(e, parts, ["user_id", "ts"]).select("event_id", "top_click", "high", C.dysfunction_by_status(F.col("event_type"), ["click", "signup"]).alias("supported"))


def _halves(spark, d):
    """Events under two keys, so each key is long, and the hours of a bucket."""
    e = events(spark, d).withColumn("half", F.col("user_id") % 2)
    return e, N.bucket_hours(e, ["half"], "ts", 500)


@query("""
SELECT a.event_id, max(b.ts) AS r_t, max_by(b.event_id, (b.ts, b.event_id)) AS r_id FROM events a LEFT JOIN LATERAL (
 SELECT ts, event_id FROM events x WHERE x.event_type = 'error' AND x.user_id % 2 = a.user_id % 2 AND x.ts <= a.ts AND x.ts >= a.ts - INTERVAL 6 HOUR ORDER BY ts DESC, event_id DESC LIMIT 1) b ON true
WHERE a.event_type = 'click' GROUP BY a.event_id""")
def asof_of_long_keys(spark, d):
    e, hours = _halves(spark, d)
    errors = e.where("event_type = 'error'").select("half", F.col("ts").alias("t"), F.col("event_id").alias("id"))
    return T.asof_join(e.where("event_type = 'click'"), errors, ["half"], "ts", "t", ["id"], hours=6, bucket=hours).select("event_id", "r_t", "r_id")


@query("""
WITH x AS (SELECT event_id, user_id % 2 AS half, ts, CASE WHEN value > 100 THEN value END AS v FROM events),
y AS (SELECT event_id, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS t, last_value(v IGNORE NULLS) OVER w AS v FROM x
 WINDOW w AS (PARTITION BY half ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), z AS (SELECT y.*, ts FROM y JOIN x USING (event_id))
SELECT event_id, CASE WHEN ts - t <= INTERVAL 3 HOUR THEN v END AS filled FROM z""")
def fills_of_long_keys(spark, d):
    e, hours = _halves(spark, d)
    e = e.withColumn("v", F.when(F.col("value") > 100, F.col("value")))
    return T.fill_forward(e, ["half"], "ts", "v", "filled", 3, tie=["event_id"], bucket=hours).select("event_id", "filled")


@query("""
WITH x AS (SELECT user_id % 2 AS half, ts, value > 60 AS high FROM events), c AS (SELECT *, CASE WHEN high IS DISTINCT FROM lag(high) OVER w OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM x WINDOW w AS (PARTITION BY half ORDER BY ts, high)),
s AS (SELECT *, sum(c) OVER (PARTITION BY half ORDER BY ts, high ROWS UNBOUNDED PRECEDING) AS spell FROM c),
r AS (SELECT half, spell::BIGINT AS spell, any_value(high) AS high, min(ts) AS s, max(ts) AS e, count(*) AS n FROM s GROUP BY half, spell),
q AS (SELECT *, lead(s) OVER (PARTITION BY half ORDER BY spell) AS next FROM r)
SELECT half, spell, high, n, next IS NULL AS censored, round((epoch_us(coalesce(next, e)) - epoch_us(s)) / 3600000000.0, 6) AS hours FROM q""")
def runs_of_long_keys(spark, d):
    e, hours = _halves(spark, d)
    runs = T.run_durations(e.withColumn("high", F.col("value") > 60), ["half"], "ts", "high", hours)
    return runs.select("half", "spell", "high", "n", "censored", F.round("hours", 6).alias("hours"))


@query("""
WITH w AS (SELECT event_id, user_id % 2 AS half, ts, value, lag(ts) OVER k AS t, lag(value) OVER k AS v, avg(value) OVER (k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_before, avg(value) OVER (k ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS mean_after FROM events
 WINDOW k AS (PARTITION BY user_id % 2 ORDER BY ts, event_id)), x AS (SELECT *, (epoch_us(ts) - epoch_us(t)) / 60e6 AS m, abs(value - v) AS dv FROM w)
SELECT event_id, coalesce(m <= 60 AND dv / (m + 1e-6::DOUBLE) > 0.5 AND dv / (m + 1e-6::DOUBLE) < 1e6, false) AS too_fast, coalesce(m <= 60 AND dv > 20, false) AS too_far, round(mean_before, 6) AS mean_before, round(mean_after, 6) AS mean_after FROM x""")
def steps_of_long_keys(spark, d):
    e, hours = _halves(spark, d)
    e = O.velocity_flags(e, ["half"], "ts", "value", 0.5, 20, 60, ["event_id"], hours)
    return O.context(e, ["half"], "ts", "value", tie=["event_id"], bucket=hours).select("event_id", "too_fast", "too_far", *rounded("mean_before", "mean_after"))


@query("""
WITH x AS (SELECT *, user_id % 2 AS half FROM events), c AS (SELECT *, lag(event_type) OVER (PARTITION BY half ORDER BY ts, event_type) AS p FROM x),
s AS (SELECT event_type AS from_state, lead(event_type) OVER w AS to_state, row_number() OVER w AS step FROM c WHERE p IS NULL OR p <> event_type WINDOW w AS (PARTITION BY half ORDER BY ts, event_type))
SELECT step::INTEGER AS step, from_state, to_state, count(*) AS n FROM s WHERE to_state IS NOT NULL GROUP BY ALL""")
def path_of_long_keys(spark, d):
    e, hours = _halves(spark, d)
    return T.path_edges(e, ["half"], "ts", "event_type", bucket=hours)


@query("""
WITH m AS (SELECT user_id % 2 AS half, ts, event_type, lag(event_type) OVER (PARTITION BY user_id % 2 ORDER BY ts, event_type = 'signup') AS p FROM events WHERE event_type IN ('signup', 'error')),
t AS (SELECT *, lead(ts) OVER (PARTITION BY half ORDER BY ts, event_type = 'signup') AS e FROM m WHERE p IS NULL OR p <> event_type)
SELECT half, ts AS "start", e AS "end", CASE WHEN e IS NULL THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM t WHERE event_type = 'signup'""")
def episodes_of_long_keys(spark, d):
    e, hours = _halves(spark, d)
    return T.episodes(e, ["half"], "ts", F.col("event_type") == "signup", F.col("event_type") == "error", hours)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id % 2, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS place, lead(event_id, 5) OVER (PARTITION BY user_id % 2, event_type ORDER BY ts, event_id) AS fifth_on FROM events")
def places_in_long_keys(spark, d):
    e, hours = _halves(spark, d)
    e = N.running_sum(e, ["half", "event_type"], "ts", ["ts", "event_id"], F.lit(1), "place", hours)
    return T.shifted(e, ["half", "event_type"], "ts", {"fifth_on": ("event_id", 5)}, ["event_id"], hours).select("event_id", "place", "fifth_on")
