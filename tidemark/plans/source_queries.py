"""Registered queries of the readers and writers: extracts written from the provided tables, read back and cleaned."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import events, query, read
from tidemark.sources import io
from tidemark.sources.shared import cut, scratch

#: An order as a line of text, in expressions that Spark and DuckDB share; the third is the time, by day.
_K = "CASE WHEN o_orderkey % 11 = 0 THEN 'Null' WHEN o_orderkey % 13 = 0 THEN concat('x', CAST(o_orderkey AS VARCHAR(20))) ELSE CAST(o_orderkey AS VARCHAR(20)) END"
_PRICE = "CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)) END"


@query(f"""
WITH x AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, {_K} AS kt, {_PRICE} AS pt FROM orders),
r AS (SELECT *, concat_ws(', ', CASE WHEN k % 19 = 0 THEN 'fields' END, CASE WHEN kt LIKE 'x%' THEN 'k: ' || kt END, CASE WHEN k % 5 = 3 THEN 't: 2024-02-30 00:00:00' END, CASE WHEN pt = 'n/a' THEN 'price: n/a' END, CASE WHEN kt = 'Null' AND k % 19 <> 0 THEN 'k: missing' END) AS why,
 CASE k % 5 WHEN 0 THEN d + INTERVAL 510 MINUTE WHEN 1 THEN d + INTERVAL 1065 MINUTE WHEN 4 THEN d::TIMESTAMP END AS t FROM x)
SELECT 'read' AS outcome, o_status AS what, count(*) AS n, sum(k)::BIGINT AS keys, count(t) AS times, sum(epoch_us(t) // 60000000)::BIGINT AS minutes, sum(TRY_CAST(pt AS DOUBLE)) AS price FROM (SELECT r.*, o_orderstatus AS o_status FROM r JOIN orders ON k = o_orderkey) WHERE why = '' GROUP BY 2
UNION ALL SELECT 'rejected', why, count(*), NULL, NULL, NULL, NULL FROM r WHERE why <> '' GROUP BY 2""")
def ingested_orders(spark, d):
    o, path = read(spark, d, "orders"), scratch(spark)
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    at = F.expr("o_orderkey % 5")
    t = (
        F.when(at == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 08:30:00.000"))).when(at == 1, F.concat(F.date_format(day, "MM/dd/yyyy"), F.lit(" 17:45")))
        .when(at == 2, "NULL").when(at == 3, "2024-02-30 00:00:00").otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    more = F.when(F.col("o_orderkey") % 19 == 0, F.concat("o_orderstatus", F.lit(",one more"))).otherwise(F.col("o_orderstatus"))
    o.select(F.concat_ws(",", F.expr(_K), t, F.expr(_PRICE), more)).write.text(path)
    formats = ["yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "MM/dd/yyyy HH:mm", "yyyy-MM-dd"]
    rows, rejected = io.ingest_csv(spark, path, {"k": "long", "t": formats, "price": "double", "status": "string"}, ["k"], header=False)
    minutes = F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', t)")
    good = rows.groupBy(F.lit("read").alias("outcome"), F.col("status").alias("what")).agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.count("t").alias("times"), F.sum(minutes).alias("minutes"), F.sum("price").alias("price"))
    bad = rejected.groupBy(F.lit("rejected").alias("outcome"), F.array_join(io.REASONS, ", ").alias("what")).agg(F.count("*").alias("n"))
    return good.unionByName(bad, allowMissingColumns=True)


@query("""
SELECT DISTINCT user_id AS csn, ts, event_type AS name, CASE WHEN event_id % 7 <> 0 THEN value END AS value, c_nationkey AS nation, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS "Baseline_x"
FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_id % 31 <> 0""")
def combined_extracts(spark, d):
    root = scratch(spark)
    text = lambda c, no, token: F.when(no, token).otherwise(F.col(c).cast("string"))
    e = events(spark, d)
    e = e.select("event_id", "user_id", text("ts", F.col("event_id") % 31 == 0, "Null").alias("ts"), "event_type", text("value", F.col("event_id") % 7 == 0, "NULL").alias("value"))
    first, second = e.where("event_type IN ('click', 'view')"), e.where("event_type NOT IN ('click', 'view')")
    again = first.where("event_id % 50 = 0")  # rows that the extract repeats
    io.write_csv(first.union(again).select(F.col("user_id").alias("csn"), "ts", F.col("event_type").alias("name"), "value"), f"{root}/one")
    io.write_csv(second.select(F.col("value").alias("Value"), F.col("event_type").alias("name"), F.lit("x").alias("extra"), F.col("user_id").alias("CSN"), "ts"), f"{root}/two")
    c = read(spark, d, "customer")
    io.write_csv(c.select(F.col("c_custkey").alias("csn"), F.col("c_nationkey").alias("nation"), text("c_acctbal", F.col("c_custkey") % 3 == 0, "null").alias("Baseline_x")), f"{root}/encounters")
    paths = [f"{root}/{n}" for n in ("one", "two", "encounters")]
    if lacking := io.missing_paths(spark, paths):
        raise FileNotFoundError(", ".join(lacking))
    one, two, enc = (io.read_text_csv(spark, p) for p in paths)
    types = {"csn": "long", "ts": "datetime", "value": "double", "nation": "int", "Baseline_x": "double"}
    rows = io.cast_known(io.harmonise([one, two], {"CSN": "csn", "Value": "value"}, ["extra"]), types)
    io.write_table(io.combine_events([rows], io.cast_known(enc, types), "csn", "ts"), f"{root}/out", "df_all")
    return io.load_folder(spark, f"{root}/out")["df_all"].select("csn", "ts", "name", "value", "nation", "Baseline_x")


@query("""
SELECT user_id AS k, max_by(event_type, ts) AS event_type, max_by(value, ts) AS value, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 9 <> 0 GROUP BY 1""")
def inferred_extract(spark, d):
    path = scratch(spark)
    e = events(spark, d).where("event_id % 9 <> 0")
    io.write_csv(e.select(F.col("user_id").alias("k"), "ts", "event_type", "value", F.lit("None").alias("nothing")), path)
    wide = cut(io.read_csv(spark, path))
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    if kinds != {"k": "bigint", "ts": "timestamp_ntz", "event_type": "string", "value": "double", "nothing": "string"}:
        raise TypeError(f"inferred {kinds}")
    attributes, scores = io.split_extract(wide, "k", "ts", ["event_type", "value"], ["value"])
    per = scores.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return attributes.join(per, "k")
