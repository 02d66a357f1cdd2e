"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Document rates r minimise their relative entropy to 1 under one token constraint per source,
sum(size * r) = target, and the bound r <= 2. The convex dual has one multiplier per source and the
rates are exponentially tilted: r = min(2, exp(lambda * size / mean size)). Newton steps, kept within
a bracket, run for all sources at once over a (source, size) histogram. Rates are then rounded into
whole copies in buckets of about 256 documents that carry the remainder from large to small
documents. Rows equal in source, id and text are counted first and are one entry of a bucket, however
many they are; its copies are dealt evenly to them.

Nulls and odd inputs: a null text has size 0 and takes nothing; a null source is a source of its
own, last in order; repeated rows are documents of their own (in `repeat_documents`, where they are
equal in source, id and text, the one with the least hash of all columns takes the copies of all);
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

#: Weights of the sources in order of name, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash that tells rows of one doc_id apart."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("tie"))


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: n, source_size, target (weighted shares, filled up to `MOST` times the size)."""
    per = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    # one row per source, not per document, is all that these ordered windows see
    w = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(w) - 1) % len(WEIGHTS)) + 1)
    ranked = per.withColumn("weight", weight).withColumn("most", (MOST * F.col("source_size")).cast("double")).withColumn("full_at", F.col("most") / F.col("weight"))
    # water level: sources full below it take all they may, the others share the rest by weight
    up = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (SHARE * F.sum("source_size").over(every) - before) / rest
    levels = ranked.withColumn("level", level).withColumn("open", F.col("full_at") >= F.col("level"))
    # the level counts at the first source, in order of fullness, that it doesn't fill
    first = F.min(F.when(F.col("open"), F.struct("full_at", "level"))).over(every)
    return levels.withColumn("target", F.least("most", F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight"))).select("source", "n", "source_size", "target")


def _newton(hist: DataFrame, state: DataFrame) -> DataFrame:
    """One step of every source's multiplier (lam in [lo, hi])."""
    x = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    free = tilt < MOST
    both = hist.join(state, hist["source"].eqNullSafe(state["source"])).select(state["source"], "count", "size", x.alias("x"), tilt.alias("tilt"), free.alias("free"), *[c for c in state.columns if c != "source"])
    mass = F.col("count") * F.col("size")
    keys = [c for c in state.columns if c != "err"]
    g = both.groupBy(*keys).agg(F.sum(mass * F.least("tilt", F.lit(float(MOST)))).alias("got"), F.sum(F.when(F.col("free"), mass * F.col("x") * F.col("tilt")).otherwise(F.lit(0.0))).alias("slope"))
    gap = F.col("got") - F.col("target")
    g = g.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
    step = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
    fine = step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi"))
    err = F.abs(gap) / F.greatest("target", F.lit(1.0))
    moved = F.when(err < 1e-9, F.col("lam")).when(fine, step).otherwise((F.col("lo") + F.col("hi")) / 2)
    return g.withColumn("err", err).withColumn("lam", moved).select(*state.columns)


def multipliers(sized: DataFrame, per: DataFrame, tolerance: float = 1e-6, rounds: int = 60) -> DataFrame:
    """`per` (from `targets`) with each source's multiplier `lam` and `mean` size."""
    hist = cut(sized.where("size > 0").groupBy("source", "size").count())
    bounds = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("count")) / F.sum("count")).alias("mean"), F.min("size").alias("least"))
    b = bounds.withColumnRenamed("source", "_s")
    start = per.join(b, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # at the upper bound even the smallest document is at its most; the lower bound leaves e^-700
    start = start.withColumn("mean", F.coalesce("mean", F.lit(1.0))).withColumn("lo", F.lit(-700.0) * F.col("mean") / F.coalesce("least", F.lit(1))).withColumn("hi", F.lit(0.6932) * F.col("mean") / F.coalesce("least", F.lit(1)))
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    state = cut(start.where(~full & (F.col("target") > 0)).select("source", "target", "mean", "lo", "hi", F.lit(0.0).alias("lam"), F.lit(1.0).alias("err")))
    for _ in range(rounds):
        state = cut(_newton(hist, state))
        if (state.agg(F.max("err")).first()[0] or 0.0) < tolerance:
            break
    found = state.select(F.col("source").alias("_s"), F.col("lam").alias("_lam"))
    out = start.join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("source", "n", "source_size", "target", "mean", F.when(full, F.col("hi")).otherwise(F.coalesce("_lam", F.lit(0.0))).alias("lam"))


def mix(sized: DataFrame) -> DataFrame:
    """A row for each (source, doc_id, tie): size, source_size, target, `rows` of `sizes`, and their `copies` together (up to 2 each)."""
    sized = cut(sized)
    per = cut(multipliers(sized, cut(targets(sized))))
    p = per.withColumnRenamed("source", "_s")
    rate = F.when(F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    same = sized.groupBy("source", "doc_id", "tie", "size").agg(F.count("*").alias("rows"))
    rated = same.join(p, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "tie", "rows", "source_size", "target", rate.alias("rate"), F.pmod("tie", F.ceil(F.col("n") / 256)).alias("bucket"))
    item = F.struct((-F.col("size")).alias("k"), "tie", "doc_id", "size", "rows", "rate")
    groups = rated.groupBy("source", "bucket", "source_size", "target").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def place(a, x):
        want = F.when(x["size"] > 0, x["rate"] * x["rows"] + a["rest"] / F.greatest(x["size"], F.lit(1))).otherwise(x["rows"].cast("double"))
        n = F.greatest(F.lit(0), F.least(MOST * x["rows"], F.floor(want + 0.5)))
        return F.struct((a["rest"] + (x["rate"] * x["rows"] - n) * x["size"]).alias("rest"), F.concat(a["out"], F.array(n)).alias("out"))

    first = F.struct(F.lit(0.0).alias("rest"), F.array().cast("array<bigint>").alias("out"))
    placed = groups.withColumn("copies", F.aggregate("items", first, place, lambda a: a["out"]))
    flat = placed.select("source", "source_size", "target", F.explode(F.arrays_zip("items", "copies")).alias("_z"))
    return flat.select("_z.items.doc_id", "source", "_z.items.size", "_z.items.tie", "_z.items.rows", "source_size", "target", "_z.copies")


def taken(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words) and copies."""
    out = mix(sizes(docs)).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    copies = (F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("_i") <= F.col("copies") % F.col("rows"), 1).otherwise(0)).cast("int")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, columns unchanged."""
    n = mix(sizes(docs)).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("tie").alias("_t"), F.col("rows").alias("_rows"), F.col("copies").alias("_n"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("_h"), whole)
    same = (F.col("_h") == F.col("_t")) & F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & F.col("_doc.source").eqNullSafe(F.col("_s"))
    joined = keyed.join(n, same)
    single = joined.where("_rows = 1").select("_doc", "_n")
    # of rows equal in source, id and text one stays: the least, found by a partial aggregate in each task
    several = joined.where("_rows > 1").groupBy("_id", "_s", "_t", "_n").agg(F.min_by("_doc", F.struct(F.xxhash64("_doc"), F.to_json("_doc"))).alias("_doc"))
    once = single.unionByName(several.select("_doc", "_n"))
    return once.select(F.explode(F.array_repeat("_doc", F.col("_n").cast("int"))).alias("_doc")).select("_doc.*")
