"""Quality rules with host-level verdicts (DataFrame functions only).

Base rules judge each document. Host-level rules then aggregate the failures of every rule by host
(`source`), shrink each host's failure rate with a beta prior fitted to all hosts by the method of
moments, and join the verdict of a host back to its documents.

Nulls and odd inputs: a null text has no words and fails the base rule; null hosts form one host of
their own; empty tables give empty results; other columns are ignored by `judge` and kept by `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, let, words

#: Rule name -> highest shrunk failure rate that a host may have.
HOST_LIMITS = {"short": 0.8, "repeat": 0.6, "symbols": 0.6, "dup_lines": 0.6}


def _repeat_words(w: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text."""
    grams = F.transform(F.slice(w, 1, F.size(w) - 7), lambda _, i: F.xxhash64(F.slice(w, i + 1, 8)))

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
                | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"])),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        return F.aggregate(
            let(ranked, starts),
            F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(8), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))
    return F.when(F.size(w) >= 8, some).otherwise(F.lit(0)).cast("long")


def metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of each document with its base counts and `base_failed`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        let(
            words(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ),
        # in the same expression, so that a filter on it computes the counts once
        lambda c: F.struct(c.alias("m"), ((c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])).alias("base_failed")),
    )
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    # one nested column, unpacked in the next step, so that nothing is computed twice
    packed = docs.select(*keep, F.struct(counts.alias("c"), symbols.cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines")).alias("_m"))
    return packed.select(*keep, "_m.c.m.n_words", "_m.c.m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.c.m.n_repeat_words", "_m.c.base_failed")


def rule_failures() -> dict[str, Column]:
    """What counts as a failure of each rule, over the columns of `metrics`."""
    return {
        "short": F.col("n_words") < 20,
        "repeat": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") > 0.3 * F.col("n_words") / 10 + 3,
    }


def host_verdicts(m: DataFrame) -> DataFrame:
    """One row per host: documents, failures and shrunk rate of each rule, `host_rejected`.

    With host rates r of mean mu and variance v, the prior has strength mu(1-mu)/v - 1, held
    between 1 and 1000 documents; equal rates or a single host give 1000.
    """
    rules = rule_failures()
    hosts = m.groupBy("source").agg(F.count("*").alias("n_docs"), *[F.count_if(c).alias(f"f_{r}") for r, c in rules.items()])
    rates = {r: F.col(f"f_{r}") / F.col("n_docs") for r in rules}
    prior = hosts.agg(
        *[(F.sum(f"f_{r}") / F.sum("n_docs")).alias(f"mu_{r}") for r in rules],
        *[F.coalesce(F.var_pop(x), F.lit(0.0)).alias(f"v_{r}") for r, x in rates.items()],
    )
    joined = hosts.crossJoin(F.broadcast(prior))  # the prior is one row
    for r in rules:
        mu, v = F.col(f"mu_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), mu * (1 - mu) / v - 1))).otherwise(F.lit(1000.0))
        joined = joined.withColumn(f"rate_{r}", (F.col(f"f_{r}") + strength * mu) / (F.col("n_docs") + strength))
    bad = F.lit(False)
    for r, limit in HOST_LIMITS.items():
        bad = bad | (F.col(f"rate_{r}") > limit)
    return joined.select("source", "n_docs", *[f"rate_{r}" for r in rules], bad.alias("host_rejected"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: counts, `base_failed`, `host_rejected`, `kept`."""
    m = cut(metrics(docs, "doc_id", "source"))
    hosts = cut(host_verdicts(m))
    h = bounded_broadcast(hosts.select(F.col("source").alias("_h"), "host_rejected"), hosts.count())
    out = m.join(h, F.col("source").eqNullSafe(F.col("_h")), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rejected",
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and whose host isn't rejected, columns unchanged.

    The texts aren't shuffled: the second pass judges them anew and only looks hosts up.
    """
    hosts = cut(host_verdicts(metrics(docs, "source")))
    bad = hosts.where("host_rejected").select(F.col("source").alias("_h"), F.lit(True).alias("_bad"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    fine = metrics(docs.select("text", "source", whole), "source", "_doc").where("not base_failed")
    out = fine.join(bounded_broadcast(bad, bad.count()), F.col("source").eqNullSafe(F.col("_h")), "left_anti")
    return out.select("_doc.*")


def oracle_sql() -> str:
    """SQL with the rows of `judge`."""
    rates = ", ".join(f"(f_{r} + k_{r} * mu_{r}) / (n_docs + k_{r}) AS rate_{r}" for r in HOST_LIMITS)
    totals = ", ".join(f"sum(f_{r}) / sum(n_docs)::DOUBLE AS mu_{r}, var_pop(f_{r} / n_docs::DOUBLE) AS v_{r}" for r in HOST_LIMITS)
    strengths = ", ".join(f"CASE WHEN v_{r} > 0 THEN least(1000.0, greatest(1.0, mu_{r} * (1 - mu_{r}) / v_{r} - 1)) ELSE 1000.0 END::DOUBLE AS k_{r}" for r in HOST_LIMITS)
    rejected = " OR ".join(f"rate_{r} > {limit}" for r, limit in HOST_LIMITS.items())
    nexts = ", ".join(f"lead(word, {k}) OVER p" for k in range(1, 8))
    return f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
u AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, lead(i, 7) OVER p AS last, concat_ws(' ', word, {nexts}) AS gram FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
d AS (SELECT rid, i FROM g WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
r AS (SELECT rid, sum(least(8, gap)) AS n FROM (SELECT rid, i - lag(i, 1, -8) OVER (PARTITION BY rid ORDER BY i) AS gap FROM d) GROUP BY rid),
c AS (SELECT rid, sum(length(word)) AS n FROM u GROUP BY rid),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (rid) LEFT JOIN r USING (rid)),
f AS (
  SELECT source, count(*) AS n_docs, count(*) FILTER (n_words < 20) AS f_short,
    count(*) FILTER (100 * n_repeat_words > 30 * n_words) AS f_repeat, count(*) FILTER (10 * n_symbols > word_chars) AS f_symbols,
    count(*) FILTER (n_dup_lines > 0.3::DOUBLE * n_words / 10 + 3) AS f_dup_lines
  FROM m GROUP BY source),
prior AS (SELECT *, {strengths} FROM (SELECT {totals} FROM f)),
h AS (SELECT source, {rejected} AS host_rejected FROM (SELECT source, {rates} FROM f, prior)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source"""
