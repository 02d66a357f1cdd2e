"""URL filter: explicit host and path rules, then a path-template tree per host.

Levels of the tree are grown from the root for all hosts at once. At each level a segment becomes a
wildcard if it is a number or hash, or if its parent has many children of which it is a small one.
Then sibling branches (equal but for one segment) are merged from the leaves up, level by level, unless
the good share of a branch's labelled urls is significantly apart from that of all its siblings. A
template is rejected if its labelled purity, shrunk to that of its host and of all urls, is below
`FLOOR` times the share of all urls. Explicit rules go before it.

Nulls and odd inputs: a null url, or one without `://`, has empty host and path and is judged like
any other; null labels count for nothing; without labels nothing is rejected; repeated rows get equal
results; empty tables give empty results. What a path has beyond `LEVELS` segments is one last segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
LEVELS, CHILDREN, SHARE, STRENGTH, Z, FLOOR = 16, 8, 0.05, 10.0, 2.0, 0.85


def host(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    got = F.when(F.locate("://", url) > 0, F.regexp_extract(rest, "^[^/?#]*", 0)).otherwise(F.lit(""))
    return F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _fits(rule: str) -> Column:
    domain, _, rest = rule.partition("/")
    return ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + rest)


def parts(pages: DataFrame, *keep: str) -> DataFrame:
    p = pages.select(*keep, F.coalesce("url", F.lit("")).alias("_u"))
    p = p.select(*keep, host(F.col("_u")).alias("host"), path(F.col("_u")).alias("path"))
    by_length = sorted(RULES, key=len, reverse=True)
    return p.withColumn("rule", F.coalesce(*[F.when(_fits(r), F.lit(r)) for r in by_length]))


def _shape(seg: Column) -> Column:
    """Numbers and hashes are variable wherever they stand."""
    return F.when(seg.rlike(r"^[0-9]+(\.[a-z0-9]+)?$"), F.regexp_replace(seg, "^[0-9]+", "*")).when(seg.rlike("^[0-9a-f-]{8,}$") & seg.rlike("[0-9]"), F.lit("*")).otherwise(seg)


def segments(path: Column) -> Column:
    """The shapes of a path's segments; those beyond `LEVELS` are joined to one."""
    s = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), _shape)
    return F.when(F.size(s) > LEVELS, F.concat(F.slice(s, 1, LEVELS), F.array(F.array_join(F.slice(s, LEVELS + 1, F.size(s)), "/")))).otherwise(s)


def _small(df: DataFrame) -> DataFrame:
    """A table of tree nodes, written; broadcast if it has few rows."""
    df = cut(df)
    return bounded_broadcast(df, df.count())


def templates(urls: DataFrame) -> DataFrame:
    """`urls` (with host, path) with `template`, an array, level by level over counts of (host, parent, segment)."""
    grown = urls.withColumn("_s", segments(F.col("path")))
    tree = cut(grown.groupBy("host", "_s").agg(F.count("*").alias("_n")).withColumn("template", F.array().cast("array<string>")))
    for k in range(tree.agg(F.max(F.size("_s"))).first()[0] or 0):
        here = tree.withColumn("_g", F.get("_s", F.lit(k)))
        kids = cut(here.where("_g is not null").groupBy("host", "template", "_g").agg(F.sum("_n").alias("_c")))
        many = kids.groupBy("host", "template").agg(F.count("*").alias("_kids"), F.sum("_c").alias("_all")).where(F.col("_kids") > CHILDREN)
        rare = _small(kids.join(many, ["host", "template"]).where(F.col("_c") < SHARE * F.col("_all")).select("host", "template", "_g", F.lit("*").alias("_rare")))
        step = here.join(rare, ["host", "template", "_g"], "left")
        longer = F.concat("template", F.array(F.coalesce("_rare", "_g")))
        tree = cut(step.select("host", "_s", "_n", F.when(F.col("_g").isNull(), F.col("template")).otherwise(longer).alias("template")))
    found = _small(tree.select(F.col("host").alias("_h"), F.col("_s").alias("_k"), "template"))
    return grown.join(found, (F.col("host") == F.col("_h")) & (F.col("_s") == F.col("_k"))).drop("_s", "_h", "_k")


def merge(node: DataFrame) -> DataFrame:
    """`node` (host, template, n labelled, g good) with `merged`: the template with `~` where siblings were merged."""
    rows = node.withColumn("merged", F.col("template"))
    for k in reversed(range(node.agg(F.max(F.size("template"))).first()[0] or 0)):
        masked = F.when(F.size("merged") > k, F.concat(F.slice("merged", 1, k), F.array(F.lit("~")), F.slice("merged", k + 2, F.greatest(F.size("merged") - k - 1, F.lit(0)))))
        now = rows.groupBy("host", "merged").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).withColumn("mask", masked)
        pool = now.where("mask is not null").groupBy("host", "mask").agg(F.count("*").alias("m"), F.sum("n").alias("kn"), F.sum("g").alias("kg")).where("m > 1")
        rate = F.when(F.col("kn") > 0, F.col("kg") / F.col("kn"))
        # a branch without labels can't be apart
        apart = F.coalesce(F.abs(F.col("g") / F.nullif("n", F.lit(0)) - rate) > Z * F.sqrt(rate * (1 - rate) / F.nullif("n", F.lit(0))), F.lit(False))
        moved = _small(now.join(pool, ["host", "mask"]).where(~apart).select("host", "merged", "mask"))
        rows = cut(rows.join(moved, ["host", "merged"], "left").withColumn("merged", F.coalesce("mask", "merged")).drop("mask"))
    return rows


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity.

    `labels` (doc_id, quality, toxic) tells good documents; a url stands for the document whose
    number (of 18 digits at most, as ids have) ends its path. Rules set the verdict of the urls that they fit.
    """
    # the text of a url decides all but page_id: hot urls are counted, then joined back
    p = cut(parts(pages, "page_id", "url"))
    urls = p.select("url", "host", "path").distinct()
    number = F.regexp_extract("path", r"(?<![0-9])([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("long")
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double")
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(good).alias("good"))
    shaped = cut(templates(urls.withColumn("_d", number)).join(label, F.col("_d") == F.col("doc_id"), "left").select("url", "host", "path", "template", "good"))
    node = cut(shaped.groupBy("host", "template").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g")))
    tree = merge(node)
    total = F.broadcast(node.agg(((F.sum("g") + 1) / (F.sum("n") + 2)).alias("all")))  # one row
    hosts = node.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("g").alias("hg"))
    pooled = tree.groupBy("host", "merged").agg(F.sum("n").alias("kn"), F.sum("g").alias("kg"))
    base = (F.col("hg") + STRENGTH * F.col("all")) / (F.col("hn") + STRENGTH)
    purity = (F.col("kg") + STRENGTH * base) / (F.col("kn") + STRENGTH)
    rated = pooled.join(hosts, "host").crossJoin(total).select("host", "merged", purity.alias("purity"), (purity < FLOOR * F.col("all")).alias("rejected"))
    of = _small(tree.select("host", "template", "merged").join(rated, ["host", "merged"]))
    found = cut(shaped.select("url", "host", "template").join(of, ["host", "template"]).select(F.col("url").alias("_url"), F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity", "rejected"))
    out = p.join(found, F.col("url").eqNullSafe(F.col("_url")))
    rule = F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("rule"))
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(rule, method).alias("verdict"), "template", "purity")
