"""Merkle manifest of a table of documents, and the climb of every leaf to the root.

Documents are leaves, ordered by doc_id within their language; every `FAN` consecutive nodes become
their digest until one is left, the subroot of the language; the subroots likewise give the root.
Leaves are numbered by a range partition and the counts before each partition, so no language has to
fit one task. Each level is one aggregate of `FAN` rows at most.

The levels are stored as node rows linked to their parents, and a recursive query of Spark climbs them:
a row of it is one run of leaves, which share all siblings above their run; each step joins the parent,
appends the siblings there, and folds the digest of every leaf of the run, tampered where its document
is. Near the root many runs meet in one node, so nodes above `BASE` levels are stored once for each
subtree below that height (a `FAN ** BASE`-th of the leaves): no join key has more than
`FAN ** (BASE - 1)` runs.

Nulls and odd inputs: a null field is hashed as `-`; a null language comes first, and null doc_ids
first in it; rows of one doc_id are leaves of their own, ordered by digest; a null doc_id is never
tampered; other columns are ignored; empty tables give empty results. A language is a group of any size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, numbered

FAN, BASE = 8, 3
#: Bytes of a digest.
_D = 32
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: Column) -> Column:
    """SHA-256 as bytes."""
    return F.unhex(F.sha2(data, 256))


def text_of(digests: Column) -> Column:
    """Digests as lowercase hex."""
    return F.lower(F.hex(digests))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf digest, and `start`: the tampered leaf where a third of all hashes says so, else the leaf."""

    def written(c: str, value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def leaf(text: Column) -> Column:
        return digest(F.concat(*[written(c, text if c == "text" else F.col(c)) for c in FIELDS]))

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    out = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(F.translate("text", _AZ, _AZ.lower()))).alias("other"))
    return out.select("doc_id", "lang", "leaf", F.coalesce("other", "leaf").alias("start"))


def depth(n: Column) -> Column:
    """Levels above n leaves."""
    return F.coalesce(*[F.when(n <= FAN**d, F.lit(d)) for d in range(21)])


def above(level: DataFrame) -> DataFrame:
    """The level above (tree, deep, level, place, node) rows: those of trees that go on, with `kids`, the digests below them in order."""
    runs = level.where("level < deep").groupBy("tree", "deep", (F.col("level") + 1).alias("level"), F.expr(f"place div {FAN}").alias("up"))
    kids = F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda x: F.hex(x["node"]))
    joined = runs.agg(F.unhex(F.array_join(kids, "")).alias("kids")).withColumnRenamed("up", "place")
    return cut(joined.withColumn("node", digest(text_of(F.col("kids")))))


def levels(first: DataFrame) -> DataFrame | None:
    """All levels from `first` (level 1, as `above` has it) on, one below the other; None without a row."""
    most = first.agg(F.max("deep")).first()[0]
    if most is None:
        return None
    every = level = first
    for _ in range(1, most):
        level = above(level)
        every = every.unionByName(level)
    return every


def _at(kids: Column, slot: Column) -> Column:
    return F.substring(kids, slot * _D + 1, F.lit(_D))


def _others(kids: Column, slot: Column) -> tuple[Column, Column]:
    """The digests before and after a slot."""
    return F.substring(kids, F.lit(1), slot * _D), F.substring(kids, slot * _D + _D + 1, F.octet_length(kids))


class Manifest:
    """The stored tree of a table of documents.

    runs: a row for each `FAN` consecutive leaves of a language: tree, deep, place, run (doc_id, start),
    kids. nodes: the node rows that the climb joins: tree, step (levels above the leaves, on into the
    tree of subroots), spot, kids, slot in the parent, up_step and up_spot of the parent (null: the root).
    roots: tree, subroot, root.
    """

    def __init__(self, docs: DataFrame) -> None:
        leaf = cut(leaves(docs))
        langs = leaf.groupBy("lang").agg(F.count("*").alias("n"))
        trees = cut(numbered(langs, [], ["lang"], "tree").withColumn("deep", depth(F.col("n"))))
        self.count = trees.count()
        t = bounded_broadcast(trees.select(F.col("lang").alias("_l"), "tree", "deep"), self.count)
        placed = numbered(leaf, ["lang"], ["lang", "doc_id", "leaf"], "place").join(t, F.col("lang").eqNullSafe(F.col("_l")))
        grouped = placed.groupBy("tree", "deep", F.expr(f"place div {FAN}").alias("up"))
        run = grouped.agg(F.sort_array(F.collect_list(F.struct("place", "leaf", "start", "doc_id"))).alias("run")).withColumnRenamed("up", "place")
        kids = F.unhex(F.array_join(F.transform("run", lambda x: F.hex(x["leaf"])), ""))
        self.runs = cut(run.select("tree", "deep", "place", F.transform("run", lambda x: F.struct(x["doc_id"], x["start"].alias("folded"))).alias("run"), kids.alias("kids")))
        first = self.runs.select("tree", "deep", F.lit(1).alias("level"), "place", "kids", digest(text_of(F.col("kids"))).alias("node"))
        inner = levels(first.where("deep > 0"))
        lone = self.runs.where("deep = 0").select("tree", F.col("kids").alias("subroot"))
        subroots = lone if inner is None else lone.unionByName(inner.where("level = deep").select("tree", F.col("node").alias("subroot")))
        subroots = cut(subroots)
        top = None
        if self.count > 1:
            deep = depth(F.lit(self.count))
            top = levels(above(subroots.select(F.lit(-1).alias("tree"), deep.alias("deep"), F.lit(0).alias("level"), F.col("tree").alias("place"), F.col("subroot").alias("node"))))
            root = top.where("level = deep").select(F.col("node").alias("root"))
        else:
            root = subroots.select(F.col("subroot").alias("root"))
        self.roots = cut(subroots.crossJoin(F.broadcast(root)))  # the root is one row
        self.nodes = self._linked(trees, inner, top)

    def links(self, tree: Column, level: Column, deep: Column, place: Column, spot: Column) -> list[Column]:
        """slot, up_step, up_spot of the node at (tree, level, place), seen from `spot`."""
        if self.count < 2:
            last = F.lit(None)
            step, slot = F.when(level < deep, level + 1), F.when(level < deep, place % FAN)
        else:
            last, step, slot = spot, level + 1, F.when(level < deep, place % FAN).otherwise(tree % FAN)
        to = F.when((level < deep) & (level < BASE), F.floor(place / FAN)).when(level < deep, spot).otherwise(last)
        return [slot.cast("int").alias("slot"), step.cast("int").alias("up_step"), to.cast("long").alias("up_spot")]

    def _linked(self, trees: DataFrame, inner: DataFrame | None, top: DataFrame | None) -> DataFrame:
        columns = ["tree", "step", "spot", "kids", "slot", "up_step", "up_spot"]
        bases = F.ceil(F.col("n") / FAN**BASE).cast("long")
        out = None
        if inner is not None:
            size = bounded_broadcast(trees.select("tree", bases.alias("bases")), self.count)
            # a node above BASE once for each of the subtrees of that height under it
            under = F.pow(F.lit(float(FAN)), F.col("level") - BASE).cast("long")
            last = F.least((F.col("place") + 1) * under, F.col("bases")) - 1
            spots = F.when(F.col("level") <= BASE, F.array("place")).otherwise(F.sequence(F.col("place") * under, last))
            # seen from a subtree that ends below BASE, the node's own subtree is the first and only one
            each = inner.join(size, "tree").withColumn("spot", F.explode(spots))
            base = F.when(F.col("level") > BASE, F.col("spot")).when(F.col("level") == BASE, F.col("place")).otherwise(F.lit(0).cast("long"))
            out = each.select("tree", F.col("level").alias("step"), "spot", "kids", *self.links(F.col("tree"), F.col("level"), F.col("deep"), F.col("place"), base))
        if top is not None:
            high = top.agg(F.max("level")).first()[0]
            seen = trees.select("tree", F.col("deep").alias("_deep"), F.explode(F.sequence(F.lit(0).cast("long"), bases - 1)).alias("spot"))
            seen = seen.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(high))))
            at = lambda level: F.floor(F.col("tree") / F.pow(F.lit(float(FAN)), level)).cast("long")
            seen = seen.withColumn("place", at(F.col("level")))
            own = top.select("level", "place", "kids")
            both = seen.join(bounded_broadcast(own, own.count()), ["level", "place"])
            more = F.col("level") < high
            over = both.select(
                "tree", (F.col("_deep") + F.col("level")).alias("step"), "spot", "kids", F.when(more, F.col("place") % FAN).cast("int").alias("slot"),
                F.when(more, F.col("_deep") + F.col("level") + 1).cast("int").alias("up_step"), F.when(more, F.col("spot")).alias("up_spot"),
            )
            out = over if out is None else out.select(*columns).unionByName(over)
        if out is None:
            spark = trees.sparkSession
            out = spark.createDataFrame([], "tree long, step int, spot long, kids binary, slot int, up_step int, up_spot long")
        return cut(out.select(*columns))

    def climb(self) -> DataFrame:
        """tree, run (doc_id, folded root), kids of each run, and the siblings above it up to the root."""
        spark = self.runs.sparkSession

        def folded(kids: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                before, after = _others(kids, i)
                return F.struct(x["doc_id"].alias("doc_id"), digest(text_of(F.concat(before, x["folded"], after))).alias("folded"))

            return F.transform("run", one)

        up = self.links(F.col("tree"), F.least(F.lit(1), "deep"), F.col("deep"), F.col("place"), F.col("place") if BASE == 1 else F.lit(0))
        start = self.runs.select("tree", F.when(F.col("deep") > 0, folded(F.col("kids"))).otherwise(F.col("run")).alias("run"), "kids", F.lit(b"").alias("proof"), *up)
        name = uuid.uuid4().hex
        start.createOrReplaceTempView(f"runs_{name}")
        self.nodes.createOrReplaceTempView(f"nodes_{name}")
        before, after = f"substring(n.kids, 1, {_D} * c.slot)", f"substring(n.kids, {_D} * c.slot + {_D + 1}, {_D * FAN})"
        query = f"""
            WITH RECURSIVE climb (tree, run, kids, proof, slot, up_step, up_spot) AS (
              SELECT tree, run, kids, proof, slot, up_step, up_spot FROM runs_{name}
              UNION ALL
              SELECT c.tree, transform(c.run, x -> named_struct('doc_id', x.doc_id, 'folded', unhex(sha2(lower(hex(concat({before}, x.folded, {after}))), 256)))),
                c.kids, concat(c.proof, {before}, {after}), n.slot, n.up_step, n.up_spot
              FROM climb c JOIN nodes_{name} n ON n.tree = c.tree AND n.step = c.up_step AND n.spot = c.up_spot)
            SELECT tree, run, kids, proof FROM climb WHERE up_step IS NULL"""
        # the steps are few (one a level), but their rows are as many as the runs
        kept = spark.conf.get("spark.sql.cteRecursionRowLimit")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        try:
            return cut(spark.sql(query))
        finally:
            spark.conf.set("spark.sql.cteRecursionRowLimit", kept)
            for view in (f"runs_{name}", f"nodes_{name}"):
                spark.catalog.dropTempView(view)


def verify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    manifest = Manifest(docs)
    each = manifest.climb().select("tree", "kids", "proof", F.posexplode("run").alias("i", "x"))
    roots = bounded_broadcast(manifest.roots, manifest.count)
    before, after = _others(F.col("kids"), F.col("i"))
    out = each.join(roots, "tree").select(
        "x.doc_id", text_of(_at(F.col("kids"), F.col("i"))).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"),
        F.sha2(text_of(F.concat(before, after, "proof")), 256).alias("proof_sha256"), text_of(F.col("x.folded")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """SQL with the rows of `verify`."""
    def hashed(text: str) -> str:
        values = [text if c == "text" else c for c in FIELDS]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + "))"

    # CRC-32, bit by bit over the digits
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
    digits = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {bits}), 4294967295)"
    sides = f"""coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, place // {FAN} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, place // {FAN} ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"""

    def tree(name: str, first: str) -> str:
        return f"""{name} AS ({first}
  UNION ALL SELECT tree, level + 1, place // {FAN}, sha256(string_agg(node, '' ORDER BY place)), (n + {FAN - 1}) // {FAN} FROM {name} WHERE n > 1 GROUP BY tree, level, place // {FAN}, n)"""

    def climb(name: str, first: str, family: str) -> str:
        return f"""{name} AS ({first}
  UNION ALL SELECT rid, c.tree, c.level + 1, c.place // {FAN}, sha256(concat(before, fold, after)), concat(proof, before, after)
  FROM {name} c JOIN {family} f ON f.tree = c.tree AND f.level = c.level AND f.place = c.place)"""

    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, {hashed("text")} AS leaf,
    CASE WHEN {crc} % 3 = 0 THEN {hashed(f"translate(text, '{_AZ}', '{_AZ.lower()}')")} END AS other FROM documents),
trees AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves GROUP BY lang),
placed AS MATERIALIZED (
  SELECT rid, doc_id, leaf, coalesce(other, leaf) AS fold, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM leaves JOIN trees ON leaves.lang IS NOT DISTINCT FROM trees.lang),
{tree("inside", "SELECT tree, 0 AS level, place, leaf AS node, n FROM placed")},
sub AS MATERIALIZED (SELECT tree, level, node FROM inside WHERE n = 1),
{tree("top", "SELECT 0 AS tree, 0 AS level, tree AS place, node, (SELECT count(*) FROM sub) AS n FROM sub")},
under AS MATERIALIZED (SELECT tree, level, place, {sides} FROM inside WHERE n > 1),
over AS MATERIALIZED (SELECT tree, level, place, {sides} FROM top WHERE n > 1),
{climb("low", "SELECT rid, tree, 0 AS level, place, fold, '' AS proof FROM placed", "under")},
{climb("high", "SELECT rid, 0 AS tree, 0 AS level, low.tree AS place, fold, proof FROM low JOIN sub USING (tree, level)", "over")}
SELECT doc_id, leaf, sub.node AS subroot, top.node AS root, sha256(proof) AS proof_sha256, high.fold AS folded_root, high.fold = top.node AS verified
FROM placed JOIN high USING (rid) JOIN top ON top.n = 1 AND top.level = high.level JOIN sub ON sub.tree = placed.tree"""
