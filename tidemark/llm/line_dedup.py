"""Line deduplication by a segment-partition edit join (DataFrame functions only).

Lines of at least `MIN_CHARS` code points take part; with `short`, as in the query and the pipeline's
stage, shorter ones with a word do as exact copies. Equal lines are grouped by hash first. Distinct
lines within `THRESHOLD` edits are found by the pigeonhole principle: a line is split into
threshold + 1 segments, at least one of which survives in any line within the threshold, near its
place. Segments index a line under (its length, segment number, text); a probe looks up, for each
length it may match, the substrings at the shifts that can still agree (multi-match-aware). Candidates
are verified with a banded bit-parallel edit distance. Segments that very many lines share are refined
by the segments of what the lines hold besides (see `candidates`). The first line (by doc_id, line number) of
each connected group stays, the others go.

Nulls and odd inputs: a null text has no lines and stays null; blank lines of less than `MIN_CHARS`
always stay, short ones too without `short`; a text may become empty, its document stays; rows of one
doc_id (or without one) are told apart by a 64-bit hash of their texts, which orders them too; rows equal
in both are one document, of which every copy keeps the same lines; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, let
from .components import components

MIN_CHARS, THRESHOLD = 20, 1
#: Distinct lines indexed under one segment that are compared as they are; a segment with more is refined.
MOST = 128
#: Bits of the word that holds the band; sums of two words stay within a long.
_W = 48


def segments(length: Column, t: int) -> list[tuple[Column, Column]]:
    """(start, size), 1-based, of the t + 1 segments of a line; the last ones are longer by one."""
    base, longer = F.floor(length / (t + 1)), length % (t + 1)
    out, at = [], F.lit(1)
    for k in range(t + 1):
        size = (base + F.when(longer > t - k, F.lit(1)).otherwise(F.lit(0))).cast("int")
        out.append((at, size))
        at = at + size
    return out


def spots(n: Column, t: int) -> list[tuple[int, Column, Column, Column]]:
    """(segment, length of the indexed line, start, size) of the substrings that a line of n characters looks up.

    The first t + 1 are its own segments, under which it is indexed and which serve as its probes for
    equal shift and length; the others are probes for lines that aren't longer.
    """
    own = [(k, n, at, size) for k, (at, size) in enumerate(segments(n, t))]
    more = []
    for less in range(t + 1):
        for k, (at, size) in enumerate(segments(n - less, t)):
            lo, hi = max(-k, less - (t - k)), min(k, less + (t - k))
            more += [(k, n - less, at + shift, size) for shift in range(lo, hi + 1) if less or shift]
    return own + more


def spot_keys(line: Column, n: Column, t: int, under: Column) -> Column:
    """The keys of `spots`, in that order; null where there is no such substring."""
    keys = []
    for i, (k, other, at, size) in enumerate(spots(n, t)):
        key = F.xxhash64(under, other, F.lit(k), F.substring(line, at, size))
        keys.append(key if i <= t else F.when((other >= 0) & (at >= 1) & (at + size - 1 <= n), key))
    return F.array(*keys)


def edit_within(a: Column, b: Column, t: int) -> Column:
    """Whether the edit distance of a and b is at most t: Hyyro's banded bit-vectors, one word a row.

    Row j of the distance table is held as vertical differences around the diagonal; the top bit
    stands for row j + t. The distance follows the diagonal, then the last row.
    """
    full, top = (1 << _W) - 1, 1 << (_W - 1)
    na, nb = F.length(a), F.length(b)

    def run(chars: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), nb - 1), first, lambda s, j: F.when(s["d"] > 2 * t + nb - na, s).otherwise(step(chars, s, j)), lambda s: s["d"])

    def step(chars: Column, s: Column, j: Column) -> Column:
        """State after character j (0-based) of b; a distance that can't come back to t stays as it is."""
        c = F.get(chars["b"], j)
        match = F.lit(0).cast("long")
        for k in range(2 * t + 1):
            at = j + t - k  # 0-based row of a at bit top - k
            match = match + F.when((at >= 0) & (at < na) & (F.get(chars["a"], at) == c), F.lit(1 << (_W - 1 - k)).cast("long")).otherwise(F.lit(0).cast("long"))

        def rest(x: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            summed = (x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full))
            d0 = summed.bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)

            def tail(d: Column) -> Column:
                hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d.bitwiseOR(vp)))
                hn = d.bitwiseAND(vp)
                half = F.shiftright(d, 1)
                diagonal = j < na - t
                # past the diagonal part the last row of a lies below the top bit by this many
                down = F.greatest(F.lit(0), j - (na - t) + 1).cast("int")
                bit = F.element_at(F.array(*[F.lit(top >> i).cast("long") for i in range(2 * t + 2)]), F.least(down, F.lit(2 * t + 1)) + 1)
                along = F.when(hp.bitwiseAND(bit) != 0, F.lit(1)).when(hn.bitwiseAND(bit) != 0, F.lit(-1)).otherwise(F.lit(0))
                cost = F.when(diagonal, F.when(d.bitwiseAND(F.lit(top)) != 0, F.lit(0)).otherwise(F.lit(1))).otherwise(along)
                nvp = hn.bitwiseOR(F.lit(full).bitwiseXOR(half.bitwiseOR(hp)))
                return F.struct(nvp.alias("vp"), half.bitwiseAND(hp).alias("vn"), (s["d"] + cost).cast("int").alias("d"))

            return let(d0, tail)

        return let(match, rest)

    vp = (full << (_W - t - 1)) & full
    first = F.struct(F.lit(vp).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(t).cast("int").alias("d"))
    dist = let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), run)
    # texts shorter than the band don't fill its word
    return F.when(F.abs(na - nb) > t, F.lit(False)).when(F.least(na, nb) <= t, F.levenshtein(a, b) <= t).otherwise(dist <= t)


def _prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by bisection."""
    lo_hi = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).alias("hi"))

    def half(s: Column, _: Column) -> Column:
        return let(
            F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int"),
            lambda m: F.when(F.substring(a, s["lo"] + 1, m - s["lo"]) == F.substring(b, s["lo"] + 1, m - s["lo"]), F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (m - 1).alias("hi"))),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.length(a) + F.length(b) + 2)).cast("int"))
    return F.aggregate(steps, lo_hi, lambda s, i: F.when(s["lo"] < s["hi"], half(s, i)).otherwise(s), lambda s: s["lo"])


def near(x: Column, y: Column, t: int) -> Column:
    """`edit_within` of what is left without the equal ends, which cost no edit, but for t + 1 characters of each.

    Those fill the band, so that the bit vectors decide. All is one expression: a filter that Spark
    pushes down computes every part once.
    """

    def ends(s: Column, n: Column) -> Column:
        return F.struct(*[F.substring(s[c], n + 1, F.length(s[c])).alias(c) for c in "xy"])

    def turned(s: Column) -> Column:
        return F.struct(*[F.reverse(s[c]).alias(c) for c in "xy"])

    def trim(s: Column) -> Column:
        return let(F.greatest(_prefix(s["x"], s["y"]) - t - 1, F.lit(0)), lambda n: ends(s, n))

    pair = F.struct(x.alias("x"), y.alias("y"))
    middle = let(let(let(pair, trim), turned), trim)  # reversed, which leaves the distance as it is
    return let(middle, lambda m: edit_within(m["x"], m["y"], t))


def row_key() -> Column:
    """What tells a row from others: its doc_id, and the hash of its text in case ids repeat."""
    return F.struct("doc_id", F.xxhash64("text").alias("tie"))


def _lines(docs: DataFrame, min_chars: int, short: bool = False) -> DataFrame:
    part = F.length("line") >= min_chars
    if short:
        part = part | F.col("line").rlike(r"[^\x20\x09-\x0D]")
    flat = docs.select(row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias("ln", "line")).where(part)
    return flat.withColumn("n", F.length("line")).withColumn("h", F.xxhash64("line")).withColumn("g", F.hash("line"))


def _looked_up(rests: DataFrame, t: int) -> DataFrame:
    """(h, rest, n, own, p, key): a row for each of the spots of `rest`, p its number; only an own line is indexed."""
    keys = spot_keys(F.col("rest"), F.col("n"), t, F.col("under"))
    each = rests.withColumn("n", F.length("rest")).select("h", "rest", "n", F.col("own").alias("_own"), F.posexplode(keys).alias("p", "key"))
    return each.where("key is not null").select("h", "rest", "n", (F.col("_own") & (F.col("p") <= t)).alias("own"), "p", "key")


def candidates(line: DataFrame, t: int = THRESHOLD, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of distinct lines, by hash, that share a segment, and all that are within t edits.

    A segment that more than `most` distinct lines are indexed under isn't compared as it stands: with
    it cut out, lines within t edits leave rests within t edits, so its lines go on under the segments
    of their rests, until no segment is crowded or at most t characters are left.
    """
    found: DataFrame | None = None
    rows = _looked_up(line.select("h", F.col("line").alias("rest"), F.lit(0).cast("long").alias("under"), F.lit(True).alias("own")), t)
    while True:
        left = F.col("n") - F.floor(F.col("n") / (t + 1)) - 1  # at least, once the segment is cut out
        owners = rows.where(F.col("own") & (left > t)).select("key", "h").distinct()
        crowded = cut(owners.groupBy("key").count().where(F.col("count") > most).select("key"))
        n = crowded.count()
        hot = bounded_broadcast(crowded, n)
        fit = rows.join(hot, "key", "left_anti") if n else rows
        keyed = fit.groupBy("key", "h").agg(F.max("own").alias("own"))
        mine = keyed.where("own").select("key", F.col("h").alias("a"))
        # probes for equal length are the index keys themselves: those pairs come up twice, once is enough
        both = keyed.withColumnRenamed("h", "b").join(mine, "key").where("a < b or (a > b and not own)")
        pairs = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = pairs if found is None else cut(found.union(pairs).distinct())
        if not n:
            return found
        each = spots(F.col("n"), t)
        at, size = (F.get(F.array(*[x[i].cast("int") for x in each]), F.col("p")) for i in (2, 3))
        rest = F.concat(F.substring("rest", F.lit(1), at - 1), F.substring("rest", at + size, F.col("n")))
        inside = rows.join(hot, "key", "left_semi").select("h", rest.alias("rest"), F.col("key").alias("under"), "own")
        rows = _looked_up(cut(inside.distinct()), t)


def near_pairs(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of distinct lines, by hash, within t edits of each other."""
    line = _lines(docs, min_chars)
    pairs = candidates(line, t, most)
    # one long a row: broadcast up to a counted limit, so that the texts of all lines needn't be shuffled
    wanted = cut(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    wanted = bounded_broadcast(wanted, wanted.count(), 1_000_000)
    texts = cut(line.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")))
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    # few rows, much work in each
    both = both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.where(near(F.col("x"), F.col("y"), t)).select("a", "b")


def removals(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """(row, exact, near): the 0-based numbers of the lines that go, as copies and as near copies, by `row_key`."""
    docs = docs.select("doc_id", "text")
    place = F.struct("row", "ln")
    firsts = cut(_lines(docs, min_chars, short).groupBy("h", "g", "n").agg(F.min(place).alias("first"), F.count("*").alias("copies")))
    comp = components(near_pairs(docs, t, min_chars))
    grouped = firsts.join(comp, firsts["h"] == comp["node"])
    keeper = grouped.groupBy("component").agg(F.min("first").alias("keeper"))
    of = grouped.join(keeper, "component").select("h", "g", "n", "first", "copies", "keeper")
    rest = firsts.join(comp, firsts["h"] == comp["node"], "left_anti").where("copies > 1").select("h", "g", "n", "first", "copies", F.col("first").alias("keeper"))
    marked = cut(of.union(rest).where("copies > 1 or first <> keeper"))
    gone = _lines(docs, min_chars, short).select("row", "ln", "h", "g", "n").join(marked, ["h", "g", "n"]).where(place != F.col("keeper"))
    # rows equal in id and text bring each of their lines as often as there are rows
    per = gone.groupBy("row").agg(F.collect_set(F.when(F.col("first") == F.col("keeper"), F.col("ln"))).alias("exact"), F.collect_set(F.when(F.col("first") != F.col("keeper"), F.col("ln"))).alias("near"))
    return per


def _kept(text: Column, drop: Column) -> Column:
    def rest(lines: Column) -> Column:
        # a set difference of the numbers: linear in the lines, however many go
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i)), "\n")

    return F.when(drop.isNull() | (F.size(drop) == 0), text).otherwise(let(F.split(text, "\n"), rest))


def _same_row() -> Column:
    return (F.col("_key.tie") == F.col("_row.tie")) & F.col("_key.doc_id").eqNullSafe(F.col("_row.doc_id"))


def drop_lines(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """The documents without repeated lines; other columns unchanged, n_chars (if there) counted anew."""
    gone = cut(removals(docs, t, min_chars, short)).select(F.col("row").alias("_row"), F.concat("exact", "near").alias("_drop"))
    # the row travels as one struct, so no name of it can clash
    rows = docs.select(row_key().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    # as many rows as there are documents with repeats: never broadcast, at no size
    joined = rows.join(gone.hint("merge"), _same_row(), "left")
    out = joined.select(F.col("_doc").withField("text", _kept(F.col("_doc.text"), F.col("_drop"))).alias("_doc"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("_doc").withField("n_chars", F.length("_doc.text").cast(docs.schema["n_chars"].dataType)).alias("_doc"))
    return out.select("_doc.*")


def report(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """Per document: doc_id, n_lines, n_exact, n_near (lines that go), kept_sha256 of what stays."""
    gone = cut(removals(docs, t, min_chars, short)).select(F.col("row").alias("_row"), "exact", "near")
    joined = docs.select("doc_id", "text", row_key().alias("_key")).join(gone.hint("merge"), _same_row(), "left")
    text = F.coalesce(_kept(F.col("text"), F.concat("exact", "near")), F.lit(""))
    return joined.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("exact"), F.lit(0)).cast("long").alias("n_exact"), F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
