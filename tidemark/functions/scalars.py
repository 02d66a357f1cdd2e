"""Column expressions for cleaning clinical text and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")


def hours_between(start: str, end: str) -> Column:
    """Fractional hours from start to end."""
    return (micros(end) - micros(start)) / HOUR


def whole_hours_between(start: str, end: str) -> Column:
    """Whole hours, toward zero."""
    return F.expr(f"timestampdiff(HOUR, `{start}`, `{end}`)")


def plus_hours(ts: str, hours: float) -> Column:
    return F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))


def null_tokens(c: Column, tokens: Sequence[str] = ("Null", "NULL", "null")) -> Column:
    return F.when(~c.isin(*tokens), c)


def part(c: Column, sep: str, k: int) -> Column:
    """The k-th part (from 1; -1 the last) of a separated text, null if there is none."""
    return F.try_element_at(F.split(c, sep), F.lit(k))


def systolic(text: Column) -> Column:
    """120 from "120/80"; null if it doesn't parse."""
    return part(text, "/", 1).try_cast("double")


def mean_arterial(text: Column) -> Column:
    """(s + 2d) / 3 to one decimal from "s/d", only if both are above 0 and s >= d."""
    s = F.trim(part(text, "/", 1)).try_cast("double")
    d = F.trim(part(text, "/", 2)).try_cast("double")
    return F.when((s > 0) & (d > 0) & (s >= d), F.round((s + 2 * d) / 3, 1))


def censored_number(text: Column, above: float, below: float) -> Column:
    """Numbers as they are; ">x" as x + above, "<x" as x - below."""
    n = F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")
    return F.when(text.startswith(">"), n + above).when(text.startswith("<"), n - below).otherwise(text.try_cast("double"))


def category(code: Column) -> Column:
    """The part of "NPOA-3" before the dash."""
    return part(code, "-", 1)


def severity(code: Column) -> Column:
    """The number of "NPOA-3"."""
    return F.regexp_extract(code, r"(\d+)\s*$", 1).try_cast("int")


def normal_code(code: Column, fold: dict[str, str] | None = None) -> Column:
    """"POA - 3" as "POA-3"; prefixes renamed by `fold`."""
    out = F.regexp_replace(F.trim(code), r"\s*-\s*", "-")
    for old, new in (fold or {}).items():
        out = F.regexp_replace(out, f"^{old}-", f"{new}-")
    return out


def yes_no(text: Column) -> Column:
    return F.when(text.isNotNull(), F.lower(F.trim(text)).startswith("y").cast("int"))


def percent_text(text: Column) -> tuple[Column, Column]:
    """(12.3, 45) from "12.3% (n=45)"; (0.0, 0) if it doesn't parse."""
    shape = r"^\s*([0-9.]+)%\s*\(n=([0-9]+)\)\s*$"
    pct = F.regexp_extract(text, shape, 1).try_cast("double")
    n = F.regexp_extract(text, shape, 2).try_cast("int")
    return F.coalesce(pct, F.lit(0.0)), F.coalesce(n, F.lit(0))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def ladder(value: Column, steps: Sequence[tuple[float, int]], below: bool) -> Column:
    """Points of the first threshold that holds: value < t if below, else value >= t; 0 if none; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for t, points in steps:
        out = out.when(value < t if below else value >= t, F.lit(points))
    return out.otherwise(F.lit(0))


def any_of(flags: Sequence[Column], null_mode: str = "as_zero") -> Column:
    """1 if a flag is 1. as_zero: null flags are 0; propagate: any null flag makes the result null."""
    out = None
    for f in flags:
        f = F.coalesce(f, F.lit(0)) if null_mode == "as_zero" else f
        out = f if out is None else out.bitwiseOR(f)
    return out
