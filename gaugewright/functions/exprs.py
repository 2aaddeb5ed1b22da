"""Scalar library: Column -> Column, all built-ins, so that everything stays in generated code.

Missing is NULL throughout (missing() maps NaN there at ingest); ratios and casts never raise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How cell names are read (site / band / cell).
CELL_PATTERNS = {
    "cell": r"(S\d+)/([^/]+)/(C\d+)",
    "band": r"S\d+/([^/]+)/C\d+",
    "site": r"(S\d+)/[^/]+/C\d+",
    "cell_id": r"S\d+/[^/]+/(C\d+)",
}


def col(name: str) -> Column:
    """A column whose name may have dots."""
    return F.col(f"`{name}`")


def missing(c: Column) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def number(c: Column) -> Column:
    """Anything that isn't a number becomes NULL, NaN and the infinities as well."""
    x = c.try_cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def timestamp(c: Column) -> Column:
    """A string or epoch seconds as a timestamp; NULL if it is none. A jitter mark that an export left is cut off."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c.cast("string"), "_jitter", "")), F.timestamp_seconds(c.cast("string").try_cast("long")))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation of complete pairs; NULL where a side has no spread (Spark's own raises there under ANSI)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """Between low and high; NULL stays NULL."""
    bound = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.when(x.isNotNull(), F.least(F.greatest(x, bound(low)), bound(high)))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def floor_to(ts: Column, seconds: float) -> Column:
    """The last grid tick, in microseconds, at or before ts."""
    us = micros(ts)
    return us - F.pmod(us, F.lit(int(seconds * 1e6)))


def snap(us: Column, anchor: Column, seconds: float) -> Column:
    """Number of the grid tick nearest to a time, both in microseconds; halves go to the even one."""
    return F.rint((us - anchor) / F.lit(seconds * 1e6)).cast("long")


def nearest_tick(ts: Column, seconds: float) -> Column:
    """The nearest tick of the grid from the epoch, as a timestamp: the key of a join on snapped ticks."""
    return F.timestamp_micros(snap(micros(ts), F.lit(0), seconds) * F.lit(int(seconds * 1e6)))


def implies(p: Column, q: Column) -> Column:
    """q where p holds; not applicable elsewhere."""
    return F.when(p, q)


def row_all(checks: Sequence[Column]) -> Column:
    """Passes if every applicable check does; not applicable if none is."""
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in checks])
    return F.when(some, reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in checks]))


def grade(x: Column, good: float, soft: float, higher_is_better: bool = True) -> Column:
    """1 / 0.5 / 0 by two thresholds."""
    at = (lambda t: x >= t) if higher_is_better else (lambda t: x <= t)
    return F.when(x.isNull(), None).when(at(good), 1.0).when(at(soft), 0.5).otherwise(0.0)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern; NULL where it doesn't match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def band_of(name: Column) -> Column:
    """The middle of a three-part name, else UNKNOWN."""
    parts = F.split(name, "/")
    return F.when((F.size(parts) == 3) & (F.get(parts, 1) != ""), F.get(parts, 1)).otherwise("UNKNOWN")


def decimals(c: Column) -> Column:
    """Digits after the point of a number as it is printed."""
    return F.length(F.split_part(c.cast("string"), F.lit("."), F.lit(2)))


def occurrences(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def fingerprint(*columns: Column) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def off_grid(delta: Column, expected: float) -> Column:
    """Whether a gap in seconds is no multiple of the expected one, within a tenth (one second at least)."""
    slack = max(1, int(0.1 * expected))
    over = F.pmod(delta, F.lit(float(expected)))
    return ~(over <= slack) & ~(F.pmod(expected - over, F.lit(float(expected))) <= slack)


def missed(delta: Column, expected: float) -> Column:
    """How many expected rows a gap in seconds leaves out."""
    return F.greatest(F.floor(delta / expected) - 1, F.lit(0))


def between_or_any(x: Column, low: float | None, high: float | None) -> Column:
    """low <= x <= high, an absent bound being none; NULL for NULL."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.when(x.isNotNull(), ok)


def tick_range(start: Column, end: Column, seconds: int) -> Column:
    """All timestamps from start to end (included)."""
    return F.sequence(start, end, F.make_dt_interval(secs=F.lit(seconds)))


def hour(ts: Column) -> Column:
    return F.hour(ts)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def window_name(number: Column, start: Column) -> Column:
    return F.format_string("window_%06d_%s", number, F.date_format(start, "yyyyMMdd_HHmmss"))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two arrays of weights; NULL for other lengths, negative weights or sums of zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.transform(a, lambda x: x / total(a))
    term = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    bad = (F.size(p) != F.size(q)) | F.exists(p, lambda x: x < 0) | F.exists(q, lambda x: x < 0) | (total(p) <= 0) | (total(q) <= 0)
    return F.when(~bad, 0.5 * total(F.zip_with(norm(p), norm(q), lambda x, y: term(x, y) + term(y, x))))


def message_kind(value: Column) -> Column:
    """Kind of a signalling message by its first two bytes."""
    head = F.hex(F.substring(value, 1, 2))
    return F.when(head == "0001", "E2AP_INITIATING").when(head == "2001", "E2AP_SUCCESSFUL").when(head == "4001", "E2AP_UNSUCCESSFUL").otherwise("UNKNOWN")
