"""Column functions: predicates in which an absent value is never equal and never greater, and text, duration and label helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _false(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def matches(x: str | Column, pattern: str) -> Column:
    """Regex find; false for an absent value."""
    return _false(_c(x).rlike(pattern))


def full_match(x: str | Column, pattern: str) -> Column:
    return matches(x, f"^(?:{pattern})$")


def is_in(x: str | Column, values) -> Column:
    return _false(_c(x).isin(list(values)))


def contains(x: str | Column, part: str) -> Column:
    return _false(_c(x).contains(part))


def ilike(x: str | Column, part: str) -> Column:
    return _false(_c(x).ilike(f"%{part}%"))


def eq(x: str | Column, value) -> Column:
    return _false(_c(x) == value)


def ne(x: str | Column, value) -> Column:
    """Not equal; true for an absent value, unlike SQL."""
    return ~_c(x).eqNullSafe(value)


def lt(x: str | Column, value) -> Column:
    return _false(_c(x) < value)


def gt(x: str | Column, value) -> Column:
    return _false(_c(x) > value)


def is_nil(x: str | Column) -> Column:
    return _c(x).isNull()


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def replace_pattern(x: str | Column, regex: str, replacement: str) -> Column:
    return F.regexp_replace(_c(x), regex, replacement)


def concat(parts, separator: str = "") -> Column:
    return F.concat_ws(separator, *[_c(p) for p in parts])


def default(x: str | Column, value) -> Column:
    return F.coalesce(_c(x), F.lit(value) if not isinstance(value, Column) else value)


def duration_seconds(x: str | Column) -> Column:
    """Seconds of '24h' or '30m'; null for another form."""
    amount = F.regexp_extract(_c(x), r"^([0-9]+)[hm]$", 1)
    return F.when(amount == "", F.lit(None)).otherwise(amount.cast("long") * F.when(_c(x).endswith("h"), 3600).otherwise(60))


def duration_interval(x: str | Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), duration_seconds(x).cast("decimal(18,6)"))


def now() -> Column:
    """The time at which the query runs, the same for all its rows."""
    return F.current_timestamp()


def rfc3339(x: str | Column) -> Column:
    return F.to_timestamp(_c(x))


def percent_text(ratio: str | Column) -> Column:
    """0.1234 as 12.34%."""
    return F.format_string("%.2f%%", _c(ratio).cast("double") * 100)


def label_name(x: str | Column) -> Column:
    """A name with everything but letters, digits and underscores replaced by underscores."""
    return F.regexp_replace(_c(x), "[^a-zA-Z0-9_]", "_")


def pick(labels: str | Column, key: str) -> Column:
    return F.try_element_at(_c(labels), F.lit(key))


def rename_keys(labels: str | Column, regex: str, replacement: str) -> Column:
    return F.transform_keys(_c(labels), lambda k, _: F.regexp_replace(k, regex, replacement))


def keep_keys(labels: str | Column, regex: str) -> Column:
    return F.map_filter(_c(labels), lambda k, _: k.rlike(regex))


def json_text(*columns: str | Column) -> Column:
    """The columns as one JSON object; absent values are left out."""
    return F.to_json(F.struct(*columns))


def hash_bucket(key: str | Column, seed: int = 22) -> Column:
    """0 to 9999 from the md5 of 'seed:key': the same for a key everywhere and in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))), 1, 8), 16, 10).cast("long") % 10000


def round6(x: Column) -> Column:
    return F.round(x, 6)
