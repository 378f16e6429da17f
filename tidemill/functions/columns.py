"""Small builders that other column functions are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes off, as a regular expression's class.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

#: Texts that stand for a missing value, lower-cased and stripped.
NULL_TOKENS = ("", "na", "n/a", "nan", "null", "none", "nil", "-", "--", "?", "unknown", "missing", "#n/a")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_text(kind: str) -> bool:
    return kind == "string" or kind.startswith(("varchar", "char"))


def is_missing(c: Column, kind: str) -> Column:
    """Null, NaN, or (text only) a placeholder such as `N/A`."""
    if is_text(kind):
        return c.isNull() | F.lower(strip(c)).isin(*NULL_TOKENS)
    if kind in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_na(c: Column, kind: str) -> Column:
    """Null, NaN, or (text only) nothing but white space: what rules take for absent."""
    if is_text(kind):
        return c.isNull() | (strip(c) == "")
    return is_missing(c, kind)


def as_text(c: Column, kind: str) -> Column:
    """The value as Python's str() writes it: True, 2.0, 2023-01-05 00:00:00."""
    if is_text(kind):
        return c
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    if kind in ("double", "float"):
        d = c.cast("double")
        whole = F.concat(F.format_string("%.0f", d), F.lit(".0"))
        return F.when(F.isnan(d), "nan").when((F.abs(d) < 1e16) & (d == F.floor(d)), whole).otherwise(d.cast("string"))
    if kind in ("timestamp_ntz", "timestamp"):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micro = F.date_format(c, "SSSSSS")
        return F.when(micro == "000000", whole).otherwise(F.concat(whole, F.lit("."), micro))
    return c.cast("string")
