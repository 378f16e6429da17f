"""Numbers and booleans written by people, as column expressions.

A number's text is first reduced to its core (digits and separators) with sign
and percent set aside. Whether a lone separator groups thousands or marks
decimals is asked of the whole column: `evidence` counts, in one aggregate, what
the unambiguous values show, and `Reading` decides from the counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import NULL_TOKENS, SPACE, is_text, let, strip

#: Currency marks that are taken out of a number's text.
CURRENCY = r"(?i)(?:us\$|r\$|usd|eur|mxn|cop|pab|pen|clp|ars|crc|gtq|dop|brl|b/\.|s/\.?|bs\.?|[$€£¥])"
#: Spellings of booleans, lower-cased and stripped.
TRUE = ("true", "t", "yes", "y", "1", "si", "sí", "s", "on", "x", "✓")
FALSE = ("false", "f", "no", "n", "0", "off", "no.", "n/a")

EXPONENT = r"^[+-]?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+$"
_CORE = "struct<text:string,negative:boolean,percent:boolean>"


def _count(s: Column, mark: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))


def core(c: Column) -> Column:
    """(text, negative, percent) of a number's text, null where it is none."""

    def bare(s: Column) -> Column:
        closed = s.rlike(r"(?s)^\(.*\)$")
        return let(F.when(closed, strip(F.regexp_replace(s, r"^\(|\)$", ""))).otherwise(s), lambda t: unsigned(t, closed))

    def unsigned(t: Column, closed: Column) -> Column:
        percent = t.endswith("%")
        digits = F.regexp_replace(t, f"%$|{CURRENCY}|[{SPACE}'’_]", "")
        return let(F.regexp_replace(digits, r"^\+", ""), lambda d: finished(d, closed, percent))

    def finished(d: Column, closed: Column, percent: Column) -> Column:
        minus = d.startswith("-")
        negative = F.when(minus & (_count(d, "-") == 1), ~closed).otherwise(closed)
        text = F.regexp_replace(d, "^-", "")
        fine = text.rlike("^[0-9.,]+$") & ~text.isin(".", ",")
        return F.when(fine, F.struct(text.alias("text"), negative.alias("negative"), percent.alias("percent")))

    simple = lambda s: F.struct(F.regexp_replace(s, "^-", "").alias("text"), s.startswith("-").alias("negative"), F.lit(False).alias("percent"))
    known = lambda s: s.isNotNull() & ~F.lower(s).isin(*NULL_TOKENS)
    return let(strip(c), lambda s: F.when(s.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), simple(s)).when(known(s), bare(s))).cast(_CORE)


#: Cores that may be thousands or ones, such as `1.000`, by their separator.
AMBIGUOUS = {".": r"^(?!0[.,])[0-9]{1,3}\.[0-9]{3}$", ",": r"^(?!0[.,])[0-9]{1,3},[0-9]{3}$"}


def ambiguous_mark(text: Column) -> Column:
    """The separator of an ambiguous core, else null."""
    return F.when(text.rlike(AMBIGUOUS["."]), ".").when(text.rlike(AMBIGUOUS[","]), ",")


def _plain(s: Column, hints: tuple[str | None, str | None]) -> Column:
    """The core's digits with a point for the decimal mark; s is a column or a field of one."""
    without = lambda mark: F.replace(s, F.lit(mark), F.lit(""))
    comma_to_point = F.replace(without("."), F.lit(","), F.lit("."))
    dots = F.when(s.rlike(AMBIGUOUS["."]), without(".")).otherwise(s) if hints[0] == "," else s
    decimal = s.rlike("^[^,]*,[0-9]{1,2}$" + (f"|{AMBIGUOUS[',']}" if hints[1] == "," else ""))
    return (
        F.when(~s.contains(",") & (_count(s, ".") <= 1), dots)
        .when(~s.contains(","), F.when(s.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$"), without(".")).otherwise(s))
        .when(F.when(s.contains("."), s.rlike(",[0-9]*$")).otherwise(decimal), comma_to_point)
        .otherwise(without(","))
    )


def parse_number(c: Column, kind: str = "string", hints: tuple[str | None, str | None] = (None, None)) -> Column:
    """The number as a double, null where it is none.

    hints: the decimal mark to assume for ambiguous values with a point and with
    a comma; (None, None) reads each value by itself.
    """
    if kind == "boolean":
        return F.lit(None).cast("double")
    if not is_text(kind):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)

    return let(read_number(c), lambda r: number_of(r, hints))


def read_number(c: Column) -> Column:
    """A text's number before its separators are decided on: (exact, core); exact where it is written with an exponent."""
    read = lambda s: F.struct(F.when(s.rlike(EXPONENT), s.try_cast("double")).alias("exact"), F.when(~s.rlike(EXPONENT), core(s)).alias("core"))
    return let(strip(c), read)


def number_of(read: Column, hints: tuple[str | None, str | None]) -> Column:
    """The number of what `read_number` has read."""
    k = read["core"]
    number = _plain(k["text"], hints).try_cast("double") / F.when(k["percent"], 100.0).otherwise(1.0)
    return F.coalesce(read["exact"], number * F.when(k["negative"], -1.0).otherwise(1.0))


def parse_boolean(c: Column, kind: str = "string") -> Column:
    """true, false, or null for what is neither; placeholders are null."""
    if kind == "boolean":
        return c
    text = c if is_text(kind) else c.cast("string")
    return let(F.lower(strip(text)), lambda s: F.when(s.isin(*NULL_TOKENS), None).when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)).cast("boolean")


def round_half_away(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


BUCKETS = tuple(f"{what}{mark}" for what in ("thousands", "decimal", "decimal3") for mark in ".,")


def shown(s: Column) -> Column:
    """Which of BUCKETS a number's core is evidence for, or `ambiguous`; s is a column or a field of one."""
    tail = lambda mark: F.when(F.length(F.substring_index(s, mark, -1)) == 3, F.lit(f"decimal3{mark}")).otherwise(F.lit(f"decimal{mark}"))
    none = F.array().cast("array<string>")
    last = lambda mark, other: F.array(F.lit(f"thousands{other}"), tail(mark))
    out = F.when(s.isNull() | ~s.rlike("[.,]"), none).when(s.contains(".") & s.contains(","), F.when(s.rlike(",[0-9]*$"), last(",", ".")).otherwise(last(".", ",")))
    out = out.when(ambiguous_mark(s).isNotNull(), F.array(F.lit("ambiguous")))
    for mark in ".,":
        grouped = F.when(s.rlike(rf"^[0-9]{{1,3}}(?:[{mark}][0-9]{{3}})+$"), F.array(F.lit(f"thousands{mark}"))).otherwise(none)
        out = out.when(s.contains(mark), F.when(_count(s, mark) > 1, grouped).otherwise(F.array(tail(mark))))
    return out


@dataclass
class Reading:
    """A column's evidence about its separators, and how ambiguous values are read."""

    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(BUCKETS, 0))
    examples: dict[str, str] = field(default_factory=dict)
    ambiguous: int = 0

    def decide(self, mark: str) -> tuple[str, str]:
        """(`thousands` or `decimal`, why) for an ambiguous value with this separator."""
        other = "," if mark == "." else "."
        has = self.counts
        if has[f"decimal3{mark}"] and not has[f"thousands{mark}"]:
            return "decimal", f"'{mark}' marks 3-digit decimals elsewhere in this column (e.g. {self.examples.get(f'decimal3{mark}', '')})"
        if has[f"thousands{mark}"] and not has[f"decimal3{mark}"]:
            return "thousands", f"'{mark}' groups thousands elsewhere in this column (e.g. {self.examples.get(f'thousands{mark}', '')})"
        if has[f"decimal{other}"] and not has[f"decimal{mark}"] and not has[f"decimal3{mark}"]:
            return "thousands", f"'{other}' is the decimal mark elsewhere in this column (e.g. {self.examples.get(f'decimal{other}', '')})"
        return ("thousands" if mark == "," else "decimal"), "no evidence in the column; default reading"

    @property
    def hints(self) -> tuple[str, str]:
        """Decimal marks to assume for ambiguous points and commas, for `parse_number`."""
        return ("." if self.decide(".")[0] == "decimal" else ","), ("," if self.decide(",")[0] == "decimal" else ".")

    @property
    def mixed_decimal_marks(self) -> bool:
        return bool(self.counts["decimal."] and self.counts["decimal,"])


def read_columns(df: DataFrame, columns: list[str], row: str, reads: dict[str, Column] | None = None) -> dict[str, Reading]:
    """The evidence of text columns, of all of them in one aggregate. Examples are the first in row order.

    reads: what `read_number` has read of them, where that is at hand.
    """
    if not columns:
        return {}
    texts = [(reads or {}).get(c, read_number(F.col(f"`{c}`")))["core"]["text"].alias(f"t{i}") for i, c in enumerate(columns)]
    seen = df.select(row, *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)), *texts)
    seen = seen.withColumns({f"e{i}": shown(F.col(f"t{i}")) for i in range(len(columns))})
    aggs = []
    for i in range(len(columns)):
        for k, bucket in enumerate((*BUCKETS, "ambiguous")):
            has = F.array_contains(f"e{i}", bucket)
            aggs += [F.count_if(has).alias(f"n{i}_{k}"), F.min(F.when(has, F.struct(F.col(row), F.col(f"v{i}").alias("v")))).alias(f"x{i}_{k}")]
    got = seen.agg(*aggs).first().asDict()
    out = {}
    for i, c in enumerate(columns):
        found = {b: got[f"x{i}_{k}"]["v"].strip() for k, b in enumerate(BUCKETS) if got[f"x{i}_{k}"]}
        out[c] = Reading({b: got[f"n{i}_{k}"] for k, b in enumerate(BUCKETS)}, found, got[f"n{i}_{len(BUCKETS)}"])
    return out
