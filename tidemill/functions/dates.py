"""Dates in mixed layouts, as column expressions; the result is TIMESTAMP_NTZ."""

from __future__ import annotations

from datetime import date
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import let, strip

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_WORD = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_TIME = r"(?:(?:T|\x20+)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]+)?))?(?:\x20*([AaPp])[Mm])?)?$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
_OFFSET = r"[T ].*(?:Z|[+-][0-9]{2}:?[0-9]{2})$"
YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})"
NUMERIC = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\x20+)?"
_MONTH_DAY = rf"(?i)^{_WEEKDAY}({_WORD})\.?\x20+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\x20+([0-9]{{4}})"
_DAY_MONTH = rf"(?i)^{_WEEKDAY}([0-9]{{1,2}})(?:st|nd|rd|th)?[\x20-]+({_WORD})\.?,?[\x20-]+([0-9]{{4}})"
_MONTH_YEAR = rf"(?i)^({_WORD})\.?,?\x20+([0-9]{{4}})$"


def looks_like_date(c: Column) -> Column:
    """Has the text a date's shape? Bare numbers have not."""
    shaped = lambda s: s.rlike(YEAR_FIRST + r"(?:[T\x20].*)?$") | s.rlike(NUMERIC + r"(?:[T\x20].*)?$") | (s.rlike(rf"(?i)(?<![A-Za-z0-9_]){_WORD}(?![A-Za-z0-9_])") & s.rlike("[0-9]{4}"))
    return F.coalesce(let(strip(c), lambda s: (F.length(s) >= 6) & s.rlike("[0-9]") & shaped(s)), F.lit(False))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _lower(c: Column) -> Column:
    """Letters A to Z in lower case."""
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def _parts(s: Column, pattern: str, order: str, mark: str = "") -> Column:
    """[year, month, day, hour, minute, second, half, mark] of a text with the pattern, matched once; no date: one element.

    order is the replacement that puts the pattern's own groups in order.
    """
    return F.split(F.regexp_replace(s, pattern + _TIME, f"{order}|$4|$5|$6|$7|{mark}"), r"\|")


def _days(year: Column, month: Column) -> Column:
    """Days of a month; dates that don't exist are told by it, not by an exception for each."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _dated(t: Column) -> Column:
    """What `read_date` returns, of a date's parts."""
    numeric, a, b = t["numeric"], t["a"], t["b"]
    now = date.today().year
    guess = _int(t["year"]) + (now // 100) * 100
    near = F.when(guess >= now + 50, guess - 100).when(guess < now - 50, guess + 100).otherwise(guess)
    year = F.when(numeric & (F.length(t["year"]) == 2), near).otherwise(_int(t["year"]))
    hour = F.coalesce(t["hour"], F.lit(0))
    hour = F.when((t["half"] == "p") & (hour < 12), hour + 12).when((t["half"] == "a") & (hour == 12), F.lit(0)).otherwise(hour)
    second = F.coalesce(t["second"], F.lit(0).cast("decimal(8,6)"))

    def made(year: Column, month: Column, day: Column) -> Column:
        there = month.between(1, 12) & day.between(1, _days(year, month))
        return F.when(there, F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(t["minute"], F.lit(0)), second))

    def orders(y: Column) -> Column:
        month_first = F.when(numeric & (a > 12), made(y, b, a)).otherwise(made(y, a, b))
        day_first = F.when(numeric & ((a > 12) | (b <= 12)), made(y, b, a)).otherwise(made(y, a, b))
        stamps = {k: F.coalesce(t["iso"], v).cast("timestamp_ntz").alias(k) for k, v in (("month_first", month_first), ("day_first", day_first))}
        return F.struct(numeric.alias("numeric"), a.alias("a"), b.alias("b"), *stamps.values())

    return let(year, orders)


def read_date(c: Column) -> Column:
    """The text's date in parts, each layout's pattern matched once: (numeric, a, b, month_first, day_first).

    month_first and day_first are the timestamps that the two orders of day and month
    give, the same where only one order can be. a and b are a numeric date's first and
    second number. Null for what has no date's shape; two-digit years lie within 50
    years of now.
    """

    def layout(s: Column) -> Column:
        month_year = F.split(F.regexp_replace(s, _MONTH_YEAR, "$2|$1|1|||||"), r"\|")
        return (
            F.when(s.rlike("^[0-9]{3}"), _parts(s, YEAR_FIRST, "$1|$2|$3"))
            .when(s.rlike("^[0-9]{1,2}[-/.][0-9]"), _parts(s, NUMERIC, "$3|$1|$2", "n"))
            .when(s.rlike("^[0-9]") | s.rlike(rf"(?i)^{_WEEKDAY}[0-9]"), _parts(s, _DAY_MONTH, "$3|$2|$1"))
            .when(s.rlike(_MONTH_YEAR), month_year)
            .otherwise(_parts(s, _MONTH_DAY, "$3|$1|$2"))
        )

    def told(s: Column) -> Column:
        stamp = s.try_cast("timestamp")
        iso = F.when(s.rlike(_OFFSET), F.to_utc_timestamp(stamp, F.current_timezone())).otherwise(stamp).cast("timestamp_ntz")

        def fields(p: Column) -> Column:
            """Of all parts or of a null; only digits are cast, as a failed cast costs an exception for each row."""
            month = F.when(p[1] < "A", _int(p[1])).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), _lower(F.substring(p[1], 1, 3))).cast("int"))
            number = lambda x: F.when(x != "", _int(x))
            values = {"iso": F.when(p.isNull() & s.rlike(ISO), iso), "year": p[0], "a": month, "b": _int(p[2]), "numeric": F.coalesce(p[7] == "n", F.lit(False))}
            values |= {"hour": number(p[3]), "minute": number(p[4]), "second": F.when(p[5] != "", p[5].try_cast("decimal(8,6)")), "half": _lower(p[6])}
            return let(F.struct(*(v.alias(k) for k, v in values.items())), _dated)

        return let(F.when(~s.rlike(ISO), let(layout(s), lambda p: F.when(F.size(p) == 8, p))), fields)

    return F.when(looks_like_date(c), let(strip(c), told))


def votes(read: Column) -> dict[str, Column]:
    """Is a numeric date day-first, month-first, or could it be either?"""
    a, b = read["a"], read["b"]
    return {"day": read["numeric"] & (a > 12) & (b <= 12), "month": read["numeric"] & (b > 12) & (a <= 12), "either": read["numeric"] & (a <= 12) & (b <= 12)}


def vote(df: DataFrame, reads: dict[str, Column]) -> dict[str, tuple[bool, int]]:
    """For each column's read dates: are they day-first, and how many could be either; all rows vote, in one aggregate."""
    if not reads:
        return {}
    got = iter(df.agg(*(F.count_if(v) for read in reads.values() for v in votes(read).values())).first())
    out = {}
    for c in reads:
        day, month, either = next(got), next(got), next(got)
        out[c] = (day > 0 and day >= month, either)
    return out


def vote_columns(df: DataFrame, columns: list[str]) -> dict[str, tuple[bool, int]]:
    """`vote` of text columns."""
    rows = df.select(*(read_date(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(columns)))
    return vote(rows, {c: F.col(f"v{i}") for i, c in enumerate(columns)})


def as_timestamp(read: Column, dayfirst: bool = False) -> Column:
    """The date of what `read_date` has read, null where it names a day that does not exist.

    A numeric date that can be read only one way is read that way whatever the vote.
    """
    return read["day_first"] if dayfirst else read["month_first"]


def parse_date(c: Column, dayfirst: bool = False) -> Column:
    """The date of a text; an offset is converted to UTC."""
    return let(read_date(c), lambda r: as_timestamp(r, dayfirst))
