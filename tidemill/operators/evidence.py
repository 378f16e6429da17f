"""What a column's values are like: counted over all of them, for all columns at once.

A table's cells become rows (column, value), summed up to distinct values with
their numbers and first places, and stored. Everything else is read from that
table, in a number of jobs that doesn't depend on the number of columns: a vector of
counts for each column, by patterns that each distinct value is held against once,
and the first or most frequent values of each column. Tables of rules then decide
on the counts; of the values themselves only a bounded number comes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import columns as C
from tidemill.functions import dates, text
from tidemill.sources.storage import save
from tidemill.sources.tables import ROW

# Spellings, month names (English and Spanish), header hints, patterns of values.
TRUE = ("true", "t", "yes", "y", "1", "si", "sí", "s", "on", "x", "✓")
FALSE = ("", "-", "false", "f", "no", "n", "0", "off")
MONTHS = (
    ("jan", "january", "ene", "enero"),
    ("feb", "february", "febrero"),
    ("mar", "march", "marzo"),
    ("apr", "april", "abr", "abril"),
    ("may", "mayo"),
    ("jun", "june", "junio"),
    ("jul", "july", "julio"),
    ("aug", "august", "ago", "agosto"),
    ("sep", "sept", "september", "set", "septiembre"),
    ("oct", "october", "octubre"),
    ("nov", "november", "noviembre"),
    ("dec", "december", "dic", "diciembre"),
)
HINTS = {
    "phone": r"(^|_)(phone|telefono|tel|celular|cel|movil|mobile|whatsapp|fax)(_|$)",
    "id": r"(^|_)(id|uuid|guid|key|code|codigo|sku|nro|num|number)$|^id(_|$)",
    "address": r"(^|_)(address|addr|direccion|street|calle|domicilio)(_|$)",
    "email": r"(^|_)(email|e_mail|mail|correo)(_|$)",
    "name": r"^((full_|first_|last_|given_|family_|middle_)?name|nombres?|fullname|nombre_completo|surname|apellidos?|(customer|client|contact|person|cliente|contacto|employee|empleado|user_full)_(name|nombre))$",
    "country": r"^(country|pais|country_name|nation|country_code)$",
}
INTEGER = r"^[+-]?[0-9]{1,3}(?:[.,\s]?[0-9]{3})*$|^[+-]?[0-9]+$"
NUMERIC = r"^[+-]?[0-9.,\s'$€£%]+$"
PHONE = r"^\+?[0-9\s().\-/]{6,24}$"
GROUPED = r"^[0-9]{1,3}(?:[ ,.][0-9]{3})+$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SEPARATED = r"[,\s']|[0-9]\.[0-9]{3}(?:[^0-9]|$)"
MONEY = r"(?i)[$€£¥]|\b(?:usd|eur|mxn|cop|pab)\b"
_CLOCK = r"(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
#: Layouts of dates: label, pattern, and what its groups are (a and b: day or month, M: a month's name).
LAYOUTS = (
    *((f"YYYY{m}MM{m}DD", rf"^([0-9]{{4}})\{m}([0-9]{{1,2}})\{m}([0-9]{{1,2}}){_CLOCK}", "ymd") for m in "-/."),
    *((f"a{m}b{m}YYYY", rf"^([0-9]{{1,2}})\{m}([0-9]{{1,2}})\{m}([0-9]{{4}}){_CLOCK}", "aby") for m in "-/."),
    ("a/b/YY", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$", "aby"),
    ("Mon DD YYYY", r"^([A-Za-z]{3,10})\.? ([0-9]{1,2}),? ([0-9]{4})$", "Mdy"),
    ("DD Mon YYYY", r"(?i)^([0-9]{1,2}) (?:de )?([A-Za-z]{3,10})\.?,? (?:de )?([0-9]{4})$", "dMy"),
    ("DD-Mon-YYYY", r"^([0-9]{1,2})-([A-Za-z]{3,10})-([0-9]{4})$", "dMy"),
)


def layout(v: Column, dayfirst: bool = True) -> Column:
    """The layout of a date, such as DD/MM/YYYY; null for what is no day of the calendar."""
    # Most values have no date's characters at all; the long chain for the rest would make generated code too large to be compiled.
    return F.when(v.rlike(r"^(?:[0-9]{1,4}[-/. ]|[A-Za-z]{3,10}\.? [0-9])"), C.let(v, lambda x: _layout(x, dayfirst)))


def _layout(v: Column, dayfirst: bool) -> Column:
    months = F.create_map(*(F.lit(x) for i, names in enumerate(MONTHS, 1) for name in names for x in (name, i)))
    found = F.lit(None).cast("string")
    for label, pattern, order in reversed(LAYOUTS):
        part = {kind: F.regexp_extract(v, pattern, i) for i, kind in enumerate(order, 1)}
        n = {kind: _int(c) for kind, c in part.items() if kind != "M"}
        year = F.when(F.length(part["y"]) == 2, n["y"] + 2000).otherwise(n["y"])
        if order == "aby":
            a, b = n["a"], n["b"]
            first = F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False).otherwise(dayfirst)
            day, month = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
            told = F.when(first, label.replace("a", "DD").replace("b", "MM")).otherwise(label.replace("a", "MM").replace("b", "DD"))
        else:
            day, month = n["d"], n["m"] if "m" in n else F.try_element_at(months, F.lower(part["M"]))
            told = F.lit(label)
        zero = F.lit(0)
        real = F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(8,6)")).isNotNull()
        found = F.when(v.rlike(pattern) & real, told).otherwise(found)
    return found


def _int(c: Column) -> Column:
    return c.try_cast("int")


def cells(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Distinct present values (c, v, n, at) of all columns, stored: number of the column, stripped text, times, first place.

    Values are summed up where they are read, so a frequent one is sent once by each task.
    """
    kinds = {c: t for c, t in df.dtypes if c != ROW}
    each = F.array(*(F.struct(F.lit(i).alias("c"), C.strip(C.as_text(F.col(f"`{c}`"), t)).alias("v")) for i, (c, t) in enumerate(kinds.items())))
    place = F.col(ROW) if ROW in df.columns else F.lit(None).cast("long")
    if not kinds:
        return df.sparkSession.createDataFrame([], "c int, v string, n long, at long"), []
    rows = df.select(place.alias("at"), F.inline(each))
    rows = rows.filter(F.col("v").isNotNull() & ~F.lower("v").isin(*C.NULL_TOKENS))
    return save(rows.groupBy("c", "v").agg(F.count("*").alias("n"), F.min("at").alias("at")), "cells"), [*kinds]


#: What values are counted by.
PATTERNS: dict[str, Callable[[Column], Column]] = {
    "boolean": lambda v: F.lower(v).isin(*TRUE, *FALSE),
    "true": lambda v: F.lower(v).isin(*TRUE),
    "integer": lambda v: v.rlike(INTEGER),
    "numeric": lambda v: v.rlike(NUMERIC) & v.rlike("[0-9]"),
    "date": lambda v: layout(v).isNotNull() | dates.looks_like_date(v),
    "email": lambda v: v.rlike(EMAIL),
    "phone": lambda v: v.rlike(PHONE) & F.regexp_count(v, F.lit("[0-9]")).between(7, 15),
    "marked": lambda v: ~v.rlike(GROUPED) & (v.startswith("+") | v.contains("(") | v.rlike(r"[0-9][\s-][0-9]")),
    "wordy": lambda v: ~v.rlike("[0-9@]"),
    "separated": lambda v: v.rlike(SEPARATED),
    "money": lambda v: v.rlike(MONEY),
}
EXAMPLES = ("separated", "money")


@dataclass
class Evidence:
    """A column's counts; shares are of its present values."""

    name: str
    n_present: int
    n_unique: int
    counts: dict[str, int]
    #: The first value of each kind of EXAMPLES.
    examples: dict[str, str]
    #: How many values there are besides spellings of the same one; None where they are too many to tell.
    groups: int | None = None

    def share(self, what: str) -> float:
        return self.counts.get(what, 0) / self.n_present if self.n_present else 0.0

    def named(self, hint: str) -> bool:
        return bool(self.name) and bool(re.search(HINTS[hint], text.snake_case(self.name)))


def gather(values: DataFrame, names: list[str]) -> list[Evidence]:
    """The evidence of all columns, in one aggregate over their distinct values."""
    v, n = F.col("v"), F.col("n")
    sums = [F.sum(F.when(test(v), n).otherwise(0)).alias(what) for what, test in PATTERNS.items()]
    sums += [F.min(F.when(PATTERNS[what](v), F.struct("at", "v"))).alias(f"first_{what}") for what in EXAMPLES]
    found: dict[int, Row] = {r.c: r for r in values.groupBy("c").agg(F.sum("n").alias("n_present"), F.count("*").alias("n_unique"), *sums).collect()} if names else {}
    return [Evidence(name, r.n_present, r.n_unique, {k: r[k] for k in PATTERNS}, {k: x.v for k in EXAMPLES if (x := r[f"first_{k}"])}) if (r := found.get(i)) else Evidence(name, 0, 0, {}, {}) for i, name in enumerate(names)]


def ranked(values: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k values of each column by order. Each task keeps its own first k before any are sent."""
    return values.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(*order))).filter(F.col("place") <= k)


#: Types, the first whose rule holds: shares and numbers are fixed values.
TYPES: tuple[tuple[str, Callable[[Evidence], bool]], ...] = (
    ("empty", lambda e: not e.n_present),
    ("boolean", lambda e: e.share("boolean") == 1 and (e.n_unique <= 3 or 0 < e.counts["true"] < e.n_present)),
    ("phone", lambda e: e.named("phone") and e.share("phone") >= 0.7),
    ("integer", lambda e: e.share("integer") == 1),
    ("float", lambda e: e.share("numeric") >= 0.98),
    ("datetime", lambda e: e.share("date") >= 0.8),
    ("email", lambda e: e.share("email") >= (0.5 if e.named("email") else 0.8)),
    ("phone", lambda e: e.share("phone") >= 0.8 and e.share("marked") >= 0.3),
    ("categorical", lambda e: e.groups is not None and e.groups <= 50 and e.groups <= 0.5 * e.n_present),
    ("text", lambda e: True),
)
#: Roles: the types they are for, and the rule; the last argument tells what share of a column's first values are countries.
ROLES: tuple[tuple[str, tuple[str, ...], Callable[[Evidence, str, Callable[[], float]], bool]], ...] = (
    ("identifier", ("integer", "text", "categorical"), lambda e, kind, known: e.named("id") and e.n_unique >= 0.5 * e.n_present),
    ("person_name", ("text", "categorical"), lambda e, kind, known: e.named("name") and e.share("wordy") >= 0.8),
    ("address", ("text", "categorical"), lambda e, kind, known: e.named("address")),
    ("country", ("text", "categorical"), lambda e, kind, known: e.named("country") or (kind == "categorical" and known() >= 0.8)),
)


def type_of(e: Evidence) -> str:
    return next(kind for kind, holds in TYPES if holds(e))


def role_of(e: Evidence, kind: str, known: Callable[[], float]) -> str | None:
    return next((role for role, kinds, holds in ROLES if e.n_present and kind in kinds and holds(e, kind, known)), None)
