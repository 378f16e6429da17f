"""Declarative rules on columns and pairs of columns, with a row for every failure.

All rules of a frame become one pass: each row builds the array of rules it
breaks and explodes it. `unique` asks a pre-aggregated table of repeated values.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import columns as C
from tidemill.functions import dates, numbers
from tidemill.operators.options import hint
from tidemill.sources.tables import ROW, with_row_ids

RULES = ("not_null", "unique", "range", "regex", "allowed", "dtype")
COMPARE = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}
FAILURE = "struct<position:int,rule:string,column:string,value:string,message:string>"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def load_rules(path: str) -> dict[str, Any]:
    """A rules file: a mapping with `columns` (a mapping of mappings) and `checks` (a list of mappings)."""
    with open(path, encoding="utf-8") as f:
        rules = yaml.safe_load(f) or {}
    if not isinstance(rules, dict):
        raise ValueError("rules file must be a mapping at the top level")
    columns, checks = rules.get("columns") or {}, rules.get("checks") or []
    if not isinstance(columns, dict) or not all(r is None or isinstance(r, dict) for r in columns.values()):
        raise ValueError("rules 'columns' must map each column to its rules")
    if not isinstance(checks, list) or not all(isinstance(c, dict) for c in checks):
        raise ValueError("rules 'checks' must be a list of mappings")
    return rules


@dataclass
class Report:
    """failures: position (of the rule), rule, column, row, line, value, message; a lazy table."""

    n_rows: int
    n_rules: int
    failures: DataFrame
    by_rule: dict[str, int] = field(default_factory=dict)

    @property
    def n_failures(self) -> int:
        return sum(self.by_rule.values())

    @property
    def ok(self) -> bool:
        return not self.by_rule

    def first(self, n: int) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.failures.orderBy("position", F.col("row").asc_nulls_first()).drop("position").limit(n).collect()]

    def as_dict(self, n: int = 1000) -> dict[str, Any]:
        return {"ok": self.ok, "n_rows": self.n_rows, "n_rules": self.n_rules, "n_failures": self.n_failures, "failures_by_rule": self.by_rule, "failures": self.first(n)}

    def to_markdown(self, n: int = 50) -> str:
        out = ["# Validation report", "", f"- Rows: {self.n_rows}", f"- Rules: {self.n_rules}", f"- Failures: {self.n_failures}", f"- Result: {'PASS' if self.ok else 'FAIL'}", ""]
        if self.by_rule:
            out += ["| Rule | Failures |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in self.by_rule.items()), "", "| Rule | Row | Line | Value | Message |", "| --- | --- | --- | --- | --- |"]
            cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
            cut = lambda v: v if v is None or len(v) <= 30 else v[:29] + "…"
            out += [f"| {cell(f['rule'])} | {cell(f['row'])} | {cell(f['line'])} | {cell(cut(f['value']))} | {cell(f['message'])} |" for f in self.first(n)]
            if self.n_failures > n:
                out += ["", f"…and {self.n_failures - n} more."]
        return "\n".join([*out, ""])


def _number_text(n: Column) -> Column:
    return F.when(n == F.floor(n), F.format_string("%.0f", n)).otherwise(n.cast("string"))


def _found(v: Column, pattern: str) -> Column:
    r"""Is a Python pattern found in the value?

    Java's engine is asked where it reads the pattern alike: \d, \w, \s and \b know
    Unicode, line ends are \n alone and \Z is the very end. Python's own, in Arrow
    batches, is asked where Java's can't compile it or knows other constructs.
    """
    finder = re.compile(pattern)
    java = "(?Ud)" + pattern.replace(r"\Z", r"\z").replace("(?P<", "(?<")
    if not re.search(r"\(\?P[=>]|\(\?\(|\[\^?[^\]]*(?:\[|&&)", pattern):
        try:
            SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(java)
            return v.rlike(java)
        except Exception:  # the engine's own complaint about the pattern
            pass

    @F.pandas_udf("boolean")
    def search(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else finder.search(x) is not None).astype(object)

    return search(v)


def _broken(name: str, kind: str, rule: str, spec: Any) -> tuple[Column, Column] | None:
    """(does the value break the rule, message); null for rules that assert nothing."""
    v, present = col(name), ~C.is_na(col(name), kind)
    if rule == "not_null":
        return (~present, F.when(v.isNull() if C.is_text(kind) else F.lit(True), "value is null").otherwise("value is blank")) if spec else None
    if rule == "range":
        spec = spec or {}
        n, low, high = numbers.parse_number(v, kind), spec.get("min"), spec.get("max")
        small = n < low if low is not None else F.lit(False)
        large = n > high if high is not None else F.lit(False)
        message = F.when(n.isNull(), "value is not numeric").when(small, F.concat(_number_text(n), F.lit(f" < min {low}"))).otherwise(F.concat(_number_text(n), F.lit(f" > max {high}")))
        return present & (n.isNull() | small | large), message
    if rule == "regex":
        return present & ~_found(C.as_text(v, kind), str(spec)), F.lit("does not match pattern")
    if rule == "allowed":
        return present & ~C.as_text(v, kind).isin(*[str(x) for x in spec or []]), F.lit("value not in allowed set")
    target = str(spec).lower()
    if target in ("int", "integer"):
        n = numbers.parse_number(v, kind)
        fine = n.isNotNull() & (n == F.floor(n))
    elif target in ("float", "number"):
        fine = numbers.parse_number(v, kind).isNotNull()
    elif target in ("bool", "boolean"):
        fine = numbers.parse_boolean(v, kind).isNotNull()
    elif target in ("date", "datetime"):
        fine = dates.parse_date(v).isNotNull() if C.is_text(kind) else F.lit(kind in ("date", "timestamp", "timestamp_ntz"))
    else:
        return None
    return present & ~F.coalesce(fine, F.lit(False)), F.lit(f"not a valid {target}")


def _compared_as(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """What columns are compared as: datetime, number or text; text columns by all their present values, in one aggregate."""
    kinds, out, asked = dict(df.dtypes), {}, []
    for name in dict.fromkeys(columns):
        if C.is_text(kinds[name]):
            asked.append(name)
        else:
            out[name] = "datetime" if kinds[name] in ("date", "timestamp", "timestamp_ntz") else "text" if kinds[name] == "boolean" else "number"
    facts = []
    for name in asked:
        v = col(name)
        present = ~C.is_na(v, kinds[name])
        facts += [F.count_if(present), F.count_if(present & dates.looks_like_date(v)), F.count_if(present & numbers.parse_number(v).isNull())]
    got = iter(df.agg(*facts).first() if facts else ())
    for name in asked:
        n, shaped, other = next(got), next(got), next(got)
        out[name] = "text" if not n else "datetime" if shaped >= 0.8 * n else "text" if other else "number"
    return out


def _side(df: DataFrame, operand: Any, own: str, other: str) -> tuple[Column, Column]:
    """(comparable value, is it absent) of a column or a literal."""
    if own != "literal":
        kind, v = dict(df.dtypes)[operand], col(operand)
        absent = C.is_na(v, kind)
        if own == "datetime":
            if C.is_text(kind):
                v = dates.parse_date(v, dates.vote_columns(df, [operand])[operand][0])
            return v.cast("timestamp_ntz"), absent | v.isNull()
        if own == "number":
            v = numbers.parse_number(v, kind)
            return v, absent | v.isNull()
        return C.as_text(v, kind), absent
    if other == "datetime":
        text = operand.isoformat() if isinstance(operand, date | datetime) else str(operand)
        v = dates.parse_date(F.lit(text))
        return v, v.isNull()
    if other == "number":
        v = numbers.parse_number(F.lit(str(operand)))
        return v, v.isNull()
    return F.lit(str(operand)), F.lit(not str(operand).strip())


def _shown(v: Column, kind: str) -> Column:
    if kind == "number":
        return _number_text(v)
    if kind == "datetime":
        return F.when(F.date_format(v, "HH:mm:ss.SSSSSS") == "00:00:00.000000", F.date_format(v, "yyyy-MM-dd")).otherwise(F.regexp_replace(C.as_text(v, "timestamp_ntz"), " ", "T"))
    return F.concat(F.lit("'"), v, F.lit("'"))


def _cross(check: dict[str, Any], types: dict[str, str], compared: dict[str, str], side: Callable[[Any, str, str], tuple[Column, Column]]) -> tuple[Column, Column, Column] | str:
    """(is it broken, value, message) of a check on two operands, or what is wrong with the check."""
    op, left, right = str(check.get("op", "==")), check.get("left"), check.get("right")
    if op not in COMPARE:
        return f"unknown operator '{op}'"
    if left is None or right is None:
        return "cross-field check needs 'left' and 'right'"
    own = [compared.get(x, "literal") if isinstance(x, str) else "literal" for x in (left, right)]
    (a, no_a), (b, no_b) = side(left, own[0], own[1]), side(right, own[1], own[0])
    kinds = [k if k != "literal" else (o if o in ("datetime", "number") else "text") for k, o in (own, own[::-1])]
    sa, sb = _shown(a, kinds[0]), _shown(b, kinds[1])
    if kinds[0] != kinds[1]:  # not comparable: as texts
        a, b = a.cast("string"), b.cast("string")
    holds = getattr(a, COMPARE[op])(b)
    raw = C.as_text(col(left), types[left]) if own[0] != "literal" else F.lit(str(left))
    return ~no_a & ~no_b & ~holds, raw, F.concat(F.lit(f"expected {left} {op} {right}, got "), sa, F.lit(" vs "), sb)


def validate(df: DataFrame, rules: dict[str, Any], lines: DataFrame | None = None) -> Report:
    """Checks a frame by rules; failures come by rule in the order declared, then by row.

    lines (row, line) tells where rows begin in their file. A name in a check that
    is no column is a literal.
    """
    df = df if ROW in df.columns else with_row_ids(df)
    kinds = dict(df.dtypes)
    position, tests, alone, unique = 0, [], [], []
    for name, own in (rules.get("columns") or {}).items():
        if name not in kinds:
            alone.append((position, f"{name}.exists", name, f"Column '{name}' is declared in rules but missing."))
            position += 1
            continue
        for rule, spec in (own or {}).items():
            at, position = position, position + 1
            if rule not in RULES:
                alone.append((at, f"{name}.{rule}", name, f"Unknown rule '{rule}' for column '{name}'.{hint(rule, RULES)}"))
            elif rule == "unique":
                unique += [(at, name)] if spec else []
            elif found := _broken(name, kinds[name], rule, spec):
                tests.append((at, f"{name}.{rule}", name, found[0], C.as_text(col(name), kinds[name]), found[1]))
    checks = rules.get("checks") or []
    sides = [check.get(side) for check in checks for side in ("left", "right")]
    checked = list(dict.fromkeys(x for x in sides if isinstance(x, str) and x in kinds))
    compared = _compared_as(df, checked)
    held: dict[str, Column] = {}

    def side(operand: Any, own: str, other: str) -> tuple[Column, Column]:
        """A column's value is made once, in a projection ahead of the checks."""
        value, absent = _side(df, operand, own, other)
        if own == "literal":
            return value, absent
        at = checked.index(operand)
        held.update({f"__value{at}": value, f"__absent{at}": absent})
        return F.col(f"__value{at}"), F.col(f"__absent{at}")

    for check in checks:
        at, position = position, position + 1
        name, found = str(check.get("name", "cross_field")), _cross(check, kinds, compared, side)
        if isinstance(found, str):
            alone.append((at, name, "" if "operator" in found else str(check.get("left") or ""), found))
        else:
            tests.append((at, name, str(check["left"]), *found))
    spark = df.sparkSession
    schema = "position int, rule string, column string, row long, value string, message string"
    parts = []
    if tests:
        broken = [F.when(bad, F.struct(F.lit(at).alias("position"), F.lit(rule).alias("rule"), F.lit(c).alias("column"), value.alias("value"), message.alias("message"))) for at, rule, c, bad, value, message in tests]
        hit = df.withColumns(held).select(F.col(ROW).alias("row"), F.explode(F.array_compact(F.array(*broken).cast(f"array<{FAILURE}>"))).alias("f"))
        parts.append(hit.select("f.position", "f.rule", "f.column", "row", "f.value", "f.message"))
    for at, name in unique:
        rows = df.select(F.col(ROW).alias("row"), col(name).alias("v")).filter(~C.is_na(F.col("v"), kinds[name]))
        again = rows.groupBy("v").count().filter("count > 1").select("v")
        hit = rows.join(again, "v", "left_semi")
        parts.append(hit.select(F.lit(at).alias("position"), F.lit(f"{name}.unique").alias("rule"), F.lit(name).alias("column"), "row", C.as_text(F.col("v"), kinds[name]).alias("value"), F.lit("duplicate value violates uniqueness").alias("message")))
    parts.append(spark.createDataFrame([(a, b, c, None, None, m) for a, b, c, m in alone], schema))
    failures = parts[0]
    for p in parts[1:]:
        failures = failures.union(p)
    failures = failures.join(lines, "row", "left") if lines is not None else failures.withColumn("line", F.lit(None).cast("long"))
    failures = failures.select("position", "rule", "column", "row", "line", "value", "message")
    counts = failures.groupBy("position", "rule").count().orderBy("position").collect()
    by_rule: dict[str, int] = {}
    for r in counts:
        by_rule[r.rule] = by_rule.get(r.rule, 0) + r["count"]
    return Report(df.count(), position, failures, by_rule)
