"""The cleaning operators, chained on one frame, each with an entry in the audit log.

A frame carries its rows' places in the hidden column ROW; whatever depends on
the order of rows asks for it by name. An operator adds to the lazy plan, and
takes all the numbers of its log entry from one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime
from difflib import SequenceMatcher
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import columns as C
from tidemill.functions import contacts, dates, numbers, text
from tidemill.functions.quantiles import quantiles
from tidemill.operators import dedup
from tidemill.operators.options import TYPES, chosen, names
from tidemill.sources.storage import save
from tidemill.sources.tables import ROW, before_each, with_row_ids

BUCKET = 100_000
#: Variants listed in a log entry; counts are of all.
LISTED = 1000


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def plain_number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else f"{x:.10g}"


def short(value: Any, width: int = 60) -> Any:
    """A value for the log: long texts cut, dates without a time when it is midnight."""
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d") if value == value.replace(hour=0, minute=0, second=0, microsecond=0) else value.isoformat()
    if value is None or isinstance(value, bool | int | float):
        return value
    s = str(value)
    return s if len(s) <= width else s[: width - 1] + "…"


class Cleaner:
    """A frame and the log of what was done to it."""

    def __init__(self, df: DataFrame, row_id: str | None = None, store: bool = False):
        """row_id names a column of distinct longs to take for the rows' places.

        With store, the frame is written to the shared folder after each operator
        that changes cells, so later operators neither read the source nor parse
        its texts again.
        """
        self.store = store
        if row_id:
            df = df.select(col(row_id).cast("long").alias(ROW), *(col(c) for c in df.columns))
        self.frame = df if ROW in df.columns else with_row_ids(df)
        self.log: list[dict[str, Any]] = []
        self.reviews: list[DataFrame] = []

    @property
    def df(self) -> DataFrame:
        """The frame without row ids."""
        return self.frame.drop(ROW)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c != ROW]

    def messages(self) -> list[str]:
        return [e["message"] for e in self.log]

    def _kind(self, name: str) -> str:
        return dict(self.frame.dtypes)[name]

    def _missing(self, name: str) -> Column:
        return C.is_missing(col(name), self._kind(name))

    def _record(self, op: str, message: str, **details: Any) -> Cleaner:
        self.log.append({"op": op, "message": message, **details})
        return self

    def _skip(self, op: str, name: str) -> None:
        self._record(op, f"Skipped '{name}': column not found.", columns=[name], skipped=True)

    def _replace(self, new: dict[str, Column]) -> None:
        if new:
            self.frame = self.frame.withColumns(new)
            self._stored()

    def _stored(self) -> Cleaner:
        if self.store:
            self.frame = save(self.frame, "cleaned")
        return self

    def _first(self, where: Column, n: int, *shown: Column) -> list[Row]:
        return self.frame.filter(where).orderBy(ROW).select(ROW, *shown).limit(n).collect()

    # Headers and white space.

    def standardize_column_names(self) -> Cleaner:
        """snake_case headers, all distinct."""
        old = self.columns
        new = text.snake_case_all(old)
        self.frame = self.frame.select(ROW, *(col(a).alias(b) for a, b in zip(old, new)))
        renames = {a: b for a, b in zip(old, new) if a != b}
        return self._record("standardize_column_names", f"Renamed {len(renames)} column(s) to snake_case.", renames=renames, columns=[*renames])

    def normalize_whitespace(self, columns: Any = None, form: str = "NFKC") -> Cleaner:
        """Unicode normalisation, single spaces, no space at the ends; nothing but space becomes null.

        Columns of plain ASCII never leave the JVM.
        """
        kinds = dict(self.frame.dtypes)
        cols = [c for c in (names(columns) or self.columns) if c in kinds and C.is_text(kinds[c])]
        if cols:
            wide = self.frame.agg(*(F.coalesce(F.bool_or(col(c).rlike(r"[^\x00-\x7F]")), F.lit(False)) for c in cols)).first()
        ascii_only = lambda c: F.nullif(C.strip(F.regexp_replace(F.regexp_replace(c, r"[\t\n\x0B\f\r]", " "), " {2,}", " ")), F.lit(""))
        new = {c: text.normalise(col(c), form) if wide[i] else ascii_only(col(c)) for i, c in enumerate(cols)}
        both = self.frame.select(ROW, *(F.struct(col(c).alias("old"), v.alias("new")).alias(c) for c, v in new.items()))
        counted = [F.count_if(~col(c)["old"].eqNullSafe(col(c)["new"])) for c in cols] + [F.count_if(col(c)["old"].isNotNull() & col(c)["new"].isNull()) for c in cols]
        got = [*both.agg(*counted).first()] if cols else []
        changed, blank = dict(zip(cols, got)), dict(zip(cols, got[len(cols) :]))
        rows = {c: [r[0] for r in both.filter(col(c)["old"].isNotNull() & col(c)["new"].isNull()).select(ROW).orderBy(ROW).limit(20).collect()] for c, n in blank.items() if n}
        self._replace({c: v for c, v in new.items() if changed[c]})
        touched, total, blanks = [c for c in cols if changed[c]], sum(changed.values()), sum(blank.values())
        message = f"Normalised whitespace/unicode in {total} cell(s) across {len(touched)} column(s)."
        if blanks:
            message += f" {blanks} whitespace-only cell(s) became null."
        return self._record("normalize_whitespace", message, columns=touched, cells_changed=total, blank_to_null=blanks, blank_rows=rows)

    # Types.

    def coerce_types(self, mapping: dict[str, str] | None = None, on_fraction: str = "round") -> Cleaner:
        """Columns to integer, float, boolean, datetime or string; without a mapping to the types the profile infers."""
        if on_fraction is None:
            raise ValueError("on_fraction is null; YAML reads a bare 'null' as nothing. Use one of: round, nullify, error.")
        chosen("on_fraction", on_fraction)
        if mapping is None:
            from tidemill.operators.profiling import infer_types

            mapping = {c: t for c, t in infer_types(self.frame).items() if t in ("integer", "float", "boolean", "datetime")}
        known = {c: TYPES.get(str(t).lower()) for c, t in mapping.items() if c in self.columns}
        kinds = dict(self.frame.dtypes)
        textual = [c for c in known if C.is_text(kinds[c])]
        # Texts are parsed once and stored with what was read of them; evidence, counts and examples come from there.
        reads = {c: numbers.read_number(col(c)) for c in textual if known[c] in ("integer", "float")}
        reads |= {c: dates.read_date(col(c)) for c in textual if known[c] == "datetime"}
        held = {c: f"__r{i}" for i, c in enumerate(reads)}
        parsed = save(self.frame.withColumns({held[c]: r for c, r in reads.items()}), "parsed") if reads else self.frame
        reads = {c: F.col(h) for c, h in held.items()}
        numeric = {c: r for c, r in reads.items() if known[c] != "datetime"}
        readings = numbers.read_columns(parsed, [*numeric], ROW, numeric)
        dayfirst = dates.vote(parsed, {c: r for c, r in reads.items() if known[c] == "datetime"})
        # Numbers first, in a projection of their own: what follows uses them more than once.
        number = {c: f"__n{i}" for i, c in enumerate(known) if known[c] in ("integer", "float")}
        parsed = parsed.withColumns({n: numbers.number_of(reads[c], readings[c].hints) if c in readings else numbers.parse_number(col(c), kinds[c]) for c, n in number.items()})
        new: dict[str, Column] = {}
        for c, target in known.items():
            v, kind = col(c), kinds[c]
            n = F.col(number.get(c, ROW))
            if target == "float":
                new[c] = n
            elif target == "integer":
                whole = F.when(n == F.floor(n), n).otherwise(numbers.round_half_away(n) if on_fraction == "round" else None)
                new[c] = F.when(F.abs(whole) < 9.2e18, whole).cast("long")
            elif target == "boolean":
                new[c] = numbers.parse_boolean(v, kind)
            elif target == "datetime":
                new[c] = dates.as_timestamp(reads[c], dayfirst[c][0]) if c in dayfirst else v.cast("timestamp_ntz")
            elif target == "string":
                new[c] = F.when(~self._missing(c), C.as_text(v, kind))
        told = parsed.select(ROW, *number.values(), *(col(c).alias(f"o{i}") for i, c in enumerate(new)), *(v.alias(f"v{i}") for i, v in enumerate(new.values())))
        facts = self._coercion_facts(told, known, [*new], kinds, readings, number)
        for c in mapping:
            if c not in known:
                self._skip("coerce_types", c)
            elif known[c] is None:
                self._record("coerce_types", f"Unknown target type '{mapping[c]}' for '{c}'; left unchanged.", columns=[c], skipped=True)
            else:
                self._record_coercion(c, mapping[c], known[c], on_fraction, readings.get(c), dayfirst.get(c), facts[c])
        self.frame = parsed.withColumns(new).drop(*number.values(), *held.values())
        return self._stored()

    def _coercion_facts(self, told: DataFrame, known: dict, new: list[str], kinds: dict, readings: dict, number: dict[str, str]) -> dict[str, dict[str, Any]]:
        """Counts of all columns in one aggregate; further jobs only where there are examples to show."""
        fraction = {c: F.coalesce(F.col(number[c]) != F.floor(number[c]), F.lit(False)) if known[c] == "integer" else F.lit(False) for c in new}
        lost = {c: F.col(f"v{i}").isNull() & ~C.is_missing(F.col(f"o{i}"), kinds[c]) & ~fraction[c] for i, c in enumerate(new)}
        got = told.agg(*(f for c in new for f in (F.count_if(lost[c]), F.count_if(fraction[c])))).first() if new else []
        out = {}
        for i, c in enumerate(new):
            fact = out[c] = {"unparsed": got[2 * i], "fractions": got[2 * i + 1], "examples": [], "fraction_examples": [], "ambiguous": []}
            old = F.col(f"o{i}")
            mark = numbers.ambiguous_mark(numbers.core(old)["text"]) if C.is_text(kinds[c]) else F.lit(None)
            some = lambda where, n, *shown: told.filter(where).orderBy(ROW).select(ROW, *shown).limit(n).collect()
            if fact["unparsed"]:
                fact["examples"] = [short(r[1]) for r in some(lost[c] & ((F.instr(old.cast("string"), ".") + F.instr(old.cast("string"), ",") == 0) | mark.isNull()), 5, old)]
            if fact["fractions"]:
                fact["fraction_examples"] = [(r[0], short(r[1]), r[2]) for r in some(fraction[c], 20, old, numbers.round_half_away(F.col(number[c])).cast("long"))]
            if c in readings and readings[c].ambiguous:
                rows = some(mark.isNotNull(), 20, C.strip(old), F.col(number[c]), mark)
                fact["ambiguous"] = [{"value": r[1], "read_as": r[2], "reason": readings[c].decide(r[3])[1]} for r in rows]
        return out

    def _record_coercion(self, c: str, asked: str, target: str, on_fraction: str, reading: Any, dayfirst: Any, fact: dict[str, Any]) -> None:
        details: dict[str, Any] = {}
        notes: list[str] = []
        if reading and reading.ambiguous:
            details["ambiguous"] = fact["ambiguous"]
            first = fact["ambiguous"][0]
            notes.append(f"{reading.ambiguous} ambiguous value(s) read from column context (e.g. '{first['value']}' -> {plain_number(first['read_as'])}).")
        if target == "integer":
            if fact["fractions"] and on_fraction == "error":
                some = ", ".join(repr(v) for _, v, _ in fact["fraction_examples"][:3])
                raise ValueError(f"coerce_types: '{c}' has {fact['fractions']} non-integer value(s) ({some}); set on_fraction to round or nullify")
            rounds = on_fraction == "round"
            details["rounded" if rounds else "nullified"] = fact["fractions"]
            if fact["fractions"]:
                shown = [{"row": r, "value": v, "to": to if rounds else None} for r, v, to in fact["fraction_examples"]]
                details["fraction_examples"] = shown
                tail = f"were rounded (e.g. '{shown[0]['value']}' -> {shown[0]['to']})." if rounds else f"became null (e.g. '{shown[0]['value']}')."
                notes.append(f"{fact['fractions']} fractional value(s) {tail}")
        if dayfirst is not None:
            details["dayfirst"] = dayfirst[0]
            if dayfirst[0] and dayfirst[1]:
                details["ambiguous_dates"] = dayfirst[1]
                notes.append(f"Day-first detected; {dayfirst[1]} ambiguous value(s) such as 05/02/2023 were read day-first.")
        message = f"Coerced '{c}' to {asked}."
        if fact["unparsed"]:
            details["unparsed_examples"] = fact["examples"]
            message += f" {fact['unparsed']} value(s) could not be parsed and became null" + (f" (e.g. {fact['examples'][0]!r})." if fact["examples"] else ".")
        self._record("coerce_types", " ".join([message, *notes]), columns=[c], target=asked, unparsed=fact["unparsed"], **details)

    # Categories.

    def standardize_categoricals(self, column: str, canonical: Any, threshold: float = 0.8, extra_aliases: dict[str, str] | None = None) -> Cleaner:
        """Spellings of a label to the label: by alias, by equal key, or by the likest key if it is like enough."""
        if column not in self.columns:
            self._skip("standardize_categoricals", column)
            return self
        labels = {c: text.clean_key_of(c) for c in names(canonical)}
        aliases = {text.clean_key_of(k): v for k, v in (extra_aliases or {}).items()}

        def label(value: str | None) -> str | None:
            key = text.clean_key_of(value)
            if value is None or value.strip().lower() in C.NULL_TOKENS:
                return None
            if key in aliases:
                return aliases[key]
            best, top = None, 0.0
            for name, other in labels.items():
                score = 1.0 if key == other else SequenceMatcher(None, key, other).ratio()
                if score > top:
                    best, top = name, score
            return best if top >= threshold else None

        value = C.as_text(col(column), self._kind(column))
        values = self.frame.select(value.alias("v"), F.col(ROW)).filter(~C.is_missing(F.col("v"), "string")).groupBy("v").agg(F.count("*").alias("n"), F.min(ROW).alias("at"))
        told = save(values.select("v", "n", "at", text.by_value(label)(F.col("v")).alias("label"), text.canonical_key(F.col("v")).alias("key")), "labels")
        mapped = told.filter("label is not null and label <> v")
        cells, variants = mapped.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        # A key that matches nothing is told once, by the spelling that comes first.
        missed = told.filter("label is null").groupBy("key").agg(F.min_by("v", "at").alias("v"), F.min("at").alias("at"))
        left = [r.v for r in missed.orderBy("at").limit(LISTED).collect()]
        n_left = missed.count() if len(left) == LISTED else len(left)
        mapping = {r.v: r.label for r in mapped.orderBy("at").limit(LISTED).collect()}
        self._replace({column: F.coalesce(text.by_value(label)(value), col(column) if C.is_text(self._kind(column)) else value)})
        message = f"Standardised '{column}': mapped {variants} variant(s) to {len(labels)} canonical value(s) in {cells} cell(s); {n_left} left unmatched."
        return self._record("standardize_categoricals", message, columns=[column], mapping=mapping, unmatched=left, cells_changed=cells, threshold=threshold)

    # Missing values.

    def handle_missing(self, strategy: str = "flag", columns: Any = None, value: Any = None, how: str = "any") -> Cleaner:
        """Drops rows or empty columns, fills gaps, or flags rows that have gaps."""
        chosen("strategy", strategy)
        chosen("how", how)
        cols = [c for c in (names(columns) or self.columns) if c in self.columns]
        if strategy == "fill" and value is None:
            raise ValueError("handle_missing: strategy 'fill' needs a value (mean, median, mode, ffill, bfill or a constant)")
        return getattr(self, f"_{strategy}")(cols, value, how)

    def _gaps(self, cols: list[str], how: str = "any") -> Column:
        out = F.lit(False)
        for i, c in enumerate(cols):
            out = self._missing(c) if not i else out & self._missing(c) if how == "all" else out | self._missing(c)
        return out

    def _drop_rows(self, cols: list[str], value: Any, how: str) -> Cleaner:
        gap = self._gaps(cols, how)
        before, dropped = self.frame.agg(F.count("*"), F.count_if(gap)).first()
        rows = [r[0] for r in self._first(gap, 100)] if dropped else []
        self.frame = self.frame.filter(~gap)
        message = f"Dropped {dropped} row(s) with missing values in {how} of {len(cols)} column(s)."
        return self._record("handle_missing", message, columns=cols, how=how, rows_before=before, rows_after=before - dropped, dropped_rows=rows)

    def _drop_columns(self, cols: list[str], value: Any, how: str) -> Cleaner:
        full = self.frame.agg(*(F.count_if(~self._missing(c)) for c in cols)).first() if cols else []
        empty = [c for c, n in zip(cols, full) if not n]
        self.frame = self.frame.drop(*empty)
        return self._record("handle_missing", f"Dropped {len(empty)} fully-empty column(s).", columns=empty)

    def _flag(self, cols: list[str], value: Any, how: str) -> Cleaner:
        gap = self._gaps(cols)
        n = self.frame.agg(F.count_if(gap)).first()[0]
        self._replace({"has_missing": gap})
        return self._record("handle_missing", f"Flagged {n} row(s) with missing values in new column 'has_missing'.", columns=cols, flag_column="has_missing")

    def _fill(self, cols: list[str], value: Any, how: str) -> Cleaner:
        counts = self.frame.agg(*(F.count_if(self._missing(c)) for c in cols)).first() if cols else []
        total, touched, fills, notes = 0, [], {}, []
        for c, n in zip(cols, counts):
            if not n:
                continue
            if value in ("ffill", "bfill"):
                self._carry(c, forward=value == "ffill")
                n -= self.frame.agg(F.count_if(col(c).isNull())).first()[0]
            else:
                fill, note = self._fill_value(c, value)
                if fill is None:
                    continue
                notes += [note] if note else []
                kind = self._kind(c)
                shown = F.lit(fill) if not C.is_text(kind) or isinstance(fill, str) else F.lit(str(fill))
                self._replace({c: F.when(self._missing(c), shown.cast(kind)).otherwise(col(c))})
                fills[c] = short(fill)
            total += n
            touched.append(c)
        message = " ".join([f"Filled {total} missing value(s) across {len(touched)} column(s) using '{value}'.", *notes])
        return self._record("handle_missing", message, columns=touched, cells_changed=total, fill=str(value), fill_values=fills)

    def _carry(self, c: str, forward: bool) -> None:
        """Fills with the last value before (or the next after) in row order.

        Rows are windowed in buckets of neighbouring places; only a value for each
        bucket is carried across, so no task sorts the whole column.
        """
        order = F.col(ROW) if forward else -F.col(ROW)
        bucket = F.floor(F.col(ROW) / BUCKET)
        kept = F.when(~self._missing(c), col(c))
        rows = self.frame.select("*", bucket.alias("__b"), kept.alias("__v"))
        inside = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        last = rows.filter(F.col("__v").isNotNull()).groupBy("__b").agg((F.max_by if forward else F.min_by)("__v", ROW).alias("__x"))
        buckets = rows.select("__b").distinct().join(last, "__b", "left")
        carried = before_each(save(buckets, "buckets"), "__b", "__x", forward, BUCKET).select("__b", F.col("__x").alias("__c"))
        filled = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(inside)).join(carried, "__b", "left")
        self.frame = filled.withColumn(c, F.coalesce("__v", "__c")).select(self.frame.columns)

    def _numbers(self, c: str) -> Column:
        kind = self._kind(c)
        hints = numbers.read_columns(self.frame, [c], ROW)[c].hints if C.is_text(kind) else (None, None)
        return numbers.parse_number(col(c), kind, hints)

    def _fill_value(self, c: str, value: Any) -> tuple[Any, str]:
        """The value that fits the column's type, and a note if it had to be rounded."""
        kind = self._kind(c)
        whole, real = kind in ("int", "bigint", "smallint", "tinyint"), kind in ("double", "float") or kind.startswith("decimal")
        stamp = kind in ("timestamp_ntz", "timestamp", "date")
        refuse = lambda what: ValueError(f"handle_missing: cannot fill {what} column '{c}' with {value!r}")
        if value in ("mean", "median"):
            if kind == "boolean":
                raise ValueError(f"handle_missing: cannot fill boolean column '{c}' with the {value}; use 'mode' or a constant")
            v = F.unix_micros(col(c).cast("timestamp")).cast("double") if stamp else self._numbers(c)
            rows = self.frame.select(v.alias("v"))
            result = rows.agg(F.avg("v")).first()[0] if value == "mean" else (quantiles(rows, ["v"], [0.5])["v"] or [None])[0]
            if result is None:
                return None, ""
            if stamp:
                return self.frame.sparkSession.range(1).select(F.timestamp_micros(F.lit(int(result))).cast("timestamp_ntz")).first()[0], ""
            value = float(result)
        elif value == "mode":
            # Values are summed up by their groups, so that no task has to hold all of them; of equal ones the least.
            counts = self.frame.filter(~self._missing(c)).groupBy(col(c).alias("v")).agg(F.count("*").alias("n"))
            best = counts.orderBy(F.desc("n"), "v").first()
            return (best["v"] if best else None), ""
        if whole or real:
            n = float(value) if isinstance(value, int | float) and not isinstance(value, bool) else self._scalar(numbers.parse_number, value)
            if n is None:
                raise refuse("integer" if whole else "numeric")
            if real:
                return n, ""
            rounded = int(math.copysign(math.floor(abs(n) + 0.5), n))
            return rounded, "" if n == rounded else f"'{c}' is an integer column: fill value {plain_number(n)} was rounded to {rounded}."
        if kind == "boolean":
            b = value if isinstance(value, bool) else self._scalar(numbers.parse_boolean, value)
            if b is None:
                raise refuse("boolean")
            return b, ""
        if stamp:
            day = value if isinstance(value, datetime) else self._scalar(dates.parse_date, value)
            if day is None:
                raise refuse("date")
            return day, ""
        return value, ""

    def _scalar(self, function: Callable[[Column], Column], value: Any) -> Any:
        return self.frame.sparkSession.range(1).select(function(F.lit(str(value)))).first()[0]

    # Duplicates.

    def deduplicate(self, subset: Any = None, keep: str = "first", fuzzy: bool = False, fuzzy_keys: Any = None, threshold: float = 0.9, flag: bool = False, block_on: Any = None) -> Cleaner:
        """Removes or flags rows that repeat another one, exactly or nearly.

        The log lists the first LISTED pairs; `reviews` has them all as tables,
        with the values of both rows.
        """
        chosen("keep", keep)
        if not 0 < float(threshold) <= 1:
            raise ValueError(f"threshold={threshold!r} must be in (0, 1]")
        subset, block_on = names(subset), names(block_on)
        for c in subset + block_on:
            if c not in self.columns:
                raise ValueError(f"deduplicate: column '{c}' not found")
        keys = [k for k in (names(fuzzy_keys) or subset or self.columns) if k in self.columns]
        pairs = save(dedup.duplicate_pairs(self.frame, subset, keep, fuzzy, keys, float(threshold), block_on), "pairs")
        counts = dict(pairs.groupBy("match").count().collect())
        exact, near = counts.get("exact", 0), counts.get("fuzzy", 0)
        listed = [{k: v for k, v in r.asDict().items() if v is not None} for r in pairs.orderBy("row").limit(LISTED).collect()]
        values = F.struct(*(col(c) for c in self.columns))
        sides = [self.frame.select(F.col(ROW).alias(r), values.alias(v)) for r, v in (("row", "values"), ("kept_row", "kept_values"))]
        self.reviews.append(pairs.join(sides[0].hint("merge"), "row").join(sides[1].hint("merge"), "kept_row").select("row", "kept_row", "match", "score", "key", "kept_key", "values", "kept_values"))
        how = f"{exact} exact on {subset if subset else 'all columns'}" + (f", {near} fuzzy at threshold {threshold}" if fuzzy else "")
        common = {"columns": subset, "duplicates": exact + near, "exact": exact, "fuzzy": near, "keep": keep, "pairs": listed}
        # Pairs may be as many as rows: small files of them are no reason to send them through the driver.
        marked = pairs.select(F.col("row").alias(ROW), F.col("kept_row").alias("duplicate_of")).hint("merge")
        if flag:
            old = [c for c in self.frame.columns if c not in ("is_duplicate", "duplicate_of")]
            self.frame = self.frame.select(old).join(marked, ROW, "left").select(*old, F.col("duplicate_of").isNotNull().alias("is_duplicate"), "duplicate_of")
            return self._record("deduplicate", f"Flagged {exact + near} duplicate row(s) ({how}) in new columns 'is_duplicate' and 'duplicate_of'.", flagged=True, **common)
        before = self.frame.count()
        self.frame = self.frame.join(marked, ROW, "left_anti").select(self.frame.columns)
        return self._record("deduplicate", f"Removed {exact + near} duplicate row(s) ({how}), keeping the {keep.replace('_', ' ')} of each group.", rows_before=before, rows_after=before - exact - near, **common)

    # Outliers.

    def handle_outliers(self, columns: Any, method: str = "iqr", action: str = "flag", factor: float = 1.5, z: float = 3.0) -> Cleaner:
        """Caps or flags values beyond Tukey's fences or z standard deviations."""
        chosen("method", method)
        chosen("action", action)
        cols = [c for c in names(columns) if c in self.columns]
        parsed = {c: f"__n{i}" for i, c in enumerate(cols)}
        columns = self.frame.columns
        if cols:
            self.frame = save(self.frame.withColumns({n: self._numbers(c) for c, n in parsed.items()}), "numbers")  # texts are parsed once
        values = {c: F.col(n) for c, n in parsed.items()}
        bounds = fences(self.frame, values, method, factor, z)
        whole = ("int", "bigint", "smallint", "tinyint")
        bounds = {c: (float(math.ceil(a)), float(math.floor(b))) if self._kind(c) in whole else (a, b) for c, (a, b) in bounds.items()}
        out = {c: F.coalesce((values[c] < a) | (values[c] > b), F.lit(False)) for c, (a, b) in bounds.items()}
        counts = dict(zip(out, self.frame.agg(*(F.count_if(o) for o in out.values())).first())) if out else {}
        touched = [c for c in out if counts[c]]
        examples = {c: [{"row": r[0], "value": short(r[1])} for r in self._first(out[c], 10, col(c))] for c in touched}
        new = {}
        for c in touched:
            a, b = bounds[c]
            if action == "flag":
                new[f"{c}_is_outlier"] = out[c]
                continue
            kind = self._kind(c)
            capped = F.when(values[c].isNotNull(), F.greatest(F.least(values[c], F.lit(b)), F.lit(a)))
            new[c] = F.coalesce(C.as_text(capped, "double"), col(c)) if C.is_text(kind) else capped.cast(kind)
        if action == "cap":
            # Text that is a number throughout becomes a column of numbers.
            texts = [c for c in touched if C.is_text(self._kind(c))]
            rest = self.frame.agg(*(F.count_if(values[c].isNull() & col(c).isNotNull()) for c in texts)).first() if texts else []
            for c, n in zip(texts, rest):
                if not n:
                    new[c] = F.greatest(F.least(F.when(values[c].isNotNull(), values[c]), F.lit(bounds[c][1])), F.when(values[c].isNotNull(), F.lit(bounds[c][0])))
                    new[c] = F.when(values[c].isNotNull(), new[c])
        self.frame = self.frame.withColumns(new).select(*(f"`{c}`" for c in [*columns, *(c for c in new if c not in columns)]))
        self._stored()
        total = sum(counts[c] for c in touched)
        message = f"{'Capped' if action == 'cap' else 'Flagged'} {total} outlier(s) across {len(touched)} column(s) via {method}."
        return self._record("handle_outliers", message, columns=touched, outliers=total, method=method, action=action, fences={c: list(bounds[c]) for c in touched}, examples=examples)

    # Contacts.

    def _present(self, op: str, columns: Any) -> list[str]:
        if not names(columns):
            raise ValueError(f"{op}: 'columns' must name at least one column")
        for c in names(columns):
            if c not in self.columns:
                self._skip(op, c)
        return [c for c in names(columns) if c in self.columns]

    def standardize_emails(self, columns: Any, fix_typos: bool = True, invalid: str = "keep") -> Cleaner:
        """Addresses in lower case with providers' typos repaired; what stays malformed is kept, nulled or flagged."""
        chosen("invalid", invalid)
        for c in self._present("standardize_emails", columns):
            raw, gap = C.as_text(col(c), self._kind(c)), self._missing(c)
            read = save(self.frame.withColumn("__e", F.when(~gap, contacts.email(raw, fix_typos))), "emails")  # read once, whatever is told of it
            told = read.select(ROW, raw.alias("raw"), F.col("__e").alias("e"))
            bad = F.col("e").isNotNull() & ~F.col("e.valid")
            changed, fixed, n_bad = told.agg(F.count_if(F.col("e.value") != F.col("raw")), F.count_if(F.col("e.fixed")), F.count_if(bad)).first()
            examples = [{"row": r[0], "value": short(r.raw)} | ({"suggestion": r.e.suggestion} if r.e.suggestion else {}) for r in told.filter(bad).orderBy(ROW).limit(20).collect()]
            self.frame = read
            self._settle(c, F.col("__e.value"), F.coalesce(~F.col("__e.valid"), F.lit(False)), invalid)
            self.frame = self.frame.drop("__e")
            fate = {"keep": "kept", "null": "set to null", "flag": "flagged"}[invalid]
            message = f"Standardised emails in '{c}': {changed} cell(s) changed, {fixed} domain typo(s) fixed, {n_bad} invalid" + (f" ({fate})." if n_bad else ".")
            self._record("standardize_emails", message, columns=[c], cells_changed=changed, typos_fixed=fixed, invalid=n_bad, invalid_examples=examples, on_invalid=invalid)
        return self

    def _settle(self, c: str, new: Column, bad: Column, invalid: str) -> None:
        if invalid == "flag":
            self._replace({f"{c}_is_invalid": bad, c: new})
        else:
            self._replace({c: F.when(bad, None).otherwise(new) if invalid == "null" else new})

    def standardize_phones(self, columns: Any, default_region: str = "PA", region_column: str | None = None, invalid: str = "keep") -> Cleaner:
        """Numbers in E.164, read in the row's own country, else in the default region, else as international ones."""
        chosen("invalid", invalid)
        default = contacts.known_region(default_region)
        there = region_column in self.columns if region_column else False
        lost = f" Region column '{region_column}' not found; used {default}." if region_column and not there else ""
        for c in self._present("standardize_phones", columns):
            raw, gap = C.as_text(col(c), self._kind(c)), self._missing(c)
            country = C.as_text(col(region_column), self._kind(region_column)) if there else None
            frame, region = self.frame, F.lit(None).cast("string")
            if there:
                known = contacts.regions_of(frame, country).select(F.col("country").alias("__country"), F.col("region").alias("__region"))
                frame, region = frame.join(known, country == F.col("__country"), "left"), F.col("__region")
            read = contacts.with_phones(frame, F.when(~gap, raw), region, default, "__p").drop("__country", "__region")
            read = save(read, "phones")  # read once, whatever is told of it
            valid = F.coalesce(F.col("__p.valid"), F.lit(False))
            told = read.select(ROW, raw.alias("raw"), F.col("__p").alias("p"))
            ok, bad, via = F.col("p.valid"), ~F.col("p.valid"), F.col("p.valid") & F.col("p.via").isNotNull()
            regions = {r.region: r.asDict()["count"] for r in told.filter(ok).groupBy(F.col("p.region").alias("region")).count().collect()}
            changed, n_bad, n_via = told.agg(F.count_if(ok & (F.col("p.value") != F.col("raw"))), F.count_if(bad), F.count_if(via)).first()
            bad_rows = told.filter(bad).orderBy(ROW).limit(20).collect()
            via_rows = told.filter(via).orderBy(ROW).limit(50).collect()
            flags = {f"{c}_is_invalid": ~gap & ~valid} if invalid == "flag" else {}
            new = F.when(valid, F.col("__p.value")).when(~gap, F.lit(None) if invalid == "null" else raw)
            self.frame = read.withColumns({**flags, c: new}).drop("__p")
            self._stored()
            fate = {"keep": "kept as-is", "null": "set to null", "flag": "flagged"}[invalid]
            message = f"Standardised phones in '{c}' to E.164: {changed} cell(s) changed, {n_bad} invalid" + (f" ({fate})" if n_bad else "")
            message += (f", {n_via} read outside the row's region." if n_via else ".") + lost
            self._record(
                "standardize_phones",
                message,
                columns=[c],
                cells_changed=changed,
                invalid=n_bad,
                invalid_examples=[{"row": r[0], "value": short(r.raw), "region": r.p.row_region, "note": r.p.note} for r in bad_rows],
                fallbacks=[{"row": r[0], "value": short(r.raw), "row_region": r.p.row_region, "read_as": r.p.value, "via": r.p.via} for r in via_rows],
                regions=dict(sorted(regions.items())),
                default_region=default,
                region_column=region_column,
                on_invalid=invalid,
            )
        return self

    def _by_value(self, op: str, columns: Any, function: Callable[[str | None], str | None], what: str) -> Cleaner:
        for c in self._present(op, columns):
            raw = C.as_text(col(c), self._kind(c))
            made = save(self.frame.withColumn("__new", text.by_value(function)(raw)), "values")
            told = made.select(ROW, raw.alias("raw"), F.col("__new").alias("new"))
            differs = ~F.col("raw").eqNullSafe(F.col("new"))
            n = told.agg(F.count_if(differs)).first()[0]
            some = [{"row": r[0], "from": short(r.raw), "to": short(r.new)} for r in told.filter(differs).orderBy(ROW).limit(10).collect()]
            columns = self.frame.columns
            self.frame = made.withColumn(c, F.col("__new")).select(columns)
            self._record(op, f"{what} in '{c}': {n} cell(s) changed.", columns=[c], cells_changed=n, examples=some)
        return self

    def standardize_names(self, columns: Any) -> Cleaner:
        """Personal names with capitals; placeholders are names like any other here."""
        return self._by_value("standardize_names", columns, contacts.name_of, "Standardised names")

    def clean_addresses(self, columns: Any) -> Cleaner:
        """Postal addresses with street words written out; placeholders are text like any other here."""
        return self._by_value("clean_addresses", columns, contacts.address_of, "Cleaned addresses")

    def apply(self, function: Callable[[DataFrame], DataFrame], message: str = "Applied a custom function.") -> Cleaner:
        """Any function of a frame; it has to keep ROW."""
        before = self.frame.columns
        self.frame = function(self.frame)
        if ROW not in self.frame.columns:
            raise ValueError(f"apply: the function must keep the column {ROW}")
        return self._record("apply", message, columns_before=len(before) - 1, columns_after=len(self.columns))


def fences(df: DataFrame, values: dict[str, Column], method: str, factor: float, z: float) -> dict[str, tuple[float, float]]:
    """Bounds of columns with four numbers or more and some spread."""
    if not values:
        return {}
    rows = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values.values())))
    got = rows.agg(*(x for v in rows.columns for x in (F.count(v), F.avg(v), F.stddev_pop(v)))).first()
    quarters = quantiles(rows, rows.columns, [0.25, 0.75]) if method == "iqr" else {}
    out = {}
    for i, c in enumerate(values):
        n, mean, deviation = got[3 * i : 3 * i + 3]
        if n < 4:
            continue
        if method == "zscore":
            if deviation:
                out[c] = (mean - z * deviation, mean + z * deviation)
            continue
        a, b = quarters[f"v{i}"]
        if a != b:
            out[c] = (a - factor * (b - a), b + factor * (b - a))
    return out


def clean(df: DataFrame, row_id: str | None = None, store: bool = False) -> Cleaner:
    return Cleaner(df, row_id, store)


__all__ = ["Cleaner", "clean", "fences"]
