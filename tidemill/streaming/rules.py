"""Column rules on a stream: stateless ones row by row, batches through the validator."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.validation import _broken, validate
from tidemill.sources.tables import with_row_ids

STATELESS = ("not_null", "range", "regex", "allowed", "dtype")


def broken_rules(stream: DataFrame, rules: dict[str, Any], column: str = "broken") -> DataFrame:
    """The stream with the names of the rules that each row breaks; needs no state.

    Rules on columns only; `unique` needs all rows and is refused.
    """
    kinds = dict(stream.dtypes)
    tests = []
    for name, own in (rules.get("columns") or {}).items():
        for rule, spec in (own or {}).items():
            if rule not in STATELESS:
                raise ValueError(f"rule '{rule}' can't be asked of single rows")
            if name not in kinds:
                raise ValueError(f"column '{name}' is not in the stream")
            found = _broken(name, kinds[name], rule, spec)
            if found:
                tests.append(F.when(found[0], F.lit(f"{name}.{rule}")))
    names = F.array_compact(F.array(*tests)) if tests else F.array()
    return stream.withColumn(column, names.cast("array<string>"))


def validate_batches(stream: DataFrame, rules: dict[str, Any], sink: Callable[[DataFrame, int], None]):
    """A stream writer that validates each micro-batch and hands its failures to the sink."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(validate(with_row_ids(df), rules).failures, n))
