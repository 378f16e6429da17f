"""Vocabularies of the operators' options, and checks of them."""

from __future__ import annotations

import difflib
from collections.abc import Iterable
from typing import Any

#: Names of target types, and what they mean.
TYPES = {
    "integer": "integer", "int": "integer",
    "float": "float", "number": "float",
    "boolean": "boolean", "bool": "boolean",
    "datetime": "datetime", "date": "datetime",
    "string": "string", "str": "string", "text": "string",
}
CHOICES = {
    "strategy": ("flag", "fill", "drop_rows", "drop_columns"),
    "how": ("any", "all"),
    "method": ("iqr", "zscore"),
    "action": ("flag", "cap"),
    "keep": ("first", "last", "most_complete"),
    "on_fraction": ("round", "nullify", "error"),
    "invalid": ("keep", "null", "flag"),
}


def hint(word: Any, options: Iterable[str]) -> str:
    close = difflib.get_close_matches(str(word), list(options), n=1, cutoff=0.6)
    return f" Did you mean '{close[0]}'?" if close else ""


def chosen(name: str, value: Any) -> str:
    """The value, if it is one of the option's; else a ValueError that says which there are."""
    if isinstance(value, str) and value in CHOICES[name]:
        return value
    raise ValueError(f"{name}={value!r} is not valid; choose one of: {', '.join(CHOICES[name])}.{hint(value, CHOICES[name]) if isinstance(value, str) else ''}")


def names(value: Any) -> list[str]:
    """A column name, or several, as a list."""
    return [] if value is None else [value] if isinstance(value, str) else list(value)
