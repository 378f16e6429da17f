"""Text keys and normalisation.

Unicode normalisation has no built-in function, so it runs in Arrow batches;
values of plain ASCII take a short way in them. Deciding whether two keys are
spellings of the same value is done on the driver, for a bounded number of keys.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.columns import NULL_TOKENS

#: Words that decorate a name without changing what it names.
NOISE = frozenset({"rep", "republica", "republic", "de", "del", "of", "the", "la", "el"})
#: Code points that count as a space.
SPACES = {c: " " for c in (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF)}


def key_of(value: str | None) -> str:
    """Comparison key: no accents, lower case, everything but letters and digits one space."""
    if not value:
        return ""
    if not value.isascii():
        value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return " ".join(re.findall("[0-9a-z]+", value.lower()))


def clean_key_of(value: str | None) -> str:
    """`key_of`, with placeholders as empty."""
    return "" if value is None or value.strip().lower() in NULL_TOKENS else key_of(value)


def normalised(value: str | None, form: str = "NFKC") -> str | None:
    """Unicode-normalised, spaces folded and collapsed; nothing but spaces becomes null."""
    if value is None:
        return None
    text = value if value.isascii() else unicodedata.normalize(form, value)
    return re.sub(" {2,}", " ", text.translate(SPACES)).strip() or None


def by_value(function, kind: str = "string"):
    """A column function that applies `function` once to each distinct value of an Arrow batch."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        codes, names = pd.factorize(values, use_na_sentinel=True)
        mapped = [function(x) for x in names.tolist()]
        empty = function(None)
        return pd.Series([mapped[k] if k >= 0 else empty for k in codes], dtype=object)

    return run


def canonical_key(c: Column) -> Column:
    return by_value(clean_key_of)(c)


def normalise(c: Column, form: str = "NFKC") -> Column:
    return by_value(lambda v: normalised(v, form))(c)


def without_noise(key: str) -> str:
    words = key.split()
    return " ".join(w for w in words if w not in NOISE) or key if len(words) > 1 else key


def one_edit(a: str, b: str) -> bool:
    """Do the texts differ by one insertion, deletion, substitution or swap of neighbours at most?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) < len(b):
        return a[start:] == b[start + 1 :]
    swapped = a[start + 1 : start + 2] == b[start : start + 1] and a[start : start + 1] == b[start + 1 : start + 2]
    return a[start + 1 :] == b[start + 1 :] or (swapped and a[start + 2 :] == b[start + 2 :])


def same_value(a: str, b: str) -> bool:
    """Are two keys spellings of one value?"""
    if not a or not b:
        return False
    x, y = without_noise(a), without_noise(b)
    if a == b or x == y:
        return True
    digits = lambda s: re.sub(r"\D", "", s)
    return digits(x) == digits(y) and min(len(x), len(y)) >= 5 and x[0] == y[0] and one_edit(x, y)


def snake_case(name: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", str(name).strip()) if not unicodedata.combining(c))
    text = re.sub(r"([a-z0-9])(?=[A-Z])|([A-Z])(?=[A-Z][a-z])", r"\1\2_", text)
    text = "_".join(re.findall("[0-9a-z]+", text.lower())) or "column"
    return f"col_{text}" if text[0].isdigit() else text


def snake_case_all(names: Iterable[str]) -> list[str]:
    """Distinct snake_case names; a name that is taken gets the least number that is free and nobody's own name."""
    natural = [snake_case(n) for n in names]
    out: list[str] = []
    for name in natural:
        new, k = name, 0
        while new in out or (k and new in natural):
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out
