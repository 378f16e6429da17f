"""Spellings of the same value, by neighbourhoods of deletions.

Two keys that differ by one insertion, deletion, substitution or swap of neighbours
have a text in common among themselves and themselves less one character. So keys
meet by those texts, a join, and what meets is confirmed; no pair of other keys is
looked at. Keys that are spellings of one value, directly or by way of others, are
a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators.graph import components
from tidemill.sources.storage import save


def key_of(value: str) -> str:
    return text.without_noise(text.key_of(value))


def neighbourhood(key: str) -> Iterator[str]:
    """The key, and each text that one deletion leaves; keys too short to be misspelt stand alone."""
    yield key
    if len(key) > 4:
        yield from dict.fromkeys(key[:i] + key[i + 1 :] for i in range(1, len(key)))


def _cased(value: str) -> bool:
    letters = "".join(c for c in value if c.isalpha())
    return bool(letters) and (len(letters) <= 3 or not (letters.isupper() or letters.islower()))


def _told(rows: list[tuple[str, int, int]]) -> dict[str, Any]:
    """rows: (value, times, first place) of one value's spellings; the most frequent is the canonical one."""
    best = max(rows, key=lambda r: (r[1], _cased(r[0]), -r[2]))
    return {"canonical": best[0], "count": sum(r[1] for r in rows), "variants": [[v, n] for v, n, _ in sorted(rows, key=lambda r: (-r[1], r[2]))]}


def clusters(counts: Iterable[tuple[str, int]]) -> list[dict[str, Any]]:
    """Spellings of the same value together; counts in the order in which values are first seen. For bounded lists."""
    counts = [*counts]
    keys = {v: key_of(v) for v, _ in counts}
    meet: dict[str, list[str]] = {}
    for k in dict.fromkeys(keys.values()):
        for x in neighbourhood(k):
            meet.setdefault(x, []).append(k)
    above = {k: k for k in keys.values()}

    def root(k: str) -> str:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    for met in meet.values():
        for i, a in enumerate(met):
            for b in met[:i]:
                if root(a) != root(b) and text.same_value(a, b):
                    above[root(a)] = root(b)
    members: dict[str, list[tuple[str, int, int]]] = {}
    for at, (v, n) in enumerate(counts):
        members.setdefault(root(keys[v]), []).append((v, n, at))
    return sorted(map(_told, members.values()), key=lambda c: (-c["count"], c["canonical"]))


def spelling_clusters(values: DataFrame) -> DataFrame:
    """canonical, count, variants (value, n) of a table of distinct values (v, n, at), of any size.

    A group's spellings meet in one task, as they are one row of the result.
    """
    keyed = save(values.select("v", "n", "at", F.udf(key_of, "string", useArrow=True)("v").alias("key")), "keys")
    keys = save(keyed.groupBy("key").agg(F.min("at").alias("at")).withColumn("id", F.monotonically_increasing_id()), "keys")
    near = keys.select("id", "key", F.explode(F.udf(lambda k: [*neighbourhood(k)], "array<string>", useArrow=True)("key")).alias("meet"))
    pairs = near.alias("a").join(near.alias("b"), (F.col("a.meet") == F.col("b.meet")) & (F.col("a.id") < F.col("b.id")))
    pairs = pairs.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()
    same = F.udf(text.same_value, "boolean", useArrow=True)
    roots = components(pairs.filter(same("x", "y")).select("u", "v"))
    rooted = keys.join(roots, keys["id"] == roots["node"], "left").select("key", F.coalesce("root", "id").alias("root"))

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _told([*zip(pdf["v"], pdf["n"].tolist(), pdf["at"].tolist())])
        return pd.DataFrame({"canonical": [c["canonical"]], "count": [c["count"]], "variants": [[{"value": v, "n": n} for v, n in c["variants"]]]})

    return keyed.join(rooted, "key").groupBy("root").applyInPandas(told, "canonical string, count long, variants array<struct<value:string,n:long>>")
