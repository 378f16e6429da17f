"""Decontamination by a distributed positional inverted index.

Training texts are indexed in segments of some megabytes: for each term of a segment
its postings, the ascending places of its tokens. Places count through the
segment's texts with a gap between texts, so nothing spans two of them. The index
is a table by segment and term, stored once; postings never leave their segment,
so a hot term is no hot key.

Test items give windows of consecutive words. Terms are ordered by their number of
postings in the whole index, rarest first. In a segment a window's candidates are
its rarest term's places, less the term's offset in the window; the offset-adjusted
postings of the next rarer terms are intersected with them one by one until none
is left or all terms agree: an exact match. A proximity match is told by the same
postings: all terms within a reach of one place of the rarest.

Only postings of terms that some item has are read back, joined with the terms on a
table of the items' terms. Items are taken in blocks of bounded size, so test sets
of any size go through; hits of a text are merged over the blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.storage import save, small_batches
from tidemill.llm.words import pieces, words

#: Bytes of text from which on a segment takes no further text; free places between texts.
SEGMENT, GAP = 8 << 20, 256
#: Bytes of items that are searched for at a time.
BLOCK = 8 << 20

_INDEX = "segment long, term binary, n long, places binary, docs array<long>, sizes array<long>"
_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("places", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_FOUND = "segment long, place long, doc_id long, n_words long, items array<string>, near array<string>, spans array<struct<a:long,b:long>>"


class _Segment:
    """Texts by the numbers of their terms."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.parts: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        n = 0
        for part in pieces(text, 1 << 20):
            found = words(part)
            self.parts.append(np.fromiter(map(self.terms.__getitem__, found), np.int32, len(found)))
            n += len(found)
        self.docs.append(doc_id)
        self.sizes.append(n)
        self.bytes += len(text) + 64

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row with the texts' ids and sizes, and a row for each term with its places as 32-bit numbers."""
        numbers = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        places = (np.arange(len(numbers)) + np.repeat(np.arange(len(self.sizes)) * GAP, self.sizes)).astype(np.uint32)
        order = np.argsort(numbers, kind="stable")
        counts = np.bincount(numbers, minlength=len(self.terms))
        ends = np.cumsum(counts)
        data = places[order]
        offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64))
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(data)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.binary()), pa.array([len(self.docs)]), pa.array([None], pa.binary()), pa.array([self.docs], _ARROW.types[4]), pa.array([self.sizes], _ARROW.types[5])], schema=_ARROW)
        if len(ends):
            none = pa.nulls(len(ends), _ARROW.types[4])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), number)), pa.array([*self.terms], pa.binary()), pa.array(counts), lists, none, none], schema=_ARROW)


def _indexed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        segment = _Segment()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                segment.add(doc_id, text or b"")
                if segment.bytes >= size:
                    yield from segment.rows(number)
                    number, segment = number + 1, _Segment()
        if segment.docs:
            yield from segment.rows(number)

    return run


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT) -> DataFrame:
    """The stored positional index of all texts: segment, term, n, places; and a row without a term for each segment, with docs and sizes.

    A null text has no words; a repeated row is a document of its own.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return save(rows.mapInArrow(_indexed(size), _INDEX), "index")


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about size bytes; a block at a time is on the driver."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("text IS NOT NULL")
    rows = save(rows, "items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // size))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        if block := [(r.item, bytes(r.text)) for r in part.collect()]:
            yield block


def _windows(block: list[tuple[str, bytes]], window: int) -> tuple[list[bytes], list[tuple[tuple[int, ...], list[str]]]]:
    """The block's terms, and the distinct windows, as numbers of terms, with their items."""
    terms: defaultdict[bytes, int] = defaultdict()
    terms.default_factory = terms.__len__
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in block:
        numbers = [terms[w] for w in words(text)]
        for i in range(max(1, len(numbers) - window + 1) if numbers else 0):
            found.setdefault(tuple(numbers[i : i + window]), set()).add(item)
    return [*terms], [(w, sorted(i)) for w, i in found.items()]


def _exact(window: tuple[int, ...], by_rarity: list[int], postings: dict[int, np.ndarray]) -> np.ndarray:
    """Places where the window begins: offset-adjusted postings, intersected from the rarest term on."""
    start = None
    for i in by_rarity:
        own = postings.get(window[i])
        if own is None:
            return np.zeros(0, np.int64)
        if start is None:
            start = own - i
        else:
            at = np.searchsorted(own, start + i)
            start = start[own[np.minimum(at, len(own) - 1)] == start + i]
        if not len(start):
            break
    return start


def _near(window: tuple[int, ...], by_rarity: list[int], postings: dict[int, np.ndarray], reach: int) -> np.ndarray:
    """Places of the rarest term that have every other term within reach."""
    base = None
    for i in by_rarity:
        own = postings.get(window[i])
        if own is None:
            return np.zeros(0, np.int64)
        if base is None:
            base = own
        else:
            at = np.searchsorted(own, base - reach)
            base = base[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= base + reach)]
        if not len(base):
            break
    return base


def _searched(windows: list[tuple[tuple[int, ...], list[str]]], frequency: np.ndarray, reach: int):
    plans = [(w, items, sorted(range(len(w)), key=lambda i, w=w: (frequency[w[i]], i))) for w, items in windows]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["docs"].notna()].iloc[0]
        sizes = np.array(head["sizes"], np.int64)
        starts = np.cumsum(sizes) - sizes + np.arange(len(sizes)) * GAP
        rest = pdf[pdf["term"].notna()]
        postings = {int(t): np.frombuffer(p, np.uint32).astype(np.int64) for t, p in zip(rest["number"], rest["places"])}
        cover: list[tuple[np.ndarray, int]] = []
        items: defaultdict[int, set[str]] = defaultdict(set)
        near: defaultdict[int, set[str]] = defaultdict(set)
        for window, names, by_rarity in plans:
            base = _near(window, by_rarity, postings, reach)
            if not len(base):
                continue
            for doc in np.unique(np.searchsorted(starts, base, "right") - 1).tolist():
                near[doc].update(names)
            found = _exact(window, by_rarity, postings)
            if len(found):
                cover.append((found, len(window)))
                for doc in np.unique(np.searchsorted(starts, found, "right") - 1).tolist():
                    items[doc].update(names)
        spans: defaultdict[int, list[dict[str, int]]] = defaultdict(list)
        if cover:
            a = np.concatenate([f for f, _ in cover])
            b = np.concatenate([f + n for f, n in cover])
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            for x, y in zip(a[first].tolist(), b[np.append(first[1:] - 1, len(b) - 1)].tolist()):
                doc = int(np.searchsorted(starts, x, "right") - 1)
                spans[doc].append({"a": x - int(starts[doc]), "b": y - int(starts[doc])})
        n = len(sizes)
        ids: list[Any] = [None if d is None or d != d else int(d) for d in head["docs"]]
        return pd.DataFrame({"segment": [int(head["segment"])] * n, "place": range(n), "doc_id": pd.array(ids, "Int64"), "n_words": sizes, "items": [sorted(items[i]) for i in range(n)], "near": [sorted(near[i]) for i in range(n)], "spans": [spans[i] for i in range(n)]})

    return run


def search(indexed: DataFrame, items: DataFrame, item_id: str = "item_id", text_col: str = "text", window: int = 10, reach: int = 20, size: int = BLOCK) -> DataFrame:
    """doc_id, n_words, items, near, spans of every text in the index.

    items: ids (as text, a null one empty) with a window of consecutive words that
    stands in the text, an item of fewer words being one window; near: those with a
    window all of whose words stand within reach of a place of its rarest word, in
    any order (reach is at least window - 1, so exact items are among them); spans: the words that exact windows cover, from a (0 is the first) to
    before b, apart from each other. An item without words has no window.
    """
    if not window - 1 <= reach < GAP:
        raise ValueError(f"reach must be from {window - 1} to {GAP - 1}")
    spark = indexed.sparkSession
    found = None
    for block in _blocks(items, item_id, text_col, size):
        terms, windows = _windows(block, window)
        # The block's size bounds its terms.
        table = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term binary, number long"))
        own = indexed.join(table, "term", "left").filter("number IS NOT NULL OR term IS NULL")
        frequency = np.zeros(len(terms), np.int64)
        for number, n in own.filter("number IS NOT NULL").groupBy("number").agg(F.sum("n")).collect():
            frequency[number] = n
        lists = own.select("segment", "term", "number", "places", "docs", "sizes").groupBy("segment").applyInPandas(_searched(windows, frequency, reach), _FOUND)
        found = lists if found is None else save(found, "found").union(lists)
        several = found is not lists
    if found is None:  # no item has words
        heads = indexed.filter("term IS NULL").select("segment", F.posexplode(F.arrays_zip("docs", "sizes")).alias("place", "x"))
        none = F.array().cast("array<string>")
        found, several = heads.select("segment", F.col("place").cast("long"), F.col("x.docs").alias("doc_id"), F.col("x.sizes").alias("n_words"), none.alias("items"), none.alias("near"), F.array().cast("array<struct<a:long,b:long>>").alias("spans")), False
    if several:
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged("items"), merged("near"), _joined(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    return found.select("doc_id", "n_words", "items", "near", "spans")


def _joined(spans):
    """Sorted spans, those that touch or overlap made one."""
    last = lambda acc: F.element_at(acc, -1)
    wider = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= s["a"]), wider(acc, s)).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(spans, F.array().cast("array<struct<a:bigint,b:bigint>>"), step)


def op13_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = search(index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS words FROM benchmark),
w AS (SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
p AS (SELECT doc, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w)),
g AS (SELECT doc, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram FROM p),
h AS (SELECT doc, item, g.n, i FROM g JOIN w ON g.n = w.n AND g.gram = w.gram),
c AS (SELECT doc, count(DISTINCT place) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc),
t AS (SELECT doc, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM h GROUP BY doc),
s AS (SELECT item, gram, list_distinct(string_split(gram, ' ')) AS terms FROM w),
f AS (SELECT word, count(*) AS times FROM (SELECT unnest(words) AS word FROM d) WHERE word IN (SELECT unnest(terms) FROM s) GROUP BY word),
v AS (SELECT item, gram, terms, arg_min(term, (coalesce(times, 0), first)) AS rarest FROM (SELECT *, list_position(string_split(gram, ' '), term) AS first FROM (SELECT *, unnest(terms) AS term FROM s)) LEFT JOIN f ON word = term GROUP BY ALL),
r AS (SELECT doc, words, i FROM (SELECT doc, words, unnest(range(1, len(words) + 1)) AS i FROM d) WHERE words[i] IN (SELECT rarest FROM v)),
u AS (SELECT doc, words[i] AS word, list_distinct(words[greatest(i - 20, 1) : i + 20]) AS around FROM r),
e AS (SELECT doc, count(DISTINCT item) AS n_near FROM u JOIN v ON u.word = v.rarest WHERE list_has_all(around, terms) GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN c USING (doc) LEFT JOIN t USING (doc) LEFT JOIN e USING (doc)
"""


QUERIES = {"op13_benchmark_decontamination": op13_benchmark_decontamination}
ORACLES = {"op13_benchmark_decontamination": _ORACLE}
