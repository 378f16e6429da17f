"""Exact and fuzzy duplicates as tables of pairs (row, kept_row, match, score, key, kept_key)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import as_text, is_missing
from tidemill.functions.text import canonical_key
from tidemill.operators.graph import components
from tidemill.sources.storage import save
from tidemill.sources.tables import ROW

_FOUND = "row long, kept_row long, score double"
#: Keys are made of these; others count as the last.
_ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789 "
_CODES = np.array([_ALPHABET.index(b) if b in _ALPHABET else len(_ALPHABET) - 1 for b in range(256)])
#: Grams of up to 4 characters are numbers: those of q characters begin at _FIRST_GRAM[q].
_FIRST_GRAM = [0, *(sum(len(_ALPHABET) ** k for k in range(1, q)) for q in range(1, 6))]
#: How many texts tell the grams' frequencies and the best length of grams.
_TRIED = 50_000


def rank(df: DataFrame, keep: str) -> Column:
    """Sort key of the rows: the least one of a group survives."""
    missing = sum((is_missing(F.col(f"`{c}`"), t).cast("int") for c, t in df.dtypes if c != ROW), F.lit(0))
    first = {"first": F.lit(0), "last": -F.col(ROW), "most_complete": missing}[keep]
    return F.struct(first.cast("long").alias("a"), F.col(ROW).alias("row"))


def _apart(df: DataFrame) -> DataFrame:
    """df for a join that must not broadcast it: its files may be small and its rows, one for each of the input's, too many for the driver."""
    return df.hint("merge")


def exact_pairs(df: DataFrame, subset: list[str], keep: str) -> DataFrame:
    """Every row that repeats another one's subset (null equals null), with the group's survivor.

    The survivor of a group is a pre-aggregated minimum; a group's rows are joined
    with it and never gathered or sorted in one task.
    """
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(subset)]
    rows = df.select(F.col(ROW), rank(df, keep).alias("rank"), F.struct(*keys).alias("k"))
    best = rows.groupBy("k").agg(F.min("rank").alias("best"), F.count("*").alias("n")).filter("n > 1")
    hit = rows.join(_apart(best), rows["k"] == best["k"]).filter(F.col(ROW) != F.col("best.row"))
    none = F.lit(None).cast("string")
    return hit.select(F.col(ROW).alias("row"), F.col("best.row").alias("kept_row"), F.lit("exact").alias("match"), F.lit(1.0).alias("score"), none.alias("key"), none.alias("kept_key"))


def signature(df: DataFrame, keys: list[str]) -> Column:
    kinds = dict(df.dtypes)
    parts = [canonical_key(as_text(F.col(f"`{k}`"), kinds[k])) for k in keys]
    spaced = [x for p in parts for x in (F.lit(" "), p)][1:]
    return F.concat(*spaced)


def _matched(threshold: float, total):
    """The least number of characters that texts of this length together must match: 2 m / (a + b) is the ratio."""
    return np.ceil(threshold * total / 2 - 1e-9).astype(np.int64)


def _shared(q: int, m, total):
    """How many grams of q characters texts have in common, of which m characters match.

    The matched characters are a common subsequence, in runs; the a - m and b - m
    others part it into a + b - 2 m + 1 runs at most, and each run has q - 1 grams
    fewer than characters.
    """
    return m - (q - 1) * (total - 2 * m + 1)


@functools.lru_cache(100_000)
def _prefix(size: int, threshold: float, q: int) -> tuple[tuple[int, int], ...]:
    """(length of grams, how many of a text's rarest ones): a text that is alike to the threshold has one of them at a fitting place.

    The rarest of the n grams that two texts must share is among the first
    size - q + 1 - n + 1 of either. Shorter grams, at last characters, are needed
    only where lengths don't make sure that there is a common longer one.
    """
    others = np.arange(math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9) + 1)
    m, out, open_ = _matched(threshold, size + others), [], np.ones(len(others), bool)
    for length in dict.fromkeys((q, 2, 1)):
        shared = _shared(length, m, size + others)
        here = open_ & (shared >= 1)
        if here.any():
            out.append((length, size - length + 2 - int(shared[here].min())))
        open_ &= ~here
    return tuple(out)


class _Texts:
    """Keys as codes of characters, one text behind the other."""

    def __init__(self, keys: pa.Array):
        self.size = pc.utf8_length(keys).to_numpy().astype(np.int64)
        data = keys.cast(pa.large_string())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        points = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        if len(points) != self.size.sum():  # not all of them are ASCII
            points = np.minimum(np.frombuffer("".join(keys.to_pylist()).encode("utf-32-le"), np.uint32), 255)
        self.codes = _CODES[points]
        self.start = np.cumsum(self.size) - self.size
        self.text = np.repeat(np.arange(len(keys)), self.size)
        self.at = np.arange(len(self.codes)) - self.start[self.text]

    def grams(self, q: int) -> np.ndarray:
        """The gram at each character; of those that end beyond their text any."""
        padded = np.concatenate([self.codes, np.zeros(q - 1, np.int64)])
        out = np.full(len(self.codes), _FIRST_GRAM[q])
        for k in range(q):
            out += padded[k : k + len(self.codes)] * len(_ALPHABET) ** (q - 1 - k)
        return out


class _Order:
    """Grams' order: by their frequency, rarest first."""

    def __init__(self, frequency: tuple[np.ndarray, np.ndarray]):
        self.frequency = np.zeros(_FIRST_GRAM[-1], np.int64)
        self.frequency[frequency[0]] = np.minimum(frequency[1], 1 << 24)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        return self.frequency[grams] * _FIRST_GRAM[-1] + grams


def _counted(lengths: tuple[int, ...]):
    """How often a batch's texts have a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _Texts(batch.column("key"))
            for q in lengths:
                grams, n = np.unique(texts.grams(q)[texts.at + q <= texts.size[texts.text]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(n, pa.int64())], ["gram", "n"])

    return run


def _tokens(threshold: float, q: int, frequency: tuple[np.ndarray, np.ndarray]):
    """A row for each of the prefix's grams, with its place."""

    def found(keys: pa.Array, order: _Order) -> tuple[np.ndarray, ...]:
        texts = _Texts(keys)
        sizes, which = np.unique(texts.size, return_inverse=True)
        prefix = [dict(_prefix(s, threshold, q)) for s in sizes.tolist()]
        parts = []
        for length in dict.fromkeys((q, 2, 1)):
            most = np.array([p.get(length, 0) for p in prefix], np.int64)[which]
            here = np.flatnonzero((texts.at + length <= texts.size[texts.text]) & (most > 0)[texts.text])
            grams, text = texts.grams(length)[here], texts.text[here]
            ranks = order(grams)
            by = np.argsort(text * (int(ranks.max(initial=0)) + 1) + ranks, kind="stable")
            first = np.searchsorted(text, np.arange(len(keys)))
            by = by[np.arange(len(by)) - first[text] < most[text]]
            parts.append((text[by], grams[by], texts.at[here][by]))
        return tuple(map(np.concatenate, zip(*parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(frequency)
        for batch in batches:
            # Long texts have as many grams as characters: some 16 million characters at a time.
            load = np.cumsum(pc.utf8_length(batch.column("key")).to_numpy().astype(np.int64) ** 2) >> 24
            cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                text, grams, at = found(part.column("key"), order)
                own = [pa.array(grams, pa.int32()), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(text)) for c in part.columns), *own], [*part.schema.names, "gram", "at"])

    return run


def _unary(texts: _Texts) -> np.ndarray:
    """Characters' counts in unary, so that a product of rows is the number of characters that two texts have in common."""
    n = len(texts.size)
    counts = np.bincount(texts.text * len(_ALPHABET) + texts.codes, minlength=n * len(_ALPHABET)).reshape(n, -1)
    counts = counts[:, counts.any(axis=0)]
    return np.concatenate([counts > k for k in range(int(counts.max(initial=0)))] or [counts > 0], axis=1).astype(np.float32)


def _bits(texts: _Texts) -> np.ndarray:
    """256 bits of a text: which bigrams it has, by a hash."""
    bits = np.zeros((len(texts.size), 256), bool)
    here = texts.at + 2 <= texts.size[texts.text]
    bits[texts.text[here], texts.grams(2)[here] % 256] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _bit_count(words: np.ndarray) -> np.ndarray:
    """Bits of each row of four words: four bytes of counts, summed by a product."""
    return (np.bitwise_count(words).view(np.uint32)[:, 0] * np.uint32(0x01010101)) >> np.uint32(24)


def _common(a: str, masks: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of a and the text whose characters' places are masks."""
    whole = s = (1 << size) - 1
    for c in a:
        u = s & masks.get(c, 0)
        s = (s + u) | (s - u)
    return size - (s & whole).bit_count()


class _Buckets:
    """Buckets: texts that share a gram among their rarest ones. All rows of a bucket are in one of these, in a row."""

    def __init__(self, rows: pa.Table, threshold: float, q: int, order: _Order):
        marks = np.stack([rows[n].to_numpy() for n in ("bucket", "x", "y")])
        group = np.concatenate([[0], np.cumsum((marks[:, 1:] != marks[:, :-1]).any(axis=0))])
        by = np.lexsort((rows["at"].to_numpy(), group))
        rows = rows.take(pa.array(by))
        self.key, self.block = rows["key"].combine_chunks(), rows["block"].combine_chunks()
        self.c = {n: rows[n].to_numpy() for n in ("a", "row", "last_a", "last_row", "chunk", "x", "y")}
        self.gram, self.at = rows["gram"].to_numpy().astype(np.int64), rows["at"].to_numpy().astype(np.int64)
        self.threshold, self.q, self.order, self.n, self.group = threshold, q, order, rows.num_rows, group[by]
        self.blocks = self.block.dictionary_encode().indices.to_numpy()
        self.texts = _Texts(self.key)
        self.size = self.texts.size
        self.ranks: dict[int, np.ndarray] = {}
        self.least = _matched(threshold, np.arange(2 * int(self.size.max()) + 1))

    def _met(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs whose lengths, places of the gram and characters allow the threshold.

        What stands ahead of the gram in one text and not in the other is unmatched.
        Where a text has few others at near places, these are listed and characters left to the bigrams.
        """
        size, each = self.size, np.arange(self.n)
        most = int(size.max())
        far = most - int(self.least[2 * most]) if most == size.min() else int(most * 2 * (1 - self.threshold) / (2 - self.threshold) + 1e-9)
        place = self.group * (int(self.at.max()) + far + 2) + self.at
        behind = np.searchsorted(place, place + far, "right") - each - 1
        if behind.sum() <= 64 * self.n:
            load = np.cumsum(behind) // 250_000
            for part in np.split(each, np.flatnonzero(np.diff(load)) + 1):
                n = behind[part]
                k = np.repeat(part, n)
                l = k + 1 + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                fits = place[l] - place[k] <= size[l] - self.least[size[l] + size[k]]
                yield k[fits], l[fits]
            return
        unary, held, n = _unary(self.texts), [], 0
        for begin in range(0, self.n - 1, 128):
            one = each[begin : begin + 128]
            other = each[begin + 1 : one[-1] + behind[one[-1]] + 1]
            if not len(other):
                continue
            m = self.least[size[other] + size[one, None]]
            fits = (place[other] - place[one, None] <= size[other] - m) & (other > one[:, None])
            fits &= unary[one] @ unary[other].T >= m
            k, l = np.nonzero(fits)
            held.append((k + begin, l + begin + 1))
            if (n := n + len(k)) > 30_000:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield tuple(map(np.concatenate, zip(*held)))

    def _first(self, k: np.ndarray, l: np.ndarray, length: int) -> np.ndarray:
        """Is the gram the first in order that the texts have in common at fitting places? Pairs meet in several buckets.

        The first one is in both prefixes, if any common one at fitting places is. Of a
        gram's places that fit, some pair has the first of both texts.
        """
        t, m = self.texts, self.least[self.size[k] + self.size[l]]
        wide = int(max(self.size[k].max(), self.size[l].max())) - length + 1
        if length not in self.ranks:
            self.ranks[length] = self.order(t.grams(length))
        grams, places = self.ranks[length], np.arange(wide)

        def laid(i: np.ndarray, none: int) -> np.ndarray:
            inside = places <= (self.size[i] - length)[:, None]
            return np.where(inside, grams[np.minimum(t.start[i][:, None] + places, len(grams) - 1)], none)

        one, other, own = laid(k, -1), laid(l, -2), self.order(self.gram[k])[:, None]
        less, same = one < own, one == own
        p, q, first = self.at[k][:, None], self.at[l][:, None], np.ones(len(k), bool)
        ahead, behind = self.size[l] - m, self.size[k] - m
        for s in range(-min(int(behind.max()), wide - 1), min(int(ahead.max()), wide - 1) + 1):
            i = slice(max(0, -s), wide - max(0, s))
            at = places[i]
            before = (one[:, i] == other[:, i.start + s : i.stop + s]) & (less[:, i] | (same[:, i] & ((at < p) | (at + s < q))))
            first &= ~(before.any(axis=1) & (s <= ahead) & (-s <= behind))
        return first

    def _candidates(self) -> Iterator[tuple[int, int]]:
        c, bits = self.c, _bits(self.texts)
        for k, l in self._met():
            # Each unmatched character breaks two bigrams of its own text and one of the other.
            m = self.least[self.size[k] + self.size[l]]
            mine, others = self.size[k] - m, self.size[l] - m
            one, other = bits[k], bits[l]
            ok = (_bit_count(one & ~other) <= 2 * mine + others) & (_bit_count(other & ~one) <= 2 * others + mine)
            k, l = k[ok], l[ok]
            ok = (self.gram[k] == self.gram[l]) & (self.blocks[k] == self.blocks[l]) & (c["row"][k] != c["row"][l])
            ok &= (c["x"][k] == c["y"][k]) | (c["chunk"][k] != c["chunk"][l])
            total = self.size[k] + self.size[l]
            m = self.least[total]
            length = np.ones(len(k), np.int64)
            for q in dict.fromkeys((2, self.q)):
                length[_shared(q, m, total) >= 1] = q
            for q in dict.fromkeys((self.q, 2, 1)):
                here = np.flatnonzero(ok & (length == q) & (self.gram[k] >= _FIRST_GRAM[q]) & (self.gram[k] < _FIRST_GRAM[q + 1]))
                step = max(1, 1_000_000 // int(self.size.max()))
                for i in range(0, len(here), step):
                    x, y = k[here[i : i + step]], l[here[i : i + step]]
                    first = self._first(x, y, q)
                    yield from zip(x[first].tolist(), y[first].tolist())

    def pairs(self) -> Iterator[tuple]:
        """(row, kept_row, score, back, la, ka, block) of pairs whose ratio reaches the threshold, the later row first."""
        c, masks = self.c, {}
        for i, j in self._candidates():
            (li, lj), (ri, rj) = c["a"][[i, j]].tolist(), c["row"][[i, j]].tolist()
            if (li, ri) < (lj, rj):
                i, j, li, lj, ri, rj = j, i, lj, li, rj, ri
            later, kept, block = self.key[i].as_py(), self.key[j].as_py(), self.block[i].as_py()
            if j not in masks:
                places: dict[str, int] = {}
                for k, ch in enumerate(kept):
                    places[ch] = places.get(ch, 0) | 1 << k
                masks[j] = places
            # The ratio can't reach the threshold if the longest common subsequence is too short.
            if _common(later, masks[j], len(kept)) < self.least[len(later) + len(kept)]:
                continue
            # The ratio depends on the order: the later text is the first, the kept one the second.
            ratio = SequenceMatcher(None, later, kept).ratio()
            if ratio >= self.threshold:
                yield ri, rj, ratio, False, li, lj, block
            if (c["last_a"][j], c["last_row"][j]) > (li, ri):  # another row with j's key comes later than i
                ratio = SequenceMatcher(None, kept, later).ratio()
                if ratio >= self.threshold:
                    yield rj, ri, ratio, True, lj, li, block


_NEAR = "row long, kept_row long, score double, back boolean, la long, ka long, block string"


def _scored(threshold: float, q: int, frequency: tuple[np.ndarray, np.ndarray], load: int = 2 << 20):
    """Streams over rows by bucket, some whole buckets at a time."""
    types = [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _NEAR.split(", ")]

    def found(rows: pa.Table, order: _Order) -> Iterator[pa.RecordBatch]:
        pairs = [*_Buckets(rows, threshold, q, order).pairs()] if rows.num_rows > 1 else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*pairs), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(frequency)
        held: list[pa.RecordBatch] = []
        bytes_, want = 0, load
        for batch in batches:
            held.append(batch)
            bytes_ += batch.nbytes
            if bytes_ < want:
                continue
            rows = pa.Table.from_batches(held)
            marks = np.stack([rows[n].to_numpy() for n in ("bucket", "x", "y")])
            last = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[-1:] + 1
            if not len(last):  # one bucket, that may go on
                want = 2 * bytes_
                continue
            yield from found(rows.slice(0, int(last[0])), order)
            held = rows.slice(int(last[0])).combine_chunks().to_batches()
            bytes_ = sum(b.nbytes for b in held)
            want = max(load, 2 * bytes_)
        if held:
            yield from found(pa.Table.from_batches(held), order)

    return run


def near_pairs(heads: DataFrame, threshold: float, tile: int, q: int | None = None) -> DataFrame:
    """Pairs of texts of a block whose ratio reaches the threshold, found by an index of positional grams.

    Grams are ordered by how many texts' places have them, rarest first; texts
    that are alike share one of a few rarest ones, at places that don't differ by more
    than the characters that may be unmatched. A bucket is a block's texts with such a
    gram. In it lengths, places, counts of characters and bigrams discard pairs, then the
    longest common subsequence, and the ratio decides. All bounds hold for any pair
    that reaches the threshold. A bucket of more than `tile` texts is dealt out as
    pairs of parts.

    Longer grams make more rows and smaller buckets: of q = 2, 3 and 4 the one is taken
    that costs least, told from some 50,000 texts' buckets. It changes no result, nor does
    the order of grams, which is counted over the same texts.
    """
    parts = max(1, heads.count() // _TRIED)
    some = heads if parts == 1 else heads.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == 0)
    tried = (q,) if q else (2,) if parts == 1 else (2, 3, 4)
    lengths = tuple(sorted({1, 2, *tried}))
    # What is rarer than the first 100,000 grams counts as not there.
    counted = some.select("key").mapInArrow(_counted(lengths), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    often = np.array(counted.orderBy(F.desc("n"), "gram").limit(100_000).collect(), np.int64).reshape(-1, 2)
    frequency = often[:, 0], often[:, 1]

    def bucketed(texts: DataFrame, q: int, kinds: str) -> DataFrame:
        columns = [x.split()[0] for x in kinds.split(", ")]
        return texts.select(columns).mapInArrow(_tokens(threshold, q, frequency), f"{kinds}, gram int, at int").withColumn("bucket", F.xxhash64("block", "gram"))

    def cost(q: int) -> float:
        sizes = bucketed(some, q, "block string, key string").groupBy("bucket").count()
        rows, pairs = sizes.agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()
        return (rows or 0) * parts + (pairs or 0) * parts**2 / 1000  # some 1,000 pairs take as long as a row

    q = min(tried, key=cost) if len(tried) > 1 else tried[0]
    tokens = bucketed(heads, q, "block string, key string, a long, row long, last_a long, last_row long")
    one = F.lit(0)
    longest = _FIRST_GRAM[2 if threshold > 0.75 else 1]  # the least tokens that many texts have
    hot = None
    if parts > 1 or often[:, 1][often[:, 0] >= longest].max(initial=0) > tile:
        sizes = bucketed(heads, q, "block string, key string").groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
        hot = save(sizes.filter("n > 1"), "hot")
    if hot is None or not (n := hot.count()):
        dealt = tokens.select("*", one.alias("chunk"), one.alias("x"), one.alias("y"))
    else:
        parted = tokens.join(F.broadcast(hot) if n <= 100_000 else hot, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        parted = parted.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = parted.select(*tokens.columns, "chunk", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))
    return dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(_scored(threshold, q, frequency), _NEAR)


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Visits rows in order: one that is like a kept row is its duplicate, else it is kept."""
    dropped: set[int] = set()
    best: dict[int, tuple[float, int]] = {}
    pdf = pdf.sort_values(["la", "row", "ka", "kept_row"])
    for row, kept, score in zip(pdf["row"].tolist(), pdf["kept_row"].tolist(), pdf["score"].tolist()):
        # Rows ahead of this one are decided; of equal scores the first in keep order stays.
        if kept not in dropped and (row not in best or score > best[row][0]):
            best[row] = (score, kept)
            dropped.add(row)
    return pd.DataFrame([(r, k, s) for r, (s, k) in best.items()], columns=["row", "kept_row", "score"])


def _greedy_by(pairs: DataFrame, unit: str, tasks: int) -> DataFrame:
    """Visits units that have no row in common, many of them in a task: they don't depend on each other."""
    return pairs.withColumn("dealt", F.pmod(F.xxhash64(unit), F.lit(tasks))).groupBy("dealt").applyInPandas(_greedy, _FOUND)


def _visited(pairs: DataFrame, in_task: int) -> DataFrame:
    """The rows that `_greedy` finds to be duplicates, where not all pairs can meet in one task.

    Components of the pairs' graph are visited whole, many small ones in a task, as long as
    they have up to in_task pairs. Of larger ones a row without an undecided earlier neighbour
    is kept, and its later neighbours are duplicates; what is left may fall apart into
    smaller components. Where that decides little, as along a chain, the first in_task
    pairs in keep order, which depend on no others, are visited in a task. Each round
    decides some pairs, so the rounds end.
    """
    nodes = lambda df, c, name="node": df.select(F.col(c).alias(name)).distinct()
    edges = save(pairs.select("row", "kept_row", "score", "la", "ka"), "edges")
    dropped, n = nodes(edges.limit(0), "row", "row"), edges.count()
    while n:
        roots = components(edges.select(F.col("row").alias("u"), F.col("kept_row").alias("v")))
        rooted = save(edges.join(_apart(roots.withColumnRenamed("node", "row")), "row"), "rooted")
        sizes = save(rooted.groupBy("root").agg(F.count("*").alias("n")), "sizes")
        small = rooted.join(_apart(sizes.filter(F.col("n") <= in_task)), "root", "left_semi")
        dropped = save(dropped.union(_greedy_by(small, "root", max(16, n // 100_000)).select("row")), "dropped")
        edges = save(rooted.join(_apart(sizes.filter(F.col("n") > in_task)), "root", "left_semi").drop("root"), "edges")
        n = edges.count()
        for _ in range(3):
            if not n:
                break
            fresh = save(nodes(edges, "kept_row").join(_apart(nodes(edges, "row")), "node", "left_anti"), "fresh")
            gone = nodes(edges.join(_apart(fresh.withColumnRenamed("node", "kept_row")), "kept_row", "left_semi"), "row", "row")
            dropped, edges, left = _without(dropped, edges, gone)
            if left and left > 0.8 * n:
                last = edges.select(F.struct("la", "row").alias("p")).orderBy("p").limit(in_task).agg(F.max("p")).first()[0]
                first = edges.filter(F.struct("la", "row") <= F.struct(F.lit(last.la).alias("la"), F.lit(last.row).alias("row")))
                found = first.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_greedy, _FOUND).select("row")
                decided = nodes(first, "row", "row")
                dropped, edges, left = _without(dropped, edges, found, decided)
            if left >= n:
                raise RuntimeError("a round of the visit decided no pair")
            n = left
    return dropped.distinct()


def _without(dropped: DataFrame, edges: DataFrame, gone: DataFrame, decided: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The duplicates with those found anew, the pairs that are still undecided, and their number."""
    gone = save(gone, "gone")
    left = edges.join(_apart(gone if decided is None else decided), "row", "left_anti")
    left = save(left.join(_apart(gone.withColumnRenamed("row", "kept_row")), "kept_row", "left_anti").select(edges.columns), "edges")
    return save(dropped.union(gone), "dropped"), left, left.count()


def fuzzy_pairs(df: DataFrame, keys: list[str], keep: str, threshold: float, block_on: list[str], tile: int = 8192, in_task: int = 200_000) -> DataFrame:
    """Rows like a kept row of their block, with the likest one.

    Blocks are the key's first character and the keys of `block_on`. Rows of a block
    with the same key are one for the search: the first stands for them. The visit in
    keep order runs in tasks, for blocks while there are up to in_task pairs that
    reached the threshold, else for components of their graph.
    """
    kinds = dict(df.dtypes)
    first = rank(df, keep)
    marks = [canonical_key(as_text(F.col(f"`{c}`"), kinds[c])) for c in block_on]
    rows = df.select(F.col(ROW).alias("row"), first["a"].alias("a"), signature(df, keys).alias("key"), F.array(*marks).cast("array<string>").alias("marks")).filter("key <> ''")
    head = F.substring("key", 1, 1)
    rows = save(rows.select("row", "a", "key", (F.to_json(F.struct(head.alias("c"), "marks")) if marks else head).alias("block")), "keys")
    place = F.struct("a", "row")
    alike = rows.groupBy("block", "key").agg(F.min(place).alias("f"), F.max(place).alias("l"))
    heads = save(alike.select("block", "key", "f.a", "f.row", F.col("l.a").alias("last_a"), F.col("l.row").alias("last_row")), "heads")
    both = save(near_pairs(heads, threshold, tile), "near")
    ahead = both.filter("not back")
    if ahead.count() <= in_task:
        found = _greedy_by(ahead, "block", 16)
    else:
        gone = _visited(ahead, in_task)
        best = F.max(F.struct("score", (-F.col("ka")).alias("a"), (-F.col("kept_row")).alias("r"))).alias("b")
        alive = ahead.join(_apart(gone.withColumnRenamed("row", "kept_row")), "kept_row", "left_anti")
        found = alive.groupBy("row").agg(best).select("row", (-F.col("b.r")).alias("kept_row"), F.col("b.score").alias("score"))
    found = save(found, "found")
    out = found.select("row", "kept_row", "score")
    # The other rows of a key: duplicates of the first if it is kept, else of the likest of all kept rows ahead of them.
    repeated = heads.filter("row <> last_row")
    if not repeated.isEmpty():
        members = rows.join(_apart(repeated.select("block", "key", F.col("row").alias("head"))), ["block", "key"]).filter("row <> head")
        first_dropped = _apart(found.select(F.col("row").alias("head")))
        same = members.join(first_dropped, "head", "left_anti").select("row", F.col("head").alias("kept_row"), F.lit(1.0).alias("score"))
        kept = both.select(F.col("row").alias("head"), "kept_row", "score", "ka").join(_apart(found.select(F.col("row").alias("kept_row"))), "kept_row", "left_anti")
        tried = members.join(first_dropped, "head", "left_semi").select("head", "row", "a").join(_apart(kept), "head")
        tried = tried.filter(F.struct(F.col("ka").alias("a"), F.col("kept_row").alias("row")) < F.struct("a", "row"))
        best = F.max(F.struct("score", (-F.col("ka")).alias("ka"), (-F.col("kept_row")).alias("kept_row"))).alias("b")
        other = tried.groupBy("row").agg(best).select("row", (-F.col("b.kept_row")).alias("kept_row"), F.col("b.score").alias("score"))
        out = out.union(same).union(other)
    out = out.join(_apart(rows.select("row", "key")), "row")
    named = out.join(_apart(heads.select(F.col("row").alias("kept_row"), F.col("key").alias("kept_key"))), "kept_row")
    return named.select("row", "kept_row", F.lit("fuzzy").alias("match"), F.round("score", 4).alias("score"), "key", "kept_key")


def duplicate_pairs(df: DataFrame, subset: list[str], keep: str, fuzzy: bool, keys: list[str], threshold: float, block_on: list[str]) -> DataFrame:
    """Exact pairs, and fuzzy ones among the exact survivors."""
    columns = [c for c in df.columns if c != ROW]
    exact = exact_pairs(df, subset or columns, keep)
    if not (fuzzy and keys):
        return exact
    rest = df.join(_apart(exact.select(F.col("row").alias(ROW))), ROW, "left_anti").select(df.columns)
    return exact.union(fuzzy_pairs(rest, keys, keep, threshold, block_on))
