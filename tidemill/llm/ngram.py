"""Interpolated modified Kneser-Ney n-gram model of order 3 (or 2): counting, storage and scoring.

Words are hashed to 64 bits, of which what lies within a shard keeps 48: the last
word of a pair, and the pair that is a trigram's context. Each task counts the
trigrams (u, v, w) it has read and sends, for each shard, one block: trigrams as
runs of v and of the context. A trigram lies in the shard of its middle word,
so that both its context (u, v) and its suffix (v, w) are whole there; those of
frequent middle words are dealt out by the context, and their suffixes are summed
once more. A shard's blocks are merged and written to the shared folder as sorted
hash arrays:

    grams/<shard>     hash of the trigram, count
    contexts/<shard>  hash of (u, v): total, trigrams seen once, twice, more often;
                      contexts with a total of 1 are left out, as they are known from
                      the pair (u, v) itself
    pairs/<shard>     hash of (v, w), number of distinct words seen ahead of it
    heads/<shard>     hash of v: the pairs' total, pairs of a number of 1, 2, more
    words/<shard>     hash of w, count
    ahead/<shard>     hash of w, number of distinct words seen ahead of it

An array keeps 32 bits of each hash behind those that an index of buckets stands
for (words: all 64), and a byte for a number, larger ones aside. Workers map these
files into memory and look their texts' distinct words, pairs and trigrams up by
binary search, so a model may be larger than a worker's memory.
"""

from __future__ import annotations

import os
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.storage import new_path, save, small_batches

#: Middle words that may count as frequent at most: 8 bytes each go to every task.
HOT = 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = "shard int, kind int, data array<binary>"
_START, _END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x2127599BF4325C37)
#: Kinds of blocks: trigrams; pairs of frequent words; words' counts; words' numbers of words ahead; sums for the driver.
_GRAMS, _PAIRS, _COUNTS, _AHEAD, _SUMS = range(5)
#: The 48 bits that are kept of a hash within a shard.
_KEPT = np.uint64(0xFFFFFFFFFFFF0000)
#: Random numbers for each byte at each of 64 places, and a factor for each further 64 places: words are hashed by their sum.
_PLACES = np.random.default_rng(7).integers(0, 1 << 64, (64, 256), np.uint64)
_FURTHER = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w, tokens of each text): every token w with the two ahead of it; the end counts as a token."""
    encoded = [(t or "").encode().translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
    begins_of_texts = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    inside = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    n_words = np.diff(np.searchsorted(begins, begins_of_texts))
    letters = data[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    value = _PLACES[place & 63, letters]
    if len(lengths) and lengths.max() > 64:
        far = np.flatnonzero(place > 63)
        value[far] *= np.power(_FURTHER, (place[far] >> 6).astype(np.uint64))
    words = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.uint64)
    words = _mixed(words ^ lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    # Each text gets a start ahead and an end behind.
    sizes = n_words.astype(np.int64) + 1
    flat = np.empty(int(sizes.sum()) + len(sizes), np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(flat), bool)
    inner[ends], inner[ends - sizes] = False, False
    flat[inner], flat[ends], flat[ends - sizes] = words, _END, _START
    inner[ends] = True  # all tokens
    at = np.flatnonzero(inner)
    u = flat[np.maximum(at - 2, 0)]
    u[np.cumsum(sizes) - sizes] = _START
    return u, flat[at - 1], flat[at], sizes


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(_mixed(a) + b * np.uint64(0xD6E8FEB86659FD93)))


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two words that follow each other."""
    return pair_hash(a, b & _KEPT)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(h ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(shards)).astype(np.int64)


def _home(v: np.ndarray, whole: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of what belongs to v; of a frequent v by the whole's hash."""
    return _shard(np.where(_among(v, hot)[0], whole, v), shards)


def _among(x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which x are among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the index of one row of each, and the sums of counts."""
    order = np.argsort(keys)
    k = keys[order]
    starts = _runs(k)
    sums = [np.add.reduceat(c[order], starts) if len(k) else c for c in counts]
    return (k[starts], order[starts], *sums)


def _small(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, as few as all of them need, compressed (most are 1); and how many planes."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return zlib.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1) + bytes([width])


def _read(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[:-1]), np.uint8).reshape(data[-1], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[-1]] = planes.T
    return out.view("<u8")[:, 0].astype(np.int64)


def _hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _short(h: np.ndarray) -> bytes:
    """The 48 bits kept of hashes."""
    return np.ascontiguousarray((h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _batch(rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
    shard, kind, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.list_(pa.binary()))], ["shard", "kind", "data"])


def _dealt(shard: np.ndarray, kind: int, columns: list[tuple[np.ndarray, Callable[[np.ndarray], bytes]]]) -> list[tuple[int, int, list[bytes]]]:
    """A block of columns, each with what writes it, for each shard."""
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [(c[order], write) for c, write in columns]
    bounds = np.append(_runs(shard), len(shard)).tolist() if len(shard) else []
    return [(int(shard[i]), kind, [write(c[i:j]) for c, write in columns]) for i, j in zip(bounds[:-1], bounds[1:])]


def _sort_key(shard: np.ndarray, shards: int, *hashes: np.ndarray) -> np.ndarray:
    """A number that orders by shard, then by the leading bits of hashes; equal hashes lie together, but for few."""
    free = 64 - max(1, int(shards - 1).bit_length())
    key = shard.astype(np.uint64) << np.uint64(free)
    for k, h in enumerate(hashes):
        bits = free // (len(hashes) - k)
        free -= bits
        key |= (h >> np.uint64(64 - bits)) << np.uint64(free)
    return key


def _gram_blocks(u: np.ndarray, v: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray, order: int) -> pa.RecordBatch:
    context, suffix = pair_of(u, v) & _KEPT, pair_of(v, w)
    gram = pair_hash(context, suffix) if order > 2 else suffix
    shard = _home(v, context if order > 2 else suffix, hot, shards)
    place = np.argsort(_sort_key(shard, shards, v, context, gram))
    starts = _runs(gram[place])
    counts = np.diff(np.append(starts, len(gram)))
    place = place[starts]
    shard, context, v, w = shard[place], context[place], v[place], w[place]
    bounds = np.append(_runs(shard), len(shard)).tolist() if len(shard) else []
    rows = []
    for i, j in zip(bounds[:-1], bounds[1:]):
        new_v, new_c = _runs(v[i:j]), _runs(v[i:j], context[i:j])
        sizes = [_small(np.diff(np.append(x, j - i))) for x in (new_v, new_c)]
        rows.append((int(shard[i]), _GRAMS, [v[i:j][new_v].tobytes(), sizes[0], _short(context[i:j][new_c]), sizes[1], _short(w[i:j]), _small(counts[i:j])]))
    return _batch(rows)


def _count_grams(shards: int, hot: np.ndarray, order: int, at_once: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            held.append(hashed(batch.column(0).to_pylist())[:3])
            n += len(held[-1][0])
            if n >= at_once:
                yield _gram_blocks(*(np.concatenate(x) for x in zip(*held)), shards, hot, order)
                held, n = [], 0
        if n:
            yield _gram_blocks(*(np.concatenate(x) for x in zip(*held)), shards, hot, order)

    return run


def _frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = np.unique(hashed(batch.column(0).to_pylist())[2], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])


class Table:
    """Sorted hashes with numbers, in one stretch of bytes that can be mapped into memory."""

    def __init__(self, data: np.ndarray):
        n, bits, width, n_over, self.exact = (int(x) for x in data[:40].view(np.int64))
        self.bits, self.width, at = bits, width, 40

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out = data[at : at + size].view(kind)
            at += size
            return out

        self.over, self.large = take(n_over, np.int64), take(n_over * width, np.int64).reshape(width, n_over)
        self.low = take(n, np.uint64) if self.exact else take(n, np.uint32)
        self.index, self.numbers = take((1 << bits) + 1, np.uint32), take(n * width, np.uint8).reshape(width, n)

    @staticmethod
    def packed(keys: np.ndarray, numbers: list[np.ndarray], exact: bool = False) -> bytes:
        """keys ascend; numbers are rows of whole numbers for them."""
        n, numbers = len(keys), np.stack(numbers).astype(np.int64)
        bits = max(0, (n // 8).bit_length() - 1)
        buckets = keys >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
        index = np.searchsorted(buckets, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
        over = np.flatnonzero((numbers > 254).any(axis=0))
        parts = [np.array([n, bits, len(numbers), len(over), exact], np.int64), over, numbers[:, over], keys if exact else Table._rest(keys, bits), index, np.minimum(numbers, 255).astype(np.uint8)]
        return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    @staticmethod
    def _rest(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The numbers (width, n) of keys, zeros for those that aren't there."""
        out = np.zeros((self.width, len(keys)), np.int64)
        n = len(self.low)
        if not n:
            return out
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        x = keys if self.exact else self._rest(keys, self.bits)
        low, high = self.index[bucket].astype(np.int64), self.index[bucket + 1].astype(np.int64)
        end = high
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = self.low[np.minimum(middle, n - 1)] < x
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        at = np.minimum(low, n - 1)
        found = np.flatnonzero((low < end) & (self.low[at] == x))
        at = at[found]
        values = self.numbers[:, at].astype(np.int64)
        if len(self.over):
            large, where = _among(at, self.over)
            values[:, large] = self.large[:, where[large]]
        out[:, found] = values
        return out


def _write(path: str, data: bytes) -> None:
    """Stores bytes in the shared folder; a second attempt replaces them with the same."""
    store, place = pyarrow.fs.FileSystem.from_uri(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    part = f"{place}.{os.getpid()}-{os.urandom(4).hex()}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, place)


class _Tables:
    """Opened tables: mapped where the shared folder is mounted, else read, the least used dropped beyond `most` bytes."""

    def __init__(self, most: int = 256 << 20):
        self.open: OrderedDict[str, tuple[Table | None, int]] = OrderedDict()
        self.most, self.held = most, 0

    def __getitem__(self, path: str) -> Table | None:
        if path in self.open:
            self.open.move_to_end(path)
            return self.open[path][0]
        store, place = pyarrow.fs.FileSystem.from_uri(path)
        table, size = None, 0
        if store.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
            if isinstance(store, pyarrow.fs.LocalFileSystem):
                table = Table(np.memmap(place, np.uint8, "r").view(np.ndarray))
            else:
                with store.open_input_file(place) as f:
                    data = np.frombuffer(f.read(), np.uint8)
                table, size = Table(data), len(data)
        self.open[path] = table, size
        self.held += size
        while len(self.open) > 1 and (self.held > self.most or len(self.open) > 20_000):
            self.held -= self.open.popitem(last=False)[1][1]
        return table


_tables = _Tables()


def _classes(n: np.ndarray) -> list[np.ndarray]:
    return [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)]


def _seen(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _sums(level: int, n: np.ndarray) -> tuple[int, int, list[bytes]]:
    """A row for the driver: how many items of a level have each number up to 4."""
    return (0, _SUMS, [np.array([level, *_seen(n)], np.int64).tobytes()])


def _merge_grams(path: str, hot: np.ndarray, shards: int, order: int):
    """Writes a shard's trigrams, contexts, pairs and heads; sends on what other shards and the model need."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        parts: list[tuple[np.ndarray, ...]] = []
        for names, vn, contexts, cn, w, c in table["data"].to_pylist():
            parts.append((np.repeat(_hashes(names), _read(vn)), np.repeat(_long(contexts), _read(cn)), _long(w), _read(c)))
        v, context, w, counts = (np.concatenate(x) for x in zip(*parts))
        suffix = pair_of(v, w)
        if order > 2:
            gram, at, counts = _summed(pair_hash(context, suffix), counts)
            v, w, suffix, context = v[at], w[at], suffix[at], context[at]
            _write(f"{path}/grams/{shard}", Table.packed(gram, [counts]))
            keys, _, total, *classes = _summed(context, counts, *_classes(counts))
            wide = total > 1
            _write(f"{path}/contexts/{shard}", Table.packed(keys[wide], [x[wide] for x in (total, *classes)]))
            del gram
        del context
        rows = [_sums(3, counts)] if order > 2 else []
        names, _, total = _summed(np.where(v == _START, _END, v), counts)  # a text has as many ends as starts
        rows += _dealt(_shard(names, shards), _COUNTS, [(names, np.ndarray.tobytes), (total, _small)])
        pairs, at, n = _summed(suffix, np.ones_like(counts) if order > 2 else counts)
        v, w = v[at], w[at]
        is_hot = _among(v, hot)[0]
        rows += _dealt(_shard(pairs[is_hot], shards), _PAIRS, [(v[is_hot], np.ndarray.tobytes), (w[is_hot], _short), (n[is_hot], _small)])
        rows += _finished(path, "pairs", shard, pairs[~is_hot], w[~is_hot], n[~is_hot], shards)
        heads, _, *facts = _summed(v[~is_hot], n[~is_hot], *_classes(n[~is_hot]))
        _write(f"{path}/heads/{shard}", Table.packed(heads, facts))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _finished(path: str, name: str, shard: int, pairs: np.ndarray, w: np.ndarray, n: np.ndarray, shards: int) -> list:
    """Writes a shard's pairs, and tells the words how many words they follow."""
    _write(f"{path}/{name}/{shard}", Table.packed(pairs, [n]))
    words, _, ahead = _summed(w, np.ones_like(n))
    return [*_dealt(_shard(words, shards), _AHEAD, [(words, _short), (ahead, _small)]), _sums(2, n)]


def _merge_pairs(path: str, shards: int):
    """The same for a shard's pairs of frequent words; sends on their heads' facts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        rows = table["data"].to_pylist()
        v, w = (np.concatenate([read(r[i]) for r in rows]) for i, read in enumerate((_hashes, _long)))
        pairs, at, n = _summed(pair_of(v, w), np.concatenate([_read(r[2]) for r in rows]))
        v, w = v[at], w[at]
        heads, _, *facts = _summed(v, n, *_classes(n))
        out = [*_finished(path, "hot", shard, pairs, w, n, shards), (0, _SUMS, [np.array([0], np.int64).tobytes(), heads.tobytes(), np.stack(facts, axis=1).tobytes()])]
        return pa.Table.from_batches([_batch(out)])

    return run


def _merge_words(path: str):
    """Writes a shard's words and their counts, and the numbers of words ahead of a shard's words."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        values = [0] * len(_WORD_SUMS)
        for kind, name, read in ((_COUNTS, "words", _hashes), (_AHEAD, "ahead", _long)):
            rows = [d for k, d in zip(kinds, data) if k == kind]
            if not rows:
                continue
            keys, _, n = _summed(np.concatenate([read(r[0]) for r in rows]), np.concatenate([_read(r[1]) for r in rows]))
            _write(f"{path}/{name}/{shard}", Table.packed(keys, [n], exact=kind == _COUNTS))
            if kind == _COUNTS:
                values[:2] = int(n.sum()), len(keys)
            else:
                values[2:] = *_seen(n), int((n > 2).sum()), int(n.sum())
        return pa.table({k: pa.array([x], pa.int64()) for k, x in zip(_WORD_SUMS, values)})

    return run


_WORD_SUMS = ("tokens", "types", "n1", "n2", "n3", "n4", "more", "total")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of items seen once to four times."""
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    d = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.0), float(k)) for k, x in zip((1, 2, 3), d))  # type: ignore[return-value]


def _share(n: np.ndarray, facts: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """Discounted shares of numbers n, with the rest dealt by the lower order; facts: total, items of 1, 2, more."""
    total, one, two, more = facts.astype(float)
    known = total > 0
    total = np.where(known, total, 1.0)
    rest = (d[0] * one + d[1] * two + d[2] * more) / total
    return np.where(known, (n - np.array((0.0, *d))[np.minimum(n, 3)]) / total + rest * lower, lower)


@dataclass
class Model:
    """What a worker needs beside the tables under `path`."""

    path: str
    shards: int
    order: int = 3
    tokens: int = 0
    types: int = 0
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    followers: int = 0
    word_rest: float = 1.0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_facts: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))

    def _look(self, names: tuple[str, ...], shard: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """Numbers (width, n) of keys by their shards, which ascend; zeros for those that aren't there.

        Shards from `shards` on are those of the next name.
        """
        out = np.zeros((width, len(keys)), np.int64)
        bounds = np.append(_runs(shard), len(shard)).tolist() if len(shard) else []
        for i, j in zip(bounds[:-1], bounds[1:]):
            name, s = divmod(int(shard[i]), self.shards)
            table = _tables[f"{self.path}/{names[name]}/{s}"]
            if table:
                out[:, i:j] = table.look(keys[i:j])
        return out

    def _facts(self, names: tuple[str, ...], shard: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """`_look` for keys in any order."""
        order = np.argsort(_sort_key(shard, self.shards * len(names), keys))
        out = np.empty((width, len(keys)), np.int64)
        out[:, order] = self._look(names, shard[order], keys[order], width)
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known tokens, base score and the model's log10 probability."""
        u, v, w, sizes = hashed(texts)
        starts = np.cumsum(sizes) - sizes
        opening = np.zeros(len(w), bool)
        opening[starts] = True
        word, word_at, _ = _distinct(w, w)
        count = self._facts(("words",), _shard(word, self.shards), word, 1)[0]
        ahead = self._facts(("ahead",), _shard(word & _KEPT, self.shards), word & _KEPT, 1)[0]
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        p = np.full(len(word), self.word_rest / (self.types + 1))
        if self.followers:
            p += (ahead - np.array((0.0, *self.discounts[1]))[np.minimum(ahead, 3)]) / self.followers
        # What is known of words as heads; the start is one too.
        head = np.append(word, _START)
        facts = self._facts(("heads",), _shard(head, self.shards), head, 4)
        is_hot, where = _among(head, self.hot)
        facts[:, is_hot] = self.hot_facts[where[is_hot]].T
        head_at = np.where(opening, len(word), np.roll(word_at, 1))

        pairs = pair_of(v, w)
        home = np.where(is_hot[head_at], _shard(pairs, self.shards) + self.shards, _shard(v, self.shards))
        pair, pair_at, first = _distinct(pairs, _sort_key(home, 2 * self.shards, pairs))
        n = self._look(("pairs", "hot"), home[first], pair, 1)[0]
        p = _share(n, facts[:, head_at[first]], self.discounts.get(2, (0.0, 0.0, 0.0)), p[word_at[first]])
        if self.order > 2:
            # The context of a token is the pair that ends ahead of it.
            before = np.where(opening, len(pair), np.roll(pair_at, 1))
            context = np.append(pair, pair_of(np.array([_START]), np.array([_START]))) & _KEPT
            middle, middle_hot = np.append(w[first], _START), np.append(is_hot[word_at[first]], is_hot[-1])
            home = np.where(middle_hot, _shard(context, self.shards), _shard(middle, self.shards))
            told = self._facts(("contexts",), home, context, 4)
            known = np.append(n, 1 if self.tokens else 0) > 0
            told[:2, known & (told[0] == 0)] = 1  # seen once
            gram = pair_hash(context[before], pairs)
            seen = self._facts(("grams",), home[before], gram, 1)[0]
            p = _share(seen, told[:, before], self.discounts.get(3, (0.0, 0.0, 0.0)), p[pair_at])
        else:
            p = p[pair_at]
        add = lambda x: np.add.reduceat(x, starts)
        return sizes, add((count > 0).astype(np.int64)[word_at]), add(base[word_at]), add(np.log10(p))


def _distinct(x: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in the order of their keys, the place of each x among them, and one place of each in x."""
    order = np.argsort(key)
    starts = _runs(x[order])
    at = np.empty(len(x), np.int64)
    at[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    return x[order[starts]], at, order[starts]


def _parsed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, key, n0, n1, n2, n3) of the rows for the driver: numbers of items, or facts of a frequent word (level 0)."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            level, *seen = np.frombuffer(data[0], np.int64).tolist()
            rows = np.array([seen], np.int64) if level else np.frombuffer(data[2], np.int64).reshape(-1, 4)
            keys = np.zeros(1, np.int64) if level else np.frombuffer(data[1], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), level, np.int32)), pa.array(keys), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4))], ["level", "key", "n0", "n1", "n2", "n3"])


def _frequent(texts: DataFrame, tokens: int, in_shard: int) -> np.ndarray:
    """Words of which some shard would have too many trigrams, told from a sample of texts.

    It decides where trigrams lie, not what is counted. A word with a quarter of a
    shard's tokens is expected 20 times in the sample.
    """
    enough = max(in_shard // 4, tokens // HOT)
    share = min(1.0, max(20 / enough, 2_000_000 / max(tokens, 1)))
    some = texts.sample(share, 1) if share < 1 else texts
    words = some.mapInArrow(_frequent_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = words.filter(F.col("n") >= max(2.0, enough * share)).toPandas()["word"]  # HOT rows or so at most
    return np.unique(np.append(rows.to_numpy(np.int64).view(np.uint64), [_START, _END]))


def train(docs: DataFrame, order: int = 3, tokens_in_shard: int = 2_000_000) -> Model:
    """Counts all of docs (text) and stores the model in the shared folder.

    order is 3 or 2. A null text counts as empty: it has the end as its only token.
    Without any document the model gives each token the probability 1.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    n, size = texts.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()
    if not n:
        return Model(new_path(spark, "ngrams"), 1, order)
    about = int(size / 6) + n
    shards = max(8, about // tokens_in_shard)
    path = new_path(spark, "ngrams")
    model = Model(path, shards, order, hot=_frequent(texts, about, tokens_in_shard))
    by_shard = lambda df: df.repartition(shards, "shard").groupBy("shard")
    blocks = texts.mapInArrow(_count_grams(shards, model.hot, order), _BLOCK)
    grams = save(by_shard(blocks).applyInArrow(_merge_grams(path, model.hot, shards, order), _BLOCK), "grams")
    pairs = save(by_shard(grams.filter(f"kind = {_PAIRS}")).applyInArrow(_merge_pairs(path, shards), _BLOCK), "pairs")
    both = grams.union(pairs)
    sums = both.filter(f"kind = {_SUMS}").select("data").mapInArrow(_parsed_sums, "level int, key long, n0 long, n1 long, n2 long, n3 long")
    facts = np.zeros((len(model.hot), 4), np.int64)
    for row in sums.groupBy("level", "key").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4))).toPandas().itertuples(index=False):  # a row for each level and hot word
        if row.level:
            model.discounts[int(row.level)] = discounts(*(int(x) for x in row[2:]))
        else:
            facts[np.searchsorted(model.hot, np.array([row.key], np.int64).view(np.uint64)[0])] = row[2:]
    model.hot_facts = facts
    merged = by_shard(both.filter(F.col("kind").isin(_COUNTS, _AHEAD))).applyInArrow(_merge_words(path), ", ".join(f"{c} long" for c in _WORD_SUMS))
    model.tokens, model.types, n1, n2, n3, n4, more, total = merged.agg(*(F.sum(c) for c in _WORD_SUMS)).first()
    model.discounts[1] = d = discounts(n1, n2, n3, n4)
    model.followers, model.word_rest = total, (d[0] * n1 + d[1] * n2 + d[2] * more) / total
    return model


def _scores(shared, at_once: int = 6_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def done(held):
            texts = [t for b in held for t in b.column(1).to_pylist()]
            ids = pa.concat_arrays([b.column(0) for b in held])
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, model.score(texts))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= at_once:
                yield done(held)
                held, size = [], 0
        if held:
            yield done(held)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document.

    score is the model's log10 probability of the text, base_score that of its
    words' smoothed shares; perplexity is 10 ** (-score / n_tokens).
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scores(shared), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    model = train(docs.filter(~held))
    scored = score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES: dict[str, str] = {}
