"""Best-fit packing of documents into sequences.

Only the histogram of lengths decides how full the sequences get, and it has no
more entries than a sequence has tokens. So the driver packs length classes, not
documents: vector best-fit, longest class first, over groups of equally filled
bins. A group's residual vector has three capacities: tokens, documents and
attention cost (the sum of squared lengths). Of the groups in which an item fits
under every constraint, the one with the least weighted residual norm after the
placement, or the largest weighted dot product of demand and residual, takes it.
The outcome is a table of placements (length class, rank range, sequence,
offset), a few rows for each class whatever the corpus holds.

Spark then ranks every piece within its length class, hot classes split over
salts, and looks its place up.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.storage import save, short_scans, small_batches

#: What tokens, documents and attention cost weigh in the choice of a bin: tokens
#: first, so that no more sequences are opened than by tokens alone; the others
#: decide among bins that are about as full.
WEIGHTS = (1.0, 0.1, 0.1)


#: The pattern by which the tokenizer cuts words into parts, and the words that may be cut by it here: letters
#: and marks up to Latin Extended-A whose normalisation is lower-casing one by one (not so U+0130), no white
#: space and no special token's bracket.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "^[!-;=?-~\u00a1-\u012f\u0131-\u017f]+$"


def _spans(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ids, one after another."""
    return ids[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist


class Memory:
    """ids of strings met before, in one array. It is emptied when it holds `most` strings or 32 times as many
    ids, and strings of over 64 characters are forgotten after their batch."""

    def __init__(self, most: int):
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.at, self.ids, self.ends = {}, np.zeros(1 << 10, "<u4"), np.zeros(1 << 10, np.int64)

    def __call__(self, strings: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all strings, one after another, and how many each has; encode gives these for distinct new ones."""
        if len(self.at) > self.most or len(self.ids) > 32 * self.most:
            self._empty()
        coded, at = strings.dictionary_encode(), self.at
        keys = _listed(coded.dictionary)
        place = np.fromiter(map(at.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            short = pc.utf8_length(coded.dictionary.take(pa.array(new))).to_numpy() <= 64
            kept, new = new[short], np.append(new[short], new[~short])
            ids, lengths = encode(coded.dictionary.take(pa.array(new)))
            n, m = len(at), int(self.ends[len(at)])
            self._room(n + len(new) + 1, m + len(ids))
            self.ids[m : m + len(ids)] = ids
            self.ends[n + 1 : n + 1 + len(new)] = m + np.cumsum(lengths)
            place[new] = np.arange(n, n + len(new))
            at.update(zip(map(keys.__getitem__, kept.tolist()), place[kept].tolist()))
        place = place[coded.indices.to_numpy()]
        starts = self.ends[place]
        lengths = self.ends[place + 1] - starts
        return _spans(self.ids, starts, lengths), lengths

    def _room(self, strings: int, ids: int) -> None:
        for name, n in (("ends", strings), ("ids", ids)):
            x = getattr(self, name)
            if n > len(x):
                setattr(self, name, np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)]))


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))


class WordIds:
    """ids of texts, and where each text's begin and end.

    The tokenizer sees no word across ASCII white space, so a batch's words are cut,
    told apart and looked up as columns, and only new ones are encoded. Words of
    plain Latin letters and marks, whose normalisation is lower-casing alone, are
    cut by the tokenizer's own pattern and only the new ones of their parts go
    through its merges; all others go through the whole tokenizer. A quarter of a million
    words and as many parts take about 100 MB, which each Python worker of an executor holds.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), Memory(most), Memory(most)
        with open(path) as f:
            kind = json.load(f)
        split, level = kind["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in kind["normalizer"]["normalizers"]]
        self.cuts = steps == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["invert"] and split["pattern"] == {"Regex": PARTS} and level["type"] == "ByteLevel" and not level["add_prefix_space"]
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(256 + hidden.index(b)) for b in hidden}

    def _merge(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        merge = self.tokenizer.model.tokenize
        shown = (p if p.isascii() else p.encode().decode("latin-1").translate(self.bytes) for p in _listed(parts))
        return _joined([[t.id for t in merge(p)] for p in shown])

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, PLAIN) if self.cuts else pa.array([False] * len(words))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), PARTS, r"\0 "))
        ids, lengths = self.parts(cut.flatten(), self._merge)
        ends = np.append(0, np.cumsum(lengths))[cut.offsets.to_numpy()]
        whole, sizes = _joined([self.tokenizer.encode(w, add_special_tokens=False).ids for w in _listed(words.filter(pc.invert(plain)))])
        starts, lengths, plain = np.empty(len(words), np.int64), np.empty(len(words), np.int64), plain.to_numpy(zero_copy_only=False)
        starts[plain], lengths[plain] = ends[:-1], np.diff(ends)
        starts[~plain], lengths[~plain] = len(ids) + np.cumsum(sizes) - sizes, sizes
        return _spans(np.append(ids, whole), starts, lengths), lengths

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and where they end, from 0 on; a null counts as empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ids, lengths = self.words(words.flatten(), self._encode)
        return ids, np.append(0, np.cumsum(lengths))[words.offsets.to_numpy()]


_memory: dict[str, WordIds] = {}


def _grouped(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of up to size bytes, or one that is larger, so that few words are told apart more than once."""
    held, n = [], 0
    for batch in batches:
        if held and n + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(batch)
        n += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def _pieces(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _memory:
            _memory[path] = WordIds(path)
        for batch in _grouped(batches):
            ids, ends = _memory[path](batch.column(1))
            ids, ends = np.insert(ids, ends[1:], end_id), (ends + np.arange(len(ends))).tolist()
            rows = []
            for doc, first, end in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                for piece, at in enumerate(range(first, end, capacity)):
                    part = ids[at : min(at + capacity, end)]
                    rows.append((doc, piece, at - first, len(part), zlib.crc32(part)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces.

    A null text counts as empty and has one piece, the end id alone.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, max_docs: int, max_cost: int, select: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, int]:
    """Placements of a histogram, and the number of sequences.

    A placement is a row (length, first rank, pieces a sequence, sequences, first
    sequence, offset): the pieces of this length with ranks from the first rank on
    fill so many consecutive sequences, so many in each, from the offset on.
    """
    limit = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights, float)
    residual, first, size = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    order = np.argsort(-lengths)
    least = int(lengths.min()) if len(lengths) else 0
    for length, count in zip(lengths[order].tolist(), counts[order].tolist()):
        demand = np.array([length, 1, length * length], np.int64)
        if (demand > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's limits")
        open_ = residual[:, 0] >= least  # the others take nothing any more
        residual, first, size = residual[open_], first[open_], size[open_]
        rank = 0
        while count:
            fits = np.flatnonzero((residual >= demand).all(axis=1))
            if len(fits):
                r = residual[fits] / limit
                score = (w * (r - demand / limit) ** 2).sum(axis=1) if select == "norm" else -(w * r * (demand / limit)).sum(axis=1)
                at = int(fits[np.argmin(score)])
                each = int((residual[at] // demand).min()) if select == "norm" else 1
                n = min(int(size[at]), count // each)
                if not n:
                    each, n = count, 1
                start, left = int(first[at]), residual[at] - each * demand
                offset = capacity - int(residual[at, 0])
                first[at] += n
                size[at] -= n
                if not size[at]:
                    residual, first, size = (np.delete(x, at, axis=0) for x in (residual, first, size))
            else:
                each = int((limit.astype(np.int64) // demand).min())
                n = count // each
                if not n:
                    each, n = count, 1
                start, offset, left = bins, 0, limit.astype(np.int64) - each * demand
                bins += n
            rows.append((length, rank, each, n, start, offset))
            rank += each * n
            count -= each * n
            residual, first, size = np.vstack([residual, left]), np.append(first, start), np.append(size, n)
    return np.array(rows, np.int64).reshape(-1, 6), bins


def _placed(shared):
    """Looks the place of (length, rank) up in the broadcast placements."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        wide = int(table[:, 1].max(initial=0) + (table[:, 2] * table[:, 3]).max(initial=1)) + 1
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 4] + k // row[:, 2]), pa.array(row[:, 5] + k % row[:, 2] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_cost: int | None = None, select: str = "norm", weights: tuple[float, float, float] = WEIGHTS, rows_in_salt: int = 1000) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns as from `token_pieces`).

    capacity bounds a sequence's tokens, max_docs its pieces and max_cost the sum
    of their squared lengths; None leaves the last two at what a sequence of that
    capacity can hold at most (then they weigh in the choice, but refuse nothing).
    Sequence ids run from 0 without a gap. Repeated
    rows are packed each for itself; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = save(pieces, "pieces")
    classes = pieces.groupBy("length").count().toPandas()  # at most `capacity` rows
    lengths, counts = classes["length"].to_numpy(np.int64), classes["count"].to_numpy(np.int64)
    table, _ = plan(lengths, counts, capacity, max_docs or capacity, max_cost or capacity * capacity, select, weights)
    most = int(counts.max()) if len(counts) else 0
    salts = max(1, -(-most // rows_in_salt))
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sums = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "piece", "ids_crc32")
    ranked = keyed.withColumn("own", F.row_number().over(own)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).cast("long").alias("rank"))
    shared = spark.sparkContext.broadcast(table)
    return ranked.mapInArrow(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, **options) -> DataFrame:
    """Packs whole documents (doc_id, text); only longer ones than a sequence are cut. options: those of `pack`."""
    with short_scans(docs.sparkSession):
        return pack(token_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id, capacity), capacity, **options)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
