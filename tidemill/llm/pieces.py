"""SentencePiece encoding with byte offsets, and decoding.

A text is normalised first: at each position the longest prefix that the model's
compiled character map knows is replaced, and every byte of the outcome records
the source bytes it came from. The normalised text is then cut into chunks that
no piece of the vocabulary can span, each chunk is encoded by the library once
and remembered, and every piece is projected through the alignment to the span
of original bytes it covers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.packing import Memory, _grouped, _joined, _listed
from tidemill.llm.storage import small_batches

SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """Longest-prefix replacement through a model's compiled character map.

    The map is a double-array trie, its size in bytes ahead of it and the
    replacements, each closed by a zero byte, behind it.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.replacements = compiled[4 + size :]
        base = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6) if self.units else 0
        known = [c for c in range(256) if self.units and (base ^ c) < len(self.units) and self.units[base ^ c] & 0x800000FF == c]
        #: Bytes that a known prefix may begin with.
        self.first = np.isin(np.arange(256), known)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data from `at` on, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)]
        return found

    def replaced(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """data with the longest known prefix at each position replaced, and the source offset of each byte.

        The walk stops only where a known prefix may begin; what lies between is
        copied as it is.
        """
        out, at, done = [], [], 0
        for i in np.flatnonzero(self.first[np.frombuffer(data, np.uint8)]).tolist():
            found = self.longest(data, i) if i >= done else None
            if found:
                size, new = found
                out += [data[done:i], new]
                at += [np.arange(done, i), i + (np.arange(size) if new == data[i : i + size] else np.zeros(len(new), np.int64))]
                done = i + size
        out.append(data[done:])
        at.append(np.arange(done, len(data)))
        return b"".join(out), np.concatenate(at)


class Encoder:
    """ids, pieces' source spans and decoding of a SentencePiece model.

    Texts are taken as columns: the chunks of a batch are cut, told apart and looked
    up together, and only new ones go to the library. `most` bounds the number of
    chunks that are remembered; chunks of over 64 characters are not kept.
    """

    def __init__(self, path: str, most: int = 250_000):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        spec: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 3:
                spec |= dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.trim, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        # The same model without normalisation: of repeated fields the last counts.
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")
        self.full = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.full.id_to_piece(i) for i in range(len(self.full))]
        own = [p for i, p in enumerate(pieces) if not (self.full.is_control(i) or self.full.is_unknown(i) or self.full.is_byte(i))]
        self.end, self.unknown = self.full.eos_id(), self.full.unk_id()
        bytes_known = any(self.full.is_byte(i) for i in range(len(pieces)))
        #: May a text be cut ahead of each run of spaces and around line ends? Then a space mark is one byte in its chunks.
        self.divisible = bytes_known and self.escape and SPACE in own and not any(SPACE in p.lstrip(SPACE) or "\n" in p or " " in p for p in own)
        self.sizes = np.array([1 if self.full.is_byte(i) else self._size(p) for i, p in enumerate(pieces)])
        self.decimals = pa.array([f"{i} " for i in range(len(pieces))], pa.large_string())
        self.known = Memory(most)

    def _size(self, piece: str) -> int:
        return len(piece.encode()) - 2 * piece.count(SPACE) * self.divisible

    def _normalised(self, data: np.ndarray, starts: np.ndarray, folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the normalised texts, where each begins (and the last ends), and the source offset of each byte and of the end.

        data are the texts' bytes and starts where each begins in them. If folded, a space mark is one byte, a space.
        """

        def only(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return out[keep], np.append(0, np.cumsum(keep))[starts], at[np.append(keep, True)]

        out, at = data, np.arange(len(data) + 1)
        if self.map.first[data].any():
            found = [(a, *self.map.replaced(data[a:b].tobytes())) for a, b in zip(starts.tolist(), starts[1:].tolist())]
            out = np.frombuffer(b"".join([new for _, new, _ in found]), np.uint8)
            at = np.append(np.concatenate([a + source for a, _, source in found]), len(data))
            starts = np.append(0, np.cumsum([len(new) for _, new, _ in found]))
        if self.trim:
            for last in (False, True):  # runs of spaces and those that lead, then one that is left at an end
                space, border = out == 32, np.zeros(len(out) + 1, bool)
                border[starts] = True
                out, starts, at = only(~(space & (border[1:] if last else np.append(True, space)[:-1] | border[:-1])))
        mark = SPACE.encode() if self.escape and not folded else b" "
        if folded:
            hits = np.flatnonzero(out[:-2] == 0xE2)
            hits = hits[(out[hits + 1] == 0x96) & (out[hits + 2] == 0x81)]
            if len(hits):
                keep, out = np.ones(len(out), bool), out.copy()
                out[hits], keep[hits + 1], keep[hits + 2] = 32, False, False
                out, starts, at = only(keep)
        elif self.escape:
            size = np.where(out == 32, len(mark), 1)
            where = np.append(0, np.cumsum(size))
            marks = where[:-1][out == 32]
            out, starts, at = np.repeat(out, size), where[starts], np.repeat(at, np.append(size, 1))
            for i, byte in enumerate(mark):
                out[marks + i] = byte
        if self.dummy:
            full = np.diff(starts) > 0
            where = np.repeat(starts[:-1][full], len(mark))
            out, at = np.insert(out, where, np.tile(np.frombuffer(mark, np.uint8), full.sum())), np.insert(at, where, at[where])
            starts = starts + len(mark) * np.append(0, np.cumsum(full))
        return out, starts, at

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text in UTF-8, and the source offset of each of its bytes and of its end."""
        data = np.frombuffer(text.encode(), np.uint8)
        out, _, at = self._normalised(data, np.array([0, len(data)]), False)
        return out.tobytes(), at

    def _encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of the normalised chunks and how many each has. An unknown piece's is its length beyond the last id."""
        texts = _listed(pc.replace_substring(chunks, " ", SPACE) if self.divisible else chunks)
        found = self.plain.encode(texts, num_threads=1)
        ids, lengths = _joined(found)
        if (ids == self.unknown).any():
            for i, text in enumerate(texts):
                if self.unknown in found[i]:
                    found[i] = [len(self.sizes) + self._size(p.surface) if p.id == self.unknown else p.id for p in self.plain.encode(text, return_type="proto").pieces]
            ids, lengths = _joined(found)
        return ids, lengths

    def _cuts(self, out: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where chunks begin and the last ends."""
        cut = np.zeros(len(out) + 1, bool)
        cut[starts] = True
        if self.divisible:
            space, line = out == 32, out == 10
            cut[:-1] |= line
            cut[1:] |= line
            cut[1:-1] |= space[1:] & ~space[:-1]
        return np.flatnonzero(cut)

    def __call__(self, texts: pa.Array, spans: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """ids of all texts, one after another; where they end, from 0 on; and the pieces' (begin, end) bytes in their texts.

        A null counts as empty.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        own = at - at[0]
        out, starts, source = self._normalised(data, own, self.divisible)
        cuts = self._cuts(out, starts)
        chunks = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(out)))
        ids, lengths = self.known(chunks, self._encode)
        ends = np.append(0, np.cumsum(lengths))[np.searchsorted(cuts, starts)]
        odd, where = ids >= len(self.sizes), None
        if spans:
            sizes = self.sizes[np.where(odd, 0, ids)]
            sizes[odd] = ids[odd] - len(self.sizes)
            stops = np.cumsum(sizes)
            where = np.stack([source[stops - sizes], source[stops]], axis=1)
            full = np.diff(ends) > 0
            where[ends[1:][full] - 1, 1] = own[1:][full]
            where -= np.repeat(own[:-1], np.diff(ends))[:, None]
        ids[odd] = self.unknown
        return ids, ends, where

    def decode(self, ids: list[int]) -> str:
        return self.full.decode(ids)


_memory: dict[str, Encoder] = {}


def _encoded(path: str, columns: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _memory:
            _memory[path] = Encoder(path)
        encoder = _memory[path]
        spans, decodes = bool({"begins", "ends", "ends_crc32"} & {*columns}), bool({"decoded", "decoded_sha256"} & {*columns})
        for batch in _grouped(batches):
            ids, ends, where = encoder(batch.column(1), spans)
            ids, last = np.insert(ids, ends[1:], encoder.end).astype("<i4"), ends + np.arange(len(ends))
            parts, decoded = list(pairwise(last.tolist())), []
            if decodes:
                every = ids.tolist()
                decoded = [encoder.decode(every[a:b]) for a, b in parts]

            def lists(bounds: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))

            def ids_sha256() -> list[str]:
                line = encoder.decimals.take(pa.array(ids))  # each id with a space behind it
                at, data = np.frombuffer(line.buffers()[1], np.int64), memoryview(line.buffers()[2] or b"")
                return [hashlib.sha256(data[a : b - 1]).hexdigest() for a, b in pairwise(at[last].tolist())]

            def ends_crc32() -> list[int]:
                at = where[:, 1].astype("<u4")
                return [zlib.crc32(at[a:b]) for a, b in pairwise(ends.tolist())]

            make = {
                "ids": lambda: lists(last, ids, pa.int32()),
                "begins": lambda: lists(ends, where[:, 0], pa.int64()),
                "ends": lambda: lists(ends, where[:, 1], pa.int64()),
                "n_tokens": lambda: pa.array(np.diff(last), pa.int64()),
                "ids_sha256": lambda: pa.array(ids_sha256(), pa.string()),
                "decoded": lambda: pa.array(decoded, pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                "ends_crc32": lambda: pa.array(ends_crc32(), pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *(make[c]() for c in columns)], ["doc_id", *columns])

    return encode


_TYPES = {"ids": "array<int>", "begins": "array<bigint>", "ends": "array<bigint>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string", "ends_crc32": "bigint"}


def encode_pieces(docs: DataFrame, model: str, columns: tuple[str, ...] = ("ids", "begins", "ends")) -> DataFrame:
    """doc_id and the asked columns of each document's whole text, the end id included.

    ids; begins and ends: the pieces' spans in the text's UTF-8 bytes (none for
    the end id); n_tokens; ids_sha256: of the decimal ids, joined by a space;
    decoded, decoded_sha256; ends_crc32: of ends as little-endian 32-bit integers.
    A null text counts as empty; repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(model, [*columns]), ", ".join(["doc_id long", *(f"{c} {_TYPES[c]}" for c in columns)]))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLES: dict[str, str] = {}
