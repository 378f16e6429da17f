"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, by numpy's exclusive-or and bit counts, tile
against tile: in the order of their population counts, rows are cut in tiles, and
a pair of tiles whose counts differ beyond the radius is skipped. Not all tiles of
a corpus need meet: of the m segments of a fingerprint, m - 3 or more are the same
in any two that differ in 3 bits at most, so each choice of m - 3 segments deals
fingerprints into buckets of some thousands by the segments' hash, and tiles meet
within a bucket. Buckets that are too large for a task are dealt out as pairs of
parts. A task returns a spanning forest of its links, not the links, so a family
of copies costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.graph import components
from tidemill.llm.storage import save, small_batches

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _shingle_digests(text: str | None, width: int, seed: int) -> bytes:
    """XXH64 of each word shingle, big-endian, one behind the other; fewer words than a shingle has are one."""
    from xxhash import xxh64_digest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return b""
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        return xxh64_digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    parts = map(joined.__getitem__, map(slice, begins[:n].tolist(), ends[width - 1 :].tolist()))
    return b"".join(map(xxh64_digest, parts, repeat(seed)))


def _distinct_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    return np.unique(np.frombuffer(_shingle_digests(text, width, seed), ">u8").astype(np.uint64))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    digests = _shingle_digests(text, width, seed)
    n = len(digests) // 8
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 64):
        part = rows[at : at + 255 * 64]
        if len(part) > 255:
            part = np.vstack([part, np.zeros((-len(part) % 255, 8), np.uint8)])
            bits = np.unpackbits(part, axis=1).reshape(-1, 255, 64)
            ones += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        else:
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every document; a null text counts as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(width, seed), "doc_id long, fp long")


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after a[i] and b[i] have been tied, each the smallest index of its set."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            new = label[label]
            if (new == label).all():
                break
            label = new


def tile_pairs(ones: np.ndarray, start: int, end: int, radius: int, tile: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of tiles of rows start..end, in the order of their population counts, that can hold a link."""
    for i in range(start, end, tile):
        most = ones[min(i + tile, end) - 1] + radius
        for j in range(i, end, tile):
            if ones[j] > most:
                break  # and so do all that follow
            yield slice(i, min(i + tile, end)), slice(j, min(j + tile, end))


def compare(fp: np.ndarray, group: np.ndarray, radius: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) indices of a forest of the links within whole groups.

    fp has a row of words for each fingerprint; group numbers ascend, and within a
    group population counts.
    """
    label = np.arange(len(fp))
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(fp)))
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        for x, y in tile_pairs(ones, start, start + size, radius, tile):
            apart = np.bitwise_count(fp[x, None, 0] ^ fp[None, y, 0]).astype(np.uint16)
            for w in range(1, fp.shape[1]):
                apart += np.bitwise_count(fp[x, None, w] ^ fp[None, y, w])
            a, b = np.nonzero(apart <= radius)
            a, b = a + x.start, b + y.start
            fresh = a < b
            if fresh.any():
                label = _unite(label, a[fresh], b[fresh])
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return tied, label[tied]


def _links(radius: int, tile: int, at_once: int = 1 << 16):
    """(u, v) ties within the groups of a partition sorted by group and population count.

    About `at_once` rows are held, and always whole groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            table = pa.Table.from_batches(held)
            ids = table["id"].to_numpy()
            fp = np.frombuffer(b"".join(table["bits"].to_pylist()), ">u8").astype(np.uint64).reshape(len(ids), -1)
            keys = [table[c].to_numpy() for c in ("choice", "key", "a", "b")]
            new = np.zeros(len(fp), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            u, v = compare(fp, np.cumsum(new), radius, tile)
            return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("choice", "key", "a", "b")]
            end = tuple(int(k[-1]) for k in keys)
            same = np.ones(batch.num_rows, bool)
            for k in keys:
                same &= k == k[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if (cut or end != last) and sum(b.num_rows for b in held) >= at_once:
                if cut:
                    held.append(batch.slice(0, cut))
                yield flush()
                held = []
                batch = batch.slice(cut)
            held.append(batch)
            last = end
        if held:
            yield flush()

    return run


def _bucket(key, n: int, rows: int):
    """Deals keys into buckets of about that many of n rows."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, n // rows)))


def linked(distinct: DataFrame, n: int, radius: int = 3, tile: int = 256, most: int = 16_384, in_bucket: int = 2_048) -> DataFrame:
    """u, v: a forest that ties fingerprints (column fp, no two alike) as their links do.

    n is their number; from it follows how finely they are cut in segments and
    dealt into buckets (a matter of speed alone). Buckets of over `most` rows are
    compared as pairs of parts, by different tasks.
    """
    segments = radius + (1 if n < 1 << 22 else 2 if n < 1 << 31 else 3)
    bounds = [round(64 * i / segments) for i in range(segments + 1)]
    choices = []
    for number, chosen in enumerate(combinations(range(segments), segments - radius)):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        choices.append(F.struct(F.lit(number).alias("choice"), _bucket(F.col("fp").bitwiseAND(F.lit(mask)), n, in_bucket).alias("key")))
    bits = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    rows = distinct.select(F.col("fp").alias("id"), bits.alias("bits"), F.bit_count("fp").alias("ones"), F.inline(F.array(*choices)))
    return tiled(rows, n * len(choices), radius, tile, most)


def _pairs_of_parts(rows: DataFrame, hot: DataFrame, by: list[str]) -> DataFrame:
    """rows with a and b: the rows of groups that hot has stand once for each pair of parts with their own."""
    rows = rows.join(save(hot, "hot"), by, "left")  # stored, so that its size decides how it is joined
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, own).alias("a"), F.greatest(p, own).alias("b")))
    alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    return rows.select("*", F.inline(F.when(F.col("parts").isNull(), alone).otherwise(others))).drop("parts")


def tiled(rows: DataFrame, n: int, radius: int, tile: int = 256, most: int = 16_384) -> DataFrame:
    """u, v: a forest of the links among fingerprints that share a choice and key.

    rows: id, bits (binary), ones (how many bits are 1), choice and key (long); n is
    about their number. Groups of over `most` rows become pairs of parts.
    """
    hot = rows.groupBy("choice", "key").count().filter(F.col("count") > most)
    hot = hot.select("choice", "key", F.ceil(F.col("count") / (most // 2)).cast("int").alias("parts"))
    rows = _pairs_of_parts(rows, hot, ["choice", "key"])
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 2_000_000)
    rows = rows.repartition(parts, "choice", "key", "a", "b")
    rows = rows.sortWithinPartitions("choice", "key", "a", "b", "ones", "id")
    return rows.mapInArrow(_links(radius, tile), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Documents whose fingerprints differ in `radius` bits at most are linked, those
    without words (fingerprint zero) like any other; component_id is the smallest
    doc_id that can be reached. A null doc_id gets its component like any other
    but never names one; where a component has no other, the name is null.
    """
    prints = save(fingerprints(docs, width, seed), "fingerprints")
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    forest = linked(distinct.select("fp"), distinct.count(), radius)
    roots = components(forest)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = save(named.join(names, "root").select("fp", "component_id"), "classes")
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(text: str | None, width: int, words: int, bands: int, rows: int, seed: int = 42) -> tuple[bytes, list[int]] | None:
    """A SimHash of 64 * words bits of the distinct shingles, and a key for each band of `rows` minima of their hashes; null without words.

    The minima are of one permutation cut in bands * rows bins; an empty bin takes
    the next one's.
    """
    h = _distinct_hashes(text, width, seed)
    return _wide_of(h, words, bands, rows) if len(h) else None


def _wide_of(h: np.ndarray, words: int, bands: int, rows: int) -> tuple[bytes, list[int]]:
    ones = np.zeros(64 * words, np.int64)
    spread = (np.arange(words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255 * 32):
        part = h[at : at + 255 * 32]
        mixed = (part[:, None] ^ (part[:, None] >> np.uint64(29))) * spread
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
        for i in range(0, len(part), 255):
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    n = bands * rows
    least = np.full(n, 1 << 32, np.uint64)
    np.minimum.at(least, ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64), h & np.uint64(0xFFFFFFFF))
    full = np.flatnonzero(least < 1 << 32)
    after = full[np.searchsorted(full, np.arange(n)) % len(full)]
    least = least[after] + ((after - np.arange(n)) % n).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    keys = np.zeros(bands, np.uint64)
    for r in range(rows):
        keys = (keys ^ least[r::rows]) * np.uint64(0x9E3779B185EBCA87)
        keys ^= keys >> np.uint64(31)
    return np.packbits(2 * ones > len(h)).tobytes(), keys.view(np.int64).tolist()


def _wide(width: int, words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [_distinct_hashes(t, width) for t in batch.column(1).to_pylist()]
            found = [_wide_of(h, words, bands, rows) if len(h) else None for h in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets], pa.binary()),
                    pa.array([f and f[0] for f in found], pa.binary()),
                    pa.array([f and int(np.bitwise_count(np.frombuffer(f[0], np.uint8)).sum()) for f in found], pa.int32()),
                    pa.array([f and f[1] for f in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "bits", "ones", "keys"],
            )

    return run


def _sets(width: int, words: int):
    """The distinct shingles' hashes and the fingerprint of texts that are to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_distinct_hashes(t, width) for t in batch.column(2).to_pylist()]
            bits = [_wide_of(h, words, 1, 1)[0] for h in sets]
            ones = [int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in bits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(ones, pa.int32()), pa.array([h.tobytes() for h in sets], pa.binary())],
                ["id", "root", "bits", "ones", "shingles"],
            )

    return run


def _alike(bits: list[bytes], shingles: list[bytes], least: float, radius: int, at_once: int = 1 << 22) -> np.ndarray:
    """Labels after all members that are as similar as `least` have been tied, each the smallest index of its set.

    Members come in the order of their population counts. Only those within the
    radius that aren't tied yet have their shingles compared.
    """
    fp = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    sizes = np.array([len(x) // 8 for x in shingles])
    starts = np.cumsum(sizes) - sizes
    values, place = np.unique(np.frombuffer(b"".join(shingles), np.uint64), return_inverse=True)
    place, mark = place.astype(np.int32), np.zeros(len(values), bool)
    label = np.arange(len(fp))
    ends = np.searchsorted(ones, ones + radius, "right")
    for i in range(len(fp) - 1):
        near = np.arange(i + 1, ends[i])
        near = near[np.bitwise_count(fp[i] ^ fp[i + 1 : ends[i]]).sum(axis=1, dtype=np.int64) <= radius]
        near = near[label[near] != label[i]]
        near = near[np.minimum(sizes[near], sizes[i]) >= least * np.maximum(sizes[near], sizes[i]) - 1e-6]
        if not len(near):
            continue
        mark[place[starts[i] : starts[i] + sizes[i]]] = True
        upto = np.cumsum(sizes[near])
        for part in np.split(near, np.flatnonzero(np.diff(upto // at_once)) + 1):
            n = sizes[part]
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(starts[part] - first, n)
            shared = np.add.reduceat(mark[place[at]], first, dtype=np.int64)
            tied = np.unique(label[part[shared / (n + sizes[i] - shared) >= least]])
            if len(tied):
                tied = np.append(tied, label[i])
                label[np.isin(label, tied)] = tied.min()
        mark[place[starts[i] : starts[i] + sizes[i]]] = False
    return label


def _confirmed(least: float, radius: int):
    """(u, v) ties within the groups of a partition sorted by root, a, b and population count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        last = None

        def flush():
            ids = np.array([x[0] for x in held], np.int64)
            label = _alike([x[1] for x in held], [x[2] for x in held], least, radius)
            tied = np.flatnonzero(label != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[label[tied]])], ["u", "v"])

        for batch in batches:
            for root, a, b, *row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("root", "a", "b", "id", "bits", "shingles"))):
                if (root, a, b) != last:
                    if len(held) > 1:
                        yield flush()
                    held, last = [], (root, a, b)
                held.append(tuple(row))
        if len(held) > 1:
            yield flush()

    return run


def confirmed(sets: DataFrame, least: float, radius: int, most: int = 4_096, most_bytes: int = 1 << 25) -> DataFrame:
    """u, v: a forest of the links, similar to `least` or more, among rows (id, bits, ones, shingles) of the same root.

    Groups of over `most` rows or `most_bytes` of shingles become pairs of parts.
    """
    n, size = F.count("*"), F.sum(F.length("shingles"))
    hot = sets.groupBy("root").agg(F.greatest(F.ceil(n / (most // 2)), F.ceil(size / (most_bytes // 2))).cast("int").alias("parts"), n.alias("n"), size.alias("size"))
    hot = hot.filter((F.col("n") > most) | (F.col("size") > most_bytes)).select("root", "parts")
    rows = _pairs_of_parts(sets, hot, ["root"])
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "root", "a", "b").sortWithinPartitions("root", "a", "b", "ones", "id")
    return rows.mapInArrow(_confirmed(least, radius), "u long, v long")


def similar_documents(docs: DataFrame, width: int = 5, words: int = 8, radius: int = 144, bands: int = 12, rows: int = 3, least: float = 0.8, in_bucket: int = 64) -> DataFrame:
    """doc_id, component_id of every document with a word; doc_id has to be a key without nulls.

    Documents are linked whose distinct word shingles have a Jaccard similarity of
    `least` or more. Bands of minimum hashes and fingerprints of 64 * words bits only
    propose: with 12 bands of 3, a pair as similar as 0.8 meets in one or more with
    a chance of 0.9998, and its 512 bits differ in 78 on average with a deviation of
    8 (texts of few shingles: 96 and 9), so a radius of 144 loses none. What is
    proposed makes coarse groups; each text in one has its shingles read once, and
    they decide.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = save(texts.mapInArrow(_wide(width, words, bands, rows), "doc_id long, digest binary, bits binary, ones int, keys array<long>").filter("bits is not null"), "prints")
    same = save(prints.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bits").alias("bits"), F.first("ones").alias("ones"), F.first("keys").alias("keys")), "distinct")
    n = same.count()
    dealt = same.select("id", "bits", "ones", F.posexplode("keys").alias("choice", "key")).withColumn("key", _bucket(F.col("key"), n, in_bucket))
    coarse = save(components(tiled(dealt, n * bands, radius)).select(F.col("node").alias("doc_id"), "root"), "coarse")
    sets = texts.join(coarse, "doc_id").select("doc_id", "root", "text").mapInArrow(_sets(width, words), "id long, root long, bits binary, ones int, shingles binary")
    roots = components(confirmed(save(sets, "sets"), least, radius))
    named = same.join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    return prints.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
