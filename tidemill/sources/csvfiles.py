"""CSV files read in byte ranges, quoted line ends included, and written in parallel and in order.

A range of a file begins at a line, but that line may stand inside a quoted field.
So a first pass tells of each range, for both cases, whether its end stands inside
one and how many records begin in it; composed in the order of the ranges (a few
numbers for each) this gives every range's true state, its first record's number and
its first line's number. The second pass reads records; one that crosses from range
to range is put together from its parts. Records are stored once, as Parquet with
their places and lines.

Fields are read as Python's csv module reads them. Line ends are LF, CR LF or CR.
"""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.storage import new_path, save

#: Encodings whose quotes, separators and line ends are those of ASCII.
_WIDE = ("utf-16", "utf-32", "utf16", "utf32", "u16", "u32", "utf-7", "utf7")
_CUT = "the ranges of the file changed between the passes"
_LINES = re.compile(rb"[^\r]*(?:\r|\Z)")


def splittable(sep: str, encoding: str) -> bool:
    return len(sep) == 1 and sep.isascii() and not encoding.lower().replace("_", "-").startswith(_WIDE)


def _charset(encoding: str) -> str:
    return "utf-8" if encoding.lower().replace("_", "-") in ("utf-8-sig", "utf8", "utf-8") else encoding


def _inside_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether the line's end stands in a quoted field, if its begin does or doesn't."""
    at = 0
    while True:
        quote = line.find(b'"', at)
        if quote < 0:
            return inside
        if not inside:
            # A quote opens a field only where the field begins.
            inside, at = quote == 0 or line[quote - 1 : quote] == sep, quote + 1
        elif line[quote + 1 : quote + 2] == b'"':
            at = quote + 2
        else:
            after = line.find(sep, quote + 1)
            if after < 0:
                return False
            inside, at = False, after + 1


def _split(line: bytes) -> list[bytes]:
    """What stands up to a line feed, with it, as lines: one as a rule, more where a CR stands alone."""
    if b"\r" not in line[:-1]:
        return [line + b"\n"]
    found = [x for x in _LINES.findall(line) if x]
    found[-1] += b"\n"
    return found


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("start"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(begin of the range, lines up to their line feeds), in the file's order."""
    for batch in batches:
        value, start = batch.columns
        if not batch.num_rows:
            continue
        starts = start.to_numpy()
        cuts = [0, *(i + 1 for i in (starts[1:] != starts[:-1]).nonzero()[0].tolist()), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            lines = value.slice(a, b - a).to_pylist()
            if starts[a] == 0 and lines and lines[0][:3] == b"\xef\xbb\xbf":
                lines[0] = lines[0][3:]
            yield int(starts[a]), lines


def _counted(sep: bytes):
    """Of each range: lines, and for a begin outside and inside of quotes, whether its end is inside and the records that begin in it."""
    schema = pa.schema([("start", pa.int64()), ("lines", pa.int64()), *((f"{x}_{k}", pa.int64()) for k in (0, 1) for x in ("inside", "records"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, inside, records = None, 0, [False, True], [0, 0]

        def told() -> pa.RecordBatch:
            values = (now, n, int(inside[0]), records[0], int(inside[1]), records[1])
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], schema=schema)

        for start, lines in _by_range(batches):
            if start != now:
                if now is not None:
                    yield told()
                now, n, inside, records = start, 0, [False, True], [0, 0]
            for line in lines:
                for part in _split(line):
                    n += 1
                    quoted = b'"' in part
                    for k in (0, 1):
                        if not inside[k] and part.strip(b"\r\n"):
                            records[k] += 1
                        if quoted:
                            inside[k] = _inside_after(part.rstrip(b"\r\n"), inside[k], sep)
        if now is not None:
            yield told()

    return run


def _parsed(records: list[bytes], charset: str, sep: str, width: int) -> list[list[str | None]]:
    """Fields of records, each of width, the empty one null."""
    csv.field_size_limit(1 << 30)
    out = []
    for row in csv.reader((r.decode(charset) for r in records), delimiter=sep):
        row = [x or None for x in row[:width]]
        out.append(row + [None] * (width - len(row)))
    return out


def _arrow(width: int) -> pa.Schema:
    return pa.schema([("place", pa.int64()), ("line", pa.int64()), ("part", pa.int64()), ("text", pa.binary()), *((f"c{i}", pa.string()) for i in range(width))])


def _batch(rows: list[list[Any]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _read(entries, charset: str, sep: str, width: int):
    """Whole records with their fields, and parts of those that cross ranges with their bytes."""
    schema, byte = _arrow(width), sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, number, inside = None, 0, 0, False
        open_, began, cut = [], 0, False  # the lines of a record that hasn't ended, its first line, whether it began in an earlier range
        whole: list[tuple[int, int, bytes]] = []
        parts: list[tuple] = []

        def made() -> Iterator[pa.RecordBatch]:
            if whole:
                fields = _parsed([r for *_, r in whole], charset, sep, width)
                yield _batch([[place, line, None, None, *f] for (place, line, _), f in zip(whole, fields, strict=True)], schema)
            if parts:
                yield _batch([[*p, *[None] * width] for p in parts], schema)
            whole.clear()
            parts.clear()

        def left() -> None:
            if open_:
                parts.append((number - 1, began, now, b"".join(open_)))

        for start, lines in _by_range(batches):
            if start != now:
                left()
                if start not in entries.value:
                    raise RuntimeError(_CUT)
                inside, number, at = entries.value[start]
                now, open_, cut = start, [], inside
            size = 0
            for line in lines:
                size += len(line)
                for part in _split(line):
                    at += 1
                    if not inside and not part.strip(b"\r\n"):
                        continue
                    if not open_:
                        began = at
                        number += not inside
                    open_.append(part)
                    inside = _inside_after(part.rstrip(b"\r\n"), inside, byte) if b'"' in part else inside
                    if not inside:
                        if cut:
                            parts.append((number - 1, began, now, b"".join(open_)))
                        else:
                            whole.append((number - 1, began, b"".join(open_)))
                        open_, cut = [], False
                if size > 4 << 20:
                    yield from made()
                    size = 0
            yield from made()
        left()
        yield from made()

    return run


def _stitched(charset: str, sep: str, width: int):
    schema = _arrow(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(place, line, b"".join(p["text"] for p in parts)) for place, line, parts in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                # One by one: the file's last record may lack a closing quote.
                yield _batch([[place, line, None, None, *_parsed([r], charset, sep, width)[0]] for place, line, r in rows], schema)

    return run


def header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """The names in a file's first record."""
    first = _lines(spark, path).filter("start < 1000000").orderBy("start", F.monotonically_increasing_id()).limit(100).collect()
    text = b"".join(bytes(r.value) + b"\n" for r in first).removeprefix(b"\xef\xbb\xbf").decode(_charset(encoding), "replace")
    return next((row for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if row), [])


def _rows(spark: SparkSession, path: str, sep: str, encoding: str, width: int) -> DataFrame:
    charset, byte = _charset(encoding), sep.encode()
    told = "start long, lines long, inside_0 long, records_0 long, inside_1 long, records_1 long"
    ranges = sorted(_lines(spark, path).mapInArrow(_counted(byte), told).collect())  # a row for each range of the file
    entries, inside, records, lines = {}, 0, 0, 0
    for r in ranges:
        entries[r.start] = (bool(inside), records, lines)
        lines += r.lines
        records += r.records_1 if inside else r.records_0
        inside = r.inside_1 if inside else r.inside_0
    schema = ", ".join(["place long, line long, part long, text binary", *(f"c{i} string" for i in range(width))])
    known = spark.sparkContext.broadcast(entries)
    read = save(_lines(spark, path).mapInArrow(_read(known, charset, sep, width), schema), "records")
    cut = read.filter("part IS NOT NULL").groupBy("place").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    if (len(ranges) > 1 or inside) and not cut.isEmpty():
        read = read.filter("part IS NULL").union(save(cut.mapInArrow(_stitched(charset, sep, width), schema), "stitched"))
    return read.filter("place > 0")  # the first record is the header


def rows(spark: SparkSession, path: str, sep: str, encoding: str, width: int) -> DataFrame:
    """place (from 1, the header being 0), line and c0, c1, ... of a file's records, stored."""
    for last in (False, True):
        try:
            return _rows(spark, path, sep, encoding, width)
        except PySparkException as e:
            if "UnicodeDecodeError" in str(e):
                raise UnicodeError(f"{path} isn't {encoding}") from None
            if _CUT not in str(e) or last:  # ranges depend on the number of cores; executors that come or go change it
                raise
    raise AssertionError


def _text(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = io.StringIO(newline="")
                csv.writer(out, lineterminator="\n").writerows(zip(*(["" if v is None else v for v in batch.column(n).to_pylist()] for n in names)))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()[:-1]])], ["value"])

    return run


def write_ordered(df: DataFrame, order: list[str], path: str, names: list[str] | None = None, header: list[str] | None = None) -> None:
    """One CSV file with df's rows by order, of the columns `names` under `header`: booleans as True and False, nulls empty.

    Ranges of rows are formatted and written by tasks, in parallel; their files are
    then copied one behind the other, as bytes and by the file system's own streams.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in order] if names is None else names
    local = {c for c, kind in df.dtypes if kind == "timestamp"}
    plain = df.orderBy(*order).select(*((F.col(f"`{c}`").cast("timestamp_ntz") if c in local else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)))
    folder = new_path(spark, "csv")
    plain.mapInArrow(_text(plain.columns), "value string").write.text(folder, lineSep="\n", compression="none")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    source = fs_path(folder).getFileSystem(conf)
    if "://" in path:
        out = fs_path(path).getFileSystem(conf).create(fs_path(path), True)
    else:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        out = jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRaw().create(fs_path(os.path.abspath(path)), True)
    try:
        first = io.StringIO(newline="")
        csv.writer(first, lineterminator="\n").writerow(names if header is None else header)
        out.write(first.getvalue().encode())
        for part in sorted(str(s.getPath().toString()) for s in source.listStatus(fs_path(folder)) if s.getPath().getName().startswith("part-")):
            stream = source.open(fs_path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()
