"""Reading tables with a row id, and writing results."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemill.functions.columns import as_text
from tidemill.sources import csvfiles
from tidemill.sources.storage import save

#: The hidden column that tells a row's place in its source, from 0.
ROW = "__row_id"


def _starts(spark: SparkSession, sizes: dict[Any, int], kind: str) -> DataFrame:
    """(part, start): the rows ahead of each part, parts in their natural order."""
    total, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, total))
        total += sizes[part]
    table = spark.createDataFrame(rows, f"__part {kind}, __start long")
    return F.broadcast(table) if len(rows) <= 100_000 else table  # a number for each partition or file


def _placed(rows: DataFrame, starts: DataFrame, inner: Column) -> DataFrame:
    """rows, that have __part, with ROW; a part that wasn't counted is an error, never a loss."""
    lost = F.raise_error(F.lit("rows belong to a part of the table that wasn't there when its rows were counted"))
    place = F.when(F.col("__start").isNull(), lost).otherwise(F.col("__start") + inner)
    return rows.join(starts, "__part", "left").withColumn(ROW, place.cast("long"))


def with_row_ids(df: DataFrame) -> DataFrame:
    """df with ROW: places 0, 1, ... in the order of its partitions and of the rows in them.

    df is computed once and stored, with each row's partition and its place there;
    the partitions' sizes (a number for each comes to the driver) are then summed
    up. Both the sizes and the result are read from what is stored: a frame whose
    partitions come out otherwise when it is computed anew (after a join, an
    aggregate or a sort, under adaptive execution) keeps all its rows.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    void = {n for n, (_, kind) in zip(names, df.dtypes) if kind == "void"}
    at = F.monotonically_increasing_id()
    stored = save(df.toDF(*names).drop(*void).select("*", at.alias("__at")), "places")
    part = F.shiftright("__at", 33).cast("long")
    sizes = {r["__part"]: r["n"] for r in stored.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).collect()}
    inner = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = _placed(stored.withColumn("__part", part), _starts(df.sparkSession, sizes, "long"), inner)
    return placed.select(ROW, *((F.lit(None) if n in void else F.col(n)).alias(c) for n, c in zip(names, df.columns)))


def before_each(parts: DataFrame, key: str, value: str, forward: bool = True, fan: int = 100_000) -> DataFrame:
    """(key, value): for each of the parts, numbered by key, the last value that isn't null of the parts before it (or, not forward, of those behind).

    A tree of prefix results: parts are windowed in groups of `fan` neighbours, and
    what a group carries on comes from the groups' own table by the same rule, so no
    window orders all parts.
    """
    least = parts.agg(F.min(key)).first()[0] or 0  # keys may be negative
    rows = parts.select(F.col(key).alias("k"), F.col(value).alias("v"), F.floor((F.col(key) - least) / fan).alias("g"))
    inside = Window.partitionBy("g").orderBy(F.col("k") if forward else -F.col("k")).rowsBetween(Window.unboundedPreceding, -1)
    told = rows.select("k", "g", F.last("v", ignorenulls=True).over(inside).alias("v"))
    groups = rows.groupBy("g").agg((F.max_by if forward else F.min_by)("v", F.when(F.col("v").isNotNull(), F.col("k"))).alias("u"))
    if groups.count() > 1:
        ahead = before_each(save(groups, "groups"), "g", "u", forward, fan)
        told = told.join(ahead, "g").withColumn("v", F.coalesce("v", "u"))
    return told.select(F.col("k").alias(key), F.col("v").alias(value))


def _sums_before(parts: DataFrame, fan: int) -> DataFrame:
    """(__b, __s): for each part the sum of __n of the parts before it, by a tree like that of before_each."""
    least = parts.agg(F.min("__b")).first()[0] or 0  # places may be negative
    rows = parts.withColumn("__g", F.floor((F.col("__b") - least) / fan))
    inside = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    told = rows.select("__b", "__g", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__s"))
    groups = rows.groupBy("__g").agg(F.sum("__n").alias("__n"))
    if groups.count() <= 1:
        return told.select("__b", "__s")
    ahead = _sums_before(save(groups.withColumnRenamed("__g", "__b"), "groups"), fan)
    return told.join(ahead.select(F.col("__b").alias("__g"), F.col("__s").alias("__a")), "__g").select("__b", (F.col("__s") + F.col("__a")).alias("__s"))


def renumbered(df: DataFrame, bucket: int = 100_000) -> DataFrame:
    """df with ROW made dense: 0, 1, ... in the order it had.

    Rows are counted and numbered in buckets of neighbouring places; the buckets'
    numbers are summed up as a tree.
    """
    rows = df.withColumn("__b", F.floor(F.col(ROW) / bucket))
    starts = _sums_before(save(rows.groupBy("__b").agg(F.count("*").alias("__n")), "sizes"), bucket)
    own = F.row_number().over(Window.partitionBy("__b").orderBy(ROW))
    out = rows.withColumn("__i", own).join(starts, "__b").withColumn(ROW, (F.col("__s") + F.col("__i") - 1).cast("long"))
    return out.select(df.columns)


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8-sig") -> DataFrame:
    """A CSV file as text: every column a string, the empty field null, with ROW.

    Headers that repeat get a number behind them, `Name`, `Name.1`. Records have the
    header's number of fields: further ones are left out, absent ones null. Tasks
    read ranges of the file, whether or not fields hold line ends, and the records
    are stored once; only a separator of several characters, or an encoding that
    isn't ASCII's in its quotes and line ends, is left to one task.
    """
    return read_csv_and_lines(spark, path, sep, encoding)[0]


def read_csv_and_lines(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8-sig") -> tuple[DataFrame, DataFrame]:
    """What read_csv returns, and (row, line): the line on which each record begins.

    Lines are counted from 1, quoted line ends and blank lines included. They are row
    + 2 where one task reads the file.
    """
    if not csvfiles.splittable(sep, encoding):
        return _read_whole(spark, path, sep, encoding)
    names = _distinct(csvfiles.header(spark, path, sep, encoding))
    rows = csvfiles.rows(spark, path, sep, encoding, len(names))
    place = F.col("place") - 1
    return rows.select(place.alias(ROW), *(F.col(f"c{i}").alias(n) for i, n in enumerate(names))), rows.select(place.alias("row"), "line")


def record_lines(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8-sig") -> DataFrame:
    return read_csv_and_lines(spark, path, sep, encoding)[1]


def _distinct(header: list[str]) -> list[str]:
    names: list[str] = []
    for name in header:
        k, new = 0, name
        while new in names:
            k += 1
            new = f"{name}.{k}"
        names.append(new)
    return names


def _read_whole(spark: SparkSession, path: str, sep: str, encoding: str) -> tuple[DataFrame, DataFrame]:
    read = lambda **more: spark.read.csv(path, sep=sep, multiLine=True, escape='"', encoding=encoding, **more)
    first = read(header=False).first()
    names = _distinct(["" if x is None else x for x in first or []])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = with_row_ids(read(schema=schema, header=True, enforceSchema=True))
    return df, df.select(F.col(ROW).alias("row"), (F.col(ROW) + 2).alias("line"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files with ROW: files by their paths, rows as they stand in them.

    Places come from the files' own row numbers, so nothing is stored and it doesn't
    matter how files are split among tasks.
    """
    files = spark.read.parquet(path)
    spot = F.col("_metadata.file_path").alias("__part"), F.col("_metadata.row_index").alias("__at")
    sizes = files.select(*spot).groupBy("__part").agg((F.max("__at") + 1).alias("n")).collect()
    starts = _starts(spark, {r["__part"]: r["n"] for r in sizes}, "string")
    placed = _placed(files.select("*", *spot), starts, F.col("__at"))
    return placed.select(ROW, *(F.col(f"`{c}`") for c in files.columns))


def ordered_rows(df: DataFrame, order: str = ROW) -> Iterator[dict[str, Any]]:
    """The rows in order, without the order column, a partition at a time."""
    for row in df.orderBy(order).toLocalIterator():
        out = row.asDict()
        out.pop(order, None)
        yield out


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file in row order; booleans as True and False, nulls empty."""
    csvfiles.write_ordered(df if ROW in df.columns else with_row_ids(df), [ROW], path)


def write_json(value: Any, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False, default=str)


def write_review(reviews: list[DataFrame], path: str, lines: DataFrame | None = None) -> int:
    """Duplicate pairs of all reviews in long form, a `duplicate` and a `kept` line for each; returns their number.

    A review has row, kept_row, match, score, and the structs `values` and
    `kept_values`. Columns are those of all reviews, in the order they first occur.
    lines (row, line) tells where records stand in their file; without it, row + 2.
    """
    kinds = [{f.name: f.dataType.simpleString() for f in r.schema["values"].dataType.fields} for r in reviews]
    columns = list(dict.fromkeys(c for k in kinds for c in k))
    if not reviews:
        return _write_lines(path, ["pair", "role", "row", "line", "match", "score"])
    texts = lambda struct, kind: F.array(*(as_text(F.col(struct)[c], kind[c]) if c in kind else F.lit(None).cast("string") for c in columns)).cast("array<string>")
    pairs = None
    for i, (r, kind) in enumerate(zip(reviews, kinds)):
        both = F.array(*(F.struct(F.lit(role).alias("role"), F.col(row).alias("row"), texts(values, kind).alias("texts")) for role, row, values in (("duplicate", "row", "values"), ("kept", "kept_row", "kept_values"))))
        one = r.select(F.lit(i).alias("review"), "row", both.alias("both"), "match", "score")
        pairs = one if pairs is None else pairs.union(one)
    pairs = with_row_ids(pairs.orderBy("review", "row"))
    long = pairs.select((F.col(ROW) + 1).alias("pair"), F.posexplode("both").alias("at", "x"), "match", "score")
    long = long.select("pair", "at", F.col("x.role").alias("role"), F.col("x.row").alias("row"), "match", "score", *(F.col("x.texts")[i].alias(f"v{i}") for i in range(len(columns))))
    long = long.join(lines, "row", "left") if lines is not None else long.withColumn("line", F.lit(None).cast("long"))
    values = [F.col(f"v{i}").alias(f"value {i}") for i in range(len(columns))]
    out = long.select("at", "pair", "role", "row", F.coalesce("line", F.col("row") + 2).alias("line"), "match", "score", *values)
    csvfiles.write_ordered(out, ["pair", "at"], path, out.columns[1:], ["pair", "role", "row", "line", "match", "score", *columns])
    return pairs.count()


def _write_lines(path: str, header: list[str]) -> int:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerow(header)
    return 0
