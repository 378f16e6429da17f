"""Row places of frames that aren't files, and of files however they are split."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators.cleaner import Cleaner
from tidemill.sources.tables import ROW, before_each, read_csv, read_csv_and_lines, read_parquet, renumbered, with_row_ids, write_csv, write_review


def whole(df, n):
    got = df.agg(F.count("*"), F.min(ROW), F.max(ROW), F.count_distinct(ROW)).first()
    assert tuple(got) == (n, 0, n - 1, n)


def test_places_of_an_aggregate_a_join_and_a_sort(spark):
    numbers = spark.range(200_000).withColumn("k", F.xxhash64("id"))
    groups = numbers.groupBy("k").agg(F.max("id").alias("m"), F.lit("x").alias("text"))
    whole(with_row_ids(groups), 200_000)
    whole(with_row_ids(groups.join(numbers.groupBy("k").agg(F.min("id").alias("l")), "k")), 200_000)
    ordered = with_row_ids(numbers.orderBy(F.desc("k")))
    whole(ordered, 200_000)
    assert ordered.select(F.corr(ROW, "k")).first()[0] < -0.99
    c = Cleaner(groups).handle_missing("drop_rows")
    assert c.df.count() == 200_000


def test_places_of_files_do_not_depend_on_their_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50_000).repartition(5).sortWithinPartitions("id").write.parquet(path)
    before = read_parquet(spark, path)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    want = before.orderBy(ROW).toPandas()
    try:
        spark.conf.set(key, "20000")
        got = read_parquet(spark, path).orderBy(ROW).toPandas()
        assert before.count() == 50_000
    finally:
        spark.conf.set(key, old)
    assert got.equals(want) and want[ROW].tolist() == [*range(50_000)]


def test_places_with_odd_columns(spark):
    df = spark.sql("SELECT NULL AS a, 1 AS `a b.c`, 2 AS A UNION ALL SELECT NULL, 3, 4")
    out = with_row_ids(df)
    assert out.columns == [ROW, "a", "a b.c", "A"]
    whole(out, 2)
    assert with_row_ids(df.limit(0)).count() == 0


SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def split(spark):
    """Sets the bytes of a task's range of a file."""
    old = spark.conf.get(SPLIT)
    yield lambda size: spark.conf.set(SPLIT, str(size))
    spark.conf.set(SPLIT, old)


def as_python_reads(path, sep, encoding):
    with open(path, newline="", encoding=encoding) as f:
        reader, begin, lines, rows = csv.reader(f, delimiter=sep), 1, [], []
        for record in reader:
            if record:
                lines.append(begin)
                rows.append(record)
            begin = reader.line_num + 1
    names, width = rows[0], len(rows[0])
    return names, [([x or None for x in r[:width]] + [None] * (width - len(r)), n) for r, n in zip(rows[1:], lines[1:])]


def as_read(spark, path, sep=",", encoding="utf-8-sig"):
    df, lines = read_csv_and_lines(spark, str(path), sep, encoding)
    at = {r.row: r.line for r in lines.collect()}
    rows = sorted(df.collect(), key=lambda r: r[0])
    assert [r[0] for r in rows] == [*range(len(rows))]
    return df.columns[1:], [(list(r[1:]), at[r[0]]) for r in rows]


FIELDS = ["", "a", "b c", '"q"', '"two\nlines"', '"doubled ""quotes"""', '"sep, inside"', 'stray " quote', '"closed" then', '"cr\r\nlf"', '"alone\rcr"', "é", '""', '"\n\n"', " ", 'x"', '"""', "'"]


@pytest.mark.parametrize("seed, end, size", [(1, "\n", 170), (2, "\r\n", 400), (3, "\n", 90)])
def test_csv_by_ranges_as_python_reads_it(spark, split, tmp_path, seed, end, size):
    rng = random.Random(seed)
    lines = ['id,"na\nme",x,x']
    for i in range(120):
        fields = [str(i), *(rng.choice(FIELDS[:-2]) for _ in range(rng.choice([3, 3, 3, 1, 5])))]
        lines.append(",".join(fields) if rng.random() > 0.1 else "")
    path = tmp_path / "odd.csv"
    path.write_bytes(b"\xef\xbb\xbf" * (seed % 2) + (end.join(lines) + end * (seed % 2)).encode())
    want_names, want = as_python_reads(path, ",", "utf-8-sig")
    split(size)
    names, got = as_read(spark, path)
    assert names == [*want_names[:3], "x.1"]
    assert got == want


def test_csv_with_other_ends_and_encodings(spark, split, tmp_path):
    split(20)
    for i, (text, sep, encoding) in enumerate([
        ('a;b\r1;"x\ry"\r\r2;z\r', ";", "utf-8"),
        ("a,b\n1,\xe9t\xe9\n2,\"\xfc\n\"\n", ",", "latin-1"),
        ('a,b\n1,"never closed\n2,x\n3,y\n', ",", "utf-8"),
        ("a,b\n", ",", "utf-8"),
    ]):
        path = tmp_path / f"{i}.csv"
        path.write_bytes(text.encode(encoding))
        assert as_read(spark, path, sep, encoding) == as_python_reads(path, sep, encoding)
    (tmp_path / "none.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "bad.csv").write_bytes(b"a\n\xff\n")
    with pytest.raises(UnicodeError):
        read_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "wide.csv").write_bytes("a||b\n1||2\n".encode("utf-16"))
    assert read_csv(spark, str(tmp_path / "wide.csv"), "||", "utf-16").drop(ROW).collect() == [("1", "2")]


def test_csv_goes_back_as_it_was(spark, split, tmp_path):
    rng = random.Random(9)
    rows = [[str(i), rng.choice(["", "a,b", 'say "x"', "two\nlines", "é", "'", "\r"]), str(rng.random())] for i in range(5_000)]
    path, again = tmp_path / "in.csv", tmp_path / "sub" / "out.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "te\nxt", "n"], *rows])
    split(10_000)
    df = read_csv(spark, str(path))
    assert df.rdd.getNumPartitions() > 4
    write_csv(df.repartition(7), str(again))
    assert again.read_bytes() == path.read_bytes()
    typed = spark.sql("SELECT 1 AS a, true AS b, 2.0D AS c, NULL AS d, DATE'2020-01-02' AS e, TIMESTAMP'2020-01-02 03:04:05' AS f")
    write_csv(typed, str(again))
    assert again.read_text() == "a,b,c,d,e,f\n1,True,2.0,,2020-01-02,2020-01-02 03:04:05\n"
    write_csv(typed.limit(0), str(again))
    assert again.read_text() == "a,b,c,d,e,f\n"


def test_review_file(spark, tmp_path):
    one = spark.sql("SELECT 4L AS row, 1L AS kept_row, 'fuzzy' AS match, 0.9D AS score, struct('a' AS x, 2.0D AS y) AS values, struct('b' AS x, NULL AS y) AS kept_values")
    two = spark.sql("SELECT 3L AS row, 0L AS kept_row, 'exact' AS match, 1.0D AS score, struct(true AS z) AS values, struct(true AS z) AS kept_values")
    lines = spark.createDataFrame([(0, 2), (1, 5), (3, 9), (4, 10)], "row long, line long")
    path = tmp_path / "review.csv"
    assert write_review([one, two], str(path), lines) == 2
    assert path.read_text() == "pair,role,row,line,match,score,x,y,z\n1,duplicate,4,10,fuzzy,0.9,a,2.0,\n1,kept,1,5,fuzzy,0.9,b,,\n2,duplicate,3,9,exact,1.0,,,True\n2,kept,0,2,exact,1.0,,,True\n"
    assert write_review([], str(path)) == 0


def test_prefix_results_as_trees(spark):
    rng = random.Random(4)
    parts = [(k, rng.choice([None, None, f"v{k}"])) for k in sorted(rng.sample(range(400), 150))]
    df = spark.createDataFrame(parts, "k long, v string")
    for forward in (True, False):
        want, last = {}, None
        for k, v in parts if forward else parts[::-1]:
            want[k] = last
            last = v or last
        assert dict(before_each(df, "k", "v", forward, 3).collect()) == want
    places = spark.createDataFrame([(k * 7,) for k, _ in parts], f"`{ROW}` long").repartition(3)
    assert sorted(r[0] for r in renumbered(places, 5).collect()) == [*range(150)]
    assert renumbered(places.limit(0), 5).count() == 0
    turned = {r[0]: r[1] for r in renumbered(places.select((-F.col(ROW)).alias(ROW), F.col(ROW).alias("old")), 5).select("old", ROW).collect()}
    assert turned == {7 * k: i for i, (k, _) in enumerate(reversed(parts))}
    below = df.select((F.col("k") - 200).alias("k"), "v")
    assert {r.k + 200: r.v for r in before_each(below, "k", "v", False, 3).collect()} == want
