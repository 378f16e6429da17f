import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidemill.llm import resample

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, order):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(f.encode()) % 10_000 for f in runs)


def brute(docs, target, order, percent=10, least=20):
    told = [(d, *features(t, order)) for d, t in docs]
    s, t = Counter(), Counter()
    for *_, c in told:
        s.update(c)
    for text in target:
        t.update(features(text, order)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for doc_id, n_words, c in told:
        n = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n_words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able):
        r.append(i + 1 if i < percent * len(able) // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("order", [1, 3])
def test_equals_brute_force(spark, odd_docs, order):
    extra = [(100 + i, " ".join(f"w{(i * j) % 17}" for j in range(15 + i))) for i in range(30)] + [(130, "w1 w2 " * 20)] * 3
    docs = odd_docs.select("doc_id", "text", "score").union(spark.createDataFrame([(*x, "") for x in extra], "doc_id long, text string, score string"))
    target = spark.createDataFrame([(1, "W1 w2 é", 1), (1, None, 2), (None, "the same text", 3)], "item_id long, text string, doc_id int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, ["W1 w2 é", None, "the same text"], order)
    assert got(resample.draw(docs, target, order=order)) == want
    assert [r[1] for r in want if r[5]] and [r for r in want if r[3] < 0]


def test_pieces_of_a_text_hold_each_run_once(spark):
    text = " ".join(f"w{i % 7}x{'y' * (i % 11)}" for i in range(500)) + " " + "z" * 300 + " end"
    df = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    for piece in (1, 40, 10_000):
        rows = {r.doc_id: r for r in resample.bucket_counts(df, "doc_id", 3, piece=piece).collect()}
        n, c = features(text, 3)
        assert (rows[1].n_words, rows[1].n_features) == (n, sum(c.values()))
        assert dict(zip(rows[1].buckets, rows[1].counts)) == c and rows[2].n_features == 3


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.draw(no_docs, none).count() == 0
    few = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert got(resample.draw(few, none)) == brute([(1, "a b")] * 2, [], 1)


def test_query_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, n_features, weight, score, rank FROM ({resample.ORACLES['op11_importance_resampling']})").fetchall()
    rows = got(resample.op11_importance_resampling(spark, SF))
    assert rows == sorted(want, key=repr)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows == brute(docs, target, 1)
