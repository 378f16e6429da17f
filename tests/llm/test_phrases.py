import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import phrases

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIELDS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=10, reach=20):
    told = [(d, words(t)) for d, t in docs]
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    count = {}
    for _, w in told:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = []
    for doc_id, w in told:
        hit, found, near = set(), set(), set()
        for win, names in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= names
            rarest = min(range(len(win)), key=lambda k: (count.get(win[k], 0), k))
            for i, x in enumerate(w):
                if x == win[rarest] and {*win} <= {*w[max(0, i - reach) : i + reach + 1]}:
                    near |= names
        spans = []
        for x in sorted(hit):
            if spans and spans[-1][1] == x:
                spans[-1][1] = x + 1
            else:
                spans.append([x, x + 1])
        out.append((doc_id, len(w), sorted(found), sorted(near), spans))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, list(r["items"]), list(r["near"]), [[s.a, s.b] for s in r.spans]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def some(spark, odd_docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)] + ["É", "naïve", "x1"]
    docs = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(200, docs[5][1].upper().replace(" ", "--\n")), (200, docs[5][1].upper().replace(" ", "--\n")), (None, docs[7][1])]
    items = [(i, " ".join(docs[i][1].split()[3 : 3 + rng.randint(2, 25)])) for i in range(0, 20, 2)]
    items += [(50, "w1 W2"), (51, None), (52, " .. "), (None, "the same text of six"), (10, "w5 w5 w5"), (53, "never seen words at all"), (54, "x " * 4)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, items string")
    both = odd_docs.select("doc_id", "text", F.lit("").alias("items")).union(frame)
    return both, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"), items


def test_equals_brute_force_over_segments_and_blocks(some):
    docs, table, items = some
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, items)
    assert got(phrases.search(phrases.index(docs), table)) == want
    small = phrases.index(docs, size=300)
    assert small.select("segment").distinct().count() > 10
    assert got(phrases.search(small, table, size=100)) == want
    assert got(phrases.search(small, table, window=3, reach=5)) == brute(rows, items, 3, 5)
    assert any(spans and len(spans) > 1 for *_, spans in want) and any(len(n) > len(i) for _, _, i, n, _ in want)


def test_index_holds_every_token(some):
    docs, *_ = some
    rows = phrases.index(docs, size=2000).filter("term IS NOT NULL").agg(F.sum("n"), F.sum(F.octet_length("places"))).first()
    n = sum(len(words(r.text)) for r in docs.collect())
    assert tuple(rows) == (n, 4 * n)


def test_empty_tables(spark, some, no_docs):
    docs, table, _ = some
    assert phrases.search(phrases.index(no_docs), table).count() == 0
    none = phrases.search(phrases.index(docs), table.limit(0)).agg(F.count("*"), F.sum(F.size("items"))).first()
    assert tuple(none) == (docs.count(), 0)
    with pytest.raises(ValueError):
        phrases.search(phrases.index(docs), table, window=30)


def test_query_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(FIELDS)} FROM ({phrases.ORACLES['op13_benchmark_decontamination']})").fetchall()
    rows = sorted((tuple(r) for r in phrases.op13_benchmark_decontamination(spark, SF).select(FIELDS).collect()), key=repr)
    assert rows == sorted(want, key=repr)
    assert sum(r[5] for r in rows) > 0
    assert {r[4] for r in rows if not r[5]} == {hashlib.sha256(b"").hexdigest()}
