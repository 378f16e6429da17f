import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemill.llm import topk
from tidemill.llm.topk import op1_exact_topk, quantised, top_k

from .conftest import SF


def brute(rows, k):
    out = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-int(np.dot(v, w)), c) for c, w in rows if c != q)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    exact = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(np.int64)) for r in rows]
    assert sorted(map(tuple, op1_exact_topk(spark, SF).collect())) == brute(exact, 5)


@pytest.mark.parametrize("blocks", [(1, 2), (1000, 1000)])
def test_sparse_ties_and_odd_rows(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(0, 120)]
    odd = [(200, None), (250, [1.0, None]), (300, [math.nan]), (350, [math.inf, 1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS id")
    q = quantised(df, "vec_id", "embedding", 1.0)
    found = top_k(q.filter("id % 50 = 0"), q, 4, *blocks)
    assert sorted(map(tuple, found.collect())) == brute([(i, np.array(v, int)) for i, v in rows], 4)


def test_empty_and_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = quantised(empty, "vec_id", "embedding")
    assert top_k(q, q).collect() == []
    two = quantised(spark.createDataFrame([(0, [1.0]), (1, [0.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert [tuple(r) for r in top_k(two.filter("id = 0"), two).collect()] == [(0, 1, 1, 0)]


def test_repeated_ids_and_groups_of_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(0, 3000)]
    q = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1.0)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "SLOT", 2)
    assert sorted(map(tuple, top_k(q.filter("id % 50 = 0"), q, 3, 7, 100).collect())) == brute([(i, np.array(v, int)) for i, v in rows], 3)
    twice = spark.createDataFrame([(0, [2.0, 1.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for order in (F.asc("embedding"), F.desc("embedding")):
        v = quantised(twice.coalesce(1).orderBy(order), "vec_id", "embedding", 1.0)
        assert [tuple(r) for r in top_k(v.filter("id = 0"), v, 5).orderBy("rank").collect()] == [(0, 1, 2, 5), (0, 2, 2, 5), (0, 3, 1, 1)]
