"""Exact top-k search by inner product over sparse integer vectors.

Exhaustive term-at-a-time accumulation. Query rows and candidate rows are packed
into blocks. A task has a group of query blocks and a slot of the candidate
blocks: it holds its query blocks and reads the candidate blocks one by one, so
candidates are sent once for each group of GROUP query blocks, queries once for
each slot, and no pair of blocks is ever a row. In a candidate block the non-zero
entries are turned into postings by term; each query scatters its weighted
postings into a dense score array, a partition selection takes the best k, and a
window merges the tasks' lists. Nothing is collected and nothing is broadcast:
memory of a task is its query blocks, one candidate block and k rows for each
query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_PACKED = "part int, ids binary, ends binary, terms binary, weights binary"
#: Query blocks in a task, and candidate blocks in a slot.
GROUP, SLOT = 32, 64


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, terms, weights): the non-zero floor(scale * x) of each vector.

    Rows whose id or vector is null, or whose vector holds a null or a
    non-finite component, are left out. An empty vector stays, without terms.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(math.inf)), F.lit(False)))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    entries = F.filter(
        F.transform(x, lambda v, i: F.struct(i.cast("int").alias("term"), F.floor(v * F.lit(scale)).cast("long").alias("weight"))),
        lambda e: e["weight"] != 0,
    )
    rows = rows.select(F.col(id_col).cast("long").alias("id"), entries.alias("entries"))
    return rows.select("id", F.col("entries.term").alias("terms"), F.col("entries.weight").alias("weights"))


def _pack(size: int):
    """Packs the rows of a partition, `size` to a block, sorted by id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def block(table: pa.Table, part: int) -> pa.RecordBatch:
            table = table.sort_by("id").combine_chunks()
            terms, weights = (table[c].combine_chunks() for c in ("terms", "weights"))
            ends = np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            values = [
                table["id"].to_numpy().astype(np.int64).tobytes(),
                ends.tobytes(),
                terms.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes(),
                weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["part", "ids", "ends", "terms", "weights"])

        n = part = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            while n >= size:
                table = pa.concat_tables(held)
                yield block(table.slice(0, size), part)
                part += 1
                held, n = [table.slice(size)], n - size
        if n:
            yield block(pa.concat_tables(held), part)

    return pack


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores; of equal ones those with smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        scores, ids = scores[at], ids[at]
    at = np.lexsort((ids, -scores))[:k]
    return scores[at], ids[at]


_ARRAYS = (("ids", np.int64), ("ends", np.int64), ("terms", np.int32), ("weights", np.int64))


def _postings(ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[dict, set]:
    """Places and weights of a block's rows by term, and the terms that all of them have."""
    order = np.argsort(terms, kind="stable")
    docs = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))[order]
    weights = weights[order]
    names, first = np.unique(terms[order], return_index=True)
    bounds = np.append(first, len(terms))
    postings = {int(t): (docs[a:b], weights[a:b]) for t, a, b in zip(names, bounds[:-1], bounds[1:])}
    return postings, {t for t, (d, _) in postings.items() if len(d) == len(ids)}


def _scored(k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[list[np.ndarray]] = []
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at = None

        def done():
            n = [len(s) for s, _ in best.values()]
            values = [np.repeat(np.fromiter(best, np.int64), n), *(np.concatenate([x[i] for x in best.values()]).astype(np.int64) for i in (1, 0))]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():  # blocks: query blocks of a cell ahead of its candidate blocks
                arrays = [np.frombuffer(row[c], t) for c, t in _ARRAYS]
                if (row["q_group"], row["slot"]) != at:
                    if best:
                        yield done()
                    at, queries, best = (row["q_group"], row["slot"]), [], {}
                if not row["side"]:
                    queries.append(arrays)
                    continue
                ids = arrays[0]
                postings, full = _postings(*arrays)
                for q_ids, q_ends, q_terms, q_weights in queries:
                    start = 0
                    for q, end in zip(q_ids.tolist(), q_ends.tolist()):
                        scores = np.zeros(len(ids), np.int64)
                        for t, w in zip(q_terms[start:end].tolist(), q_weights[start:end].tolist()):
                            if t in full:
                                scores += w * postings[t][1]
                            elif t in postings:
                                d, x = postings[t]
                                scores[d] += w * x
                        start = end
                        other = ids != q
                        found = _best(scores[other], ids[other], k)
                        if q in best:
                            found = _best(*(np.concatenate(x) for x in zip(best[q], found)), k)
                        best[q] = found
        if best:
            yield done()

    return score


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 1024, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates.

    Both inputs have id (long), terms (array<int>, no term twice) and weights
    (array<long>); see `quantised`. A candidate with the query's own id is not a
    candidate for it. Ties go to the smaller id; with fewer than k candidates all
    are returned; with none, or with no query, the result is empty. Ids are keys:
    of query rows that repeat an id the one with the least terms, then weights,
    is used; candidates that repeat an id each keep a place.
    """
    spark = queries.sparkSession
    groups = max(1, math.ceil(queries.count() / (query_block * GROUP)))
    tasks = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = max(math.ceil(tasks / groups), math.ceil(candidates.count() / (candidate_block * SLOT)), 1)
    once = queries.groupBy("id").agg(F.min(F.struct("terms", "weights")).alias("v")).select("id", "v.terms", "v.weights")
    columns = ["q_group", "slot", "side", "ids", "ends", "terms", "weights"]
    of = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = once.repartition(groups, "id").mapInArrow(_pack(query_block), _PACKED).select("*", of(groups).alias("q_group"), F.lit(0).alias("side")).withColumn("slot", every(slots))
    right = candidates.mapInArrow(_pack(candidate_block), _PACKED).select("*", of(slots).alias("slot"), F.lit(1).alias("side")).withColumn("q_group", every(groups))
    cells = left.select(*columns).union(right.select(*columns)).repartition(groups * slots, "q_group", "slot").sortWithinPartitions("q_group", "slot", "side")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    lists = cells.mapInArrow(_scored(k), out)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return lists.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(rows.filter(F.col("id") % 50 == 0), rows, k=5)


QUERIES = {"op1_exact_topk": op1_exact_topk}
ORACLES = {
    "op1_exact_topk": """
WITH good AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS t FROM good),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM e q JOIN e c ON q.t = c.t AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
