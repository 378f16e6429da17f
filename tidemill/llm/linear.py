"""Hashed byte n-grams of whole texts, and linear models over them.

Models are small and are fitted on the driver, from a bounded sample of rows; a
sample is the same whatever the partitioning, as its rows are those with the
least hash of their id and text. Rows that are the same in both count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.storage import small_batches

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def gram_counts(data: np.ndarray, orders: tuple[int, ...], bits: int, at_once: int = 1 << 20) -> np.ndarray:
    """Counts by bucket (2**bits of them) of the n-grams of the given orders in data (uint8)."""
    out = np.zeros(1 << bits, np.int64)
    for start in range(0, len(data), at_once):
        part = data[start : start + at_once + max(orders) - 1].astype(np.uint32) + np.uint32(1)
        for order in orders:
            n = min(len(part) - order + 1, at_once)
            if n <= 0:
                continue
            h = np.full(n, order, np.uint32)
            for j in range(order):
                h += part[j : j + n] * _MULTIPLIERS[j]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
            out += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def damped(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length 1 (or all zero)."""
    x = np.sqrt(counts.astype(np.float32))
    n = float(np.sqrt(x @ x))
    return x / n if n else x


def text_key(text: str = "text") -> Column:
    """What tells rows with the same id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def bounded_sample(rows: DataFrame, by: str, most: int, total: int | None = None) -> DataFrame:
    """At most `most` rows (doc_id, key, by) of each value of `by` (or its share of `total`): those with the least hash of doc_id and key.

    The values are classes of a model, few by nature. Rows far from the least
    hashes are put aside before any class is sorted, and repeated rows are
    collapsed by each task first, so a class with a third of all rows sends no
    more to its task than a small one, and neither does an id with a third.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if not sizes:
        return rows.limit(0)
    if total is not None:
        most = max(1, total // len(sizes))
    enough = most + 10 * int(most**0.5) + 100
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, enough / n)))), F.col(by))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 11) / F.lit(float(1 << 53))
    w = Window.partitionBy(by).orderBy("place", "doc_id", "key")
    near = rows.select("doc_id", "key", by).withColumn("place", place).filter(F.col("place") <= share).distinct()
    return near.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).drop("place", "nth")


def sample_matrix(docs: DataFrame, sample: DataFrame, label: str, features: Callable[[str], np.ndarray], width: int) -> tuple[np.ndarray, list]:
    """Features of the sample's documents, and the labels.

    sample (doc_id, key, label) is bounded by its maker and has a row for each id
    and key at most, so no more rows come back however often docs repeats one;
    texts stay on the executors, and only the non-zero features come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for t in batch.column(2).to_pylist():
                x = features(t or "")
                nz = np.flatnonzero(x)
                at.append(nz.astype(np.uint16 if width <= 1 << 16 else np.uint32).tobytes())
                values.append(x[nz].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "label", "at", "values"])

    small_batches(docs.sparkSession)
    kind = dict(sample.dtypes)[label]
    rows = docs.select("doc_id", text_key().alias("key"), "text").join(F.broadcast(sample.select("doc_id", "key", F.col(label).alias("label"))), ["doc_id", "key"])
    rows = rows.groupBy("doc_id", "key", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text")
    found = rows.mapInArrow(run, f"doc_id long, label {kind}, at binary, values binary").collect()
    found.sort(key=lambda r: (r.doc_id, r["at"]))
    x = np.zeros((len(found), width), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], np.uint16 if width <= 1 << 16 else np.uint32)] = np.frombuffer(r["values"], np.float16)
    return x, [r.label for r in found]


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights, the last of them the bias, of a linear support vector machine (hinge loss).

    Dual coordinate ascent; y is 1 or -1. Classes count alike, however many rows
    they have.
    """
    rng = np.random.default_rng(0)
    w, bias, alpha = np.zeros(x.shape[1], np.float64), 0.0, np.zeros(len(y))
    norm = (x * x).sum(axis=1, dtype=np.float64) + 1
    upper = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y < 0).sum()))
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                bias += step
                alpha[i] = new
    return np.append(w, bias)


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1e-4, rounds: int = 150, rate: float = 4.0) -> np.ndarray:
    """Weights, the last of them the bias, of a logistic scorer for soft labels p; both classes count alike."""
    share = np.where(p >= 0.5, 0.5 / max(1, (p >= 0.5).sum()), 0.5 / max(1, (p < 0.5).sum())).astype(np.float32)
    w, v, bias, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for _ in range(rounds):
        look, look_b = w + 0.9 * v, bias + 0.9 * vb
        e = share * (1 / (1 + np.exp(-np.clip(x @ look + look_b, -30, 30))) - p)
        v = 0.9 * v - rate * (e @ x + ridge * look)
        vb = 0.9 * vb - rate * float(e.sum())
        w, bias = w + v, bias + vb
    return np.append(w, bias).astype(np.float64)
