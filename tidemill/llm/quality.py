"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns (of all documents)
estimates each labeller's accuracy for either class and the classes' shares; a
pattern's posterior is the weak label. Posterior labels train a logistic scorer
on hashed features, which scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.linear import bounded_sample, damped, gram_counts, logistic, sample_matrix, text_key
from tidemill.llm.storage import rows_where, save, small_batches

BAD, GOOD, NONE = 0, 1, 2
SYMBOLS = b"#*$%&|<>"
#: Kinds of bytes: lower case and what isn't ASCII, upper case, digits, symbols, marks, line ends, other space.
_KIND = np.array([1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in SYMBOLS else 5 if b == 10 else 6 if b in b" \t\r\x0b\x0c" else 7 for b in range(256)], np.uint8)
BITS = 12
#: Documents whose score is below are rejected; clean ones rarely fall under 0.4, flawed ones rarely rise over 0.2.
KEEP = 0.3
WIDTH = (1 << BITS) + (1 << BITS) + 2

#: Labellers that vote bad above a value, or nothing. The second value bounds what counts as clean, the third is the least number of words.
FLAWS = {
    "symbols": (0.2, 0.05, 5),
    "capitals": (0.4, 0.15, 5),
    "exclamations": (0.3, 0.1, 5),
    "adjacent_repeats": (0.2, 0.05, 5),
    "repeated_lines": (0.5, 0.45, 20),
    "few_words_again_and_again": (0.65, 0.6, 30),
    "lines_without_end": (0.6, 0.55, 20),
}
#: Those that vote good: no value above its bound for clean; sentences of usual lengths.
MERITS = ("clean", "sentences")
LABELLERS = (*FLAWS, *MERITS)


def statistics(text: str) -> tuple[int, list[float]]:
    """Number of words, and a value for each labeller (the higher, the worse)."""
    data = text.encode()
    words = data.split()
    n = max(1, len(words))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8)
    lines = [x for x in map(bytes.rstrip, data.split(b"\n")) if x]
    return len(words), [
        kinds[4] / n,
        kinds[2] / max(1, kinds[1] + kinds[2]),
        data.count(b"!!") / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len({*lines}) / max(1, len(lines)),
        1 - len({*words}) / n,
        1 - sum(x[-1:] in b".!?:" for x in lines) / max(1, len(lines)),
    ]


def votes(text: str | None) -> int:
    """The labellers' votes as one number in base 3; a null text has no votes."""
    text = text or ""
    n, values = statistics(text)
    code, clean = 0, n > 0
    for value, (bad, good, least) in zip(values, FLAWS.values()):
        code = 3 * code + (BAD if n >= least and value > bad else NONE)
        clean &= value <= good or n < least
    ends = text.count(". ") + text.count(".\n") + text.count("! ") + text.count("? ") + 1
    usual = n >= 20 and 3 <= n / ends <= 60
    return (3 * code + (GOOD if clean else NONE)) * 3 + (GOOD if usual else NONE)


def _unpacked(codes: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return np.stack([codes // 3 ** (k - 1 - j) % 3 for j in range(k)], axis=1)


class LabelModel:
    """Class shares and the labellers' vote probabilities, by expectation-maximisation."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 200):
        v = _unpacked(codes)
        bad, good = (v == BAD).sum(axis=1), (v == GOOD).sum(axis=1)
        p = np.clip((good + 0.5) / (bad + good + 1.0), 0.05, 0.95)
        for _ in range(rounds):
            self.share = float(np.clip((counts @ p + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
            self.table = np.empty((v.shape[1], 2, 3))
            for y, q in ((BAD, counts * (1 - p)), (GOOD, counts * p)):
                for j in range(v.shape[1]):
                    seen = np.bincount(v[:, j], weights=q, minlength=3) + 0.5
                    self.table[j, y] = seen / seen.sum()
            new = self.posterior(codes)
            if np.abs(new - p).max(initial=0) < 1e-9:
                break
            p = new

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        v = _unpacked(codes)
        log = np.log([[1 - self.share, self.share]]).repeat(len(v), axis=0)
        for j in range(v.shape[1]):
            log += np.log(self.table[j][:, v[:, j]].T)
        return 1 / (1 + np.exp(np.clip(log[:, BAD] - log[:, GOOD], -700, 700)))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller: how often its votes are right."""
        prior = np.array([1 - self.share, self.share])
        return {name: float((prior * t[[0, 1], [0, 1]]).sum() / (prior[:, None] * t[:, :2]).sum()) for name, t in zip(LABELLERS, self.table)}


def features(text: str) -> np.ndarray:
    """Hashed n-grams of bytes and of kinds of bytes, how often a word follows itself, and shortness."""
    data = text.lower().encode()
    words = data.split()
    kinds = _KIND[np.frombuffer(text.encode(), np.uint8)]
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))
    grams = damped(gram_counts(np.frombuffer(data, np.uint8), (3,), BITS))
    shapes = damped(gram_counts(kinds, (1, 2, 3, 4), BITS))
    return np.concatenate([grams, shapes, np.array([np.sqrt(again), np.exp(-len(words) / 10)], np.float32)])


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([votes(t) for t in batch.column(1).to_pylist()], pa.int32())], ["doc_id", "key", "code"])


def _score(weights: np.ndarray | None, posterior: dict[int, float], text: str | None) -> float:
    if weights is None:
        return posterior[votes(text)]
    return float(1 / (1 + np.exp(-np.clip(weights[:-1] @ features(text or "") + weights[-1], -30, 30))))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            weak, score = [posterior[votes(t)] for t in texts], [_score(weights, posterior, t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "weak_label", "score"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, most: int = 1500) -> tuple[np.ndarray | None, dict[int, float]]:
    """The scorer's weights (none where one class has no document) and the posterior of each vote pattern.

    The scorer learns from at most `most` documents of either posterior class;
    votes and their statistics are over all documents.
    """
    rows = _texts(docs)
    small_batches(docs.sparkSession)
    cast = save(rows.withColumn("key", text_key()).mapInArrow(_voted, "doc_id long, key long, code int"), "votes")
    patterns = cast.groupBy("code").count().toPandas().sort_values("code")  # at most 3 ** labellers rows
    codes, counts = patterns["code"].to_numpy(np.int64), patterns["count"].to_numpy(np.float64)
    posterior = dict(zip(codes.tolist(), LabelModel(codes, counts).posterior(codes).tolist()))
    good = [c for c, p in posterior.items() if p >= 0.5]
    if not 0 < len(good) < len(posterior):
        return None, posterior
    sides = cast.filter("doc_id is not null").withColumn("good", F.col("code").isin(good))
    sample = bounded_sample(sides, "good", most)
    codes_of = cast.select("doc_id", "key", "code").join(F.broadcast(sample), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.min("code").alias("code"))
    x, code = sample_matrix(rows, codes_of, "code", features, WIDTH)
    p = np.array([posterior[c] for c in code], np.float32)
    some = len(p) and 0 < (p >= 0.5).sum() < len(p)
    return (logistic(x, p).astype(np.float32) if some else None), posterior


def score_quality(docs: DataFrame, most: int = 1500) -> DataFrame:
    """doc_id, weak_label (posterior that it is good), score (the trained scorer's) of every document.

    Where one class has no document there is nothing to separate, and score is the
    posterior. A null text counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, most))
    return _texts(docs).mapInArrow(_scored(shared), "doc_id long, weak_label double, score double")


def good_documents(docs: DataFrame, least: float = KEEP, most: int = 1500) -> DataFrame:
    """The rows of docs with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, most))
    return rows_where(docs, "text", lambda texts: [_score(*shared.value, t) >= least for t in texts])


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.withColumn("keep", F.col("score") >= KEEP)


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}
