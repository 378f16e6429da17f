"""Language identification by hierarchical discrimination.

A first level of linear support vector machines, one for each language family
against the rest, picks the family; within it, one-versus-one machines separate
the closely related languages by their votes. Features are hashed byte n-grams of
the whole lower-cased text, all that is no letter taken as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.linear import bounded_sample, damped, gram_counts, linear_svm, sample_matrix, text_key
from tidemill.llm.storage import rows_where, small_batches

#: Families of ISO 639-1 codes; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "ur", "pa", "gu", "mr", "ne", "si"),
    "iranian": ("fa", "ps", "ku", "tg"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS, ORDERS = 13, (1, 2, 3, 4)
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    data = _LETTERS[np.frombuffer(text.lower().encode(), np.uint8)]
    return damped(gram_counts(data, ORDERS, BITS))


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


@dataclass
class Model:
    """Languages by family, a weight row for each family, and one for each pair within it."""

    families: dict[str, list[str]] = field(default_factory=dict)
    first: np.ndarray | None = None
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    second: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        names, of = np.array(langs), np.array([family(x) for x in langs])
        out = cls({f: sorted({*names[of == f].tolist()}) for f in sorted({*of.tolist()})})
        if len(out.families) > 1:
            fs = list(out.families)
            first = [linear_svm(x, np.where(of == f, 1, -1)) for f in (fs[:1] if len(fs) == 2 else fs)]
            out.first = np.stack([first[0], -first[0]] if len(fs) == 2 else first).astype(np.float32)
        out.pairs = [(f, a, b) for f, langs in out.families.items() for a, b in combinations(langs, 2)]
        weights = []
        for _, a, b in out.pairs:
            rows = (names == a) | (names == b)
            weights.append(linear_svm(x[rows], np.where(names[rows] == a, 1, -1)))
        if weights:
            out.second = np.stack(weights).astype(np.float32)
        return out

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language, and how sure: the family's share times the language's share of its pairs."""
        names, sure = list(self.families), 1.0
        if self.first is None:
            chosen = names[0]
        else:
            p = 1 / (1 + np.exp(-3 * (self.first[:, :-1] @ x + self.first[:, -1])))
            chosen, sure = names[int(np.argmax(p))], float(p.max() / max(p.sum(), 1e-9))
        langs = self.families[chosen]
        if len(langs) == 1:
            return langs[0], sure
        votes, share = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (f, a, b), w in zip(self.pairs, self.second):
            if f == chosen:
                p = 1 / (1 + np.exp(-3 * float(w[:-1] @ x + w[-1])))
                votes[a if p >= 0.5 else b] += 1
                share[a] += p / (len(langs) - 1)
                share[b] += (1 - p) / (len(langs) - 1)
        best = max(langs, key=lambda k: (votes[k], share[k]))
        return best, sure * share[best]


def held_out(doc_id, remainder: int, of: int):
    """Is crc32 of the id as text that remainder? Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == remainder, F.lit(False))


def train(docs: DataFrame, most: int = 3000) -> Model:
    """Fits a model on at most `most` documents, shared evenly by the languages.

    docs: doc_id, text, lang; rows with a null in any of them, or with a text
    without a letter, teach nothing.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = bounded_sample(known.select("doc_id", text_key().alias("key"), "lang"), "lang", most, total=most)
    x, y = sample_matrix(known, sample, "lang", features, 1 << BITS)
    return Model.fit(x, y)


def _told(model: Model, text: str | None) -> tuple[str, float]:
    lang, score = model.predict(features(text)) if text and model.families and has_letter(text) else ("und", 0.0)
    return lang, min(1.0, max(0.0, score))


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                lang, score = _told(model, text)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every document; `und`, 0.0 for a null text or one without a letter."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose language can be told with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows_where(docs, "text", lambda texts: [lang != "und" and score >= least for lang, score in (_told(shared.value, t) for t in texts)])


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out(F.col("doc_id"), 2, 4)))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 2, 4).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
