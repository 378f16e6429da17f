"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns they were given; the last returns the
pieces' places in the sequences. SQL can't express the learned stages, so
ORACLE_SQL is None and tests hold every stage against a plainer version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import langid, packing, pii, quality, simhash
from tidemill.llm.storage import save

#: A prediction that is less sure than this tells no language.
LEAST_SURE = 0.2


def _marked(docs: DataFrame, name: str) -> DataFrame:
    """docs under the names c_0, c_1 ..., with a key of its own for each row, so that repeated or null ids stay apart and no name clashes."""
    renamed = docs.toDF(*(f"c_{i}" for i in range(len(docs.columns))))
    return save(renamed.select(F.monotonically_increasing_id().alias("row_key__"), "*"), name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letter, a null text, or too unsure."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"), 2, 4)))
    return langid.identified(docs, model, LEAST_SURE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly supervised scorer takes for junk."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the least id.

    Near copies have a Jaccard similarity of 0.8 or more on distinct word 5-grams:
    wide fingerprints propose them, the 5-grams decide. Documents without a word have nothing to compare and are no group.
    """
    marked = _marked(docs, "copies")
    at = {c.lower(): F.col(f"c_{i}") for i, c in enumerate(docs.columns)}
    keyed = marked.select(F.col("row_key__").alias("doc_id"), at["text"].alias("text"))
    groups = simhash.similar_documents(keyed).select(F.col("doc_id").alias("row_key__"), "component_id")
    ids = marked.select("row_key__", at["doc_id"].cast("long").alias("id"))
    ranked = save(ids.join(groups, "row_key__", "left"), "groups")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row_key__").alias("row_key__"))
    firsts = ranked.filter("component_id is not null").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row_key__").alias("row_key__"))
    kept = firsts.union(ranked.filter("component_id is null").select("row_key__"))
    return marked.join(kept, "row_key__", "left_semi").drop("row_key__").toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    names = [f"c_{i}" for i in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index("text")]
    out, types = [], dict(docs.dtypes)
    found = pii.with_spans(docs.toDF(*names), text, "spans__")
    found = found.withColumn("text__", pii.redacted(F.col(text), F.col("spans__")))
    for c, held in zip(docs.columns, names):
        if held == text:
            out.append(F.col("text__").alias(held))
        elif c.lower() == "n_chars":
            out.append(F.when(F.size("spans__") > 0, F.length("text__")).otherwise(F.col(held)).cast(types[c]).alias(held))
        else:
            out.append(F.col(held))
    return found.select(*out).toDF(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents, each stage's rows stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
