import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from .test_packing import check as check_packing
from .test_pii import base

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}

    told = cp.language(spark, docs, SF)
    assert told.columns == docs.columns and told.count() == len(before)

    good = cp.quality_stage(spark, told, SF)
    kept = {r.doc_id: r for r in good.collect()}
    assert good.columns == docs.columns and all(kept[i] == before[i] for i in kept)
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) > 0.98 * len(right)

    good = cp.save(good, "good")
    single = cp.near_duplicates(spark, good, SF)
    assert single.columns == docs.columns
    left = {r.doc_id for r in single.collect()}
    grams = {i: shingles(r.text) for i, r in kept.items()}
    ids = sorted(kept)
    pairs = [(alike(grams[a], grams[b]), a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if grams[a] & grams[b]]
    assert not [p for p in pairs if p[0] >= 0.8 and p[1] in left and p[2] in left]
    gone = {*ids} - left
    assert all(max(p[0] for p in pairs if i in p[1:]) >= 0.8 for i in gone)

    single = cp.save(single, "single")
    clean = cp.personal_data(spark, single, SF)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    for r in clean.collect():
        old = before[r.doc_id]
        if not base(old.text) and "token =" not in old.text:
            assert r == old
        else:
            assert r.n_chars == len(r.text) and not base(r.text) and re.search(r"\[[A-Z]+\]", r.text)
    clean = cp.save(clean, "clean")
    rows = cp.sequences(spark, clean, SF).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in clean.collect()])


def test_run_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for rows in (odd_docs, no_docs):
        place = str(tmp_path / f"d{rows.count()}")
        odd = rows.withColumn("spans", F.lit(1)).withColumn("row", F.lit(2)).withColumn("row_key__", F.lit(3)).withColumn("c_0", F.lit(4)).withColumnRenamed("text", "TEXT")
        odd.write.parquet(f"{place}/documents.parquet")
        docs = spark.read.parquet(f"{place}/documents.parquet")
        for name, stage in cp.STAGES[:-1]:
            docs = cp.save(stage(spark, docs, place), name)
            assert docs.columns == odd.columns
        want = {r.doc_id for r in docs.collect()}
        assert {r.doc_id for r in cp.run(spark, place).collect()} == want
