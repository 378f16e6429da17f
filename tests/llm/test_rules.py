import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm.rules import NAMES, P, SHARE, chi_square, chi_square_quantile, consistency, cutoff, distances, estimates, op10_quality_rules, quality_rules

SF = "/root/testdata/sf0.01"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(covered), failed


def check(rows, docs):
    of = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, *of(r)) for r in rows), key=key) == sorted(((r.doc_id, *base(r.text)) for r in docs), key=key)
    assert all(r.kept == (not r.base_failed and (r.distance is None or r.distance <= cutoff())) for r in rows)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op10_quality_rules(spark, SF).collect()
    check(rows, docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = [(r.kept, labels[r.doc_id]) for r in rows if not r.base_failed and r.doc_id in labels]
    assert np.mean([k for k, q in passed if q]) > 0.98
    assert np.mean([not k for k, q in passed if not q]) > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    check(quality_rules(odd_docs).collect(), odd_docs.collect())
    assert quality_rules(no_docs).collect() == []
    more = odd_docs.union(odd_docs).withColumnRenamed("length", "row").withColumnRenamed("score", "distance")
    check(quality_rules(more).collect(), more.collect())


def test_copies_fill_a_source_without_harm(spark):
    rng = np.random.default_rng(6)
    words = [f"word{i}"[: rng.integers(3, 9)] for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(40, 300))) for _ in range(150)]
    texts += [texts[0]] * 2000 + ["$$ ## " * 3 + " ".join(f"x{i} ## && $$" for i in range(30))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    assert [r.doc_id for r in quality_rules(docs).filter("not kept and not base_failed").collect()] == [len(texts) - 1]


def least_determinant(x, rng, tries=200):
    """Concentration steps on exact subsets from many random starts: least log-determinant, centre, covariance."""
    h, best = int(np.ceil(SHARE * len(x))), (np.inf, None, None)
    for _ in range(tries):
        at, last = rng.choice(len(x), P + 1, replace=False), np.inf
        while True:
            m, s = x[at].mean(axis=0), np.cov(x[at].T, bias=True)
            det = np.linalg.slogdet(s)[1]
            if len(at) == h and det >= last - 1e-9:
                break
            last = det if len(at) == h else np.inf
            at = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(s), x - m), kind="stable")[:h]
        if det < best[0]:
            best = (det, m, s)
    return best


def contaminated(rng, n):
    """Vectors whose first two statistics go together; a fifth is a cluster elsewhere, the last one breaks the tie alone."""
    x = rng.normal(size=(n, P))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    x[: n // 5] = rng.normal(size=(n // 5, P)) * 0.2 + [6, -6, 5, 5, 5]
    x[-1] = [1.2, -1.2, 0, 0, 0]
    return x


def test_estimates_against_exact_subsets(spark):
    rng = np.random.default_rng(12)
    groups = {g: contaminated(rng, n) for g, n in (("a", 200), ("b", 400))}
    rows = [(g, i, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "group string, i int, " + ", ".join(f"{n} double" for n in NAMES))
    found = estimates(df)
    told = {r.group: r for r in found.collect()}
    measured = {(r.group, r.i): r.distance for r in distances(df, found).select("group", "i", "distance").collect()}
    for g, x in groups.items():
        det, m, s = least_determinant(x, rng)
        assert abs(told[g].log_det - det) < 0.02
        assert np.abs([told[g][f"m_{k}"] - m[k] for k in range(P)]).max() < 0.02
        want = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        got = np.array([measured[g, i] for i in range(len(x))])
        sure = np.abs(np.log(want / consistency() / cutoff())) > 0.1
        assert ((got > consistency() * cutoff()) == (want > consistency() * cutoff()))[sure].all() and np.median(np.abs(np.log(got / want))) < 0.05
        # The verdict is the covariance's: neither scales alone nor all rows' covariance give it.
        scales = np.median(np.abs(x - np.median(x, axis=0)), axis=0) * 1.4826
        plain = (((x - np.median(x, axis=0)) / scales) ** 2).sum(axis=1)
        classic = np.einsum("ij,jk,ik->i", x - x.mean(axis=0), np.linalg.inv(np.cov(x.T)), x - x.mean(axis=0))
        assert got[-1] > consistency() * cutoff() > plain[-1] and (got[: len(x) // 5] > consistency() * cutoff()).all()
        assert (classic <= cutoff()).all()


def test_statistics_without_spread(spark):
    rows = [("a", float(i), 1.0, 0.0, 0.0, 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "group string, " + ", ".join(f"{n} double" for n in NAMES))
    assert estimates(df).filter(~F.col("log_det").isNotNull()).count() == 0
    assert estimates(df.limit(0)).collect() == []


def test_chi_square():
    assert abs(chi_square_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(chi_square_quantile(0.99, 1) - 6.6349) < 1e-3
    assert abs(chi_square(4.3515, 5) - 0.5) < 1e-4 and abs(consistency(1 - 1e-9) - 1) < 1e-6
