import math
from collections import Counter
from zlib import crc32

import numpy as np

from tidemill.llm.langid import Model, family, identify, op8_language_id, train
from tidemill.llm.linear import bounded_sample, sample_matrix, text_key
from tidemill.llm.quality import FLAWS, LABELLERS, LabelModel, _unpacked, op7_quality_classifier, score_quality
from tidemill.llm.quality import train as train_quality

SF = "/root/testdata/sf0.01"


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_language_id(spark, SF).collect()
    assert {r.doc_id for r in rows} == {*docs} and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [docs[r.doc_id].lang == r.lang_pred for r in rows if r.held_out]
    assert np.mean(held) > 0.98


def test_language_odd_rows(spark, odd_docs, no_docs):
    assert family("de") == family("en-GB") == "germanic" and family("fr") == family("es") and family("xx") == "xx"
    rows = identify(odd_docs, train(odd_docs)).collect()
    for r, (text,) in zip(rows, odd_docs.select("text").collect()):
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr", "de", "es") and 0 <= r.score <= 1
    assert {r.lang_pred for r in identify(odd_docs, train(no_docs)).collect()} == {"und"}
    assert identify(no_docs, Model()).collect() == []
    one = spark.createDataFrame([(1, "abc def", "en")], "doc_id long, text string, lang string")
    assert identify(one, train(one)).first().lang_pred == "en"


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op7_quality_classifier(spark, SF).collect() if r.doc_id in labels]
    assert len(rows) == len(labels)
    assert np.mean([r.keep == bool(labels[r.doc_id]) for r in rows]) > 0.98


def test_labeller_accuracies_are_recovered():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.8
    k, right = len(LABELLERS), np.linspace(0.95, 0.7, len(LABELLERS))
    votes = np.where(rng.random((len(truth), k)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = 2
    codes, counts = np.unique(votes @ 3 ** np.arange(k)[::-1], return_counts=True)
    assert (_unpacked(codes) <= 2).all()
    model = LabelModel(codes, counts.astype(float))
    assert abs(model.share - 0.8) < 0.02
    assert np.abs(np.array([*model.accuracies().values()]) - right).max() < 0.03


def test_quality_odd_rows(spark, odd_docs, no_docs):
    rows = score_quality(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(no_docs).collect() == []


def plain_hash(gram, order):
    """The bucket hash of a byte n-gram, byte by byte."""
    h = order
    for j, byte in enumerate(gram):
        h = (h + (byte + 1) * (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)[j]) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
    return h


def plain_grams(data, orders, bits):
    counts = Counter(plain_hash(data[i : i + n], n) >> 32 - bits for n in orders for i in range(len(data) - n + 1))
    length = sum(counts.values()) ** 0.5
    return {k: c**0.5 / length for k, c in counts.items()} if counts else {}


def test_language_by_brute_force(spark, docs):
    model = train(docs)
    texts = {r.doc_id: r.text for r in docs.filter("length(text) < 1500").collect()}
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    dot = lambda w, x: float(sum(w[k] * v for k, v in x.items()) + w[-1])
    sigmoid = lambda z: 1 / (1 + math.exp(-3 * z))
    assert len(texts) > 50
    for i, text in texts.items():
        if not any(map(str.isalpha, text or "")):
            assert got[i].lang_pred == "und"
            continue
        x = plain_grams(bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode()), (1, 2, 3, 4), 13)
        families = dict(zip(model.families, (sigmoid(dot(w, x)) for w in model.first))) if model.first is not None else dict.fromkeys(model.families, 1.0)
        chosen = max(families, key=families.get)
        sure = families[chosen] / sum(families.values())
        votes, share = Counter(), Counter()
        for (f, a, b), w in zip(model.pairs, model.second if model.second is not None else ()):
            if f == chosen:
                p, rivals = sigmoid(dot(w, x)), len(model.families[f]) - 1
                votes[a if p >= 0.5 else b] += 1
                share.update({a: p / rivals, b: (1 - p) / rivals})
        best = max(model.families[chosen], key=lambda k: (votes[k], share[k]))
        assert got[i].lang_pred == best
        assert math.isclose(got[i].score, sure * (share[best] if share else 1), abs_tol=1e-4)


def plain_votes(text):
    words = (text or "").encode().split()
    n = len(words)
    per = lambda k: k / max(1, n)
    data = (text or "").encode()
    upper = sum(65 <= b <= 90 for b in data)
    lower = sum(97 <= b <= 122 or b > 127 for b in data)
    lines = [x.rstrip() for x in data.split(b"\n") if x.strip()]
    values = [
        per(sum(chr(b) in "#*$%&|<>" for b in data)),
        upper / max(1, upper + lower),
        per(data.count(b"!!")),
        per(sum(a == b for a, b in zip(words, words[1:]))),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(words)) / max(1, n),
        1 - sum(x[-1:] in (b".", b"!", b"?", b":") for x in lines) / max(1, len(lines)),
    ]
    bad = [0 if n >= least and v > above else 2 for v, (above, _, least) in zip(values, FLAWS.values())]
    clean = n > 0 and all(v <= good or n < least for v, (_, good, least) in zip(values, FLAWS.values()))
    ends = sum((text or "").count(e) for e in (". ", ".\n", "! ", "? ")) + 1
    return [*bad, 1 if clean else 2, 1 if n >= 20 and 3 <= n / ends <= 60 else 2]


def test_quality_by_brute_force(spark, docs):
    rows = {r.doc_id: r for r in score_quality(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    # Expectation-maximisation document by document.
    votes = [plain_votes(texts[i]) for i in texts]
    p = [min(0.95, max(0.05, (v.count(1) + 0.5) / (v.count(0) + v.count(1) + 1))) for v in votes]
    for _ in range(200):
        share = (sum(p) + 1) / (len(p) + 2)
        table = {}
        for y in (0, 1):
            weight = [q if y else 1 - q for q in p]
            for j in range(len(LABELLERS)):
                seen = [0.5, 0.5, 0.5]
                for v, q in zip(votes, weight):
                    seen[v[j]] += q
                table[y, j] = [s / sum(seen) for s in seen]
        log = [[math.log(prior) + sum(math.log(table[y, j][v[j]]) for j in range(len(v))) for y, prior in ((0, 1 - share), (1, share))] for v in votes]
        p = [1 / (1 + math.exp(min(700, max(-700, a - b)))) for a, b in log]
    assert all(math.isclose(rows[i].weak_label, q, abs_tol=1e-6) for i, q in zip(texts, p))
    # The trained scorer, term by term.
    weights, _ = train_quality(docs)
    for i, text in texts.items():
        if len(text or "") > 1500:
            continue
        data, words = (text or "").encode(), (text or "").lower().encode().split()
        kind = lambda b: 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if chr(b) in "#*$%&|<>" else 5 if b == 10 else 6 if b in (32, 9, 13, 11, 12) else 7
        z = float(weights[-1])
        z += sum(weights[k] * v for k, v in plain_grams((text or "").lower().encode(), (3,), 12).items())
        z += sum(weights[4096 + k] * v for k, v in plain_grams(bytes(map(kind, data)), (1, 2, 3, 4), 12).items())
        again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
        z += weights[8192] * again**0.5 + weights[8193] * math.exp(-len(words) / 10)
        assert math.isclose(rows[i].score, 1 / (1 + math.exp(-max(-30, min(30, z)))), abs_tol=1e-3)


def test_samples_stay_bounded_where_ids_repeat(spark, docs):
    hot = docs.limit(1)
    many = docs
    for _ in range(8):
        hot = hot.union(hot)
    rows = many.union(hot).select("doc_id", text_key().alias("key"), "lang")
    sample = bounded_sample(rows, "lang", 20)
    assert max(r["count"] for r in sample.groupBy("lang").count().collect()) <= 20
    x, y = sample_matrix(many.union(hot), sample, "lang", lambda t: np.ones(4, np.float32), 4)
    assert len(y) == sample.count()
