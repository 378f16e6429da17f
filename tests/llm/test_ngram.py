import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tidemill.llm.ngram import Table, discounts, op6_lm_scoring, score, train

from .conftest import SF


def split(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def plain(train_texts, texts, order=3):
    grams, words = Counter(), Counter()
    for t in train_texts:
        w = split(t)
        words.update(w)
        grams.update(zip(["<s>", "<s>", *w], ["<s>", *w], w))
    n, v = sum(words.values()), len(words)
    pairs = Counter()
    for (_, a, b), c in grams.items():
        pairs[a, b] += 1 if order > 2 else c
    ahead = Counter(b for _, b in pairs)

    def level(counts):
        """Discounts, and each context's total and items of 1, 2, more."""
        d = (0, *discounts(*(sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))))
        total, kinds = Counter(), defaultdict(Counter)
        for key, c in counts.items():
            total[key[:-1]] += c
            kinds[key[:-1]][min(c, 3)] += 1
        return d, total, kinds

    def share(counts, facts, key, lower):
        d, total, kinds = facts
        if not total[key[:-1]]:
            return lower
        c = counts[key]
        return (c - d[min(c, 3)] + sum(d[k] * m for k, m in kinds[key[:-1]].items()) * lower) / total[key[:-1]]

    third, second = level(grams), level(pairs)
    d1 = level({(w,): c for w, c in ahead.items()})[0]
    all_ = sum(ahead.values())
    rest = sum(d1[min(c, 3)] for c in ahead.values()) / all_ if all_ else 1

    def p1(w):
        return (ahead[w] - d1[min(ahead[w], 3)]) / (all_ or 1) + rest / (v + 1)

    def p(a, b, c):
        two = share(pairs, second, (b, c), p1(c))
        return share(grams, third, (a, b, c), two) if order > 2 else two

    assert not n or math.isclose(sum(p1(w) for w in words) + rest / (v + 1), 1)
    out = []
    for t in texts:
        w = split(t)
        out.append((len(w), sum(words[x] > 0 for x in w), n, sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(*g)) for g in zip(["<s>", "<s>", *w], ["<s>", *w], w))))
    return out


def same(rows, want):
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-9, abs_tol=1e-9)


def test_query(spark, docs):
    rows = sorted(docs.select("doc_id", "text").collect())
    held = [crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    got = sorted(op6_lm_scoring(spark, SF).collect())
    assert [r.held_out for r in got] == held
    same(got, plain([r.text for r, h in zip(rows, held) if not h], [r.text for r in rows]))
    unseen = [(r.score / r.n_tokens, r.base_score / r.n_tokens) for r in got if r.held_out]
    assert sum(s for s, _ in unseen) > sum(b for _, b in unseen)


@pytest.mark.parametrize("order, size", [(3, 2_000_000), (3, 300), (2, 300)])
def test_odd_rows(spark, odd_docs, no_docs, order, size):
    texts = [r.text for r in odd_docs.select("text").collect()]
    got = score(odd_docs, train(odd_docs, order, size)).collect()
    same(got, plain(texts, texts, order))
    same(score(odd_docs, train(no_docs, order)).collect(), plain([], texts, order))
    assert score(no_docs, train(odd_docs, order)).collect() == []


def test_frequent_words_and_more_context(spark, docs):
    rows = docs.select("text").collect()
    texts = [r.text for r in rows]
    got = score(docs, train(docs, 3, 2_000)).collect()  # many words are frequent for shards of that size
    same(got, plain(texts, texts))
    two = score(docs, train(docs, 2, 2_000)).collect()
    same(two, plain(texts, texts, 2))
    assert sum(r.score for r in got) > sum(r.score for r in two)


@pytest.mark.parametrize("exact", [False, True])
def test_tables(exact):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 64, 5000, np.uint64))
    numbers = [rng.integers(0, 300, len(keys)), rng.integers(0, 1 << 40, len(keys))]
    table = Table(np.frombuffer(Table.packed(keys, numbers, exact), np.uint8))
    assert (table.look(keys) == np.stack(numbers)).all()
    assert (table.look(np.setdiff1d(rng.integers(0, 1 << 64, 5000, np.uint64), keys)) == 0).all()
    empty = Table(np.frombuffer(Table.packed(keys[:0], [np.zeros(0, int)]), np.uint8))
    assert (empty.look(keys) == 0).all()
