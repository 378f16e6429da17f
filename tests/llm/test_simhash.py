import random

import numpy as np
import pytest
import xxhash

from tidemill.operators.graph import components
from tidemill.llm.simhash import compare, fingerprint, linked, near_duplicates, op9_simhash, similar_documents, tile_pairs, wide_fingerprint

from .conftest import SF


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=3):
    """Smallest id that each (id, fingerprint) can reach."""
    label = {i: i for i, _ in prints}
    changed = True
    pairs = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= radius]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_query(spark, docs):
    prints = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, SF).collect()}
    assert got == {i: (f"{x:016x}", want[i]) for i, x in prints}


def test_long_texts():
    words = [f"w{i % 997}" for i in range(40_000)]
    assert fingerprint(" ".join(words)) == plain(" ".join(words))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if int(r.fingerprint, 16) == 0]
    assert [r.component_id for r in zero] == [0] * 3
    assert near_duplicates(no_docs).collect() == []


def test_tiles_beyond_the_radius_are_skipped():
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 63, (4000, 1), np.uint64)
    fp[2000:] = fp[:2000] ^ np.uint64(1 << 5) ^ np.uint64(1 << 40)
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    fp, ones = fp[order], ones[order]
    met = [*tile_pairs(ones, 0, len(fp), 3, 128)]
    tiles = -(-len(fp) // 128)
    assert tiles < len(met) < 0.8 * tiles * (tiles + 1) / 2  # tiles are compared, and many pairs of them are not
    u, v = compare(fp, np.zeros(len(fp), int), 3, 128)
    apart = np.bitwise_count(fp[:, None, 0] ^ fp[None, :, 0]) <= 3
    assert len(u) >= 2000 and apart[u].any(axis=1).all()
    held = np.zeros((len(fp), len(fp)), bool)
    for x, y in met:
        held[x, y] = True
    assert not (np.triu(apart, 1) & ~held).any()


def test_buckets_are_compared_by_tiles(spark):
    rng = random.Random(3)
    prints = sorted({rng.getrandbits(63) for _ in range(3000)})
    prints += [x ^ 1 << 7 ^ 1 << 33 ^ 1 << 60 for x in prints[:500]]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {r.node: r.root for r in components(linked(df, len(prints), in_bucket=500)).collect()}
    want = classes([(x, x) for x in prints[:20] + prints[3000:3020]])
    assert len(found) >= 1000 and all(found[x] == want[x] for x in want)


@pytest.mark.parametrize("most, n", [(16_384, 1), (64, 1), (16_384, 1 << 23)])
def test_links_against_all_pairs(spark, most, n):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for x in list(prints)[:150]:
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            prints.add(x)
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(20, 30)}
    prints = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {r.node: r.root for r in components(linked(df, n, 3, 16, most)).collect()}
    want = classes([(x, x & (1 << 64) - 1) for x in prints])
    assert {x: found.get(x, x) for x in prints} == want


def test_components_of_chains_and_hubs(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, x) for x in range(1001, 1400)] + [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "u long, v long")).collect()}
    label = {x: x for e in edges for x in map(int, e)}
    for _ in range(400):
        for a, b in edges:
            label[int(a)] = label[int(b)] = min(label[int(a)], label[int(b)])
    assert got == {x: r for x, r in label.items() if x in got}
    assert all(r == x for x, r in label.items() if x not in got)


def test_similar_documents(spark, odd_docs):
    rng = random.Random(8)
    rows, family = [], []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for c in range(rng.randrange(1, 5)):
            copy = list(words)
            if c:
                copy[rng.randrange(len(copy))] = f"x{k}{c}"
            if c == 3:
                copy = copy[: len(copy) // 2] + [f"y{k}{i}" for i in range(len(copy))]
            rows.append((len(rows), " ".join(copy)))
            family.append(k if c < 3 else 1000 + k)
    rows += [(9000, ""), (9001, None), (9002, "one"), (9003, "ONE")]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: family.index(f) for i, f in enumerate(family)}
    assert {i: got[i] for i in want} == want and got[9002] == got[9003] == 9002 and 9000 not in got
    assert wide_fingerprint(" \n", 5, 8, 12, 3) is None and len(wide_fingerprint("a b", 5, 8, 12, 3)[0]) == 64


def test_similar_documents_are_as_similar_as_told(spark):
    rng = random.Random(5)
    texts = []
    for k in range(150):  # copies of texts of all lengths, changed here and there
        words = [f"v{rng.randrange(9000)}" for _ in range(rng.choice([8, 9, 10, 12, 14, 30, 100, 250]))]
        for c in range(4):
            copy = list(words)
            for _ in range(c and rng.randrange(1, 2 + len(words) // 25)):
                copy[rng.choice([rng.randrange(len(copy)), -1])] = f"x{k}{c}"
            texts.append(" ".join(copy))
    texts += ["one two three four five six seven eight nine " + last for last in ("ten", "eleven")]
    texts += ["a b c d e " * 200 + " ".join(f"{x}{i}" for i in range(60)) for x in "pq"]  # repeats of little
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = [*range(len(texts))]
    pairs = [(a, b) for a in label for b in range(a) if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    for _ in range(5):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert len({*label}) < len(texts) - 100
    assert {r.doc_id: r.component_id for r in similar_documents(rows).collect()} == dict(enumerate(label))


def test_confirmed_groups_in_parts():
    from tidemill.llm.simhash import _alike, _distinct_hashes, _wide_of

    words = [f"w{i}" for i in range(100)]
    sets = [_distinct_hashes(" ".join(words[:k] + [f"y{k}"] + words[k + 1 :]), 5) for k in range(100)]
    sets.sort(key=lambda h: sum(map(int.bit_count, _wide_of(h, 8, 1, 1)[0])))
    bits, held = [_wide_of(h, 8, 1, 1)[0] for h in sets], [h.tobytes() for h in sets]
    assert {*_alike(bits, held, 0.8, 144).tolist()} == {0}
    assert (_alike(bits, held, 0.8, 144, 50) == _alike(bits, held, 0.8, 144)).all()
    assert len({*_alike(bits, held, 0.99, 144).tolist()}) == 100
