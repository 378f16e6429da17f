import hashlib
import re

from pyspark.sql import functions as F

from tidemill.llm.pii import luhn, mod97, op5_pii, personal_data, redacted, with_spans

from .conftest import SF

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2]) % 10 + sum(x // 10 + x % 10 for x in (2 * y for y in d[1::2])) % 10 in (0, 10)


def fine(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 14 <= len(digits) <= 19 and passes_luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def base(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if fine(k, m.group()))


def check(rows, docs):
    texts = sorted(((d.doc_id is None, d.doc_id, d.text) for d in docs), key=lambda x: (x[0], x[1] or 0))
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(rows) == len(texts)
    for r, (_, doc, text) in zip(rows, texts):
        assert r.doc_id == doc
        found = [(s.start, s.number, s.end, s.kind) for s in r.spans]
        assert found == sorted(found)
        assert [x for x, s in zip(found, r.spans) if s.base] == base(text), text


def test_query(spark, docs):
    want = {}
    for r in docs.collect():
        b = base(r.text)
        want[r.doc_id] = tuple(sum(k == x[3] for x in b) for k in KINDS) + (hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in b).encode()).hexdigest(),)
    rows = op5_pii(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == want
    assert any("secret:" in r.spans for r in rows) == any("token = " in (r.text or "") for r in docs.collect())


def test_odd_texts(spark, odd_docs, no_docs):
    check(personal_data(odd_docs).collect(), odd_docs.collect())
    assert personal_data(no_docs).collect() == []
    texts = [
        "a@b.c_d@e.f x@@y.z é.q@mail.example.com, a@b.c..d@e.f %+@x.yy-",
        "1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.000001 1.2.3 1.2.3.4 .1.2.3.4",
        "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 1111 1111 41111111111111114111111111111111",
        "+1 (234) 555-7713 +4930123 ++49 30 123456 (7) +1-2-3-4-5-6-7-8-9-0 +1.2 ) +",
        "𝟙 𝒳 a@b.cd 日本 10.0.0.1 é x@y.zz",
        "7" * 30_000 + " 1" * 10_000,
        "a" * 60_000 + "." + "@" * 5 + "b.c " * 5_000,
        " ".join(f"n{i}@mail{i}.example.com" for i in range(600)),
        'iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE88 3704 0044 0532 0130 00; token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
        "ssn 078-05-1120 and then, after fifty and more other characters in between, 078-05-1121, card 4111111111111111 5500005555555559",
    ]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS score")
    rows = sorted(personal_data(df).collect())
    check(rows, df.collect())
    assert [s.kind for s in rows[8].spans] == ["iban", "iban", "secret"]
    assert [s.kind for s in rows[9].spans] == ["ssn", "card", "card"] and not rows[9].spans[1].base


def test_checksums(spark):
    codes = [("4111111111111111", "GB82 WEST 1234 5698 7654 32"), ("4111111111111112", "GB83WEST12345698765432"), ("0", "FR1420041010050500013M02606")]
    got = spark.createDataFrame(codes, "a string, b string").select(luhn(F.col("a")), mod97(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, True)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail é.q@mail.example.com or +1 (234) 555-7713!"), (2, None), (3, "none")], "doc_id long, text string")
    rows = personal_data(df).join(df, "doc_id").select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in rows] == ["mail é[EMAIL] or [PHONE]!".replace("é[EMAIL]", "é[EMAIL]"), None, "none"]


def test_numbers_beside_others(spark):
    iban, card, amex = "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111", "3782 822463 10005"
    cases = [
        (f"IBAN {iban} BIC COBADEFFXXX", [iban]),
        (f"{iban} GB82 WEST 1234 5698 7654 32 1234", [iban, "GB82 WEST 1234 5698 7654 32"]),
        ("konto DE88 3704 0044 0532 0130 00 BIC", []),
        (f"card {card} 12/27", [card]),
        (f"x{card} 5500-0000-0000-0004 {amex}", [card, "5500-0000-0000-0004", amex]),
        ("4222222222222 is short", ["4222222222222"]),
        ("counts 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", []),
        ("token = " + "aB3" * 400 + " end", ["token = " + "aB3" * 400]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in personal_data(df).collect()}
    assert [[t[s.start : s.end] for s in rows[i] if s.kind != "phone"] for i, (t, _) in enumerate(cases)] == [want for _, want in cases]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a@b.cd", 2, 3, 4)], "doc_id long, TEXT string, found_email int, c_0 int, chunks__ int")
    row = with_spans(df, "text", "spans").first()
    assert row[:5] == (1, "a@b.cd", 2, 3, 4) and [(s.start, s.end) for s in row.spans] == [(0, 6)]


def test_many_matches_in_long_texts(spark):
    text = "".join(f"é mail{i}@host{i}.example.com, 10.0.{i % 256}.{i % 200} " for i in range(8_000))
    df = spark.createDataFrame([(1, text), (2, "x" * 511 + " a@b.cd " + "y" * 5000 + " 1.2.3.4")], "doc_id long, text string")
    rows = {r.doc_id: r for r in with_spans(df, "text", "spans").select("*", redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert [(s.start, s.number, s.end, s.kind) for s in rows[1].spans] == base(text)
    assert rows[1].t == "".join("é [EMAIL], [IP] " for _ in range(8_000))
    assert rows[2].t == "x" * 511 + " [EMAIL] " + "y" * 5000 + " [IP]"
