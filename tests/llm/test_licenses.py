import math
import re

import duckdb

from tidemill.llm.licenses import BLOCK, ORACLES, PHRASES, TEMPLATES, op4_license_scan, scan

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(doc_id, text):
    words = words_of(text)
    places, base, more, best = [], set(), set(), 0.0
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, template in TEMPLATES:
        t = {*template.split()}
        lines = [w for w in map(words_of, (text or "").split("\n")) if w]
        for i in range(len(lines)):
            block, behind = [*lines[i]], 0
            for line in lines[i + 1 :]:
                if behind < BLOCK:
                    block += line
                    behind += len(line)
            n = len(t & {*block})
            if n >= math.ceil(0.85 * len(t) - 1e-9):
                more.add(label)
                best = max(best, n / len(t))
    return (doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best)


def key(row):
    return tuple((x is None, x) for x in row)


def test_query_and_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    rows = op4_license_scan(spark, "/root/testdata/sf0.01")
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted(plain(r.doc_id, r.text) for r in docs)
    assert {r[5] for r in got} >= {"", "mit", "apache-2", "cc-by-nc"}
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    sql = c.execute(ORACLES["op4_license_scan"]).fetchall()
    assert sorted(sql) == got


def test_odd_rows(spark, odd_docs, no_docs):
    assert sorted(map(tuple, scan(odd_docs).collect()), key=key) == sorted((plain(r.doc_id, r.text) for r in odd_docs.collect()), key=key)
    assert scan(no_docs).collect() == []
    texts = [
        "x Under-the MIT\nLICENSE y under the mit license.",
        "CC BY NC cc by nc, and cc-by-nc! Apache License Version 2.0",
        "under the mit licenses; éunder the mit license; the mit license",
        "Redistribution and use in source or binary forms with or without modification are permitted provided that following conditions are met.",
        "released the mit under license " * 3000,
        "permission is hereby granted, free of charge, to any person obtaining a copy\nof this software",
        "Text.\n\n  Permission is hereby granted, free of charge, to any person\n  obtaining a copy of this software and associated\n\n  documentation files (the Software)\nmore",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted " + "x\n" * 70 + "provided that the following conditions are met",
        "y " * 58 + "permission is hereby granted free of charge to any person\nobtaining a copy of this software and associated documentation files",
        "y " * 300 + "permission is hereby granted free of charge to any person\n\nobtaining a copy of this software\nand associated documentation files",
    ]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = sorted(map(tuple, scan(df).collect()))
    assert got == sorted(plain(i, t) for i, t in enumerate(texts))
    assert [r[6] for r in got[-4:]] == ["mit", "", "mit", "mit"]
