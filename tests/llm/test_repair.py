import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import repair

SF = "/root/testdata/sf0.01"
FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute(turns):
    """Every way to edit (role, text, fault) turns, by a search over states that carries whole audits."""
    states = {("-",): (0, "", ())}
    best = {"-": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in [*best.items()]:
                role = "assistant" if state == "u" else "user"
                option = (cost + 2, audit + "I", (*lines, f"{role}:"))
                if role[0] not in best or option[:2] < best[role[0]][:2]:
                    best[role[0]] = option
        return best

    for role, text, fault in turns:
        new = {}

        def offer(state, option):
            if state not in new or option[:2] < new[state][:2]:
                new[state] = option

        for state, (cost, audit, lines) in inserted(best).items():
            offer(state, (cost + 3, audit + "D", lines))
            if fault in (0, 3):
                cut = fault == 3
                due = "a" if state == "u" else "u"
                if role[:1] == due or (role[:1] == "s" and state == "-"):
                    offer(role[:1], (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                offer(due, (cost + cut + 2, audit + "R", (*lines, f"{'assistant' if due == 'a' else 'user'}:{text}")))
        best = new
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in "-a")
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    """rows: (conv_id, turn, role, text) as they are in the table."""
    out = {}
    for r in rows:
        out.setdefault(r[0], [])
        conv, turn, role, text = (" " if x is None else str(x) for x in r)
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out[r[0]] += [(r[1], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    table = []
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        told, seen = [], set()
        for _, role, text in turns:
            short = text.rstrip(" \t\n\x0b\x0c\r")
            told.append((role, text, 1 if not short else 2 if (role, text) in seen else 0 if short[-1] in ".!?" else 3))
            seen.add((role, text))
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len({*numbers}) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        table.append((conv, gaps, *(sum(f == k for *_, f in told) for k in (1, 2, 3)), illegal, *brute(told)))
    return sorted(table, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(FIELDS).collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    texts = ["Yes.", "Yes.", "no", " ", "", "What?\n", "a.b", None, "x " * 3000 + "!", "é…"]
    rows = [(c, rng.choice([None, *range(n)]) if c % 3 == 0 else i, rng.choice(["user", "assistant", "assistant", "system", "user", "tool", "", None]), rng.choice(texts)) for c in range(150) for n in [rng.randint(1, 9)] for i in range(n)]
    rows += [(None, i, "user", "hello.") for i in range(12)] + [(7, 1, "user", "Yes.")] * 2
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, copies int"), rows


def test_equals_brute_force(odd):
    df, rows = odd
    assert rows_of(repair.repair(repair.damaged(df))) == expected(rows)


def test_stretches_equal_whole_conversations(spark, odd):
    df, rows = odd
    rng = random.Random(6)
    long = [(900, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!", "", f"{i}."])) for i in range(120)]
    both = df.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))
    assert rows_of(repair.repair(repair.damaged(both), limit=4)) == expected([*rows, *long])
    turns = repair.repair(repair.damaged(both), turns=True, limit=4)
    told = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(":", "role", "text").alias("x")))).alias("x"))
    hashes = {r[0]: r[1] for r in told.select("conv_id", F.sha2(F.array_join("x.x", "\n"), 256)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r[0]: r[-1] for r in expected([*rows, *long])} == {c: hashes.get(c, empty) for c in {r[0] for r in [*rows, *long]}}


def test_no_rows(spark, odd):
    df, _ = odd
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0
    gone = spark.createDataFrame([(3, None, None, None, 0)], "conv_id long, turn long, role string, text string, copies int")
    assert rows_of(repair.repair(gone)) == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(FIELDS)} FROM ({repair.ORACLES['op12_conversation_repair']})").fetchall()
    got = rows_of(repair.op12_conversation_repair(spark, SF))
    assert got == sorted(want, key=repr)
    assert got == expected([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
