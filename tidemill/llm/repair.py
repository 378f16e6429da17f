"""Repair of conversations: which turns to keep, rerole, delete or insert.

A repaired conversation has the roles (s?(ua)+)? : a system turn at most, first, then
users and assistants in turn. A programme over retained subsequences finds the
cheapest edits. A turn that may stay is kept with its own role or reroled. What
lies between two retained turns is deleted, which prefix sums of deletion costs
price, and the two roles tell what has to be inserted. Going backward, the least
value behind a turn is a running minimum for each role of the next retained turn,
so the work is linear. Of equally cheap edits the audit (the edits' initials) that
is least in ASCII wins: D stands ahead of I, K and R, so the farthest next turn
comes first, then an insertion, then keeping.

Conversations go to tasks that stream over their rows. Those with more than LIMIT
rows or BYTES of text are cut into stretches: a stretch tells the least cost for
each role retained ahead of it and each one behind it, these tables compose by
addition and minimum, and each stretch is then solved for itself. Only the hash
over a repaired conversation reads its lines one after the other, as a stream.

Rows of a turn that occurs more than once are taken by role and text. Columns other
than conv_id, turn, role and text play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.storage import save, small_batches
from tidemill.sources.tables import ROW, with_row_ids

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: A conversation up to this many rows and bytes of text is solved in one piece.
LIMIT, BYTES = 20_000, 32 << 20

_FAR = 1 << 60
#: The role retained last, - where there is none yet.
_STATES = "-sua"
#: How many turns have to be inserted between that role and the next retained one, or the end.
_BETWEEN = {
    "-": {"s": 0, "u": 0, "a": 1, "end": 0},
    "s": {"u": 0, "a": 1, "end": 2},
    "u": {"u": 1, "a": 0, "end": 1},
    "a": {"u": 0, "a": 1, "end": 0},
}
_NAMES = {"u": "user", "a": "assistant"}
_END = [INSERT * _BETWEEN[s]["end"] for s in _STATES]
_FINE, _BLANK, _AGAIN, _TRUNCATED = range(4)

_TURNS = "conv_id long, place long, role string, text string, edit string"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by the remainder of crc32(conv_id:turn) by 20.

    0 drops the row (no copies), 1 empties its text, 2 removes the ends of its
    sentences, 3 repeats it, 4 makes it the user's. Nulls are written as a space.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced["role"]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"]).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def solve(turns: list[tuple[str, int]], tail: list[int] = _END) -> tuple[list[int], dict[str, tuple[list[str], str]]]:
    """Costs by the role retained ahead of the turns, and for each such role (edits of each turn, role retained last).

    turns: initial of the role, and fault. tail: what follows costs by the role
    retained last. An edit has an I for each insertion ahead of the turn.
    """
    n = len(turns)
    deleted = range(0, DELETE * (n + 1), DELETE)  # prefix sums: each turn costs the same
    best: dict[str, tuple[int, int, str]] = {}  # by the next retained role: value and sum ahead of it, its place, its letter
    links: dict[tuple[int, str], tuple[int, str]] = {}

    def follow(state: str, at: int) -> tuple[int, int, str]:
        """Least value of what comes after state from place at on, with the next retained turn's place and role."""
        found = (deleted[n] - deleted[at] + tail[_STATES.index(state)], -n, "", "")
        for role, inserts in _BETWEEN[state].items():
            if role in best:
                value, place, letter = best[role]
                found = min(found, (value - deleted[at] + INSERT * inserts, -place, "I" * inserts + letter, role))
        return found[0], -found[1], found[3]

    for i in range(n - 1, -1, -1):
        initial, fault = turns[i]
        if fault in (_BLANK, _AGAIN):
            continue
        new = {}
        for role in "sua":
            if role == initial or role != "s":
                value, *links[i, role] = follow(role, i + 1)
                new[role] = (value + (0 if role == initial else REROLE) + (CUT if fault == _TRUNCATED else 0) + deleted[i], i, "K" if role == initial else "R")
        for role, option in new.items():
            if role not in best or option[0] < best[role][0]:  # of equal ones the farther stays
                best[role] = option
    costs, ways = [], {}
    for first in _STATES:
        value, place, role = follow(first, 0)
        costs.append(value)
        edits, state = ["D"] * n, first
        while place < n:
            edits[place] = "I" * _BETWEEN[state][role] + ("K" if role == turns[place][0] else "R")
            state = role
            place, role = links[place, role]
        ways[first] = (edits, state)
    return costs, ways


class _Conversation:
    """What is told of a conversation whose turns come one after the other with their edits."""

    def __init__(self, conv_id: int | None):
        self.id, self.state, self.cost, self.places = conv_id, "-", 0, 0
        self.turns, self.first, self.last, self.distinct = 0, None, None, 0
        self.faults, self.illegal, self.before = [0] * 4, 0, ""
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def _out(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update(("\n" * (self.places > 0) + f"{role}:{text}").encode())
        self.state = role[:1] if edit == "K" else role[0]
        self.places += 1
        return self.id, self.places - 1, role, text, edit

    def _due(self) -> str:
        return _NAMES["a" if self.state == "u" else "u"]

    def insert(self) -> tuple:
        self.audit.append("I")
        self.cost += INSERT
        return self._out(self._due(), "", "I")

    def add(self, turn: int | None, role: str, text: str, fault: int, edits: str) -> Iterator[tuple]:
        self.faults[fault] += 1
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.illegal += self.turns > 0 and self.before + role[:1] not in ("su", "ua", "au")
        self.before, self.turns = role[:1], self.turns + 1
        for _ in edits[:-1]:
            yield self.insert()
        edit = edits[-1]
        self.audit.append(edit)
        self.cost += DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (CUT if fault == _TRUNCATED else 0)
        if edit != "D":
            yield self._out(role if edit == "K" else self._due(), text, edit)

    def end(self) -> Iterator[tuple]:
        for _ in range(_BETWEEN[self.state]["end"]):
            yield self.insert()

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return self.id, gaps, *self.faults[_BLANK:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in ddl.split(", "))])


def _edited(whole: bool, turns: bool):
    """Streams over rows by conversation and turn.

    whole: a conversation's rows are solved here, all at a time; else rows have
    their edits. turns: repaired turns are returned, else a report.
    """
    schema = _arrow(_TURNS if turns else _REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, now, held = 0, None, []

        def close() -> None:
            nonlocal size
            if whole:
                seen: set[tuple[str, str]] = set()
                rows = []
                for turn, role, text, fault in held:
                    again = fault != _BLANK and (role, text) in seen
                    seen.add((role, text))
                    rows.append((turn, role, text, _AGAIN if again else fault))
                _, ways = solve([(role[:1], fault) for _, role, _, fault in rows])
                for row, edits in zip(rows, ways["-"][0]):
                    take(now.add(*row, edits))
            take(now.end())
            if not turns:
                out.append(now.report())
                size += len(out[-1][-2])

        def take(made: Iterator[tuple]) -> None:
            nonlocal size
            for row in made:
                if turns:
                    out.append(row)
                    size += len(row[3])

        for batch in batches:
            for conv_id, turn, role, text, fault, n, edits in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.id != conv_id:
                    if now is not None:
                        close()
                    now, held = _Conversation(conv_id), []
                if whole:
                    held.extend([(turn, role, text, fault)] * n)
                else:
                    take(now.add(turn, role, text, fault, edits))
                if len(out) >= 4096 or size > 8 << 20:
                    yield _batch(out, schema)
                    out.clear()
                    size = 0
        if now is not None:
            close()
        if out:
            yield _batch(out, schema)

    return run


def _costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stretch's least costs by role ahead of it and role behind it."""
    pdf = pdf.sort_values("place")
    turns = [*zip(pdf["initial"], pdf["fault"].tolist())]
    columns = [solve(turns, [0 if i == k else _FAR for i in range(4)])[0] for k in range(4)]
    return pd.DataFrame({"conv": [pdf["conv"].iloc[0]], "stretch": [pdf["stretch"].iloc[0]], "costs": [[columns[k][i] for i in range(4) for k in range(4)]]})


def _tails(pdf: pd.DataFrame) -> pd.DataFrame:
    """What all stretches behind each one cost, by the role retained last."""
    tail, out = _END, []
    for conv, stretch, costs in pdf.sort_values("stretch", ascending=False)[["conv", "stretch", "costs"]].itertuples(index=False):
        out.append((conv, stretch, tail))
        tail = [min(costs[4 * i + k] + tail[k] for k in range(4)) for i in range(4)]
    return pd.DataFrame(out, columns=["conv", "stretch", "tail"])


def _ways(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("place")
    _, ways = solve([*zip(pdf["initial"], pdf["fault"].tolist())], [int(x) for x in pdf["tail"].iloc[0]])
    return pd.DataFrame({"conv": pdf["conv"].iloc[0], "stretch": pdf["stretch"].iloc[0], "ahead": [*_STATES], "behind": [ways[s][1] for s in _STATES], "edits": ["".join(ways[s][0]) for s in _STATES]})


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """The role that is retained ahead of each stretch."""
    behind = {(k, a): b for k, a, b in zip(pdf["stretch"].tolist(), pdf["ahead"], pdf["behind"])}
    state, out = "-", []
    for stretch in sorted({k for k, _ in behind}):
        out.append((pdf["conv"].iloc[0], stretch, state))
        state = behind[stretch, state]
    return pd.DataFrame(out, columns=["conv", "stretch", "ahead"])


def _each_edit(edits: str) -> list[str]:
    return re.findall("I*[DKR]", edits)


def _long(rows: DataFrame, limit: int) -> DataFrame:
    """conv_id, turn, role, text, fault, n, edits of conversations that aren't solved in one piece."""
    each = rows.filter("n > 0").withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    placed = save(with_row_ids(each.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text")), "turns")
    starts = placed.groupBy("conv_id").agg(F.min(ROW).alias("conv"))
    placed = placed.join(starts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    placed = placed.withColumn("place", F.col(ROW) - F.col("conv")).withColumn("digest", F.sha2("text", 256))
    first = placed.groupBy("conv", "role", "digest").agg(F.min("place").alias("first"))
    told = placed.join(first, ["conv", "role", "digest"])
    again = (F.col("fault") != _BLANK) & (F.col("place") > F.col("first"))
    told = told.withColumn("fault", F.when(again, _AGAIN).otherwise(F.col("fault")))
    told = save(told.select("conv", "place", F.floor(F.col("place") / limit).cast("long").alias("stretch"), "conv_id", "turn", "role", "text", "fault", "n"), "turns")
    lean = told.select("conv", "stretch", "place", F.substring("role", 1, 1).alias("initial"), "fault")
    costs = save(lean.groupBy("conv", "stretch").applyInPandas(_costs, "conv long, stretch long, costs array<long>"), "costs")
    tails = costs.groupBy("conv").applyInPandas(_tails, "conv long, stretch long, tail array<long>")
    solved = lean.join(tails, ["conv", "stretch"]).groupBy("conv", "stretch").applyInPandas(_ways, "conv long, stretch long, ahead string, behind string, edits string")
    solved = save(solved, "edits")
    ahead = solved.groupBy("conv").applyInPandas(_chained, "conv long, stretch long, ahead string")
    each_edit = F.udf(_each_edit, "array<string>", useArrow=True)
    edits = solved.join(ahead, ["conv", "stretch", "ahead"]).select("conv", "stretch", F.posexplode(each_edit("edits")).alias("i", "edits"))
    edits = edits.select("conv", (F.col("stretch") * limit + F.col("i")).alias("place"), "edits")
    out = told.join(edits, ["conv", "place"]).repartition("conv").sortWithinPartitions("conv", "place")
    return out.select("conv_id", "turn", "role", "text", "fault", "n", "edits")


def repair(rows: DataFrame, turns: bool = False, limit: int = LIMIT, size: int = BYTES) -> DataFrame:
    """Repairs conversations: rows have conv_id, turn, role, text and copies, how often a row stands (0: it is gone).

    With turns, returns the repaired turns, conv_id, place, role, text and edit (K
    kept, R reroled, I inserted). Else returns a report for each conv_id, of those
    whose rows are all gone too: gaps in turns; blank, duplicate and truncated turns
    by their first fault; illegal neighbours; the cheapest edits' cost and audit; and
    the hash of the repaired role:text lines.
    """
    small_batches(rows.sparkSession)
    text = F.col("text")
    blank, ended = ~text.rlike(r"[^\x20\x09-\x0D]"), text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, _BLANK).when(ended, _FINE).otherwise(_TRUNCATED)
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.col("copies").alias("n"), F.lit("").alias("edits"))
    sizes = rows.groupBy("conv_id").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.octet_length("text")).alias("bytes"))
    large = save(sizes.filter((F.col("rows") > limit) | (F.col("bytes") > size)).select(F.col("conv_id").alias("c")), "large")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    some = not large.isEmpty()
    short = (rows.join(large, same, "left_anti") if some else rows).repartition("conv_id")
    short = short.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    schema = _TURNS if turns else _REPORT
    out = short.mapInArrow(_edited(True, turns), schema)
    return out.union(_long(rows.join(large, same, "left_semi"), limit).mapInArrow(_edited(False, turns), schema)) if some else out


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _oracle() -> str:
    """Aligns turn by turn: a state is its cost, in six digits, before its audit, so the least text wins."""

    def paid(state: str, cost: int | str, letter: str) -> str:
        return f"lpad(CAST(CAST({state}[:6] AS INT) + {cost} AS VARCHAR), 6, '0') || {state}[7:] || '{letter}'"

    keep = "(CASE WHEN fault = 3 THEN 1 ELSE 0 END)"
    may = lambda initial, made: f"CASE WHEN fault IN (0, 3) AND initial = '{initial}' THEN {made} END"
    rerole = lambda made: f"CASE WHEN fault IN (0, 3) THEN {made} END"
    before_u = f"least(u, {paid('n', 2, 'I')}, {paid('s', 2, 'I')}, {paid('a', 2, 'I')})"
    before_a = f"least(a, {paid('u', 2, 'I')})"
    options = {
        "n": [paid("n", 3, "D")],
        "s": [paid("s", 3, "D"), may("s", paid("n", keep, "K"))],
        "u": [paid("u", 3, "D"), *(may("u", paid(x, keep, "K")) for x in "nsa"), *(rerole(paid(x, f"2 + {keep}", "R")) for x in "nsa")],
        "a": [paid("a", 3, "D"), may("a", paid("u", keep, "K")), rerole(paid("u", f"2 + {keep}", "R"))],
    }
    steps = ", ".join(f"least({', '.join(made)}) AS {k}" for k, made in options.items())
    far = "'900000'"
    return rf"""
WITH RECURSIVE steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps),
k AS (SELECT *, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
d AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, [('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(len(h) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, crc),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
  unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS short FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN short = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(short, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
sizes AS (SELECT conv_id, count(*) AS turns, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
p(conv_id, i, n, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, '000000', {far}, {far}, {far} FROM sizes
  UNION ALL
  SELECT conv_id, i, {steps} FROM (
    SELECT * REPLACE ({before_a} AS a) FROM (
      SELECT * REPLACE ({before_u} AS u) FROM (SELECT f.conv_id, f.i, fault, initial, n, s, u, a FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)))
),
e AS (SELECT p.conv_id, least(n, {paid("s", 4, "II")}, {paid("u", 2, "I")}, a) AS best FROM p JOIN sizes ON sizes.conv_id IS NOT DISTINCT FROM p.conv_id AND sizes.turns = p.i),
l AS (SELECT conv_id, best[7:] AS audit, unnest(range(1, len(best) - 5)) AS pos FROM e),
m AS (SELECT conv_id, pos, audit[pos] AS edit, count(*) FILTER (audit[pos] <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM l),
q AS (SELECT m.conv_id, m.pos, m.edit, f.role, f.text, f.initial, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.pos) AS nth FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i WHERE m.edit <> 'D'),
z AS (SELECT *, max(CASE WHEN nth = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM q),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired FROM z GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best[:6], '0') AS BIGINT) AS cost, coalesce(best[7:], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN sizes ON sizes.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES = {"op12_conversation_repair": _oracle()}
