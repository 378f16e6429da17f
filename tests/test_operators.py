import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemill import cli
from tidemill.functions.text import clean_key_of
from tidemill.operators.cleaner import Cleaner
from tidemill.operators.evidence import layout
from tidemill.operators.profiling import Profile, infer_types, profile
from tidemill.operators.spellings import clusters, spelling_clusters
from tidemill.operators.validation import validate
from tidemill.plans.pipeline import check_steps, content_hash, run_pipeline
from tidemill.plans.suggest import outward, suggest
from tidemill.sources.tables import ROW, ordered_rows, read_csv, record_lines, renumbered

CSV = """﻿Client ID,Full Name,Email,Country,Joined,Seen,Balance,Active,Age
1,ana  LOPEZ,ANA@GMIAL.com,Panamá,05/02/2023,2023-03-01,"1,250.00",yes,31
2,"o'brien
smith",ob@x.example,panama,13/02/2023,2023-03-02,"2.500,50",no,40
3,   ,leohotmail.com,PANAMA,2023-02-14,2023-03-03,1.000,Yes,29
4,jean-paul roy,jp@y.example,Panama,Feb 15 2023,2023-03-04,$980,YES,35
4,jean-paul roy,jp@y.example,Panama,Feb 15 2023,2023-03-04,$980,YES,35
5,maría sol,ms@yahoo.con,Colombia,16/02/2023,2023-03-05,700,N/A,200
6,,,,,,,,
"""


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "messy.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"`{ROW}` long, {schema}")


def brute(sigs, order, blocks, threshold):
    kept, out = [], {}
    for i in order:
        if not sigs[i]:
            continue
        scored = [(SequenceMatcher(None, sigs[i], sigs[k]).ratio(), -n, k) for n, k in enumerate(kept) if blocks[i] == blocks[k]]
        best = max(scored, default=(0, 0, 0))
        if best[0] >= threshold:
            out[i] = best[2]
        else:
            kept.append(i)
    return out


@pytest.mark.parametrize("keep", ["first", "most_complete"])
@pytest.mark.parametrize("tile, in_task", [(2000, 200_000), (40, 0)])
def test_fuzzy_duplicates_against_brute_force(spark, keep, tile, in_task, monkeypatch):
    from tidemill.operators import dedup

    rng = random.Random(5)
    first, last = ["ana", "anna", "ANA", "beto", "carla", None, ""], ["ruiz", "ruis", "Ruiz", "gomez", "lopez", "Lopéz"]
    rows = [(" ".join(filter(None, (rng.choice(first), rng.choice(last), rng.choice(last)))) if rng.random() > 0.1 else rng.choice([None, "", "N/A"]), rng.choice(["x", "y", None])) for _ in range(200)]
    monkeypatch.setattr(dedup.fuzzy_pairs, "__defaults__", (tile, in_task))
    c = Cleaner(frame(spark, rows, "name string, city string").repartition(5))
    c.deduplicate("name", keep=keep, fuzzy=True, threshold=0.85, flag=True)
    got = {r[ROW]: r.duplicate_of for r in c.frame.collect() if r.is_duplicate}
    order = sorted(range(200), key=lambda i: (sum(clean_key_of(v) == "" for v in rows[i]) if keep == "most_complete" else 0, i))
    exact, seen = {}, {}
    for i in order:
        if rows[i][0] in seen:
            exact[i] = seen[rows[i][0]]
        else:
            seen[rows[i][0]] = i
    sigs = [clean_key_of(r[0]) for r in rows]
    assert got == exact | brute(sigs, [i for i in order if i not in exact], [s[:1] for s in sigs], 0.85)


def test_pipeline_end_to_end(spark, messy):
    steps = [
        {"op": "standardize_column_names"},
        {"op": "normalize_whitespace"},
        {"op": "handle_missing", "strategy": "drop_rows", "columns": ["full_name", "email"], "how": "all"},
        {"op": "coerce_types", "mapping": {"client_id": "integer", "joined": "date", "balance": "float", "active": "bool", "age": "int", "gone": "int"}},
        {"op": "standardize_categoricals", "column": "country", "canonical": ["Panama", "Colombia"]},
        {"op": "standardize_names", "columns": "full_name"},
        {"op": "standardize_emails", "columns": ["email"], "invalid": "flag"},
        {"op": "handle_outliers", "columns": ["age"], "action": "cap"},
        {"op": "deduplicate", "subset": "client_id", "keep": "most_complete"},
    ]
    df = read_csv(spark, messy)
    result = run_pipeline(df, {"name": "t", "steps": steps})
    rows = list(ordered_rows(result.df))
    assert [r["client_id"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["balance"] for r in rows] == [1250.0, 2500.5, 1000.0, 980.0, 700.0]
    assert [r["active"] for r in rows] == [True, False, True, True, None]
    assert [str(r["joined"])[:10] for r in rows] == ["2023-02-05", "2023-02-13", "2023-02-14", "2023-02-15", "2023-02-16"]
    assert [r["full_name"] for r in rows] == ["Ana Lopez", "O'Brien Smith", None, "Jean-Paul Roy", "María Sol"]
    assert [r["email"] for r in rows] == ["ana@gmail.com", "ob@x.example", "leohotmail.com", "jp@y.example", "ms@yahoo.com"]
    assert [r["email_is_invalid"] for r in rows] == [False, False, True, False, False]
    assert {r["country"] for r in rows} == {"Panama", "Colombia"} and rows[4]["age"] < 200
    assert result.before["rows"] == 7 and result.after["duplicate_rows"] == 0
    assert any("column not found" in e["message"] for e in result.audit_log)
    assert run_pipeline(read_csv(spark, messy), {"steps": steps}).after["hash"] == result.after["hash"]
    assert "## Audit log" in result.to_markdown() and len(result.audit_log) == 14


def test_content_hash(spark):
    df = frame(spark, [("a", None), (None, "a")], "x string, y string")
    other = frame(spark, [(None, "a"), ("a", None)], "x string, y string")
    assert content_hash(df) == content_hash(df.repartition(3)) != content_hash(other)
    gaps = df.withColumn(ROW, df[ROW] * 1000)
    assert content_hash(gaps) == content_hash(df) and [r[0] for r in renumbered(gaps).orderBy(ROW).collect()] == [0, 1]


def test_missing_and_outliers(spark):
    c = Cleaner(frame(spark, [("31",), ("44",), (None,), ("n/a",)], "age string")).coerce_types({"age": "integer"}).handle_missing("fill", "age", "median")
    assert sorted(r.age for r in c.df.collect()) == [31, 38, 38, 44] and "was rounded to 38" in c.messages()[-1]
    c = Cleaner(frame(spark, [(str(v),) for v in (10, 11, 12, 13, 1000)], "v string")).handle_outliers("v", action="cap")
    assert sorted(r.v for r in c.df.collect()) == [10.0, 11.0, 12.0, 13.0, 16.0]
    c = Cleaner(frame(spark, [("2.5",), ("3.7",), ("x",)], "n string"))
    with pytest.raises(ValueError, match="non-integer"):
        c.coerce_types({"n": "int"}, on_fraction="error")
    assert [r.n for r in c.coerce_types({"n": "int"}, on_fraction="nullify").frame.orderBy(ROW).collect()] == [None, None, None]
    with pytest.raises(ValueError, match="needs a value"):
        c.handle_missing("fill", "n")
    with pytest.raises(ValueError, match="Did you mean 'flag'"):
        c.handle_missing("flagg")


def test_validation(spark):
    df = frame(spark, [("1", "2023-01-02", "2023-01-01", True), (" ", "2023-01-02", "03/01/2023", False), ("x", None, "2023-01-01", None), ("1", "2023-01-05", "13/01/2023", True)], "a string, s string, e string, b boolean")
    rules = {"columns": {"a": {"not_null": True, "unique": True, "range": {"min": 2}, "nope": 1}, "b": {"allowed": ["True"]}, "zz": {}}, "checks": [{"name": "order", "left": "s", "op": "<=", "right": "e"}, {"name": "bad", "left": "s", "op": "~", "right": "e"}]}
    r = validate(df, rules)
    assert r.by_rule == {"a.not_null": 1, "a.unique": 2, "a.range": 3, "a.nope": 1, "b.allowed": 1, "zz.exists": 1, "order": 1, "bad": 1} and r.n_rules == 8
    told = {f["rule"]: f for f in r.first(50)}
    assert told["order"]["message"] == "expected s <= e, got 2023-01-02 vs 2023-01-01" and told["a.not_null"]["message"] == "value is blank"
    assert not r.ok and "FAIL" in r.to_markdown()


def test_profile_and_suggestion(spark, messy):
    df = read_csv(spark, messy)
    p = profile(df)
    assert {c.name: c.inferred_type for c in p.columns} | {"Country": ""} == {"Client ID": "integer", "Full Name": "text", "Email": "email", "Country": "", "Joined": "datetime", "Seen": "datetime", "Balance": "float", "Active": "boolean", "Age": "integer"}
    assert p.n_duplicate_rows == 1 and p.column("Client ID").semantic == "identifier" and "4" in p.column("Client ID").details["duplicate_row_keys"]
    assert Profile.from_dict(p.as_dict()).column("Age").n_outliers == p.column("Age").n_outliers == 1
    assert p.to_markdown().startswith("# Data profile") and "<table>" in p.to_html()
    s = suggest(df)
    assert s.round_trips()
    assert [x.step["op"] for x in s.steps][:4] == ["standardize_column_names", "normalize_whitespace", "handle_missing", "coerce_types"]
    assert s.rules["checks"] == [{"name": "joined_not_after_seen", "left": "joined", "op": "<=", "right": "seen"}]
    check_steps(s.pipeline())
    assert suggest(df.limit(0)).round_trips()


def test_small_helpers(spark, tmp_path):
    assert [outward(125, True), outward(-8450, False), outward(0, True)] == [130, -8500, 0]
    days = ["15 de enero de 2023", "31/02/2023", "2/13/2023", "3/4/23", "2023-02-28T10:00:00Z", "2023.2.30", "Sept. 5, 2020", "5-ene-2020", "5-xyz-2020", "1/2/2023 x"]
    shown = [r[0] for r in spark.createDataFrame([(d,) for d in days], "v string").select(layout(F.col("v"))).collect()]
    assert shown == ["DD Mon YYYY", None, "MM/DD/YYYY", "DD/MM/YY", "YYYY-MM-DD", None, "Mon DD YYYY", "DD-Mon-YYYY", None, None]
    found = clusters([("Panamá", 2), ("panama", 1), ("Colombia", 3), ("Columbia", 1)])
    assert [(c["canonical"], c["count"]) for c in found] == [("Colombia", 4), ("Panamá", 3)]
    path = tmp_path / "a.csv"
    path.write_text('id,note\n1,"a\nb\nc"\n2,x\n')
    assert [r.line for r in record_lines(spark, str(path)).orderBy("row").collect()] == [2, 5]


@pytest.mark.parametrize("config, told", [({"steps": []}, "non-empty"), ({"steps": [{"op": "dedup"}]}, "unknown op"), ({"steps": [{"op": "handle_outliers"}]}, "missing required"), ({"steps": [{"op": "deduplicate", "keeep": "first"}]}, "Did you mean 'keep'"), ({"steps": [{"op": "coerce_types", "mapping": {"a": "intt"}}]}, "not a known type"), ({"steps": [{"op": "deduplicate", "subset": 3}]}, "column name or a list"), ({"steps": [{"op": "coerce_types", "on_fraction": None}]}, "bare null")])
def test_bad_steps(config, told):
    with pytest.raises(ValueError, match=told):
        check_steps(config)


def test_cli(spark, messy, tmp_path, capsys):
    steps, rules, out = (str(tmp_path / x) for x in ("s.yaml", "r.yaml", "o.csv"))
    assert cli.main(["suggest", messy, "--steps-out", steps, "--rules-out", rules], spark) == 0
    assert cli.main(["suggest", messy, "--steps-out", steps, "--rules-out", rules], spark) == 2
    assert cli.main(["run-pipeline", messy, "--steps", steps, "--out", out, "--audit", str(tmp_path / "a.json"), "--review-out", str(tmp_path / "v.csv")], spark) == 0
    assert (tmp_path / "v.csv").read_text().count("duplicate") == 1 and "client_id" in (tmp_path / "o.csv").read_text()
    (tmp_path / "own.yaml").write_text("columns: {Email: {regex: '@'}}\n")
    assert cli.main(["validate", messy, "--rules", str(tmp_path / "own.yaml")], spark) == 1
    assert "(line 5)" in capsys.readouterr().out
    assert cli.main(["profile", str(tmp_path / "none.csv")], spark) == 2
    for name, begin in (("p.html", "<!doctype html>"), ("p.json", "{"), ("p.md", "# Data profile")):
        assert cli.main(["profile", messy, "--out", str(tmp_path / name)], spark) == 0
        assert (tmp_path / name).read_text(encoding="utf-8").startswith(begin)
    (tmp_path / "broken.yaml").write_text("steps: [\n")
    assert cli.main(["run-pipeline", messy, "--steps", str(tmp_path / "broken.yaml")], spark) == 2
    assert "not valid YAML" in capsys.readouterr().err
    (tmp_path / "l1.csv").write_bytes("id,name\n1,Zo\xeb\n".encode("latin-1"))
    assert cli.main(["validate", str(tmp_path / "l1.csv"), "--rules", str(tmp_path / "own.yaml")], spark) == 2
    assert "--encoding" in capsys.readouterr().err


def test_two_reviews_and_a_named_output(spark, tmp_path, monkeypatch):
    path = tmp_path / "d.csv"
    path.write_text("id,name\n1,ana\n1,ana\n2,beto cruz\n3,beto cruzz\n")
    steps = tmp_path / "s.yaml"
    steps.write_text("steps:\n- {op: deduplicate}\n- {op: deduplicate, subset: name, fuzzy: true, threshold: 0.9}\n")
    review = tmp_path / "r.csv"
    assert cli.main(["run-pipeline", str(path), "--steps", str(steps), "--review-out", str(review)], spark) == 0
    lines = review.read_text().splitlines()
    assert [x.split(",")[:5] for x in lines[1:]] == [["1", "duplicate", "1", "3", "exact"], ["1", "kept", "0", "2", "exact"], ["2", "duplicate", "3", "5", "fuzzy"], ["2", "kept", "2", "4", "fuzzy"]]
    assert (tmp_path / "d_out.csv").read_text() == "id,name\n1,ana\n2,beto cruz\n"
    assert cli.main(["run-pipeline", str(path), "--steps", str(steps)], spark) == 2  # its name is taken


def test_regular_expressions_as_python_reads_them(spark):
    df = frame(spark, [("ab\n",), ("ab",), ("aa",), ("a\u2028b",), (None,)], "a string")
    for pattern, bad in (("b$", {2}), (r"b\Z", {0, 2}), (r"(?P<first_letter>a)(?P=first_letter)", {0, 1, 3}), ("a.b", {0, 1, 2}), (r"^(a)(?(1)b|c)", {2, 3}), (r"[[]|b", {2})):
        found = validate(df, {"columns": {"a": {"regex": pattern}}}).failures.collect()
        assert {r.row for r in found} == bad, pattern


def test_findings(spark):
    rows = [("1.000", "05/02/2023"), ("2,500", "13/02/2023"), ("7.250,50", "14/02/2023"), ("3", "bad"), ("4", "15/02/2023")]
    p = profile(frame(spark, rows, "amount string, day string"))
    amount, day = p.column("amount"), p.column("day")
    told = dict(zip(amount.codes, amount.issues))
    assert "'1.000' as 1000" in amount.issues[amount.codes.index("ambiguous")] and "separators" in told
    assert {"order", "dates"} <= {*day.codes} and day.details["dayfirst"]


def test_all_rows_vote(spark):
    rows = [(f"0{1 + i % 9}/02/2023", str(i)) for i in range(6000)] + [("25/02/2023", "x")]
    df = frame(spark, rows, "d string, n string")
    c = Cleaner(df).coerce_types({"d": "datetime"})
    assert "Day-first" in c.messages()[-1] and str(c.frame.orderBy(ROW).first().d) == "2023-02-01 00:00:00"


def greedy(pairs):
    """pairs: (row, kept_row, score). Rows in order: one that is like a kept row ahead of it is its duplicate."""
    near, out = {}, {}
    for row, kept, score in pairs:
        near.setdefault(row, []).append((score, -kept))
    for row in sorted(near):
        alive = [x for x in near[row] if -x[1] not in out]
        if alive:
            out[row] = -max(alive)[1]
    return out


@pytest.mark.parametrize("in_task", [7, 60, 100_000])
def test_visit_of_chains_hubs_and_others(spark, in_task):
    from tidemill.operators import dedup

    rng = random.Random(2)
    large = in_task == 100_000
    chain = [(i + 1, i) for i in range(2_000 if large else 120)]
    hub = [(10_000 + i, 5_500) for i in range(50_000 if large else 300)]
    loose = {tuple(sorted(rng.sample(range(5_000, 5_090), 2), reverse=True)) for _ in range(160)}
    pairs = [(a, b, rng.choice([0.9, 0.95])) for a, b in [*chain, *hub, *loose]]
    df = spark.createDataFrame([(*p, 0, 0) for p in pairs], "row long, kept_row long, score double, la long, ka long")
    if in_task == 7:
        df = df.filter("row < 40 OR row BETWEEN 5000 AND 9999")
        pairs = [p for p in pairs if p[0] < 40 or 5_000 <= p[0] < 10_000]
    got = {r.row for r in dedup._visited(df, in_task).collect()}
    assert got == {*greedy(pairs)}


def test_no_table_of_duplicates_goes_through_the_driver(spark, monkeypatch):
    """Their files may be small and their rows as many as the input's, so no join broadcasts them, nor is each chain a group of its own."""
    from tidemill.operators import cleaner, dedup, graph
    from tidemill.sources.storage import save

    plans, visits = [], []

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    for module in (cleaner, dedup, graph):
        monkeypatch.setattr(module, "save", recorded)
    deal = dedup._greedy_by
    monkeypatch.setattr(dedup, "_greedy_by", lambda pairs, unit, tasks: visits.append(tasks) or deal(pairs, unit, tasks))
    monkeypatch.setattr(dedup.fuzzy_pairs, "__defaults__", (8192, 50))
    base = ["".join(random.Random(i).choices("abcdefgh", k=30)) for i in range(60)]
    rows = [(t,) for b in base for t in (b, b[:27] + "zzz", b[:24] + "yyyzzz", b)]
    c = Cleaner(frame(spark, rows, "name string")).deduplicate("name", fuzzy=True, flag=True)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (c.frame, c.reviews[0])]
    assert {r[ROW]: r.duplicate_of for r in c.frame.collect() if r.is_duplicate} == {4 * i + k: 4 * i for i in range(60) for k in (1, 3)}
    assert c.reviews[0].count() == 120 and visits == [16]
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.88, 0.95, 1.0])
def test_similarity_join_finds_the_pairs_of_brute_force(spark, threshold):
    from tidemill.operators import dedup

    rng = random.Random(int(threshold * 100))
    texts = {"a", "ab", "aa", "aab", "abc", "abab", "a b", "ba", "aé"}
    while len(texts) < 160:
        old = rng.choice([*texts])
        i = rng.randrange(1, len(old) + 1)
        texts.add(rng.choice([old[:i] + rng.choice("ab c1") + old[i:], old[: i - 1] + old[i:] or "a", old + old[:i], old[:i] + rng.choice("abz") + old[i + 1 :]]).strip() or "a")
    texts = sorted(texts)
    rng.shuffle(texts)
    heads = spark.createDataFrame([(t[:1], t, 0, i, 0, i + 500 * (i % 5 == 0)) for i, t in enumerate(texts)], "block string, key string, a long, row long, last_a long, last_row long")
    want = set()
    for i, x in enumerate(texts):
        for j, y in enumerate(texts[:i]):
            if x[:1] == y[:1]:
                want |= {(i, j, False)} if SequenceMatcher(None, x, y).ratio() >= threshold else set()
                want |= {(j, i, True)} if j % 5 == 0 and j + 500 > i and SequenceMatcher(None, y, x).ratio() >= threshold else set()
    for tile in (10_000, 25):
        got = [(r.row, r.kept_row, r.back) for r in dedup.near_pairs(heads, threshold, tile).collect()]
        assert len(got) == len({*got}) and {*got} == want


@pytest.mark.parametrize("q, tile", [(2, 10_000), (3, 25), (4, 10_000)])
def test_similarity_join_by_grams_of_any_length(spark, q, tile):
    """Texts of other lengths, doubled grams, and characters that keys don't have."""
    from tidemill.operators import dedup

    rng = random.Random(q)
    texts = {"a", "ab", "aa", "aé", "a" * 40, "ab" * 20}
    while len(texts) < 200:
        old = rng.choice([*texts]) if rng.random() < 0.7 else "a" + "".join(rng.choices("abc12 ", k=rng.randrange(1, 45)))
        i = rng.randrange(1, len(old) + 1)
        texts.add(rng.choice([old, old[:i] + rng.choice("ab1") + old[i:], old[: i - 1] + old[i:] or "a", old[:i] + "zz" + old[i + 2 :]]).strip() or "a")
    texts = sorted(texts)
    rng.shuffle(texts)
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts[:i]) if x[:1] == y[:1] and SequenceMatcher(None, x, y).ratio() >= 0.8}
    heads = spark.createDataFrame([(t[:1], t, 0, i, 0, i) for i, t in enumerate(texts)], "block string, key string, a long, row long, last_a long, last_row long")
    got = [(r.row, r.kept_row) for r in dedup.near_pairs(heads, 0.8, tile, q).collect()]
    assert len(got) == len({*got}) and {*got} == want


def test_many_texts_are_met_in_small_buckets(spark, monkeypatch):
    """The length of grams follows from the buckets' sizes, so that near places of a gram are few among many texts."""
    from tidemill.operators import dedup

    taken = []
    scored = dedup._scored
    monkeypatch.setattr(dedup, "_TRIED", 1_000)
    monkeypatch.setattr(dedup, "_scored", lambda threshold, q, *more: taken.append(q) or scored(threshold, q, *more))
    rng = random.Random(4)
    texts = ["a" + "".join(rng.choices("0123456789abcdef", k=31)) for _ in range(40_000)]
    texts[3::10] = [t[:-1] + "z" for t in texts[2::10]]
    heads = spark.createDataFrame([("a", t, 0, i, 0, i) for i, t in enumerate(texts)], "block string, key string, a long, row long, last_a long, last_row long")
    assert {(r.row, r.kept_row) for r in dedup.near_pairs(heads, 0.9, 8192).collect()} == {(i, i - 1) for i in range(3, 40_000, 10)}
    assert taken[0] > 2


def test_spelling_clusters_equal_all_pairs(spark):
    from tidemill.functions.text import same_value

    rng = random.Random(8)
    names = ["".join(rng.choices("abcde", k=rng.randint(3, 8))) for _ in range(500)]
    words = list(dict.fromkeys(w for w in (rng.choice([x, x.upper(), x[:2] + x[3:], "Rep. de " + x, x[:1] + x[2:3] + x[1:2] + x[3:], x + rng.choice("ab1")]) for x in names * 3)))
    counts = [(w, rng.randint(1, 9)) for w in words]
    keys = sorted({clean_key_of(w) for w in words})
    got = {(c["canonical"], c["count"], tuple(map(tuple, c["variants"]))) for c in clusters(counts)}
    rows = spelling_clusters(spark.createDataFrame([(w, n, i) for i, (w, n) in enumerate(counts)], "v string, n long, at long")).collect()
    assert {(r.canonical, r["count"], tuple((x.value, x.n) for x in r.variants)) for r in rows} == got
    group = {w: i for i, (*_, variants) in enumerate(got) for w, _ in variants}
    alone = {k: k for k in keys}

    def root(k):
        while alone[k] != k:
            k = alone[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if root(a) != root(b) and same_value(a, b):
                alone[root(a)] = root(b)
    roots = {w: root(clean_key_of(w)) for w in words}
    assert len({*roots.values()}) == len(got) and len({(roots[w], group[w]) for w in words}) == len(got)


def test_types_of_many_columns_take_as_many_jobs_as_of_few(spark):
    def jobs(n):
        df = spark.range(50).select(F.col("id").alias(ROW), *((F.col("id") % (i + 2)).cast("string").alias(f"c{i}") for i in range(n)))
        spark.sparkContext.setJobGroup(f"types of {n}", "")
        try:
            infer_types(df)
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"types of {n}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert 0 < jobs(40) == jobs(3)
