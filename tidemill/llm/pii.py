"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

DataFrame functions only. Offsets are code points, ends exclusive. Matches are
found without a cursor: the texts of all matches and the gaps between them have
the same order, so running sums of their lengths are the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which kinds are listed. `\G` and the look-behind keep a search
#: from starting anew within a run of characters that it has already read; the
#: possessive quantifiers change no match, as nothing follows that could need
#: what they hold.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: How long IBANs are, by country.
IBAN_LENGTHS = {
    15: ("NO",),
    16: ("BE",),
    18: ("DK", "FI", "FK", "FO", "GL", "NL", "SD"),
    19: ("MK", "SI"),
    20: ("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"),
    21: ("CH", "HR", "LI", "LV"),
    22: ("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"),
    23: ("AE", "GI", "IL", "IQ", "OM", "SO", "TL"),
    24: ("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"),
    25: ("LY", "PT", "ST"),
    26: ("IS", "TR"),
    27: ("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"),
    28: ("AL", "AZ", "BY", "CY", "DO", "GT", "HN", "HU", "LB", "NI", "PL", "SV"),
    29: ("BR", "EG", "PS", "QA", "UA"),
    30: ("JO", "KW", "MU", "YE"),
    31: ("MT", "SC"),
    32: ("LC",),
    33: ("RU",),
}
_COUNTRIES = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes)
#: An IBAN at a text's start: as long as its country's are, or as long as it goes.
_IBAN = (
    "^(?:"
    + "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
    + rf"|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
)
MORE = {
    # Where one may start; _IBAN tells where it ends.
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}(?=[0-9]{2}(?:\x20?[A-Z0-9]){11})",
    "secret": r"(?i)(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20?[:=]\x20?[\"']?[A-Za-z0-9_/+.-]{16,}+[\"']?",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # Runs of groups of digits, as the base pattern's; _cards looks for numbers in them.
    "account": BASE["card"],
}
#: Sizes of groups in which card numbers are written.
_LAYOUTS = r"^(?:1[3-9]|4,4,4,4|4,4,4,4,[1-3]|4,4,4,[1-3]|4,6,[45]|6,1[0-3]|4,4,5|4,3,3,3)$"
KINDS = (*BASE, *MORE)
#: Words that speak for a kind when they stand near.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|master|credit|debit|payment|pay",
    "phone": "phone|tel|call|mobile|cell|fax",
    "iban": "iban|bank|account|transfer|konto|cuenta|compte",
    "secret": "token|secret|password|key",
    "ssn": "ssn|social|security|insurance|tax",
    "account": "card|visa|master|credit|debit|payment|pay|account",
}
#: Score by pattern and checksum alone, and what context words add.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "secret": 0.6, "ssn": 0.3, "account": 0.5}
#: An account number whose digits are grouped like no card's.
ODD_LAYOUT = 0.3
NEAR, BONUS, LEAST = 40, 0.2, 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the text of digits pass Luhn's check?"""
    n = F.length(digits)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    value = lambda i: F.coalesce(F.substr(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Does the account number pass ISO 7064's mod-97 check?"""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    letters = F.split(turned, "")

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, s: Column) -> Column:
    digits = _digits(s)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(s)
    return F.lit(True)


#: Values in a run of a prefix sum, and code points in a chunk of a text.
_RUN, _CHUNK = 128, 512


def _let(value: Column, then) -> Column:
    """then(value), the value found once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _ends(sizes: Column) -> Column:
    """Running sums of an array, by runs of _RUN values, so that no array grows value by value to its full length."""

    def summed(values: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(values, begin, add, lambda acc: acc["out"])

    def joined(runs: Column) -> Column:
        before = summed(F.transform(runs, lambda r: F.element_at(r, -1)))
        return F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.when(i > 0, F.get(before, i - 1)).otherwise(0))))

    def cut(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int"))
        return _let(F.transform(starts, lambda k: summed(F.slice(values, k * _RUN + 1, F.lit(_RUN)))), joined)

    return F.when(F.size(sizes) > 0, _let(sizes, cut)).otherwise(F.array().cast("array<int>"))


def _chunked(text: Column) -> Column:
    """A text cut once in chunks, from which parts are taken without counting from its head."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, end: Column) -> Column:
    """The text from one offset to another, start being no negative number."""
    first = F.floor(start / _CHUNK).cast("int")
    n = F.greatest(F.floor((end - 1) / _CHUNK).cast("int") - first + 1, F.lit(0))
    return F.substr(F.array_join(F.slice(chunks, first + 1, n), ""), start - first * _CHUNK + 1, F.greatest(end - start, F.lit(0)))


def _placed(text: Column, pattern: str) -> Column:
    """(start, end, match) of a pattern's matches, leftmost and without overlaps."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def at(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
        ends = _ends(F.zip_with(gaps, found, lambda g, m: g + F.length(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    return _let(matches, at)


def _ibans(text: Column, chunks: Column, pattern: str) -> Column:
    """(start, end, match) at each place where one may start, as long as it can be one."""

    def whole(m: Column) -> Column:
        match = F.regexp_extract(_part(chunks, m["start"], m["start"] + 70), _IBAN, 0)
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(match)).alias("end"), match.alias("match"))

    return F.filter(F.transform(_placed(text, pattern), whole), lambda m: m["match"] != "")


_WINDOWS = "array<struct<start:int,end:int,match:string,usual:boolean>>"


def _cards(text: Column, chunks: Column, pattern: str) -> Column:
    """(start, end, match, usual) of numbers that pass Luhn's check in runs that don't as a whole.

    Every window of 13 to 19 digits that starts and ends at borders of a run's
    groups is tried. Of those that overlap, usual layouts go first, then what
    starts first, then the longest.
    """

    def windows(run: Column) -> Column:
        def at(groups: Column) -> Column:
            def wide(g: Column, i: Column) -> Column:
                def made(k: Column) -> Column:
                    part = F.slice(groups, i + 1, k)
                    layout = F.array_join(F.transform(part, lambda x: F.length(x["match"]).cast("string")), ",")
                    return F.struct(
                        (run["start"] + g["start"]).alias("start"),
                        (run["start"] + F.get(groups, i + k - 1)["end"]).alias("end"),
                        F.array_join(F.transform(part, lambda x: x["match"]), "").alias("match"),
                        layout.rlike(_LAYOUTS).alias("usual"),
                    )

                most = F.least(F.size(groups) - i, F.lit(19))
                tried = F.transform(F.sequence(most, F.lit(1), F.lit(-1)), made)
                return F.filter(tried, lambda w: F.when(F.length(w["match"]).between(13, 19), luhn(w["match"])).otherwise(False))

            return _apart(F.flatten(F.transform(groups, wide)))

        return _let(_placed(run["match"], "[0-9]+"), at)

    runs = F.filter(_placed(text, pattern), lambda m: (F.length(_digits(m["match"])) >= 13) & ~_valid("card", m["match"]))
    return F.flatten(F.transform(runs, windows))


def _apart(windows: Column) -> Column:
    """Windows (by start, longest first) that don't overlap, those of usual layouts before others."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_WINDOWS).alias("out"))

    def step(acc: Column, w: Column) -> Column:
        return F.when(w["start"] >= acc["at"], F.struct(w["end"].alias("at"), F.concat(acc["out"], F.array(w)).alias("out"))).otherwise(acc)

    taken = lambda ws: F.aggregate(ws.cast(_WINDOWS), start, step, lambda acc: acc["out"])

    def both(ws: Column) -> Column:
        def rest(usual: Column) -> Column:
            free = F.filter(ws, lambda w: ~w["usual"] & ~F.exists(usual, lambda u: (u["start"] < w["end"]) & (w["start"] < u["end"])))
            return F.concat(usual, taken(free))

        return _let(taken(F.filter(ws, lambda w: w["usual"])), rest)

    return _let(windows, both)


_SPAN = "array<struct<start:int,number:int,end:int,kind:string,base:boolean,score:double>>"


def _spans(text: Column, chunks: Column, kind: str, pattern: str) -> Column:
    """The kind's confirmed spans with their scores."""
    base = kind in BASE

    def scored(m: Column) -> Column:
        around = F.lower(_part(chunks, F.greatest(m["start"] - NEAR, F.lit(0)), m["start"]))
        after = F.lower(_part(chunks, m["end"], m["end"] + NEAR))
        near = around.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind])
        if kind == "secret":
            near = F.lit(True)
        sure = F.when(m["usual"], SCORES[kind]).otherwise(ODD_LAYOUT) if kind == "account" else F.lit(SCORES[kind])
        score = F.least(F.lit(1.0), sure + F.when(near, BONUS).otherwise(0.0))
        # An account number that base cards have is not told twice.
        name = "card" if kind == "account" else kind
        return F.struct(m["start"].alias("start"), F.lit(KINDS.index(name)).alias("number"), m["end"].alias("end"), F.lit(name).alias("kind"), F.lit(base).alias("base"), score.alias("score"))

    own = {"iban": _ibans, "account": _cards}.get(kind)
    placed = own(text, chunks, pattern) if own else _placed(text, pattern)
    found = F.transform(F.filter(placed, lambda m: _valid(kind, m["match"])), scored)
    return found if base else F.filter(found, lambda s: s["score"] >= LEAST)


#: What a text must have for a kind's pattern to be worth a search.
_HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]"),
    "secret": lambda t: t.rlike("[:=]") & t.rlike("(?i)token|secret|passw|key"),
    "ssn": lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"),
    "account": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"),
}


def with_spans(docs: DataFrame, text: str, column: str) -> DataFrame:
    """docs and the sorted spans of a text column.

    Base spans are all kept; others stay if they score LEAST or more and don't
    lie within a base span. A null text has none. docs may have columns of any
    names but `column`.
    """
    names, of = [*docs.columns], F.coalesce(F.col("text__"), F.lit(""))
    at = [c.lower() for c in names].index(text.lower())
    held = docs.toDF(*(f"c_{i}" for i in range(len(names)))).withColumn("text__", F.col(f"c_{at}").cast("string"))
    hints = {k: _HINT[k](of) for k in (*BASE, *MORE)}
    some = F.array(*hints.values())
    held = held.withColumn("hints__", some)
    none = F.array().cast("array<string>")
    held = held.withColumn("chunks__", F.when(F.exists("hints__", lambda h: h), _chunked(of)).otherwise(none))
    cells = [F.when(F.get("hints__", F.lit(i)), _spans(of, F.col("chunks__"), k, p)).otherwise(F.array().cast(_SPAN)).cast(_SPAN).alias(f"found_{k}") for i, (k, p) in enumerate((BASE | MORE).items())]
    found = held.select("*", *cells)
    base = F.concat(*(F.col(f"found_{k}") for k in BASE))
    more = F.filter(F.concat(*(F.col(f"found_{k}") for k in MORE)), lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return found.select(*(f"c_{i}" for i in range(len(names))), F.array_sort(F.concat(base, more)).alias("spans__")).toDF(*names, column)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of start, number, end, kind, base, score) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(rows, "text", "spans").drop("text")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    # Runs of overlapping spans: those that start behind all ends ahead of them.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        last = F.element_at(acc["out"], -1)
        wider = F.struct(last["start"].alias("start"), s["end"].alias("end"), last["kind"].alias("kind"))
        joined = F.when(s["end"] > acc["at"], F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(wider))).otherwise(acc["out"])
        out = F.when((F.size(acc["out"]) == 0) | (s["start"] >= acc["at"]), F.concat(acc["out"], F.array(span))).otherwise(joined)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def told(runs: Column, chunks: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            return F.concat(_part(chunks, F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        return F.concat(F.array_join(F.transform(runs, piece), ""), _part(chunks, F.element_at(runs, -1)["end"], F.length(text)))

    done = _let(F.aggregate(spans, begin, step, lambda acc: acc["out"]), lambda runs: _let(_chunked(text), lambda chunks: told(runs, chunks)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    rows = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    rows = rows.select("doc_id", "spans", base.alias("base"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
