import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions.quantiles import quantiles
from tidemill.functions import contacts, dates, numbers, text
from tidemill.sources.tables import ROW


def values(spark, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i long, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_numbers(spark):
    cases = {"1,234.56": 1234.56, "1.234,56": 1234.56, "$1,234": 1234.0, "(1234)": -1234.0, "50%": 0.5, "1e3": 1000.0, "12 years": None, "1 234,5": 1234.5, "": None, "N/A": None, "-5": -5.0, "(-5)": 5.0, "1.234.567": 1234567.0, "1,5": 1.5, "1,500": 1500.0, "1.000": 1.0, "+7": 7.0, "USD 3": 3.0, "B/. 2.50": 2.5, ".": None, "1'000": 1000.0, " 2_000 ": 2000.0}
    assert values(spark, cases, numbers.parse_number) == [*cases.values()]


@pytest.mark.parametrize("items, want", [(["1,250.00", "2.500,50", "1.000", "3,000"], [1250, 2500.5, 1000, 3000]), (["0.125", "1.500", "2.375"], [0.125, 1.5, 2.375]), (["1,5", "2,75", "1.000"], [1.5, 2.75, 1000]), (["1.000"], [1.0]), (["1,000"], [1000.0])])
def test_ambiguous_numbers_are_read_from_the_column(spark, items, want):
    df = spark.createDataFrame([*enumerate(items)], f"`{ROW}` long, v string")
    hints = numbers.read_columns(df, ["v"], ROW)["v"].hints
    assert [r[0] for r in df.orderBy(ROW).select(numbers.parse_number(F.col("v"), "string", hints)).collect()] == want


def test_booleans(spark):
    cases = {"Yes": True, " sí ": True, "x": True, "0": False, "No.": False, "n/a": None, "maybe": None, "OFF": False, "✓": True}
    assert values(spark, cases, numbers.parse_boolean) == [*cases.values()]


def test_dates(spark):
    d = datetime
    cases = {
        "2023-01-05": d(2023, 1, 5), "2023-01-05T10:30:00Z": d(2023, 1, 5, 10, 30), "2023-01-05 10:00:00+02:00": d(2023, 1, 5, 8), "13/02/2023": d(2023, 2, 13), "05/02/2023": d(2023, 2, 5), "12/31/2023": d(2023, 12, 31),
        "31/02/2023": None, "2024/3/5": d(2024, 3, 5), "2024.03.05": d(2024, 3, 5), "2024/13/05": None, "Jan 15 2023": d(2023, 1, 15), "Sept 5, 2023": d(2023, 9, 5), "15 Jan 2023": d(2023, 1, 15), "15-Jan-2023": d(2023, 1, 15), "Jan 2023": d(2023, 1, 1),
        "5": None, "20230105": None, "1000": None, "15-06-2023 10:30 PM": d(2023, 6, 15, 22, 30), "5 de may 2023": None, "x": None,
    }
    assert values(spark, cases, lambda c: dates.parse_date(c, True)) == [*cases.values()]
    assert values(spark, ["05/02/2023", "13/02/2023"], lambda c: dates.parse_date(c, False)) == [d(2023, 5, 2), d(2023, 2, 13)]


def test_emails(spark):
    got = values(spark, [" JUAN@GMIAL.con ", "mailto:a@yahooo.com", "<a@b.example>", "vrojasgmail.com", "a@ymail.com", "  ", "a b@hotmail.cm"], contacts.email)
    assert [g and tuple(g) for g in got] == [("juan@gmail.com", True, True, None), ("a@yahoo.com", True, True, None), ("a@b.example", True, False, None), ("vrojasgmail.com", False, False, "vrojas@gmail.com"), ("a@ymail.com", True, False, None), None, ("ab@hotmail.com", True, True, None)]


@pytest.mark.parametrize(
    "raw, region, value, valid",
    [("6123-4567", "PA", "+50761234567", True), ("507 6123 4567", "PA", "+50761234567", True), ("+52 1 55 1234 5678", "PA", "+525512345678", True), ("0099887766", "PA", "+99887766", False), ("3105551234", "CO", "+573105551234", True), ("+593 0 991234567", "PA", "+593991234567", True), ("305-555-0199 ext. 12", "US", "+13055550199;ext=12", True), ("12", "PA", "+50712", False), ("n/a", "PA", None, False)],
)
def test_phones(spark, raw, region, value, valid):
    df = spark.createDataFrame([(raw, region), (None, None)], "raw string, region string")
    p, none = (r.p for r in contacts.with_phones(df, F.col("raw"), F.col("region"), region, "p").collect())
    assert (p.value, p.valid) == (value, valid)
    assert tuple(none) == (None, None, None, None, region, None)


def test_phones_by_detours(spark):
    rows = [("+507 6123-4567", "MX"), ("61234567", "MX"), ("5215512345678", "PA"), ("0099887766", "PA"), ("+50761234 ext 567", "PA"), ("ext. 5", "PA"), ("809 012 3456", "US"), (" N/A ", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, region string")
    found = contacts.with_phones(df, F.col("raw"), F.col("region"), "PA", "p")
    assert not {"Python", "Pandas", "Arrow"} & {w for w in ("Python", "Pandas", "Arrow") if w in found._jdf.queryExecution().executedPlan().toString()}
    got = [(r.p.value, r.p.valid, r.p.region, r.p.via) for r in found.orderBy("i").collect()]
    other, default = "international without '+'", "default region"
    assert got == [("+50761234567", True, "PA", None), ("+50761234567", True, "PA", default), ("+525512345678", True, "MX", other), ("+99887766", False, None, None), ("+50761234567", True, "PA", other), (None, False, None, None), ("+18090123456", True, "DO", None), (None, False, None, None)]


def test_regions_names_addresses():
    assert [contacts.region_of(x) for x in ("Rep. de Panamá", "méxico", "CO", "Columbia", "Nowhere", None)] == ["PA", "MX", "CO", "CO", None, None]
    with pytest.raises(ValueError, match="unknown phone region"):
        contacts.known_region("XX")
    names = {"  JUAN   de la CRUZ ": "Juan de la Cruz", "maría josé": "María José", "o'brien": "O'Brien", "mcdonald": "McDonald", "jean-paul": "Jean-Paul", "j.r. smith": "J.R. Smith", "de la torre": "De la Torre", " ": None}
    assert {k: contacts.name_of(k) for k in names} == names
    addresses = {"ave balboa , edif 12b": "Avenida Balboa, Edificio 12B", "CRA 7 NO 12": "Carrera 7 No. 12", "PH Ocean, apto 3": "PH Ocean, Apartamento 3", "calle 5TA, CDMX": "Calle 5ta, CDMX", ", ,": None}
    assert {k: contacts.address_of(k) for k in addresses} == addresses


def test_text():
    assert text.key_of("Rep. de Panamá") == "rep de panama" and text.without_noise("rep de panama") == "panama"
    assert text.same_value("colombia", "columbia") and not text.same_value("item 1", "item 2") and text.same_value("mexico", "mexcio")
    assert not text.one_edit("abc", "cba") and text.one_edit("abcd", "abdc") and text.one_edit("abc", "abxc")
    assert text.snake_case_all(["Name", "name", "name_1"]) == ["name", "name_2", "name_1"]
    assert [text.snake_case(x) for x in ("Balance (USD)", "customerID", "2nd Línea", "%%", "HTTPServer")] == ["balance_usd", "customer_id", "col_2nd_linea", "column", "http_server"]
    assert text.normalised("a  b​ ") == "a b" and text.normalised(" \t ") is None and text.normalised("ﬁ") == "fi"


@pytest.mark.parametrize("in_memory, bins", [(1_000_000, 1024), (10, 4), (10, 1024)])
def test_quantiles_are_exact(spark, in_memory, bins):
    rng = random.Random(3)
    rows = [(rng.choice([rng.gauss(0, 1e6), float(rng.randrange(5)), 1e300, -1e300]), float(i % 3), None, 7.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, df.columns, shares, in_memory, bins)
    for i, c in enumerate("abd"):
        values = sorted(r["abcd".index(c)] for r in rows)
        assert np.allclose(got[c], np.quantile(values, shares), rtol=1e-12), c
    assert got["c"] is None


def test_dates_at_the_edges(spark):
    cases = {
        "29/02/2024": "2024-02-29",
        "29/02/2023": None,
        "29/02/1900": None,
        "31/04/2023": None,
        "12/31/2023": "2023-12-31",
        "05/02/2023": "2023-02-05",
        "2023.13.05": None,
        "2023/2/28 11:05 pm": "2023-02-28 23:05:00",
        "2023-02-28 12:00 am": "2023-02-28",
        "March 3, 2021": "2021-03-03",
        "3 MAR 2021": "2021-03-03",
        "2023-02-28T10:00:00+02:00": "2023-02-28 08:00:00",
        "2023-02-30": None,
        "no date": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(k, v if v is None or " " in v else f"{v} 00:00:00") for k, v in cases.items()], "v string, want string")
    got = rows.select("v", "want", dates.parse_date(F.col("v"), True).cast("string").alias("got"), dates.parse_date(F.col("v"), False).cast("string").alias("other")).collect()
    assert [(r.v, r.got) for r in got] == [(r.v, r.want) for r in got]
    assert {r.v: r.other for r in got}["05/02/2023"] == "2023-05-02 00:00:00"


def test_numbers_by_hints(spark):
    texts = ["1.000", "1,000", "0.500", "1.234,5", "1,234.5", "1.234.567", "12,5", "1,2,3", "(1,000)", "-0", "5 %", "US$ 3", "1.2.3", "x", "", None]
    none = [1.0, 1000.0, 0.5, 1234.5, 1234.5, 1234567.0, 12.5, 123.0, -1000.0, 0.0, 0.05, 3.0, None, None, None, None]
    swapped = [1000.0, 1.0, 0.5, 1234.5, 1234.5, 1234567.0, 12.5, 123.0, -1.0, 0.0, 0.05, 3.0, None, None, None, None]
    df = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1)
    for hints, want in (((None, None), none), ((".", "."), none), ((",", ","), swapped)):
        assert [r[0] for r in df.select(numbers.parse_number(F.col("v"), hints=hints)).collect()] == want
