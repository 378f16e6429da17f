"""Registered queries over columns of made-up values, each with the SQL that states what has to come out."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.cleaner import Cleaner
from tidemill.operators.profiling import profile
from tidemill.operators.validation import validate
from tidemill.plans.catalog import messy, register
from tidemill.plans.pipeline import content_hash, run_pipeline
from tidemill.plans.suggest import suggest
from tidemill.sources.tables import ROW


def _literal(v: Any) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int | float) else f"'{v}'"


def pick(key: str, values: list, kind: str = "VARCHAR(40)") -> str:
    """An SQL expression that deals values out by key, for both engines."""
    cases = " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values))
    return f"CAST(CASE CAST({key} % {len(values)} AS INT) {cases} END AS {kind})"


def text(key: str, values: list) -> str:
    return pick(key, values, "STRING")


def rows(names: str, values: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, v)) + ')' for v in values)}) t({names})"


# Contacts.

NAMES = {"  JUAN   de la CRUZ ": "Juan de la Cruz", "maría josé": "María José", "mcdonald": "McDonald", "jean-paul": "Jean-Paul", "j.r. smith": "J.R. Smith", "de la torre": "De la Torre", "VAN DEN BERG": "Van den Berg", "ana": "Ana"}
ADDRESSES = {"ave balboa , edif 12b": "Avenida Balboa, Edificio 12B", "CRA 7 NO 12": "Carrera 7 No. 12", "PH Ocean, apto 3": "PH Ocean, Apartamento 3", "calle 5TA, CDMX": "Calle 5ta, CDMX"}
#: Phone, country, result, is it invalid.
PHONES = [
    ("+52 1 55 1234 5678", "Panamá", "+525512345678", False),
    ("3105551234", "Columbia", "+573105551234", False),
    ("305-555-0199 ext. 12", "EEUU", "+13055550199;ext=12", False),
    ("6123-4567", "Rep. de Colombia", "+50761234567", False),
    ("34 612 345 678", "panama", "+34612345678", False),
    ("12", "Nowhere", "12", True),
]


@register(f"SELECT c_custkey, {pick('c_custkey', [*NAMES.values()])} AS name FROM customer")
def standardize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "customer", "c_custkey", name=text("c_custkey", [*NAMES])).standardize_names("name").df


@register(f"SELECT c_custkey, {pick('c_custkey', [*ADDRESSES.values()])} AS address FROM customer")
def clean_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "customer", "c_custkey", address=text("c_custkey", [*ADDRESSES])).clean_addresses("address").df


@register(f"SELECT c_custkey, {pick('c_custkey', [p[2] for p in PHONES])} AS phone, c_custkey % 6 = 5 AS phone_is_invalid FROM customer")
def phones_by_detour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row's country (with typos and noise), then the default region, then bare international numbers."""
    c = messy(spark, sf_dir, "customer", "c_custkey", phone=text("c_custkey", [p[0] for p in PHONES]), country=text("c_custkey", [p[1] for p in PHONES]))
    return c.standardize_phones("phone", region_column="country", invalid="flag").df.drop("country")


@register("SELECT c_custkey AS \"row\", 'c' || c_custkey || '@hotmail.com' AS suggestion FROM customer WHERE c_custkey % 5 = 3 ORDER BY c_custkey LIMIT 20")
def email_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's suggestions for addresses without @; made, never applied."""
    mail = "CASE WHEN c_custkey % 5 = 3 THEN concat('c', c_custkey, 'hotmail.com') ELSE concat('c', c_custkey, '@shop.example.org') END"
    c = messy(spark, sf_dir, "customer", "c_custkey", mail=mail).standardize_emails("mail")
    return spark.createDataFrame([(e["row"], e["suggestion"]) for e in c.log[-1]["invalid_examples"]], "row long, suggestion string")


# Numbers and types.


@register(f"SELECT o_orderkey, {pick('o_orderkey', [1000.0, 2500.75, 7.0], 'DOUBLE')} AS a, {pick('o_orderkey', [1.25, 0.125, 12.5], 'DOUBLE')} AS b, {pick('o_orderkey', [1250.0, 3.5, 8.0], 'DOUBLE')} AS c FROM orders")
def ambiguous_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values like 1.000 are read as their column's others show."""
    columns = {"a": ["1.000", "2.500,75", "7"], "b": ["1.250", "0.125", "12.500"], "c": ["1,250", "3,5", "8"]}
    return messy(spark, sf_dir, "orders", "o_orderkey", **{k: text("o_orderkey", v) for k, v in columns.items()}).coerce_types(dict.fromkeys(columns, "float")).df


@register(f"SELECT p_partkey, {pick('p_partkey', ['small', None, 'x y', None])} AS note, {pick('p_partkey', [1, None, 3, -4], 'BIGINT')} AS n FROM part")
def coerce_text_and_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messy(spark, sf_dir, "part", "p_partkey", note=text("p_partkey", ["small", "N/A", "x y", " ? "]), n=text("p_partkey", ["1", "2.5", "3.0", "(4)"]))
    return c.coerce_types({"note": "string", "n": "integer"}, on_fraction="nullify").df


@register("SELECT 'n' AS name, count(*) FILTER (p_partkey % 4 = 0) AS unparsed FROM part UNION ALL SELECT 'd', count(*) FILTER (p_partkey % 4 = 1) FROM part")
def coercion_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values the log says could not be parsed."""
    c = messy(spark, sf_dir, "part", "p_partkey", n=text("p_partkey", ["abc", "1", "N/A", "2,5"]), d=text("p_partkey", ["2023-01-05", "31/02/2023", None, "5 Jan 2023"]))
    c.coerce_types({"n": "float", "d": "datetime"})
    return spark.createDataFrame([(e["columns"][0], e["unparsed"]) for e in c.log if "unparsed" in e], "name string, unparsed long")


@register(f"""SELECT p_partkey, {pick('p_partkey', [True, False, True, False], 'BOOLEAN').replace("'True'", 'true')} AS b, {pick('p_partkey', [5, 3, 7, 3], 'BIGINT')} AS n,
{pick('p_partkey', ['2023-01-05', '2023-02-06', '2023-01-05', '2023-02-06'], 'TIMESTAMP')} AS d FROM part""".replace("THEN True", "THEN true").replace("THEN False", "THEN false"))
def fill_typed_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messy(spark, sf_dir, "part", "p_partkey", b=text("p_partkey", ["yes", "no", None, "off"]), n=text("p_partkey", ["5", None, "7", "N/A"]), d=text("p_partkey", [None, "6 Feb 2023", "2023/1/5", "2023-02-06 00:00"]))
    c.coerce_types({"b": "boolean", "n": "integer", "d": "datetime"})
    return c.handle_missing("fill", "b", "Yes").handle_missing("fill", "n", "2.5").handle_missing("fill", "d", "2023-01-05").df


# Outliers.

_SPREAD = "CASE WHEN p_partkey % 97 = 0 THEN 5000 WHEN p_partkey % 89 = 0 THEN -700 ELSE p_size END"


@register(f"""WITH t AS (SELECT p_partkey, CAST({_SPREAD} AS BIGINT) AS v FROM part), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM t),
f AS (SELECT ceil(a - 1.5 * (b - a)) AS low, floor(b + 1.5 * (b - a)) AS high FROM q)
SELECT p_partkey, CAST(least(greatest(v, low), high) AS BIGINT) AS v, least(greatest(v, low0), high0) AS w FROM t, f, (SELECT a - 1.5 * (b - a) AS low0, b + 1.5 * (b - a) AS high0 FROM q)""")
def cap_integers_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences of whole numbers are whole; a text column of numbers becomes one of numbers."""
    c = messy(spark, sf_dir, "part", "p_partkey", v=f"CAST({_SPREAD} AS BIGINT)", w=f"CAST({_SPREAD} AS STRING)")
    return c.handle_outliers(["v", "w"], action="cap").df


# Duplicates.

_HASHED = "CASE WHEN c_custkey % 10 = 3 THEN concat(substring(md5(CAST(c_custkey - 1 AS VARCHAR(20))), 1, 31), 'z') ELSE md5(CAST(c_custkey AS VARCHAR(20))) END"


@register("SELECT c_custkey AS \"row\", c_custkey - 1 AS kept_row, 'fuzzy' AS match, CAST(0.9688 AS DOUBLE) AS score FROM customer WHERE c_custkey % 10 = 3")
def fuzzy_duplicates_of_known_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth name is the one ahead of it with its last of 32 letters changed."""
    c = messy(spark, sf_dir, "customer", "c_custkey", name=_HASHED.replace("VARCHAR(20)", "STRING")).deduplicate("name", fuzzy=True, threshold=0.9, flag=True)
    return c.reviews[0].select("row", "kept_row", "match", "score")


@register("""SELECT p_partkey AS "row", first_value(p_partkey) OVER w AS kept_row, p_type AS type, first_value(p_type) OVER w AS kept_type
FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey) QUALIFY row_number() OVER w > 1""")
def duplicate_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the values of both rows."""
    c = messy(spark, sf_dir, "part", "p_partkey", brand="p_brand", size="p_size", type="p_type").deduplicate(["brand", "size"])
    return c.reviews[0].select("row", "kept_row", F.col("values.type").alias("type"), F.col("kept_values.type").alias("kept_type"))


# Rules.

_OPS = {"<": "<", "<=": "<=", ">": ">", ">=": ">=", "==": "=", "!=": "<>"}


@register(" UNION ALL ".join(f"SELECT '{op}' AS rule, count(*) AS n FROM part WHERE NOT (p_size {sql} p_partkey % 50 + 1)" for op, sql in _OPS.items()))
def validate_every_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messy(spark, sf_dir, "part", "p_partkey", size="p_size", bound="CAST(p_partkey % 50 + 1 AS STRING)")
    checks = [{"name": op, "left": "size", "op": op, "right": "bound"} for op in _OPS]
    return validate(c.frame, {"checks": checks}).failures.groupBy("rule").agg(F.count("*").alias("n"))


_KINDS = {"integer": ["1", "2.0", "2.5", "x"], "float": ["1", "2,5", "$3", "x"], "boolean": ["yes", "0", "maybe", "FALSE"], "date": ["2023-01-05", "5 Jan 2023", "31/02/2023", "x"]}
_BAD = {"integer": (2, 3), "float": (3,), "boolean": (2,), "date": (2, 3)}


@register(" UNION ALL ".join(f"SELECT '{k}.dtype' AS rule, count(*) AS n FROM part WHERE p_partkey % 4 IN {b if len(b) > 1 else f'({b[0]})'}" for k, b in _BAD.items()))
def validate_every_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messy(spark, sf_dir, "part", "p_partkey", **{k: text("p_partkey", v) for k, v in _KINDS.items()})
    return validate(c.frame, {"columns": {k: {"dtype": k} for k in _KINDS}}).failures.groupBy("rule").agg(F.count("*").alias("n"))


@register("SELECT 'size.max' AS rule, 1 AS n UNION ALL SELECT 'gone.exists', 1 UNION ALL SELECT 'odd', 1 UNION ALL SELECT 'half', 1 UNION ALL SELECT 'size.range', count(*) FROM part WHERE p_size > 45")
def validate_malformed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown rules, absent columns and checks that can't be made are failures of their own, in the report's summary."""
    c = messy(spark, sf_dir, "part", "p_partkey", size="p_size")
    rules = {"columns": {"size": {"max": 3, "range": {"max": 45}}, "gone": {"not_null": True}}, "checks": [{"name": "odd", "left": "size", "op": "~", "right": 3}, {"name": "half", "left": "size", "op": "<"}]}
    return spark.createDataFrame([*validate(c.frame, rules).by_rule.items()], "rule string, n long")


@register('SELECT p_partkey AS "row", p_partkey * 3 + 2 AS line, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size < 3')
def validate_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messy(spark, sf_dir, "part", "p_partkey", size="p_size")
    lines = c.frame.select(F.col(ROW).alias("row"), (F.col(ROW) * 3 + 2).alias("line"))
    return validate(c.frame, {"columns": {"size": {"range": {"min": 3}}}}, lines).failures.select("row", "line", "value")


@register("SELECT count(*) FILTER (p_partkey % 4 = 2) AS n_text, count(*) FILTER (p_partkey % 4 = 1) AS n_literal FROM part")
def validate_literals_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side that names no column is a literal, read as the other side's kind; mixed kinds are compared as texts."""
    c = messy(spark, sf_dir, "part", "p_partkey", code=text("p_partkey", ["b", "a", "z", "10"]), day=text("p_partkey", ["2023-01-05", "04/01/2024", "5 Jan 2023", None]))
    found = validate(c.frame, {"checks": [{"name": "text", "left": "code", "op": "<", "right": "c"}, {"name": "literal", "left": "day", "op": "<=", "right": "2023-12-31"}]}).by_rule
    return spark.createDataFrame([(found.get("text", 0), found.get("literal", 0))], "n_text long, n_literal long")


# Profiles and suggestions.

#: Name, values by key, type, role, kinds of findings.
COLUMNS = [
    ("Client Key", None, "integer", "identifier", []),
    ("Amount", ["$1,200.50", "1100.4", "1000", "1300"], "float", None, ["separators", "separators"]),
    ("Joined", ["2023-01-05", "13/02/2023", "14/02/2023", "15/02/2023"], "datetime", None, ["formats", "order"]),
    ("Active", ["yes", "no", "Y", "N"], "boolean", None, ["spellings"]),
    ("Mail", ["a@gmial.com", "b@x.example", "c@x.example", "d@x.example"], "email", None, ["addresses"]),
    ("Phone", ["6123-4567", "+507 6123-4568", "61234569", "(507) 6123 4560"], "phone", None, ["layouts", "layouts"]),
    ("Country", ["Panamá", "panama", "Colombia", "Columbia"], "categorical", "country", ["variants", "variants"]),
    ("Full Name", ["ANA ruiz", "beto cruz", "Carla Paz", "Dan Roy"], "categorical", "person_name", ["casing"]),
    ("Empty", [None, None, None, None], "empty", None, ["empty"]),
]


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.selectExpr(f"c_custkey AS `{ROW}`", *(f"{text('c_custkey', v) if v else 'CAST(c_custkey AS STRING)'} AS `{name}`" for name, v, *_ in COLUMNS))


@register(rows("name, kind, role", [(c[0], c[2], c[3]) for c in COLUMNS]))
def profile_types_and_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c.name, c.inferred_type, c.semantic) for c in profile(_profiled(spark, sf_dir)).columns], "name string, kind string, role string")


@register(rows("name, code", [(c[0], code) for c in COLUMNS for code in c[4]]))
def profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c.name, code) for c in profile(_profiled(spark, sf_dir)).columns for code in c.codes], "name string, code string")


@register("""SELECT 'Panamá' AS canonical, count(*) FILTER (c_custkey % 4 IN (0, 1)) AS n, CAST(2 AS BIGINT) AS spellings FROM customer
UNION ALL SELECT 'Colombia', count(*) FILTER (c_custkey % 4 IN (2, 3)), 2 FROM customer""")
def profile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The canonical spelling is the most frequent one; a third of the others become it, whatever the keys.
    value = "CASE WHEN c_custkey % 12 IN (1, 5) THEN 'panama' WHEN c_custkey % 4 IN (0, 1) THEN 'Panamá' WHEN c_custkey % 12 IN (3, 7) THEN 'Columbia' ELSE 'Colombia' END"
    found = profile(messy(spark, sf_dir, "customer", "c_custkey", country=value).frame.select(ROW, "country")).column("country").clusters
    return spark.createDataFrame([(c["canonical"], c["count"], len(c["variants"])) for c in found], "canonical string, n long, spellings long")


@register("""WITH s AS (SELECT o_orderkey FROM orders) SELECT 'YYYY-MM-DD' AS layout, count(*) AS n FROM s WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'DD/MM/YYYY', count(*) FROM s WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'DD Mon YYYY', count(*) FROM s WHERE o_orderkey % 3 = 2""")
def profile_date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts among the profile's first 2,000 distinct values, counted over all rows."""
    day = text("o_orderkey", ["2023-01-05", "13/02/2023", "5 de enero de 2023"])
    found = profile(messy(spark, sf_dir, "orders", "o_orderkey", day=day).frame.select(ROW, "day")).column("day").details["date_formats"]
    return spark.createDataFrame([*found.items()], "layout string, n long")


@register("""WITH t AS (SELECT p_partkey, p_brand, p_retailprice AS v FROM part), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM t)
SELECT (SELECT count(*) FROM t, q WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outliers, (SELECT sum(strlen(p_brand)) FROM t) AS bytes,
(SELECT string_agg(p_brand, ',' ORDER BY k) FROM (SELECT p_brand, min(p_partkey) AS k FROM t GROUP BY 1 ORDER BY 2 LIMIT 5)) AS examples""".replace("SELECT sum(strlen(p_brand))", "SELECT CAST(sum(strlen(p_brand)) AS BIGINT)"))
def profile_outliers_and_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = messy(spark, sf_dir, "part", "p_partkey", brand="p_brand", price="p_retailprice").frame
    prices, brands = profile(df.select(ROW, "price")), profile(df.select(ROW, "brand"))
    return spark.createDataFrame([(prices.column("price").n_outliers, brands.memory_bytes, ",".join(brands.column("brand").examples))], "outliers long, bytes long, examples string")


STEPS = ["standardize_column_names", "normalize_whitespace", "coerce_types", "standardize_categoricals", "standardize_emails", "standardize_phones", "standardize_names"]
RULES = [("client_key", "not_null"), ("client_key", "unique"), ("client_key", "dtype"), ("amount", "not_null"), ("amount", "dtype"), ("amount", "range"), ("joined", "not_null"), ("joined", "dtype"), ("active", "not_null"), ("active", "allowed"), ("mail", "not_null"), ("mail", "regex"), ("phone", "not_null"), ("phone", "regex"), ("country", "not_null"), ("country", "allowed"), ("full_name", "not_null"), ("full_name", "allowed")]


@register(rows("part, name, told", [("step", s, "") for s in STEPS] + [("rule", c, r) for c, r in RULES] + [("check", "joined_not_after_left", "<=")]))
def suggested_steps_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core steps in the order of a pipeline, the rules, and the order of dates that holds on all rows."""
    df = _profiled(spark, sf_dir).withColumn("Left", F.expr(text(ROW, ["2023-01-06", "2023-02-13", "2023-03-14", "2023-02-16"]).replace(ROW, f"`{ROW}`")))
    s = suggest(df)
    out = [("step", x["op"], "") for x in s.core_pipeline()["steps"]] + [("rule", c, r) for c, spec in s.rules["columns"].items() if c != "left" for r in spec]
    return spark.createDataFrame(out + [("check", c["name"], c["op"]) for c in s.rules["checks"]], "part string, name string, told string")


# Pipelines.


@register(f"""SELECT * FROM (SELECT c_custkey AS customer_key, {pick('c_custkey', ['Ana Ruiz', 'Beto Cruz', 'Carla Paz'])} AS full_name, {pick('c_custkey', [1000.5, None, 2000.0], 'DOUBLE')} AS amount, c_nationkey AS nation FROM customer)
QUALIFY row_number() OVER (PARTITION BY nation, full_name ORDER BY customer_key) = 1""")
def pipeline_of_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"op": "standardize_column_names"}, {"op": "normalize_whitespace"}, {"op": "coerce_types", "mapping": {"amount": "float"}}, {"op": "standardize_names", "columns": ["full_name"]}, {"op": "deduplicate", "subset": ["nation", "full_name"]}]
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(f"c_custkey AS `{ROW}`", "c_custkey AS `CustomerKey`", f"{text('c_custkey', [' ANA  ruiz', 'beto CRUZ ', 'Carla Paz'])} AS `Full Name`", f"{text('c_custkey', ['1,000.5', '-', '$2,000.00'])} AS `Amount`", "c_nationkey AS nation")
    return run_pipeline(df, {"name": "t", "steps": steps}).df.drop(ROW)


@register("SELECT true AS same_rows, false AS other_order, false AS other_value, 16 AS digits")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash knows values and their order, not partitions."""
    df = messy(spark, sf_dir, "part", "p_partkey", brand="p_brand", size="p_size").frame
    own = content_hash(df)
    others = [df.repartition(7), df.withColumn(ROW, -F.col(ROW)), df.withColumn("size", F.when(F.col(ROW) == 3, 0).otherwise(F.col("size")))]
    return spark.createDataFrame([(*(content_hash(x) == own for x in others), len(own))], "same_rows boolean, other_order boolean, other_value boolean, digits int")


@register("SELECT c_custkey, 2 * c_nationkey AS doubled FROM customer")
def apply_a_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messy(spark, sf_dir, "customer", "c_custkey", n="c_nationkey")
    return c.apply(lambda df: df.withColumn("doubled", 2 * F.col("n")).drop("n"), "doubled").df
