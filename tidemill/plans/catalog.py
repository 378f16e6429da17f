"""The library's registered queries and the SQL they are checked against.

The driver's tables are clean, so each query first makes a mess of a table by an
expression that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import profiling
from tidemill.operators.cleaner import Cleaner
from tidemill.operators.validation import validate
from tidemill.plans.pipeline import summary
from tidemill.sources.tables import ROW

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def messy(spark: SparkSession, sf_dir: str, table: str, key: str, **columns: str) -> Cleaner:
    """A table's key and columns made by SQL expressions, as a Cleaner with the key for row id."""
    return Cleaner(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(key, *(f"{e} AS {c}" for c, e in columns.items())), key)


# Missing values.

_ORDERS = {"status": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END", "priority": "CASE WHEN o_orderkey % 5 = 0 THEN ' N/A ' ELSE o_orderpriority END", "total": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END"}
_O = ", ".join(f"{e} AS {c}" for c, e in _ORDERS.items())


@register(f"SELECT * FROM (SELECT o_orderkey, {_O} FROM orders) WHERE NOT (status IS NULL OR lower(trim(priority)) = 'n/a')")
def missing_drop_rows_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "orders", "o_orderkey", **_ORDERS).handle_missing("drop_rows", ["status", "priority"]).df


@register(f"SELECT * FROM (SELECT o_orderkey, {_O} FROM orders) WHERE NOT (status IS NULL AND total IS NULL AND lower(trim(priority)) = 'n/a')")
def missing_drop_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "orders", "o_orderkey", **_ORDERS).handle_missing("drop_rows", ["status", "priority", "total"], how="all").df


@register(f"SELECT *, (status IS NULL OR total IS NULL OR lower(trim(priority)) = 'n/a') AS has_missing FROM (SELECT o_orderkey, {_O} FROM orders)")
def missing_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "orders", "o_orderkey", **_ORDERS).handle_missing().df


@register("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def missing_drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "orders", "o_orderkey", status="o_orderstatus", none="CASE WHEN o_orderkey % 2 = 0 THEN '-' END", gone="CAST(NULL AS DOUBLE)").handle_missing("drop_columns").df


_BALANCE = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"


@register(f"WITH t AS (SELECT c_custkey, {_BALANCE} AS balance FROM customer) SELECT c_custkey, round(coalesce(balance, (SELECT avg(balance) FROM t)), 4) AS balance FROM t")
def missing_fill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "customer", "c_custkey", balance=_BALANCE).handle_missing("fill", "balance", "mean").df.withColumn("balance", F.round("balance", 4))


@register(f"WITH t AS (SELECT c_custkey, {_BALANCE} AS balance FROM customer) SELECT c_custkey, round(coalesce(balance, (SELECT median(balance) FROM t)), 4) AS balance FROM t")
def missing_fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "customer", "c_custkey", balance=_BALANCE).handle_missing("fill", "balance", "median").df.withColumn("balance", F.round("balance", 4))


_SEGMENT = "CASE WHEN c_custkey % 6 = 0 THEN 'unknown' ELSE c_mktsegment END"


@register(f"""WITH t AS (SELECT c_custkey, {_SEGMENT} AS segment FROM customer),
m AS (SELECT segment FROM t WHERE segment <> 'unknown' GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)
SELECT c_custkey, CASE WHEN segment = 'unknown' THEN (SELECT segment FROM m) ELSE segment END AS segment FROM t""")
def missing_fill_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "customer", "c_custkey", segment=_SEGMENT).handle_missing("fill", "segment", "mode").df


_VALUE = "CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END"


@register(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS v FROM (SELECT event_id, {_VALUE} AS v FROM events)")
def missing_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "events", "event_id", v=_VALUE).handle_missing("fill", "v", "ffill").df


@register(f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM (SELECT event_id, {_VALUE} AS v FROM events)")
def missing_fill_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "events", "event_id", v=_VALUE).handle_missing("fill", "v", "bfill").df


@register(f"SELECT c_custkey, CASE WHEN {_SEGMENT} = 'unknown' THEN 'NONE GIVEN' ELSE c_mktsegment END AS segment, coalesce({_BALANCE}, 1234.5) AS balance FROM customer")
def missing_fill_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messy(spark, sf_dir, "customer", "c_custkey", segment=_SEGMENT, balance=_BALANCE)
    return c.handle_missing("fill", "segment", "NONE GIVEN").handle_missing("fill", "balance", "1,234.5").df


# Types.

_PRICE = """CASE CAST(o_orderkey % 6 AS INT)
  WHEN 0 THEN concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.5')
  WHEN 1 THEN concat('(', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ')')
  WHEN 2 THEN concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ',25 EUR')
  WHEN 3 THEN concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '%')
  WHEN 4 THEN concat('1.234.', CAST(100 + CAST(floor(o_totalprice) AS BIGINT) % 900 AS STRING), ',5')
  ELSE 'n/a' END"""


@register("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN floor(o_totalprice) + 0.5 WHEN 1 THEN -floor(o_totalprice)
  WHEN 2 THEN floor(o_totalprice) + 0.25 WHEN 3 THEN floor(o_totalprice) / 100.0
  WHEN 4 THEN 1234000 + 100 + CAST(floor(o_totalprice) AS BIGINT) % 900 + 0.5 ELSE NULL END::DOUBLE AS price FROM orders""")
def coerce_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "orders", "o_orderkey", price=_PRICE).coerce_types({"price": "float"}).df


@register("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN -(p_size + 1) WHEN p_partkey % 4 = 1 THEN p_size + 1 ELSE p_size END AS BIGINT) AS size FROM part""")
def coerce_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = "CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat(' ', p_size, ' ') WHEN 1 THEN concat(p_size, '.5') WHEN 2 THEN concat('-', p_size, ',5') ELSE concat(p_size, ' years') END"
    return messy(spark, sf_dir, "part", "p_partkey", size=size).coerce_types({"size": "integer"}).df


@register("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE NULL END AS done FROM orders")
def coerce_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = "CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN ' Yes' ELSE 'ON' END WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'No.' ELSE '0' END ELSE 'maybe' END"
    return messy(spark, sf_dir, "orders", "o_orderkey", done=done).coerce_types({"done": "boolean"}).df


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) END AS day FROM orders")
def coerce_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = """CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy')
      WHEN 2 THEN date_format(o_orderdate, 'MMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyy.M.d') ELSE '31/02/2023' END"""
    return messy(spark, sf_dir, "orders", "o_orderkey", day=day).coerce_types({"day": "datetime"}).df


# Headers and white space.


@register("SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS acct_bal_usd, c_nationkey AS full_name_1 FROM customer")
def standardize_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS `CustomerKey`", "c_name AS ` Full Name`", "c_acctbal AS `Acct. Bal (USD)`", "c_nationkey AS full_name")
    c = Cleaner(df, "CustomerKey")
    return c.standardize_column_names().df


@register("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE regexp_replace(c_name, '#', ' ', 'g') END AS name FROM customer")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = r"CASE WHEN c_custkey % 9 = 0 THEN ' \t ' WHEN c_custkey % 2 = 0 THEN concat('  ', replace(c_name, '#', ' \t  ')) ELSE concat(replace(c_name, '#', ' '), '\n') END"
    return messy(spark, sf_dir, "customer", "c_custkey", name=name).normalize_whitespace().df


# Duplicates.


@register("SELECT doc_id, text, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def deduplicate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "documents", "doc_id", text="text", lang="lang").deduplicate("text").df


@register("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def deduplicate_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "events", "event_id", user_id="user_id", event_type="event_type").deduplicate(["user_id", "event_type"], keep="last").df


_GAPS = {"user_id": "CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END", "kind": "event_type", "v": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END", "p": "CASE WHEN event_id % 5 < 2 THEN '-' ELSE props END"}


@register(f"""SELECT event_id, user_id, kind, v, p FROM (SELECT event_id, {", ".join(f"{e} AS {c}" for c, e in _GAPS.items())} FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY CAST(user_id IS NULL AS INT) + CAST(v IS NULL AS INT) + CAST(p = '-' AS INT), event_id) = 1""")
def deduplicate_most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "events", "event_id", **_GAPS).deduplicate(["user_id", "kind"], keep="most_complete").df


@register("""SELECT doc_id, doc_id <> f AS is_duplicate, CASE WHEN doc_id <> f THEN f END AS duplicate_of
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)""")
def deduplicate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "documents", "doc_id", text="text").deduplicate("text", flag=True).df.drop("text")


@register()
def deduplicate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that differ little; the ratio of matching blocks has no SQL."""
    name = "CASE WHEN p_partkey % 10 = 0 THEN concat(upper(p_name), '.') ELSE p_name END"
    return messy(spark, sf_dir, "part", "p_partkey", name=name, brand="p_brand").deduplicate("name", fuzzy=True, threshold=0.9, block_on="brand", flag=True).df


# Outliers.

_Q = "SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, avg(value) AS m, stddev_pop(value) AS s FROM events"


@register(f"WITH q AS ({_Q}) SELECT event_id, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS value_is_outlier FROM events, q")
def outliers_iqr_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "events", "event_id", value="value").handle_outliers("value").df


@register(f"WITH q AS ({_Q}) SELECT event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS value FROM events, q")
def outliers_iqr_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "events", "event_id", value="value").handle_outliers("value", action="cap").df.withColumn("value", F.round("value", 6))


@register(f"WITH q AS ({_Q}) SELECT event_id, value, value < m - 2 * s OR value > m + 2 * s AS value_is_outlier FROM events, q")
def outliers_zscore_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "events", "event_id", value="value").handle_outliers("value", method="zscore", z=2.0).df


# Contacts and categories.

_MAIL = """CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat(' C', c_custkey, '@GMIAL.con ') WHEN 1 THEN concat('mailto:c', c_custkey, '@yahooo.com')
  WHEN 2 THEN concat('<c', c_custkey, '@shop.example.org>') WHEN 3 THEN concat('c', c_custkey, 'hotmail.com') ELSE 'N/A' END"""


@register("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'c' || c_custkey || '@gmail.com' WHEN 1 THEN 'c' || c_custkey || '@yahoo.com'
  WHEN 2 THEN 'c' || c_custkey || '@shop.example.org' WHEN 3 THEN 'c' || c_custkey || 'hotmail.com' ELSE NULL END AS mail, c_custkey % 5 = 3 AS mail_is_invalid FROM customer""")
def standardize_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir, "customer", "c_custkey", mail=_MAIL).standardize_emails("mail", invalid="flag").df


@register("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+5076' || (1000000 + c_custkey) WHEN 1 THEN '+5073' || (100000 + c_custkey)
  WHEN 2 THEN '+573' || (100000000 + c_custkey) ELSE NULL END AS phone FROM customer""")
def standardize_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = """CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN concat('6', CAST(1000000 + c_custkey AS STRING)) WHEN 1 THEN concat('(507) 3', CAST(100000 + c_custkey AS STRING))
      WHEN 2 THEN concat('3', CAST(100000000 + c_custkey AS STRING)) ELSE '12' END"""
    country = "CASE WHEN c_custkey % 4 = 2 THEN 'Rep. de Colombia' ELSE 'Panamá' END"
    return messy(spark, sf_dir, "customer", "c_custkey", phone=phone, country=country).standardize_phones("phone", region_column="country", invalid="null").df.drop("country")


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'other' ELSE o_orderpriority END AS priority FROM orders")
def standardize_categoricals(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = "CASE WHEN o_orderkey % 8 = 0 THEN 'other' WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 3 = 1 THEN concat(replace(o_orderpriority, '-', ' / '), '!') ELSE substring(o_orderpriority, 1, 1) END"
    labels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return messy(spark, sf_dir, "orders", "o_orderkey", priority=priority).standardize_categoricals("priority", labels, 0.8, {x[0]: x for x in labels}).df


# Rules.

_RULES = {"columns": {"total": {"not_null": True, "range": {"min": 1000, "max": 400000}}, "priority": {"allowed": ["1-URGENT", "2-HIGH"], "regex": "^[1-4]-"}, "cust": {"unique": True}}}


@register("""WITH t AS (SELECT o_orderkey AS "row", CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS total, o_orderpriority AS priority, o_custkey AS cust FROM orders)
SELECT 'total.not_null' AS rule, "row", 'value is null' AS message FROM t WHERE total IS NULL
UNION ALL SELECT 'total.range', "row", 'out' FROM t WHERE total < 1000 OR total > 400000
UNION ALL SELECT 'priority.allowed', "row", 'value not in allowed set' FROM t WHERE priority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'priority.regex', "row", 'does not match pattern' FROM t WHERE NOT regexp_matches(priority, '^[1-4]-')
UNION ALL SELECT 'cust.unique', "row", 'duplicate value violates uniqueness' FROM t QUALIFY count(*) OVER (PARTITION BY cust) > 1""")
def validate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = messy(spark, sf_dir, "orders", "o_orderkey", total=_ORDERS["total"], priority="o_orderpriority", cust="o_custkey")
    found = validate(c.frame, _RULES).failures
    return found.select("rule", "row", F.when(F.col("rule") == "total.range", "out").otherwise(F.col("message")).alias("message"))


@register("""SELECT l_orderkey * 10 + l_linenumber AS "row", count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE NOT (l_shipdate <= o_orderdate + INTERVAL 60 DAY) GROUP BY 1""")
def validate_cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ROW), "l_shipdate", F.expr("o_orderdate + INTERVAL 60 DAY").alias("latest"))
    found = validate(both, {"checks": [{"name": "ships in time", "left": "l_shipdate", "op": "<=", "right": "latest"}]}).failures
    return found.groupBy("row").agg(F.count("*").alias("n"))


@register("""SELECT 'size.dtype' AS rule, count(*) AS n FROM part WHERE p_partkey % 4 = 3
UNION ALL SELECT 'price above size', count(*) FROM part WHERE p_partkey % 4 <> 3 AND NOT (p_retailprice > p_size * 30)""")
def validate_types_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = "CASE WHEN p_partkey % 4 = 3 THEN 'large' ELSE concat('$', p_size) END"
    c = messy(spark, sf_dir, "part", "p_partkey", size=size, price="CAST(p_retailprice AS STRING)", bound="CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(p_size * 30 AS DOUBLE) END")
    rules = {"columns": {"size": {"dtype": "integer"}}, "checks": [{"name": "price above size", "left": "price", "op": ">", "right": "bound"}]}
    return validate(c.frame, rules).failures.groupBy("rule").agg(F.count("*").alias("n"))


# Profiles.


@register(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n_total, count({c}) AS n_present, count(DISTINCT {c}) AS n_unique FROM lineitem" for c in ("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")))
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    return profiling.count_table(df).select("name", "n_total", "n_present", "n_unique")


@register(" UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.75), 4) AS p75 FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def profile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount")
    return profiling.number_table(df, df.columns)


@register("""SELECT * FROM (SELECT 'p_brand' AS name, p_brand AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'p_type' AS name, p_type AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.top_values(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_brand", "p_type"])


@register("""SELECT count(*) AS "rows", CAST(2 AS BIGINT) AS cols, count(*) FILTER (event_type IS NULL) + count(*) FILTER (user_id % 4 = 0) AS missing_cells,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS u FROM events)) AS duplicate_rows FROM events""")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS u")
    s = summary(df)
    return spark.createDataFrame([(s["rows"], s["cols"], s["missing_cells"], s["duplicate_rows"])], "rows long, cols long, missing_cells long, duplicate_rows long")


@register("""SELECT p_brand AS brand, count(*) AS n_rows, true AS repeated, count(DISTINCT (p_type, p_size)) > 1 AS conflicting FROM part GROUP BY 1 HAVING count(*) > 1""")
def profile_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand AS brand", "p_type AS type", "CAST(p_size AS STRING) AS size")
    return profiling.repeated_keys(df, "brand").select("brand", "n_rows", F.lit(True).alias("repeated"), "conflicting")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complete, typed row for each customer: drop gaps, coerce prices, keep the most complete order."""
    columns = {"cust": "o_custkey", "status": _ORDERS["status"], "price": _PRICE, "priority": _ORDERS["priority"]}
    c = messy(spark, sf_dir, "orders", "o_orderkey", **columns)
    return c.handle_missing("drop_rows", ["status"]).coerce_types({"price": "float"}).deduplicate("cust", keep="most_complete").df


def queries() -> dict[str, Query]:
    from tidemill.plans import tables, values  # noqa: F401  they register more

    return {**_QUERIES, "flagship": flagship}


def oracle_sql() -> dict[str, str]:
    from tidemill.plans import tables, values  # noqa: F401

    price = """CASE o_orderkey % 6 WHEN 0 THEN floor(o_totalprice) + 0.5 WHEN 1 THEN -floor(o_totalprice) WHEN 2 THEN floor(o_totalprice) + 0.25
      WHEN 3 THEN floor(o_totalprice) / 100.0 WHEN 4 THEN 1234000 + 100 + CAST(floor(o_totalprice) AS BIGINT) % 900 + 0.5 ELSE NULL END::DOUBLE"""
    sql = f"""SELECT o_orderkey, cust, status, price, priority FROM (
      SELECT o_orderkey, o_custkey AS cust, {_ORDERS["status"]} AS status, {price} AS price, {_ORDERS["priority"]} AS priority FROM orders) WHERE status IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY cust ORDER BY CAST(price IS NULL AS INT) + CAST(lower(trim(priority)) = 'n/a' AS INT), o_orderkey) = 1"""
    return {**_SQL, "flagship": sql}
