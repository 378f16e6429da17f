"""Registered queries on frames without row ids, files that are written and read again, and profiles counted from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.cleaner import Cleaner
from tidemill.operators.profiling import infer_types, profile
from tidemill.operators.spellings import spelling_clusters
from tidemill.operators.validation import validate
from tidemill.plans.catalog import messy, register
from tidemill.plans.pipeline import run_pipeline
from tidemill.sources.storage import new_path
from tidemill.sources.tables import ROW, read_csv, read_csv_and_lines, read_parquet, with_row_ids, write_csv, write_review

# Places of rows.


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def row_places_of_a_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return with_row_ids(orders.orderBy(F.desc("o_totalprice"), "o_orderkey")).select("o_orderkey", F.col(ROW).alias("place"))


@register("""SELECT count(*) AS n, CAST(0 AS BIGINT) AS first_place, count(*) - 1 AS last_place, count(*) AS places, sum(n_orders) AS orders
FROM (SELECT c_custkey, count(*) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) t""")
def row_places_of_a_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    placed = with_row_ids(customer.join(counts, "c_custkey"))
    return placed.agg(F.count("*").alias("n"), F.min(ROW).alias("first_place"), F.max(ROW).alias("last_place"), F.count_distinct(ROW).alias("places"), F.sum("n_orders").alias("orders"))


@register("SELECT l_orderkey, sum(l_quantity) AS quantity, max(CASE WHEN l_linenumber > 1 THEN l_linestatus END) AS mode FROM lineitem GROUP BY 1 HAVING max(CASE WHEN l_linenumber > 1 THEN l_linestatus END) IS NOT NULL")
def cleaner_on_an_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grouped = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.max(F.when(F.col("l_linenumber") > 1, F.col("l_linestatus"))).alias("mode"))
    return Cleaner(grouped).handle_missing("drop_rows", ["mode"]).df


@register("SELECT count(*) AS n, count(*) AS places, count(*) - 1 AS last_place, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def row_places_of_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_parquet(spark, f"{sf_dir}/orders.parquet")
    return df.agg(F.count("*").alias("n"), F.count_distinct(ROW).alias("places"), F.max(ROW).alias("last_place"), F.sum("o_orderkey").alias("keys"))


# Files. Texts with quotes, separators and line ends, by key.

_ODD = "CASE c_custkey % 5 WHEN 0 THEN c_name || ', \"x\"' WHEN 1 THEN c_name || {lf} || 'two' || {lf} || 'three' WHEN 2 THEN NULL WHEN 3 THEN '\"' || c_name ELSE 'é ' || c_name END"
_SPARK_ODD, _SQL_ODD = _ODD.format(lf="'\n'"), _ODD.format(lf="chr(10)")
#: The line on which a customer's record begins, the header being on the first.
_LINES = f"SELECT c_custkey, text, row, 2 + coalesce(sum(1 + CASE WHEN c_custkey % 5 = 1 THEN 2 ELSE 0 END) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM (SELECT c_custkey, {_SQL_ODD} AS text, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer)"


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = f"{new_path(spark, 'customers')}.csv"
    write_csv(messy(spark, sf_dir, "customer", "c_custkey", text=_SPARK_ODD, balance="c_acctbal").frame.repartition(3), path)
    return path


@register(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {_SQL_ODD} AS text, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def csv_file_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, _written(spark, sf_dir)).select("c_custkey", "text", F.col(ROW).alias("place"))


@register(f"SELECT row, CAST(line AS BIGINT) AS line FROM ({_LINES})")
def csv_record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv_and_lines(spark, _written(spark, sf_dir))[1]


@register(f"SELECT row, CAST(line AS BIGINT) AS line, 'text' AS name FROM ({_LINES}) WHERE text IS NULL")
def csv_failures_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, lines = read_csv_and_lines(spark, _written(spark, sf_dir))
    return validate(df, {"columns": {"text": {"not_null": True}}}, lines).failures.select("row", "line", F.lit("text").alias("name"))


@register("""WITH t AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS row, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part),
d AS (SELECT row_number() OVER (ORDER BY t.row) AS pair, t.row, k.row AS kept_row, p_brand FROM t JOIN (SELECT p_partkey, row FROM t) k ON k.p_partkey = first WHERE t.p_partkey <> first)
SELECT pair::VARCHAR AS pair, role, row::VARCHAR AS row, (row + 2)::VARCHAR AS line, 'exact' AS match, p_brand AS brand FROM (
SELECT pair, 'duplicate' AS role, row, p_brand FROM d UNION ALL SELECT pair, 'kept', kept_row, p_brand FROM d)""")
def review_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Cleaner(with_row_ids(spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "p_brand AS brand").orderBy("p_partkey"))).deduplicate("brand")
    path = f"{new_path(spark, 'review')}.csv"
    write_review(c.reviews, path)
    return read_csv(spark, path).select("pair", "role", "row", "line", "match", "brand")


@register("SELECT (SELECT count(*) FROM supplier) AS records, (SELECT count(DISTINCT (s_nationkey, s_suppkey = 1)) FROM supplier) AS steps_rows, true AS same")
def pipeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline's Markdown and audit tell the rows ahead of it and behind it; its result goes to a file and back."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(f"s_suppkey AS `{ROW}`", "s_nationkey AS nation", "s_suppkey % 2 AS side")
    result = run_pipeline(df.withColumn("side", F.when(F.col(ROW) == 1, 9).otherwise(0)), {"steps": [{"op": "deduplicate", "subset": ["nation", "side"]}]})
    path = f"{new_path(spark, 'clean')}.csv"
    write_csv(result.df, path)
    n, told = read_csv(spark, path).count(), result.to_markdown()
    before, after = result.before["rows"], result.after["rows"]
    return spark.createDataFrame([(before, after, n == after and f"| rows | {before} | {after} |" in told)], "records long, steps_rows long, same boolean")


# Duplicates in chains.

@register("SELECT p_partkey, p_partkey % 3 = 1 AND p_partkey > 1 AS is_duplicate, CASE WHEN p_partkey % 3 = 1 AND p_partkey > 1 THEN p_partkey - 1 END AS duplicate_of FROM part WHERE p_partkey > 2")
def deduplicate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each second text is like the first and the third, which aren't alike: it is a duplicate of the first, and the third stays."""
    key = "CAST(CAST((p_partkey - p_partkey % 3) / 3 AS BIGINT) AS STRING)"
    made = f"CASE p_partkey % 3 WHEN 0 THEN substr(md5({key}), 1, 30) WHEN 1 THEN substr(md5({key}), 1, 27) || 'zzz' ELSE substr(md5({key}), 1, 24) || 'yyyzzz' END"
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey > 2").selectExpr("p_partkey", f"{made} AS name")
    return Cleaner(parts, "p_partkey").deduplicate("name", fuzzy=True, threshold=0.9, flag=True).df.select("p_partkey", "is_duplicate", "duplicate_of")


# Types, findings and spellings, counted from the tables.

_TYPED = {
    "whole": "CAST(o_custkey AS {text})",
    "price": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS {text}) END",
    "day": "CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS {text}) END",
    "done": "CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'No' END",
    "free": "o_orderpriority || ' ' || CAST(o_orderkey AS {text})",
}


@register(f"""SELECT o_orderkey, CAST({_TYPED['whole'].format(text='VARCHAR')} AS BIGINT) AS whole, CAST({_TYPED['price'].format(text='VARCHAR')} AS DOUBLE) AS price,
CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS day, o_orderstatus = 'F' AS done, {_TYPED['free'].format(text='VARCHAR')} AS free FROM orders""".replace("CAST(o_orderdate AS TIMESTAMP)", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)"))
def coerce_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a mapping, columns become what all their values are like."""
    return messy(spark, sf_dir, "orders", "o_orderkey", **{c: e.format(text="STRING") for c, e in _TYPED.items()}).coerce_types().df


@register("""SELECT 'whole' AS name, CASE WHEN count(*) FILTER (regexp_full_match(v, '[0-9]+')) = count(*) THEN 'integer' ELSE 'text' END AS kind FROM (SELECT CAST(o_custkey AS VARCHAR) AS v FROM orders)
UNION ALL SELECT 'status', CASE WHEN count(DISTINCT o_orderstatus) <= 50 AND count(DISTINCT o_orderstatus) <= 0.5 * count(*) THEN 'categorical' ELSE 'text' END FROM orders
UNION ALL SELECT 'mixed', CASE WHEN avg(CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE 1 END) >= 0.98 THEN 'float' ELSE 'text' END FROM orders
UNION ALL SELECT 'loose', CASE WHEN avg(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END) >= 0.98 THEN 'float' ELSE 'text' END FROM orders
UNION ALL SELECT 'day', CASE WHEN avg(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END) >= 0.8 THEN 'datetime' ELSE 'text' END FROM orders""")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "whole": "CAST(o_custkey AS STRING)",
        "status": "o_orderstatus",
        "mixed": "CASE WHEN o_orderkey % 100 = 0 THEN concat('x', o_orderkey) ELSE concat(o_totalprice) END",
        "loose": "CASE WHEN o_orderkey % 10 = 0 THEN concat('x', o_orderkey) ELSE concat(o_totalprice) END",
        "day": "CASE WHEN o_orderkey % 6 = 0 THEN concat('soon ', o_orderkey) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    }
    found = infer_types(messy(spark, sf_dir, "orders", "o_orderkey", **columns).frame.select(ROW, *columns))
    return spark.createDataFrame([*found.items()], "name string, kind string")


_FOUND = {
    "some": ("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END", "missing", "avg(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) >= 0.2"),
    "hollow": ("CASE WHEN o_orderkey % 50 = 0 THEN '  ' ELSE o_orderpriority END", "blank", "count(*) FILTER (o_orderkey % 50 = 0) > 0"),
    "same": ("'one'", "variety", "count(*) > 0"),
    "spaced": ("CASE WHEN o_orderkey % 40 = 0 THEN concat(o_orderpriority, ' ') ELSE o_orderpriority END", "space", "count(*) FILTER (o_orderkey % 40 = 0) > 0"),
    "composed": ("CASE WHEN o_orderkey % 40 = 0 THEN 'é' ELSE o_orderpriority END", "form", "count(*) FILTER (o_orderkey % 40 = 0) > 0"),
    "when_": ("CASE WHEN o_orderkey % 30 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END", "dates", "count(*) FILTER (o_orderkey % 30 = 0) > 0"),
    "marked": ("CASE WHEN o_orderkey % 2 = 0 THEN concat(o_custkey, ',25') ELSE concat(o_custkey, '.5') END", "marks", "count(*) FILTER (o_orderkey % 2 = 0) > 0 AND count(*) FILTER (o_orderkey % 2 = 1) > 0"),
    "parted": ("concat(1 + o_orderkey % 9, '.', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'))", "ambiguous", "count(*) > 0"),
    "blended": ("CASE WHEN o_orderkey % 4 = 0 THEN concat(o_custkey) ELSE o_orderpriority END", "mixed", "avg(CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0 END) > 0.1"),
    "far": ("CASE WHEN o_orderkey % 200 = 0 THEN 1000000 ELSE o_custkey % 100 END", "outliers", "count(*) FILTER (o_orderkey % 200 = 0) > 0"),
    "order_id": ("CASE WHEN o_orderkey % 10 = 0 THEN 'k' ELSE concat('k', o_orderkey) END", "keys", "count(*) FILTER (o_orderkey % 10 = 0) > 1"),
}


@register(" UNION ALL ".join(f"SELECT '{name}' AS name, '{code}' AS code FROM orders HAVING {condition}" for name, (_, code, condition) in _FOUND.items()))
def findings_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each column the finding that it is made for."""
    columns = {name: made for name, (made, *_) in _FOUND.items()}
    found = {c.name: c.codes for c in profile(messy(spark, sf_dir, "orders", "o_orderkey", **columns).frame.select(ROW, *columns)).columns}
    return spark.createDataFrame([(name, code) for name, (_, code, _) in _FOUND.items() if code in found[name]], "name string, code string")


@register("SELECT upper(p_brand) AS canonical, count(*) AS n, count(DISTINCT p_partkey % 3) AS spellings FROM part GROUP BY p_brand")
def spellings_of_any_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands in capitals, small letters and with a space: clusters from a table of distinct values."""
    made = "CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) ELSE replace(p_brand, '#', ' # ') END"
    values = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{made} AS v").groupBy("v").agg(F.count("*").alias("n"), F.min("p_partkey").alias("at"))
    found = spelling_clusters(values).select(F.upper(F.regexp_replace("canonical", " ", "")).alias("canonical"), F.col("count").alias("n"), F.size("variants").cast("long").alias("spellings"))
    return found
