import shutil

from tidemill.streaming.rules import broken_rules, validate_batches

RULES = {"columns": {"o_totalprice": {"range": {"min": 100000}}, "o_orderstatus": {"allowed": ["F", "O"]}}}
SF = "/root/testdata/sf0.001"


def test_rules_on_a_stream(spark, tmp_path):


    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/orders.parquet", tmp_path / "in" / "a.parquet")
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = broken_rules(stream, RULES).writeStream.format("memory").queryName("broken").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT o_orderkey FROM broken WHERE array_contains(broken, 'o_totalprice.range')").count()
    assert got == batch.filter("o_totalprice < 100000").count()

    seen = []
    w = validate_batches(stream, RULES, lambda failures, n: seen.append(failures.count())).option("checkpointLocation", str(tmp_path / "c")).start()
    w.processAllAvailable()
    w.stop()
    assert sum(seen) == got + batch.filter("o_orderstatus NOT IN ('F', 'O')").count()
