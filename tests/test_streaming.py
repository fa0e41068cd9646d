"""Streams run to their end over Parquet files."""

from pyspark.sql import functions as F

from lorekeep.rules import Rule
from lorekeep.streaming import watch

FACTS = "s string, p string, o string"


def test_watch(spark, tmp_path):
    spark.createDataFrame([("a", "p", "1"), ("b", "q", "2")], FACTS).write.parquet(str(tmp_path / "in"))
    seen = []
    watch.watch(watch.facts_stream(spark, str(tmp_path / "in"), FACTS), {"p": "q"}, lambda df, n: seen.extend(r.s for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert seen == ["b"]


def test_materialise_in_steps(spark, tmp_path):
    rules = [Rule([("?x", "part", "?y")], [("?x", "in", "?y")]), Rule([("?x", "in", "?y"), ("?y", "part", "?z")], [("?x", "in", "?z")])]
    for i, rows in enumerate([[("a", "part", "b")], [("b", "part", "c")]]):
        spark.createDataFrame(rows, FACTS).write.mode("append").parquet(str(tmp_path / "in"))
        watch.materialise(watch.facts_stream(spark, str(tmp_path / "in"), FACTS), rules, str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination()
        got = {(r.s, r.p, r.o) for r in spark.read.parquet(str(tmp_path / "store")).collect()}
        assert ("a", "in", "b") in got and (("a", "in", "c") in got) == (i == 1)


def test_moved_poses(spark, tmp_path):
    rows = [("f", 0.0, 0.0, 0.0, 0.0), ("f", 0.01, 0.0001, 0.0, 0.0), ("f", 0.02, 0.5, 0.0, 0.0), ("f", 0.2, 0.5, 0.0, 0.0), ("g", 0.0, 1.0, 1.0, 1.0)]
    schema = "frame string, ts double, x double, y double, z double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = watch.moved(watch.facts_stream(spark, str(tmp_path / "in"), schema))
    q = stream.writeStream.format("memory").queryName("moved").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.frame, r.ts) for r in spark.table("moved").collect()) == [("f", 0.0), ("f", 0.02), ("f", 0.2), ("g", 0.0)]


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'b'").write.parquet(str(tmp_path / "in"))
    stream = watch.windowed_counts(watch.facts_stream(spark, str(tmp_path / "in"), "ts timestamp, k string"), "ts", "k")
    q = stream.writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("counts").select("k", F.col("n")).collect()) == [("a", 2), ("b", 1)]
