from pyspark.sql import functions as F

from sievespark.functions import text as T
from sievespark.plans.schema import TABLES
from sievespark.sources import files, lines
from sievespark.streaming.drift import drift, once


def test_drift_of_a_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", "N/A" if i % 4 == 0 else "x") for i in range(24)]
    spark.createDataFrame(rows, "id int, t string, v string").select("id", F.col("t").cast("timestamp").alias("ts"), "v").write.parquet(f"{tmp_path}/in")
    schema = "id int, ts timestamp, v string"
    stream = drift(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", {"v": T.is_placeholder(F.col("v"))})
    query = stream.writeStream.format("memory").queryName("drifted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    table = drift(spark.read.parquet(f"{tmp_path}/in"), "ts", {"v": T.is_placeholder(F.col("v"))})
    assert sorted(map(tuple, spark.table("drifted").collect())) == sorted(map(tuple, table.collect()))
    assert {(r["rows"], r["blank_v"]) for r in table.collect()} == {(8, 0.25)}


def test_repeats_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = once(spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in"), "k", "ts")
    query = stream.writeStream.format("memory").queryName("single").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["k"] for r in spark.table("single").collect()) == ["a", "b"]


def test_files(spark, tmp_path):
    columns = ", ".join(f"{c} string" for c in TABLES["urunler"])
    df = spark.createDataFrame([["U0001", 'A "b", c', "Kitap", None, "10.5"]], columns).withColumn("birim_fiyat", F.col("birim_fiyat").cast("decimal(18,2)"))
    files.write_table(df, "urunler", f"{tmp_path}/t")
    assert [tuple(r) for r in files.read_table(spark, f"{tmp_path}/t", "urunler").collect()] == [("U0001", 'A "b", c', "Kitap", None, "10.50")]
    assert files.read_table(spark, f"{tmp_path}/missing", "urunler").count() == 0
    files.write_report(df, f"{tmp_path}/r", "json")
    assert spark.read.json(f"{tmp_path}/r").count() == 1


def test_samples(spark):
    df = spark.createDataFrame([(0, "S000001,x"), (1, "S000002"), (2, "none"), (3, "S000001 S000002")], "line_no long, line string")
    ids = lines.mentioned_ids(df)
    one = lines.sampled_ids(ids, 1, seed=3)
    assert one.collect() == lines.sampled_ids(ids.repartition(3), 1, seed=3).collect()
    assert lines.lines_in_scope(df, one).count() == 2 and ids.count() == 2
