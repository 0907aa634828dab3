"""Orders cleaned as they come against the same lines cleaned at once."""

from pyspark.sql import functions as F

from sievespark.operators import changes, entity
from sievespark.plans import cleaning, corrupt
from sievespark.sources import lines as L
from sievespark.streaming.orders import OrderStream


def _run(stream, spark, folder):
    source = spark.readStream.schema("line_no long, line string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    for query in stream.start(source, availableNow=True):
        query.awaitTermination()
        assert query.exception() is None


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


def test_a_stream_gives_what_a_table_gives(spark, tmp_path):
    truth = corrupt.synthetic(spark, 240, 40, 20)
    dirty, _ = corrupt.corrupted(truth["siparisler"], "siparisler", factor=2.0)
    dirty, _ = corrupt.repeated_orders(dirty, share=0.3)
    made, _ = corrupt.as_lines(cleaning.cut(dirty), "siparisler", share=0.3)
    lines = cleaning.cut(made.select(F.row_number().over(corrupt.Window.orderBy("line_no")).cast("long").alias("line_no"), "line"))
    lines = cleaning.cut(lines.unionByName(spark.createDataFrame([(90_000, "a,b"), (90_001, None)], "line_no long, line string")))
    for i, part in enumerate(("line_no <= 100", "line_no > 100 and line_no <= 180", "line_no > 180")):
        lines.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    prices = cleaning.cut(truth["urunler"].select("urun_id", F.col("birim_fiyat").cast("decimal(18,2)").alias("birim_fiyat")))
    mapping = spark.createDataFrame([("M00001", "M00002")], "old_id string, new_id string")
    stream = OrderStream(f"{tmp_path}/out", prices, mapping)
    assert stream.counters(spark).count() == 1
    _run(stream, spark, f"{tmp_path}/in")

    records, bad = L.ingest(lines, "siparisler")
    records = cleaning.cut(records)
    sold, open_cells = cleaning.orders(records.drop("repaired"), cleaning.NoResolver())
    every = cleaning.cut(cleaning.completed(cleaning.priced(sold, prices)))
    want = entity.keep_first(entity.rewrite(every.drop(changes.LOG), mapping, "musteri_id"), "siparis_id", "row_idx")
    got = _rows(stream.results(spark, "temiz"))
    assert got == _rows(want) and len(got) == 240
    kept = {r["row_idx"] for r in want.select("row_idx").collect()}
    log = changes.taken_apart(every.where(F.col("row_idx").isin(kept)), "siparisler", "siparis_id")
    assert _rows(stream.results(spark, "sorunlar")) == _rows(log) and log.count() > 100
    assert sorted(r["ham_satir"] for r in stream.results(spark, "karantina").collect()) == ["", "a,b"]
    counted = {r["name"]: r["n"] for r in stream.counters(spark).collect()}
    assert counted["okunan_satir"] == records.count() and counted["karantina"] == 2 and counted["kalan_siparis"] == 240
    assert counted["onarilan_satir"] == records.where("repaired").count() > 10
    assert counted["silinen_tekrar_siparis"] == records.count() - 240 > 10
    by_action = {f"siparisler.{r['islem']}": r["n"] for r in log.groupBy("islem").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in counted.items() if k.startswith("siparisler.") and v} == by_action
    assert stream.results(spark, "belirsiz").count() == counted["belirsiz_hucre"] == open_cells.where(F.regexp_extract("id", r"(\d+)$", 1).isin([str(k) for k in kept])).count()

    # a stream that goes on knows the orders of its earlier runs, and a batch that is tried again writes over its own results
    lines.where("line_no <= 20").withColumn("line_no", F.col("line_no") + 200_000).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    again = OrderStream(f"{tmp_path}/out", prices, mapping)
    _run(again, spark, f"{tmp_path}/in")
    assert _rows(again.results(spark, "temiz")) == got
    after = {r["name"]: r["n"] for r in again.counters(spark).collect()}
    assert after["okunan_satir"] > counted["okunan_satir"] and after["kalan_siparis"] == 240
    again.take_lines(spark.read.parquet(f"{tmp_path}/in/0"), 0)
    first = spark.read.parquet(f"{tmp_path}/out/gelen").where("batch = 1").drop("batch").checkpoint()
    again.take_orders(first.select(F.struct("*").alias("first"), F.lit(1).alias("arrived"), F.lit(1).alias("seen")), 1)
    assert _rows(again.results(spark, "temiz")) == got and {r["name"]: r["n"] for r in again.counters(spark).collect()} == after
