from pyspark.sql import functions as F

from strandwork.sources import readers
from strandwork.streaming import ingest


def test_dedup_over_micro_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, i) for k in range(i, i + 4)] + [(None, i)], "record_id long, batch int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("record_id long, batch int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ingest.drain(ingest.deduplicated(stream, "record_id"), "test")
    assert sorted(r["record_id"] for r in out.collect()) == list(range(6))
    seen = []
    ingest.periodically(stream, "every", 2, lambda batch, n: seen.append((n, batch.count())))
    assert seen == [(0, 5), (2, 5)]
    files = [f.rsplit("/", 1)[1] for f in spark.read.parquet(str(tmp_path / "in")).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]]
    assert readers.pinned(spark, str(tmp_path / "in"), files[:2], "record_id long").count() == 10


def test_windows_wait_for_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", None), ("2024-01-01 05:00:00", "b", 2.0), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    out = ingest.drain(ingest.event_windows(stream, "ts", "1 hour", "1 hour"), "windows").collect()
    assert [(r["event_type"], r["events"], r["total"]) for r in out] == [("a", 2, 1.0)]
