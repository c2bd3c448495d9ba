import datetime

from tidemark.streaming.history import event_counts, link_stream


def test_stream_links_visits_over_batches(spark, tmp_path):
    schema = "rid long, pid string, date date, items array<string>"
    d = datetime.date
    spark.createDataFrame([(1, "p", d(2020, 1, 1), ["a"]), (2, "p", d(2020, 1, 5), [])], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = link_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("linked_visits").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(3, "p", d(2020, 1, 9), ["b"]), (4, "q", d(2020, 1, 1), ["z"])], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        got = {r.rid: (r.prev_items, r.prev_gap, r.visit_ix) for r in spark.sql("SELECT * FROM linked_visits").collect()}
    finally:
        q.stop()
    assert got == {1: (None, None, 0), 2: (["a"], 4, 1), 3: (["a"], 8, 2), 4: (None, None, 0)}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    t = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(t(0, 5), "view", 1.0), (t(0, 50), "view", 2.0), (t(3, 0), "view", 9.0)], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = event_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e"))
    q = stream.writeStream.format("memory").queryName("event_windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").start()
    try:
        q.processAllAvailable()
        got = [(r.event_type, r.n, r.total) for r in spark.sql("SELECT * FROM event_windows").collect()]
    finally:
        q.stop()
    assert got == [("view", 2, 3.0)]
