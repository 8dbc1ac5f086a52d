from datetime import datetime, timedelta

from hanmaru.streaming.progress import LatestStore, merge_frequencies, merge_vectors, windowed_counts

T0 = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(minutes=m), v) for k, m, v in rows], "k string, ts timestamp, v string")


def test_latest_store(spark, tmp_path):
    store = LatestStore(spark, str(tmp_path / "state"), ["k"], "ts", 900)
    assert store.read() is None
    store.merge(frame(spark, [("a", 0, "x"), ("a", 5, "y"), ("b", 1, "z")]), 0)
    store.merge(frame(spark, [("c", 17, "w")]), 1)
    store.merge(frame(spark, [("a", 40, "again")]), 1)  # a batch met again changes nothing
    assert sorted((r.k, r.v) for r in store.read().collect()) == [("a", "y"), ("c", "w")]


def test_stream_end_to_end(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k string, ts timestamp, v string"
    frame(spark, [("a", 0, "x"), ("b", 1, "y")]).write.parquet(source)
    store = LatestStore(spark, str(tmp_path / "state"), ["k"], "ts", 900)
    for _ in range(2):
        store.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp")).awaitTermination()
        frame(spark, [("a", 2, "newer")]).write.mode("append").parquet(source)
    assert sorted((r.k, r.v) for r in store.read().collect()) == [("a", "newer"), ("b", "y")]


def test_windowed_counts_in_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, [("a", 0, "x"), ("a", 3, "y"), ("a", 12, "z"), ("b", 200, "w")]).coalesce(1).write.parquet(source)
    stream = windowed_counts(spark.readStream.schema("k string, ts timestamp, v string").parquet(source), "ts", "k")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.events) for r in spark.table("counts").collect()) == [("a", 1), ("a", 2)]


def test_merge_vectors(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "owner int, item string, weight double")
    c = spark.createDataFrame([(1, "c", 2.0)], "owner int, item string, weight double")
    assert sorted(tuple(r) for r in merge_vectors(s, c).collect()) == [(1, "c", 2.0), (2, "b", 1.0)]


def test_merge_frequencies(spark):
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "owner int, item string")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "item string, df long")
    c = spark.createDataFrame([(1, "b"), (1, "d"), (4, "c")], "owner int, item string")
    assert sorted(tuple(r) for r in merge_frequencies(df, s, c).collect()) == [("b", 2), ("c", 2), ("d", 1)]
