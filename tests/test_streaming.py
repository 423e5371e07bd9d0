from __future__ import annotations

from leafmill.streaming import logs


def test_stream_counts_as_the_table_does(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = logs.counts(logs.read_stream(spark, str(tmp_path / "in"), "part-*.parquet", 3))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("log_counts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("log_counts").collect())) == sorted(map(tuple, logs.counts(events).collect()))
