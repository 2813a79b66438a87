"""Streams give what the batch steps give."""

from pyspark.sql import functions as F

from passerelle.operators.health import check_pages
from passerelle.streaming import runs, streams


def test_first_seen_across_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "url string, ts timestamp"

    def arrive(*urls):
        spark.createDataFrame([(u,) for u in urls], "url string").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(source)
        stream = streams.stream_first_seen(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["url"] for r in spark.read.schema(schema).parquet(out).collect())

    assert arrive("a", "b", "a") == ["a", "b"]
    assert arrive("b", "c") == ["a", "b", "c"]


def test_health_is_the_batch_step(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "<p>Page not found</p>", 200), ("u2", None, 404), ("u3", "<p>ok</p>", 0)], "url string, html string, status int")
    pages.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "p"))
    got = sorted(map(tuple, runs.drained(streams.stream_link_health(stream)).collect()))
    assert got == sorted(map(tuple, check_pages(pages).collect()))
    done = runs.drained(streams.stream_progress(streams.stream_link_health(stream), 8), "complete").head()
    assert (done["done"], done["failed"], done["percent"]) == (3, 3, 37.5)


def test_bounded_state_across_restarts(spark, tmp_path):
    """Within an hour of event time a key comes once, restarts or not; behind the watermark its state is dropped and it may come again."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "url string, ts timestamp"

    def arrive(*rows):
        spark.createDataFrame(rows, "url string, ts string").select("url", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        with runs.state_store(spark):
            stream = streams.stream_first_seen(spark.readStream.schema(schema).parquet(source), ts="ts", within="1 hour")
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
        return sorted(r["url"] for r in spark.read.schema(schema).parquet(out).collect()), query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert arrive(("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:01:00"), ("a", "2024-01-01 10:02:00")) == (["a", "b"], 2)
    assert arrive(("a", "2024-01-01 10:30:00"), ("c", "2024-01-01 10:31:00"))[0] == ["a", "b", "c"]
    # a day later all of that is over
    seen, size = arrive(("d", "2024-01-02 10:00:00"))
    assert seen == ["a", "b", "c", "d"] and size == 1
    seen, size = arrive(("a", "2024-01-02 10:10:00"), ("a", "2024-01-02 10:20:00"))
    assert seen == ["a", "a", "b", "c", "d"] and size == 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != runs.STATE_STORE["spark.sql.streaming.stateStore.providerClass"]


def test_readers_meet_whole_results_only(spark, tmp_path, monkeypatch):
    """A stop between a batch and its marker: readers keep the result before, and the batch that runs again replaces what was left."""
    path = str(tmp_path)
    keep, schema = runs.keep_batch(path), "done long"
    assert runs.newest(spark, path, schema) is None
    keep(spark.range(1).toDF("done"), 0)
    writer, seen = type(spark.range(1).write), []
    write = writer.parquet

    def stopping(self, path, *more, **options):
        seen.append(path)
        if "/done/" in path:
            raise KeyboardInterrupt
        return write(self, path, *more, **options)

    monkeypatch.setattr(writer, "parquet", stopping)
    try:
        keep(spark.range(5).toDF("done"), 1)
    except KeyboardInterrupt:
        pass
    monkeypatch.setattr(writer, "parquet", write)
    assert len(seen) == 2 and runs.newest(spark, path, schema).count() == 1
    keep(spark.range(7).toDF("done"), 1)
    assert runs.newest(spark, path, schema).count() == 7
