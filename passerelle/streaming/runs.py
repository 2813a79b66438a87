"""Bounded runs of streams, and tables that always show a whole result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from passerelle.sources.shared import shared_dir

#: State beside the heap, of which a batch writes what has changed; for streams with many keys.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession, settings: dict[str, str] = STATE_STORE) -> Iterator[None]:
    """The settings for streams that start inside; then what was set before. A stream keeps the store that its checkpoint began with."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_batch(path: str):
    """For foreachBatch in complete mode: each batch goes to a folder of its own, then its marker is written. A batch that runs again replaces its folder."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/{number}")
        batch.sparkSession.range(1, numPartitions=1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{path}/done/{number}")

    return keep


def newest(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The last batch that was written to its end; None before the first. Folders without a marker don't count."""
    try:
        number = spark.read.schema("number long").option("recursiveFileLookup", True).parquet(f"{path}/done").agg(F.max("number")).head()[0]
    except AnalysisException:
        return None
    return spark.read.schema(schema).parquet(f"{path}/batches/{number}") if number is not None else None


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives until its source is read to the end; in complete mode its last result."""
    spark = stream.sparkSession
    path = shared_dir(spark, "stream")
    run = stream.writeStream.option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        run.format("parquet").option("path", f"{path}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")
    run.foreachBatch(keep_batch(path)).start().awaitTermination()
    last = newest(spark, path, stream.schema)
    return last if last is not None else spark.createDataFrame([], stream.schema)
