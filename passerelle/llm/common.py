"""What the operators share: reading tables, shared folders, bounded samples, joins on hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary one if Spark runs in one process, else it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='passerelle-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: its lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark drops the shuffle files of finished stages now instead of some time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """A round of an iteration, written: unlike checkpoint() it keeps none of the plan's constraints, which unions of later rounds trip over."""
    return written(df, "round")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text modulo folds; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def row_key(*columns: str) -> Column:
    """A digest of the columns' text that repeated rows share, and no others: each value goes in behind its length, a null as a mark."""
    text = [F.col(c).cast("string") for c in columns]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])))


def sampled(rows: DataFrame, label: str, key: str, per_label: int, seed: int = 17, max_labels: int = 1000) -> DataFrame:
    """About per_label rows of each label, chosen by a hash of the key, in one extra pass over label and key.

    The rows that come out are at most about 1.2 * per_label + 60 for each label, whatever the input's size.
    Labels beyond max_labels raise: their samples would no longer be bounded.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=str):
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, (1.1 * per_label + 40) / n))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(unit < share)


def hot_join(left: DataFrame, right: DataFrame, key: list[str], n: str, spread: Column, shares: int = 1000) -> DataFrame:
    """left LEFT JOIN right on key (unique in right), where right.n says how many rows of left have the key.

    Keys that hold over 1/shares of left are at most `shares`, so they are broadcast, and their rows in left
    are dealt by `spread` instead of the key; the rest is an ordinary shuffled join without large groups.
    right is written first, since it is read three times.
    """
    right = written(right, "join-keys")
    total = right.agg(F.sum(n)).head()[0] or 0
    values = [c for c in right.columns if c not in key]
    hot = right.where(F.col(n) * shares > total).select(*key, F.struct(*values).alias("_hot"))
    cold = right.where(F.col(n) * shares <= total).select(*[F.col(k).alias(f"_k_{k}") for k in key], F.struct(*values).alias("_cold"))
    out = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(spread))
    cold = cold.withColumn("_k_salt", F.lit(0))
    on = [out[k] == cold[f"_k_{k}"] for k in key] + [out["_salt"] == cold["_k_salt"]]
    out = out.join(cold, on, "left").drop(*[f"_k_{k}" for k in key], "_k_salt", "_salt")
    got = F.coalesce("_hot", "_cold")
    return out.withColumns({v: got[v] for v in values}).drop("_hot", "_cold")
