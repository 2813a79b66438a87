"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's 3-word shingles. Each of the 64 bits
gets a non-zero vector of F_2^(r+1); the table of a non-zero vector v compares the bits whose vector has an odd
product with v. For r differing bits some v is orthogonal to all their vectors, so every pair within radius r
agrees in some table: no pair is lost, with 2^(r+1)-1 tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from passerelle.llm.common import checkpointed, hot_join, read, row_key, written

WORDS, SEED, RADIUS = 3, 42, 3
#: Distinct fingerprints of a bucket that are compared pair by pair; larger buckets go through flipped keys.
LARGE = 256


def fingerprint(text: str | None, shingle: int = WORDS, seed: int = SEED) -> int:
    """The SimHash as a signed 64-bit integer; 0 for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is \\x20 \\x09-\\x0D
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        count += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([fingerprint(t) for t in part], dtype="int64")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The bits that each table compares, as signed integers."""
    size = 1 << (radius + 1)
    of_bit = [1 + i % (size - 1) for i in range(bits)]
    out = [sum(1 << i for i, m in enumerate(of_bit) if (m & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def bucketed(nodes: DataFrame, radius: int) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks(radius))])
    return nodes.select("fp", F.explode(tables).alias("b")).select("b.t", "b.key", "fp")


def near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def flips(mask: int, most: int, bits: int = 64) -> list[int]:
    """Every pattern of at most `most` bits that the mask leaves out, as signed integers."""
    free = [i for i in range(bits) if not mask >> i & 1]
    found = [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(free, n)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def links_of_large(members: DataFrame, radius: int) -> DataFrame:
    """Links that connect what lies within the radius inside large buckets, without comparing all pairs.

    Two members within r bits share a key that is at most r // 2 flips from one and r - r // 2 from the other,
    flipping only bits that the table doesn't compare. Everyone at a key is linked to its smallest closely
    flipped member, which is within r of them all, so the links are real and join the same components. A key has
    no more members than there are flips, whatever the bucket's size.
    """
    far, close = radius - radius // 2, radius // 2
    # as a table of a row for each mask: thousands of literals in a plan would be copied over and over in the driver
    ways = members.sparkSession.createDataFrame([(t, flips(m, far)) for t, m in enumerate(masks(radius))], "t int, ways array<long>")
    at = members.join(F.broadcast(ways), "t").select("t", "fp", F.explode("ways").alias("way"))
    at = at.select("t", F.col("fp").bitwiseXOR(F.col("way")).alias("at"), "fp", (F.bit_count("way") <= close).alias("close"))
    first = at.where("close").groupBy("t", "at").agg(F.min("fp").alias("a"))
    return at.join(first, ["t", "at"]).where("fp <> a").select("a", F.col("fp").alias("b"))


def links(nodes: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`: every pair within the radius is linked or joined by a path of links."""
    dealt = bucketed(nodes, radius)
    shared = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(dealt.join(shared, ["t", "key"]), "buckets")
    small = members.where(F.col("n") <= large)
    a, b = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & near(F.col("a"), F.col("b"), radius)).select("a", "b")
    rest = members.where(F.col("n") > large)
    return (pairs.unionByName(links_of_large(rest, radius)) if rest.head(1) else pairs).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: root is the smallest node of its component.

    Alternates large-star and small-star steps, each linear in the links, until the links are stars.
    """
    now, was = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    sign = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).head())
    while was != (was := sign(now)):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        step = now.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = checkpointed(step.where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """doc_id, row_key (of id and text), fp (long), fingerprint (hex), component (its least fp) and component_id of each row.

    Null and empty texts have fingerprint zero, which links like any other. Equal fingerprints are one node, so
    copies are never paired with each other. component_id is the smallest non-null doc_id that is reachable; repeated
    doc_ids stay separate rows. Other columns of docs are not read.
    """
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), simhash(F.col(text)).alias("fp")), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp"), radius, large))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = checkpointed(named)
    ids = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of = named.join(ids, "root").select("fp", F.col("root").alias("component"), "component_id", "n")
    out = hot_join(rows, of, ["fp"], "n", F.xxhash64("doc_id"))
    return out.select("doc_id", "row_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id (nulls first), then row_key. Of rows equal in both any one stays."""
    least = near_duplicates(docs, doc_id, text, radius).groupBy("component").agg(F.min(F.struct("doc_id", "row_key"))["row_key"].alias("_key"))
    return docs.withColumn("_key", row_key(doc_id, text)).join(least.select("_key"), "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
