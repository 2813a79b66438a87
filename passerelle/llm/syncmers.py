"""Document fingerprints from closed syncmers of words. Native columns only.

A run of k words is a closed syncmer if the smallest hash among its inner runs of s words is the first or the last
of them. That depends on the run alone, not on its neighbours, so an edit changes only the anchors that it touches; about two in
k - s + 1 runs are anchors. A fingerprint is every anchor of a whole text with its position, in the text's order.

Two fingerprints are matched by position: anchors that each text has once vote for the offset between the texts, and an anchor counts
if the other text has it at this offset, BAND words aside at most. Passages in another order therefore don't count as alike.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType

from passerelle.llm.common import read

K, S, BAND = 8, 2, 64
#: An anchor is a long: 32 bits of hash, 31 of position, and a bit that is free for the side of a comparison.
NONE = "array<bigint>"


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """df with `out`: the anchors of the text in order. A text without a closed syncmer has one anchor, of all its words at position 0; an empty one none."""
    words = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col("_h")
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[h[i + j] for j in range(s)])) if s > 1 else h
    df = df.withColumn("_g", F.when(F.size(h) >= k, grams).otherwise(F.array().cast(NONE)))
    g, last = F.col("_g"), k - s

    def anchor(i: Column) -> Column:
        mid = [g[i + j] for j in range(1, last)]
        closed = F.least(g[i], g[i + last]) <= (F.least(*mid) if len(mid) > 1 else mid[0])
        return F.when(closed, packed(F.xxhash64(*[h[i + j] for j in range(k)]), i))

    df = df.withColumn("_a", F.when(F.size(h) >= k, F.array_compact(F.transform(F.sequence(F.lit(0), F.size(h) - k), anchor))).otherwise(F.array().cast(NONE)))
    whole = F.when(F.size(h) > 0, F.array(packed(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast(NONE))
    return df.withColumn(out, F.when(F.size("_a") > 0, F.col("_a")).otherwise(whole)).drop("_h", "_g", "_a")


def packed(h: Column, at: Column) -> Column:
    return F.shiftleft(h, 32).bitwiseOR(F.shiftleft(at.cast("long"), 1))


def place(x: Column) -> Column:
    return F.shiftright(x.bitwiseAND(F.lit(0xFFFFFFFF)), 1)


def same(x: Column, y: Column) -> Column:
    """Whether two anchors have equal hashes; false beside the end of a list."""
    return F.coalesce(F.shiftright(x, 32) == F.shiftright(y, 32), F.lit(False))


def sides(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y).bitwiseAND(F.lit(1)) == 1


def as_text(anchors: str) -> Column:
    """16 hex digits an anchor: hash and twice its position."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def merged(a: Column, b: Column) -> Column:
    """Both lists by hash, then position; the last bit tells the second list."""
    return F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(1)))))


def with_likeness(df: DataFrame, a: str, b: str, out: str, band: int = BAND) -> DataFrame:
    """df with `out`, 0 to 1: the share of both lists' anchors that the other list has at the common offset; two empty lists are alike.

    The common offset is the most frequent one, in steps of `band`, among anchors that both lists have once; on ties the
    smallest, then the negative one; 0 without votes. Sorting is all that takes more than linear time.
    """
    df = df.withColumn("_m", merged(F.col(a), F.col(b)))
    m = F.col("_m")

    def vote(x: Column, i: Column) -> Column:
        y = F.get(m, i + 1)
        # the first list's comes first at equal positions; the side bit is the last
        once = same(x, y) & sides(x, y) & ~same(x, F.get(m, i - 1)) & ~same(x, F.get(m, i + 2))
        apart = (place(x) - place(y)) * F.when(x.bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1)
        return F.when(once, F.floor(apart / band + 0.5))

    df = df.withColumn("_v", F.sort_array(F.array_compact(F.transform(m, vote))))
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("bin", "run", "best", "most")])

    def count(acc: Column, v: Column) -> Column:
        run = F.when((acc["run"] > 0) & (acc["bin"] == v), acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        better = (run > acc["most"]) | ((run == acc["most"]) & (F.abs(v) < F.abs(acc["best"])))
        return F.struct(v.alias("bin"), run.alias("run"), F.when(better, v).otherwise(acc["best"]).alias("best"), F.greatest(run, acc["most"]).alias("most"))

    df = df.withColumn("_o", F.aggregate("_v", zero, count, lambda acc: acc["best"]) * F.lit(2 * band)).drop("_v")
    # positions stay positive: the list that lies ahead of the other moves back to it
    shift = lambda c, by: F.transform(c, lambda x: x + by)
    moved = F.when(F.col("_o") > 0, merged(F.col(a), shift(F.col(b), F.col("_o")))).when(F.col("_o") < 0, merged(shift(F.col(a), -F.col("_o")), F.col(b))).otherwise(m)
    df = df.withColumn("_n", moved)
    n = F.col("_n")
    near = lambda x, y: same(x, y) & sides(x, y) & (F.abs(place(x) - place(y)) <= band)
    hits = F.size(F.filter(n, lambda x, i: near(x, F.get(n, i + 1)) | near(x, F.get(n, i - 1))))
    return df.withColumn(out, F.when(F.size(n) == 0, F.lit(1.0)).otherwise(hits / F.size(n))).drop("_m", "_o", "_n")


def listed(values: list, kind: DataType) -> Column:
    """An array constant as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values, default=str)), ArrayType(kind))


def at_or_below(bounds: list[float], key: Column) -> Column:
    """How many of the sorted bounds are at most the key: a binary search."""
    held = listed(bounds, DoubleType())
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(bounds)) & (F.get(held, n + step - 1) <= key), n + step).otherwise(n))


def as_number(df: DataFrame, key: str) -> Column:
    """A number that never falls as the key rises: of text, its first six bytes."""
    if df.schema[key].dataType.typeName() in ("string", "varchar", "char"):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(key).cast("double")


def with_next(df: DataFrame, key: str, columns: dict[str, str], tie: str, per_bucket: int = 4000, most: int = 1 << 16) -> DataFrame:
    """df with the named columns of the next row by ascending key, after the last the first; ties by `tie`, nulls first.

    Rows are dealt to ranges of the numeric key, each with a second copy of the next range's first rows, so one shuffle
    is all and no task has more than a range. Ranges that repeat one key only are as large as that key's rows.
    """
    n = df.count()
    ranges = max(1, min(most, n // per_bucket))
    number = as_number(df, key)
    bounds = sorted(set(df.select(number.alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    of = at_or_below(bounds, number) if bounds else F.lit(0)
    df = df.withColumn("_range", F.when(F.col(key).isNull(), F.lit(0)).otherwise(of))
    # the least key of each range that has rows: `most` values
    least = {r[0]: r[1] for r in df.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull(), F.col(key).alias("k")))["k"].alias("k")).collect()}
    held = sorted(least)
    before = {b: held[i - 1] for i, b in enumerate(held)}
    every = range(len(bounds) + 1)
    head = F.get(listed([least.get(b) for b in every], df.schema[key].dataType), F.col("_range"))
    twice = F.when(F.col(key).eqNullSafe(head), F.get(listed([before.get(b) for b in every], IntegerType()), F.col("_range")))
    dealt = F.array_compact(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("again")), F.when(F.col("_twice").isNotNull(), F.struct(F.col("_twice").alias("r"), F.lit(1).alias("again")))))
    df = df.withColumn("_twice", twice).withColumn("_in", F.explode(dealt)).drop("_range", "_twice")
    # plain columns, so that all leads share one shuffle
    df = df.select("*", F.col("_in.r").alias("_r"), F.col("_in.again").alias("_again")).drop("_in")
    w = Window.partitionBy("_r").orderBy("_again", F.col(key).asc_nulls_first(), tie)
    df = df.select("*", *[F.lead(column).over(w).alias(name) for column, name in columns.items()])
    return df.where("_again = 0").drop("_r", "_again")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S, band: int = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    A null text counts as empty. Rows with equal doc_ids follow each other by text; a single row is its own next.
    Equal texts have equal fingerprints, and so have texts that differ in white space only. Other columns of docs are not read.
    doc_ids are numbers, timestamps or text. Rows of one repeated doc_id (or of none) are ordered by one task.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_anchors(rows, "text", "own", k, s), "doc_id", {"text": "_text", "own": "next"}, "text")
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_text", F.lit(1), cut)))
    rows = with_anchors(rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next", "edited"), "edited", "other", k, s)
    rows = with_likeness(with_likeness(rows, "own", "other", "near_edited", band), "own", "next", "near_next", band)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"), "near_edited", "near_next")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
