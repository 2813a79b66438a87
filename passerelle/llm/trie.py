"""The prefix trie of conversations, and totals of subtrees by parallel tree contraction.

A turn's position and content hash to 128 bits, and a prefix is the XOR of its turns' hashes, so prefixes of a conversation of any
length come from sums of blocks that are spread over tasks. Each distinct prefix is a node. Totals of subtrees come from rounds of
joins: rake takes the leaves off and adds them to their parents, compress takes nodes with one child out of chains, a third of these
at least wherever they stand; so the tree shrinks by a constant share each round, deep chains and wide roots alike. The nodes taken
out of chains are then expanded again: their totals are what they held plus the totals of the nodes that took their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passerelle.llm.common import read, written

GROUP, HEADS = 100, 6


def halves(digest: Column) -> list[Column]:
    """The two longs of an MD5 in hex."""
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def blocks(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """rows, written in the order of `by` and `order`, with `at` (increasing in that order) and `part`, its block of rows of one task.

    Rows are dealt by ranges of the whole order, so a `by` with very many rows spreads over many blocks.
    """
    dealt = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    keep = [c for c in rows.columns if c not in order]
    return written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).select(*keep, "part", "at"), "blocks")


def running(rows: DataFrame, by: str, total: Callable[[Column], Column], plus: Callable[[Column, Column], Column], **values: Column) -> DataFrame:
    """rows with each value's running total over `by`, in the order of (part, at): within blocks, plus what the blocks before hold.

    `total` is an aggregate function, `plus` adds two of its results.
    """
    inside = Window.partitionBy("part", by).orderBy("at")
    sums = rows.groupBy("part", by).agg(*[total(v).alias(f"_{k}") for k, v in values.items()])
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", by, *[F.coalesce(total(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values])
    out = rows.withColumns({k: total(v).over(inside) for k, v in values.items()}).join(sums, ["part", by])
    return out.withColumns({k: plus(F.col(k), F.col(f"_{k}")) for k in values}).drop(*[f"_{k}" for k in values])


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, part, at, pos (from 1), d1, d2 (digest of role and text), size (code points): turns by number, nulls first, ties by role and text."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    own = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    own = own.withColumns({"d": digest, "size": F.char_length("text").cast("long")}).withColumns(dict(zip(("d1", "d2"), halves(F.col("d")), strict=True))).drop("d")
    return running(blocks(own, "conv", "turn", "role", "text"), "conv", F.sum, lambda a, b: a + b, pos=F.lit(1))


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): conv, n_turns of each, and conv, part, at, depth (from 1), d1, d2, size of their turns once rebuilt.

    A conversation takes the first h turns of the one at the start of its group, h = crc32(conv) % heads, in place of its own first h.
    """
    base = F.col("conv") - F.col("conv") % group
    h = F.crc32(F.col("conv").cast("string")) % heads
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.withColumns({"base": base, "h": h}).join(bases, "base", "left")
    convs = convs.withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv", "base", "h", "n_head", "n_turns"), "conversations")
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < heads)).select(F.col("conv").alias("base"), "pos", "d1", "d2", "size")
    head = convs.where("n_head > 0").join(first, "base").where("pos <= n_head").select("conv", F.lit(-1).alias("part"), F.col("pos").cast("long").alias("at"), F.col("pos").alias("depth"), "d1", "d2", "size")
    tail = turns.where(F.col("pos") > h).join(convs.select("conv", "n_head"), "conv").select("conv", "part", "at", (F.col("pos") - h + F.col("n_head")).alias("depth"), "d1", "d2", "size")
    return convs.select("conv", "n_turns"), head.unionByName(tail)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, k1, k2 (the prefix up to this turn), p1, p2 (that before it), size."""
    placed = F.md5(F.concat_ws(":", "depth", "d1", "d2"))
    own = turns.withColumns(dict(zip(("t1", "t2"), halves(placed), strict=True)))
    own = running(own, "conv", F.bit_xor, lambda a, b: a.bitwiseXOR(b), k1=F.col("t1"), k2=F.col("t2"))
    return own.select("conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "size")


def joined_digests(ends: DataFrame, by: list[str], value: str, per_row: int = 10_000) -> DataFrame:
    """by, sha256 of each group's values in ascending order, as decimals joined by commas.

    A group's values are put in order by ranges of (by, value), and joined to rows of at most `per_row`; what remains of a group, one row
    for each of these, streams through one digest, as SHA-256 has no other way. Memory is bounded whatever the group's size.
    """
    dealt = ends.select(*by, value).repartitionByRange(*by, value).sortWithinPartitions(*by, value)
    sorted_ = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ends")
    chunk = F.floor((F.row_number().over(Window.partitionBy("part", *by).orderBy("at")) - 1) / per_row)
    lines = sorted_.withColumn("chunk", chunk).groupBy("part", "chunk", *by).agg(F.min("at").alias("at"), F.sort_array(F.collect_list(value)).alias("v"))
    lines = lines.select(*by, "at", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("line"))
    schema = ", ".join(f"{c} {t}" for c, t in lines.dtypes if c in by) + ", sha256 string"

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in parts:
            done = []
            for *key, line in part[[*by, "line"]].itertuples(index=False, name=None):
                if key != now:
                    if now is not None:
                        done.append([*now, state.hexdigest()])
                    now, state = key, hashlib.sha256(line.encode())
                else:
                    state.update(b"," + line.encode())
            yield pd.DataFrame(done, columns=[*by, "sha256"])
        if now is not None:
            yield pd.DataFrame([[*now, state.hexdigest()]], columns=[*by, "sha256"])

    return lines.repartition(*by).sortWithinPartitions(*by, "at").mapInPandas(digest, schema)


def subtree_totals(nodes: DataFrame, values: list[str], most_rounds: int = 500) -> DataFrame:
    """id and, for each value, the sum over the node's subtree. nodes: id (unique long), parent (null for roots), the values.

    In a round every leaf is raked: its sum goes to its parent, one message a leaf, added up before the shuffle. Then every node with
    one child whose rank of this round exceeds its child's and its parent's is compressed: the child takes its place and notes what it
    passes over. No two neighbours go at once, as only one of them ranks above the other. Each node knows the XOR of its children, so one with a
    single child knows which. Parents that aren't in the table are errors of the caller.
    """
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.bit_xor("id").alias("kid"))
    over = {f"over_{v}": F.lit(0).cast("long") for v in values}  # what lies between a node and its present parent
    live = nodes.select("id", "parent", *[F.col(v).cast("long") for v in values]).join(kids, "id", "left").na.fill(0, ["n", "kid"]).withColumns(over)
    live, done, events = written(live, "tree"), [], []
    for number in range(most_rounds):
        # rake
        gains = live.where("n = 0 and parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.count("*").alias("_n"), F.bit_xor("id").alias("_kid"), *[F.sum(F.col(v) + F.col(f"over_{v}")).alias(f"_{v}") for v in values]
        )
        done.append(live.where("n = 0").select("id", *values))
        raked = live.where("n > 0").join(gains, "id", "left")
        raked = raked.withColumns({"n": F.col("n") - F.coalesce("_n", F.lit(0)), "kid": F.col("kid").bitwiseXOR(F.coalesce("_kid", F.lit(0))), **{v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}})
        live = written(raked.select(live.columns), "raked")
        # compress
        rank = lambda c: F.xxhash64(F.lit(number), F.col(c))  # noqa: B023, E731
        gone = (F.col("n") == 1) & F.col("parent").isNotNull() & (rank("id") > rank("kid")) & (rank("id") > rank("parent"))
        marked = live.withColumn("_gone", F.coalesce(gone, F.lit(False)))
        none = F.lit(None).cast("long")
        to_kid = F.struct(F.col("kid").alias("to"), F.col("parent").alias("lifted"), F.col("id").alias("from"), F.lit(0).cast("long").alias("flip"), *[F.col(v).alias(f"own_{v}") for v in values], *[F.col(f"over_{v}").alias(f"far_{v}") for v in values])
        to_parent = F.struct(F.col("parent").alias("to"), none.alias("lifted"), none.alias("from"), F.col("id").bitwiseXOR(F.col("kid")).alias("flip"), *[none.alias(f"own_{v}") for v in values], *[none.alias(f"far_{v}") for v in values])
        sent = marked.where("_gone").select(F.explode(F.array(to_kid, to_parent)).alias("m")).select("m.*")
        sent = sent.groupBy(F.col("to").alias("id")).agg(F.max("lifted").alias("lifted"), F.max("from").alias("from"), F.bit_xor("flip").alias("flip"), *[F.max(f"{x}_{v}").alias(f"{x}_{v}") for x in ("own", "far") for v in values])
        step = marked.where("not _gone").join(sent, "id", "left")
        through = written(
            step.select(
                "id", F.coalesce("lifted", "parent").alias("parent"), *values, "n", F.col("kid").bitwiseXOR(F.coalesce("flip", F.lit(0))).alias("kid"),
                *[(F.col(f"over_{v}") + F.coalesce(F.col(f"own_{v}") + F.col(f"far_{v}"), F.lit(0))).alias(f"over_{v}") for v in values],
                "from", *[(F.col(f"over_{v}") + F.col(f"own_{v}")).alias(f"add_{v}") for v in values],
            ),
            "compressed",
        )
        events.append(through.where("from is not null").select(F.col("from").alias("id"), F.col("id").alias("to"), *[F.col(f"add_{v}").alias(v) for v in values]))
        live = through.select(live.columns)
        if not live.head(1):
            break
    else:
        raise RuntimeError(f"the tree isn't contracted in {most_rounds} rounds")
    totals, chained = (written(reduce(DataFrame.unionByName, parts), name) for parts, name in ((done, "totals"), (events, "chains")))
    return totals.unionByName(expanded(chained, totals, values))


def expanded(chained: DataFrame, totals: DataFrame, values: list[str], most_rounds: int = 64) -> DataFrame:
    """id and totals of the compressed nodes: (id, to, values) says that id's total is that of `to` plus the values.

    Each round a node goes on to where its `to` goes, so a chain of length n takes log n rounds until it ends at a raked node.
    """
    now = chained
    for _ in range(most_rounds):
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), *[F.col(v).alias(f"_{v}") for v in values])
        step = now.join(ahead, "to", "left")
        now = written(step.select("id", F.coalesce("_to", "to").alias("to"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], F.col("_to").isNotNull().alias("moved")), "chains")
        if not now.where("moved").head(1):
            break
        now = now.drop("moved")
    ends = totals.select(F.col("id").alias("to"), *[F.col(v).alias(f"_{v}") for v in values])
    return now.join(ends, "to").select("id", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, nulls first, and equal numbers by role and text, so that the order of rows changes nothing; repeated rows are
    turns each. Null role and text are empty. Rows without conv_id belong to no conversation and are left out. A conversation that has no turns left
    once rebuilt ends at the root. An empty table has no nodes, not even the root. Other columns are not read.
    """
    convs, turns = rebuilt(numbered(conversations, conv, turn, role, text), group, heads)
    zero = F.lit(0).cast("long")
    paths = prefixes(turns).unionByName(convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("size")))
    key = ["depth", "k1", "k2"]
    nodes = paths.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("size").alias("size"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(nodes.join(above, ["depth", "p1", "p2"], "left"), "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "id", "left").na.fill(0, ["n_children"])
    values = nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    totals = subtree_totals(values, ["n_leaves", "saved_tokens"])
    at_end = paths.join(convs.select("conv", F.col("n_turns").alias("depth")), ["conv", "depth"]).select(*key, "conv")
    ends = joined_digests(at_end, key, "conv")
    out = nodes.join(totals, "id").join(ends, key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))
