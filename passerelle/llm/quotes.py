"""Quotation linking: which message a quoted passage comes from, and conversations in reply order without quotes.

Lines that start with `>` are quoted, a mark for each level. A message's own passages (paragraphs and their lines) and
its quoted passages (paragraphs of one level, and their lines) are normalised and hashed. A quote of level n links to the
earliest message of the conversation that has the passage at level n - 1, where level 0 is what it says itself; failing
that, to the earliest that says it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passerelle.llm.common import checkpointed, hot_join, read, written

MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
PARSED = "own_text string, max_level int, own array<binary>, quoted array<struct<level:int,hash:binary,chars:int>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def parse(text: str | None) -> tuple[str | None, int, list[bytes], list[tuple[int, bytes, int]]]:
    """(text without quotes, deepest level, hashes of own passages, quoted passages) of a message. Blank passages are left out."""
    if text is None:
        return None, 0, [], []
    runs: list[tuple[int, list[str]]] = []  # (level, lines); a blank line, own or quoted, ends a paragraph
    own: list[str] = []
    for row in text.split("\n"):
        m = MARK.match(row)
        level, body = (m[1].count(">"), row[m.end() :]) if m else (0, row)
        if not level:
            own.append(row)
        if runs and runs[-1][0] == level and body.strip() and runs[-1][1][-1].strip():
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    said, quoted = set(), {}
    for level, lines in runs:
        whole = normal(" ".join(lines))
        for passage in {whole, *map(normal, lines)}:
            if passage:
                if level:
                    quoted[level, digest(passage)] = len(passage)
                else:
                    said.add(digest(passage))
    deepest = max((level for level, _ in runs), default=0)
    # what a quote leaves behind are the blank lines around it
    rest = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if deepest else text
    return rest, deepest, sorted(said), [(level, h, n) for (level, h), n in sorted(quoted.items())]


def parsed(messages: DataFrame, text: str) -> DataFrame:

    @F.pandas_udf(PARSED)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([parse(t) for t in part], columns=["own_text", "max_level", "own", "quoted"])

    return messages.withColumn("_p", of(F.col(text)))


def roots(links: DataFrame) -> DataFrame:
    """conv, turn, root, depth from links (conv, turn, parent), whose parents come earlier: by doubling, so a chain of n links takes log n rounds."""
    now = checkpointed(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        step = now.join(up, ["conv", "root"], "left")
        if not step.where("_root is not null").head(1):
            return now
        now = checkpointed(step.select("conv", "turn", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", least: int = 12) -> DataFrame:
    """messages with own_text, n_quotes, max_level, reply_to, thread and depth.

    reply_to is the turn that the most quoted characters of the first level come from (ties: the later turn), among the
    earlier turns of the conversation; null without one. Next count deeper quotes that the turn quotes one level less deep, then
    deeper quotes that it says itself; passages under `least` normalised characters count only after all longer ones. thread is the first turn of the chain of replies, the message's own turn
    if it replies to nothing, and depth the links to it: by (conversation, thread, turn) every message follows what it
    replies to. Null texts stay null; null conversations or turns are linked to nothing; rows that repeat a turn share its links.
    Columns of the added names are replaced.
    """
    names = ("own_text", "n_quotes", "max_level", "reply_to", "thread", "depth")
    keep = [c for c in messages.columns if c not in names]
    rows = written(parsed(messages.select(*keep), text).withColumns({"conv": F.col(conv), "_turn": F.col(turn)}), "parsed")  # parsed once, read by every step
    units = rows.where("conv is not null and _turn is not null")
    # the earliest turn that has each passage at a level; many may have it, so sums are made before the shuffle
    had = F.concat(F.transform("_p.own", lambda h: F.struct(F.lit(0).alias("at"), h.alias("hash"))), F.transform("_p.quoted", lambda q: F.struct(q["level"].alias("at"), q["hash"].alias("hash"))))
    first = units.select("conv", "_turn", F.explode(had).alias("h")).select("conv", "_turn", "h.*").groupBy("conv", "at", "hash").agg(F.min("_turn").alias("said"))
    quoted = units.select("conv", "_turn", F.explode("_p.quoted").alias("q")).select("conv", "_turn", "q.*")
    # kind: a first-level quote, a deeper one by what quoted it before, a deeper one by who says it
    direct, said = F.when(F.col("level") == 1, F.lit(0)).otherwise(F.lit(1)), F.when(F.col("level") > 1, F.struct(F.lit(0).alias("at"), F.lit(2).alias("kind")))
    ways = F.array_compact(F.array(F.struct((F.col("level") - 1).alias("at"), direct.alias("kind")), said))
    asked = written(quoted.withColumn("w", F.explode(ways)).select("conv", "_turn", "hash", "chars", "w.at", "w.kind").distinct(), "quoted")
    count = asked.groupBy("conv", "at", "hash").agg(F.count("*").alias("n"))
    found = hot_join(asked, first.join(count, ["conv", "at", "hash"]), ["conv", "at", "hash"], "n", F.xxhash64("_turn")).where("said < _turn")
    sums = [F.sum(F.when((F.col("kind") == k) & ((F.col("chars") >= least) == long), F.col("chars")).otherwise(0)).alias(f"_{k}{long}") for long in (True, False) for k in range(3)]
    ranks = [f"_{k}{long}" for long in (True, False) for k in range(3)]
    best = found.groupBy("conv", "_turn", "said").agg(*sums).groupBy("conv", "_turn").agg(F.max(F.struct(*ranks, "said"))["said"].alias("parent"))
    links = checkpointed(best.select("conv", F.col("_turn").alias("turn"), "parent"))
    at = links.join(roots(links).drop("parent"), ["conv", "turn"]).select("conv", F.col("turn").alias("_turn"), "parent", "root", F.col("depth").alias("_depth"))
    out = rows.join(at, ["conv", "_turn"], "left")
    return out.select(
        *keep,
        F.col("_p.own_text").alias("own_text"),
        F.size("_p.quoted").alias("n_quotes"),
        F.col("_p.max_level").alias("max_level"),
        F.col("parent").alias("reply_to"),
        F.coalesce("root", "_turn").alias("thread"),
        F.coalesce("_depth", F.lit(0)).alias("depth"),
    )


def with_quotes(messages: DataFrame) -> DataFrame:
    """Conversations whose messages quote the one before, quotes and all, over their own text: what mail threads look like. The first of each has none."""
    before = messages.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_before"))
    older = messages.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("_older"))
    rows = messages.join(before, ["conv_id", "turn"], "left").join(older, ["conv_id", "turn"], "left")
    marked = lambda c, mark: F.regexp_replace(c, "(?m)^", mark)
    quote = F.concat(F.coalesce(F.concat(marked(F.col("_older"), ">> "), F.lit("\n>\n")), F.lit("")), marked(F.col("_before"), "> "), F.lit("\n\n"))
    return rows.withColumn("text", F.concat(F.coalesce(quote, F.lit("")), "text")).drop("_before", "_older")


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(with_quotes(read(spark, sf_dir, "conversations"))).drop("text")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "conversations")).drop("text")
