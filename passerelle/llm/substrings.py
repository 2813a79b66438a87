"""Exact removal of repeated windows of words, behind a count-min prefilter.

A window's rarest-looking gram (the smallest hash among its short word grams, leftmost on ties) anchors it. Equal windows
have equal anchors at equal distances, so the count of an anchor is never below that of its windows. Partition
sketches count anchors; merged, they overestimate every window's count, and only anchors that are estimated
repeated go on. The second pass groups these exactly: first whole spans (an anchor with all of its windows), then,
where an anchor's spans differ, single windows. No repeated window is lost, and none is removed on an estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passerelle.llm.common import hot_join, read, released, written

WINDOW, GRAM = 35, 8
#: Cells of a sketch block, and words that are hashed at once (a longer text goes alone).
BLOCK, AT_ONCE = 1 << 20, 1 << 18
#: Odd multiplier of the rolling hash, its inverse modulo 2^64, and the two rows' seeds.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, from the words' hashes."""
    n = len(words)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(STEP, n), dtype=np.uint64)])
    return mixed((total[width:] - total[:-width]) * powers(BACK, n)[: n - width + 1])


def smallest(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    have = 1
    while have * 2 <= width:
        key, have = np.minimum(key[:-have], key[have:]), have * 2
    return key if have == width else np.minimum(key[: len(key) - (width - have)], key[width - have :])


def anchored(texts: list[list[bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts as words: (text, anchor hash, first window's start, how many windows) of each anchor, and the windows' hashes.

    Starts count from the text's first word; the last array counts from the first word of all texts.
    """
    import xxhash

    sizes = np.array([len(w) for w in texts])
    n = int(sizes.sum())
    if n < window:
        return (np.zeros(0, "int64"),) * 5
    words = np.fromiter((xxhash.xxh64_intdigest(w) for t in texts for w in t), np.uint64, n)
    grams, whole = runs_hashes(words, gram), runs_hashes(words, window)
    low = np.uint64((1 << 28) - 1)
    at = (smallest(grams & ~low | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & low).astype("int64")[: len(whole)]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)[: len(whole)]
    size = np.repeat(sizes, sizes)[: len(whole)]
    start = np.flatnonzero(np.arange(len(whole)) - first + window <= size)
    if not len(start):
        return (np.zeros(0, "int64"),) * 5
    cut = np.flatnonzero(np.concatenate([[True], (at[start][1:] != at[start][:-1]) | (np.diff(start) != 1)]))
    a = start[cut]
    text = np.repeat(np.arange(len(texts)), sizes)[a]
    return text, grams[at[a]], a - first[a], np.diff(np.concatenate([cut, [len(start)]])), whole


def in_lots(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first, words of each), AT_ONCE words or one text at a time."""
    lot, first, n = [], 0, 0
    for i, t in enumerate(texts):
        words = (t or "").encode().split()  # of bytes: \\x20 and \\x09-\\x0D, no other white space
        if lot and n + len(words) > AT_ONCE:
            yield first, lot
            lot, first, n = [], i, 0
        lot.append(words)
        n += len(words)
    if lot:
        yield first, lot


def cells(anchor: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mixed(anchor, SEEDS[row]) & np.uint64(width - 1)).astype("int64")


def sketch(docs: DataFrame, text: str, window: int, gram: int, width: int, flush: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """For each sketch row, the bits of cells that count two or more. Counters saturate at two: no more is asked."""
    blocks = width // BLOCK

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sparse partition sketches: per row and block, the cells that count one (even) or more (odd)."""

        def out(held: list[np.ndarray]) -> pd.DataFrame:
            anchor, rows = np.concatenate(held), []
            for row in range(len(SEEDS)):
                cell, count = np.unique(cells(anchor, row, width), return_counts=True)
                edges = np.searchsorted(cell, np.arange(blocks + 1) * BLOCK)
                code = ((cell % BLOCK) * 2 + (count > 1)).astype("<u4")
                rows += [(row, b, code[i:j].tobytes()) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]
            return pd.DataFrame(rows, columns=["row", "block", "cells"])

        held, n = [], 0
        for part in parts:
            for _, lot in in_lots(part[text].tolist()):
                held.append(anchored(lot, window, gram)[1].astype(np.uint64))
                n += len(held[-1])
                if n >= flush:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(BLOCK, np.uint8)
        for payload in part["cells"]:
            code = np.frombuffer(payload, "<u4")
            count[code >> 1] = np.minimum(2, count[code >> 1] + 1 + (code & 1))
        return pd.DataFrame({"row": part["row"].iloc[:1], "block": part["block"].iloc[:1], "bits": [np.packbits(count > 1, bitorder="little").tobytes()]})

    bits = [np.zeros(width // 8, np.uint8) for _ in SEEDS]
    for r in docs.select(text).mapInPandas(partial, "row int, block int, cells binary").groupBy("row", "block").applyInPandas(merged, "row int, block int, bits binary").toLocalIterator():
        bits[r["row"]][r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return tuple(bits)


def sketch_width(docs: DataFrame, text: str, most: int) -> int:
    """A power of two, 16 cells for each 100 bytes of text, between one block and `most`; what exceeds it is only filtered less."""
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    return min(most, max(BLOCK, 1 << int(size * 0.16).bit_length()))


def candidates(docs: DataFrame, key: str, text: str, window: int, gram: int, width: int, bits: tuple[np.ndarray, ...]) -> DataFrame:
    """Spans whose anchor is estimated repeated: key, anchor, span (digest of its words, told apart by anchor and digest together), first (window), wins (hashes of its windows)."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(b.tobytes() for b in bits))

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.frombuffer(b, np.uint8) for b in sent.value]
        for part in parts:
            keys = part["key"].tolist()
            for at, lot in in_lots(part["text"].tolist()):
                doc, anchor, first, n, whole = anchored(lot, window, gram)
                if not len(doc):
                    continue
                twice = np.ones(len(anchor), bool)
                for row, b in enumerate(held):
                    cell = cells(anchor, row, width)
                    twice &= (b[cell >> 3] >> (cell & 7) & 1).astype(bool)
                sizes = np.cumsum([0, *map(len, lot)])
                whole = whole.view("int64")
                rows = []
                for d, h, a, k in zip(doc[twice].tolist(), anchor[twice].view("int64").tolist(), first[twice].tolist(), n[twice].tolist(), strict=True):
                    span = hashlib.blake2b(b" ".join(lot[d][a : a + k + window - 1]), digest_size=8).digest()
                    rows.append((keys[at + d], h, int.from_bytes(span, "little", signed=True), a, whole[sizes[d] + a : sizes[d] + a + k]))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "anchor", "span", "first", "wins"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(of, "key binary, anchor long, span long, first int, wins array<long>")


def repeated(found: DataFrame, docs: DataFrame) -> DataFrame:
    """key, marks: array of (first, mask), which windows from `first` on (bit i: the i-th) start anywhere else too; n: docs' rows of the key."""
    spark = found.sparkSession
    at = written(found, "spans")
    # copies add up on the map side, so a large group of them is a few rows
    spans = written(at.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.any_value("wins").alias("wins")), "distinct-spans")
    anchors = spans.groupBy("anchor").agg(F.count("*").alias("n_spans"), F.min("n").alias("least")).where("n_spans > 1 and least = 1")
    unlike = hot_join(spans, anchors.select("anchor", "n_spans"), ["anchor"], "n_spans", F.xxhash64("span")).where("n_spans is not null").select("anchor", "span", "n", "wins")
    unlike = written(unlike, "unlike-spans")
    released(spark)
    each = unlike.select("anchor", "span", "n", F.posexplode("wins").alias("i", "win"))
    wins = each.groupBy("anchor", "win").agg(F.sum("n").alias("starts"), F.min("n").alias("least"), F.count("*").alias("n_rows")).where("starts > 1 and least = 1")
    single = hot_join(each.where("n = 1").drop("n"), wins.select("anchor", "win", "n_rows"), ["anchor", "win"], "n_rows", F.xxhash64("span")).where("n_rows is not null")
    part = single.groupBy("anchor", "span").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("some"))
    masks = spans.join(part, ["anchor", "span"], "left").select("anchor", "span", "n", F.when(F.col("n") > 1, F.expr("shiftleft(1L, size(wins)) - 1")).otherwise(F.col("some")).alias("mask")).where("mask is not null")
    marked = hot_join(at.drop("wins"), masks, ["anchor", "span"], "n", F.xxhash64("key", "first")).where("mask is not null")
    marks = written(marked.groupBy("key").agg(F.collect_set(F.struct("first", "mask")).alias("marks")), "marks")
    released(spark)
    return marks.join(docs.groupBy("key").agg(F.count("*").alias("n")), "key")


@F.pandas_udf(T.BinaryType())
def deflated(texts: pd.Series) -> pd.Series:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda t: packer.compress((t or "").encode()))


@F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())]))
def without(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for texts, marks, windows in parts:
        rows = []
        for text, marked, window in zip(texts, marks, windows, strict=True):
            words = unpacker.decompress(text).split()
            gone = np.zeros(len(words) + 1, np.int32)
            for m in marked if marked is not None else ():
                starts = m["first"] + np.flatnonzero([m["mask"] >> i & 1 for i in range(m["mask"].bit_length())])
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
            rows.append((len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, most_cells: int = 1 << 28) -> DataFrame:
    """docs without the text, with n_words, n_removed, kept (the words left, joined by one space) and kept_sha256.

    A word goes if a window of `window` words that covers it also starts elsewhere, in the same row or another;
    repeated rows are each other's copies. Null texts have no words; texts shorter than a window keep all.
    Columns of the added names in docs are replaced. most_cells bounds the two bit maps that tasks get; at
    most window - gram + 1 <= 62 windows share an anchor.
    """
    spark = docs.sparkSession
    names = ("n_words", "n_removed", "kept", "kept_sha256")
    keep = [c for c in docs.columns if c not in names]
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_key")
    width = sketch_width(docs, text, most_cells)
    bits = sketch(docs, text, window, gram, width)
    found = candidates(docs.select(F.col(text).alias("_text"), key), "_key", "_text", window, gram, width, bits)
    marks = repeated(found, docs.select(key.alias("key"))).select(F.col("key").alias("_key"), "marks", "n")
    # texts go through the last shuffle deflated
    keyed = docs.select(*[c for c in keep if c != text], key, deflated(F.col(text)).alias("_text"))
    out = hot_join(keyed, marks, ["_key"], "n", F.xxhash64(F.monotonically_increasing_id()))
    return out.withColumn("_out", without(F.col("_text"), F.col("marks"), F.lit(window))).select(*[c for c in keep if c != text], "_out.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
