"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces of at most `size` tokens. How many pieces have each length is all
that the program needs: at most `size` numbers, whatever the corpus. Its variables are patterns, the ways to fill
one sequence. Multiplicative weights price the lengths, a knapsack dynamic program finds the best patterns at these
prices, and rounds go on until the cover's value and the dual bound agree within `gap`. Amounts are rounded to whole sequences; what
that leaves is packed best-fit, again by counts. Pieces then take their places by length and by their rank within it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passerelle.llm.common import read, written

SIZE, END = 2048, 0
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(json_name: str, ranks_name: str, end_token: str):
    """ids of a text by the byte-level vocabulary; what the quick library refuses goes to the other one."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks_name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end_token: len(ranks)})

    def ids(text: str) -> list[int]:
        try:
            return quick.encode(text, allowed_special="all")
        except BaseException as error:  # its panics aren't Exceptions
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            from tokenizers import Tokenizer

            return Tokenizer.from_file(public_tokenizers.path(json_name)).encode(text, add_special_tokens=False).ids

    return ids


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full."""
    first = n if n <= size else n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, vocabulary: tuple[str, str, str] = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>")) -> DataFrame:
    """A row per piece, without its place; a null text counts as empty and still ends with `end`."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(*vocabulary)
        for part in parts:
            rows = []
            for key, body in zip(part["doc_id"], part["text"], strict=True):
                got = np.array([*ids(body or ""), end], "<u4")
                rows += [(key, k, a, n, zlib.crc32(got[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(got), size))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": part["doc_id"].dtype})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(of, PIECES.format(id=kind))


def worths(lengths: np.ndarray, prices: np.ndarray, size: int) -> np.ndarray:
    """The knapsack program: the highest total price of lengths (repeats allowed) that fit in each room from 0 to size."""
    best, known = np.zeros(size + 1), np.searchsorted(lengths, np.arange(size + 1), "right")
    for room in range(int(lengths[0]), size + 1):
        k = known[room]
        best[room] = max(best[room - 1], (best[room - lengths[:k]] + prices[:k]).max())
    return best


def priced(lengths: np.ndarray, prices: np.ndarray, left: np.ndarray, first: int, best: np.ndarray, size: int) -> tuple[Counter, float]:
    """(pattern as positions in lengths, its total price): the one that the knapsack finds with `first`, of what is left."""
    own, room, worth, live = Counter({first: 1}), size - int(lengths[first]), prices[first], prices.copy()
    live[left < 1e-9] = -np.inf
    if left[first] < 2:
        live[first] = -np.inf
    while room >= lengths[0]:
        k = int(np.searchsorted(lengths, room, "right"))
        total = best[room - lengths[:k]] + live[:k]
        j = int(total.argmax())
        if total[j] == -np.inf:
            break
        own[j] += 1
        room, worth = room - int(lengths[j]), worth + prices[j]
        if own[j] + 1 > left[j]:
            live[j] = -np.inf
    return own, float(worth)


def covering(lengths: np.ndarray, prices: np.ndarray, need: np.ndarray, size: int, slack: float) -> tuple[Counter, float, np.ndarray]:
    """A cover of the whole demand at these prices: (amounts of patterns, price of the best pattern, how near to it each length's patterns come).

    Patterns are taken while they are worth the best of the open lengths, or `slack` less; then the knapsack is solved anew for
    what is open. What fits badly is left to the end, in patterns worth less, which tells the next round to price it higher.
    """
    left, out, got, top, reached = need.copy(), Counter(), np.zeros(len(lengths)), None, np.inf
    while len(open_ := np.flatnonzero(left > 1e-9)):
        own, price, cap = lengths[open_], prices[open_], left[open_]
        best = worths(own, price, size)
        top = best[size] if top is None else top
        least, reached = (1 - slack) * min(best[size], reached), 0.0
        for first in np.flatnonzero(price + best[size - own] >= least)[::-1]:
            while cap[first] > 1e-9:
                pattern, worth = priced(own, price, cap, first, best, size)
                if worth < least:
                    reached = max(reached, worth)
                    break
                amount = min(cap[j] / m for j, m in pattern.items())
                amount = np.floor(amount) if amount > 1 else amount
                for j, m in pattern.items():
                    cap[j] -= amount * m
                    got[open_[j]] += amount * m * worth
                out[tuple(sorted((int(own[j]) for j in pattern.elements()), reverse=True))] += float(amount)
        if cap.sum() < left[open_].sum():
            reached = max(reached, least)
        left[open_] = cap
    return out, float(top), got / need / top


@dataclass
class Program:
    """A solution of the configuration program: amounts of patterns that cover the demand, their sum, and a lower bound of any cover's."""

    amounts: dict[tuple[int, ...], float]
    value: float
    bound: float
    rounds: int


def solve(count: dict[int, int], size: int, gap: float = 1e-3, heat: float = 0.5, most: int = 200, grain: int = 64) -> Program:
    """The covering program over all patterns, by multiplicative weights, until value <= (1 + gap) * bound or `most` rounds are done.

    Prices start at a length's share of a sequence, the dual of a perfect packing. Each round covers the demand at its prices, in
    amounts of 1/grain at least, and multiplies a length's price by exp(heat * shortfall), the shortfall being how much less than the best
    pattern's its own patterns were worth. Prices over the best pattern's are a feasible dual, whose value no packing beats.
    """
    lengths = np.array(sorted(count))
    need = np.array([count[n] for n in lengths], float) * grain
    prices, bound, value, kept = lengths / size, 0.0, np.inf, Counter()
    for turn in range(1, most + 1):
        amounts, top, got = covering(lengths, prices, need, size, min(0.004, 8 * gap))
        bound = max(bound, float(need @ prices) / top / grain)
        if (total := sum(amounts.values()) / grain) < value:
            value, kept = total, amounts
        if value <= (1 + gap) * bound:
            break
        prices = prices * np.exp(heat * (1 - got))
        prices /= prices.max()
    return Program({p: a / grain for p, a in kept.items()}, value, bound, turn)


def best_fit(count: dict[int, int], size: int) -> Counter:
    """Best-fit decreasing by counts: patterns (sorted tuples of lengths) and how many sequences have each."""
    room: dict[int, Counter] = {size: Counter()}  # what is left -> patterns so far
    out: Counter = Counter()
    for n in sorted(count, reverse=True):
        todo = count[n]
        while todo:
            fits = [r for r, held in room.items() if n <= r and (held or r == size)]
            r = min(fits)
            if r == size:
                each = size // n
                if full := todo // each:
                    room.setdefault(size - each * n, Counter())[(n,) * each] += full
                if rest := todo % each:
                    room.setdefault(size - rest * n, Counter())[(n,) * rest] += 1
                todo = 0
                continue
            held, k = next(iter(room[r].items()))
            each = min(r // n, max(1, todo // k))
            some = min(k, todo // each)
            room[r][held] -= some
            if not room[r][held]:
                del room[r][held]
            room.setdefault(r - each * n, Counter())[(*held, *(n,) * each)] += some
            todo -= some * each
    for held in room.values():
        out.update({tuple(sorted(p, reverse=True)): k for p, k in held.items() if k})
    return out


def rounded(count: dict[int, int], amounts: dict[tuple[int, ...], float]) -> tuple[Counter, Counter]:
    """(whole patterns, what they leave): amounts rounded up as far as there are pieces, largest amounts first, then the largest fractions."""
    left, out = Counter(count), Counter()
    for pattern, amount in sorted(amounts.items(), key=lambda x: (-(x[1] // 1), -(x[1] % 1), -sum(x[0]), x[0])):
        k = min(-int(-(amount - 1e-9) // 1), *[left[n] // m for n, m in Counter(pattern).items()])
        if k > 0:
            out[pattern] += k
            left.subtract({n: m * k for n, m in Counter(pattern).items()})
    return out, +left


def plan(count: dict[int, int], size: int = SIZE, gap: float = 1e-3, most: int = 24) -> Counter:
    """Patterns and how many sequences have each; every piece of the histogram has a place.

    Full pieces are sequences of their own. For the others the program is solved and rounded; the pieces that rounding leaves, a few in a
    hundred at most where lengths have few pieces each, are packed best-fit.
    """
    out, small = Counter(), {n: k for n, k in count.items() if 0 < n < size and k}
    if count.get(size):
        out[(size,)] = count[size]
    if small:
        whole, left = rounded(small, solve(small, size, gap, most=most).amounts)
        out.update(whole)
        if left:
            out.update(best_fit(left, size))
    return out


def places(patterns: Counter) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, how many a sequence holds, offset of the first)."""
    rank, seq, out = Counter(), 0, {}
    for pattern, k in sorted(patterns.items(), reverse=True):
        offset = 0
        for n, m in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(n, []).append((rank[n], seq, m, offset))
            rank[n] += m * k
            offset += n * m
        seq += k
    return {n: np.array(rows, "int64") for n, rows in out.items()}


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, chunk_rows: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Every row of docs gives pieces, repeated and null doc_ids too; an empty table gives none. Other columns of
    docs are not read.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, doc_id, text, size, end), "pieces")
    count = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    sent = spark.sparkContext.broadcast(places(plan(count, size)))

    # a length may have a third of all pieces: they are numbered in chunks of any mix
    chunks = max(8, sum(count.values()) // chunk_rows)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("chunk", "length").count().select("chunk", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("chunk", "length").orderBy("doc_id", "piece")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(base, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), "int64")
        values, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(values):
            own = np.flatnonzero(values == n)
            table = sent.value[int(n)]
            first, seq, each, offset = table[np.searchsorted(table[:, 0], ranks[own], "right") - 1].T
            turn = ranks[own] - first
            out[own, 0], out[own, 1] = seq + turn // each, offset + turn % each * n
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("p", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
