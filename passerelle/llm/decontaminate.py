"""Benchmark passages in documents, by a prefix-filtered join of word shingles. Native columns only.

An item's windows are runs of `window` words (a shorter item is one window). A window lies in a document only if all
its shingles do, so one shingle, the rarest in the corpus, is the prefix that a join needs. Shingles are counted first,
and only the prefixes are joined. A document position that holds one gives a candidate start; bounds on start and
length go first, then the words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passerelle.llm.common import read, row_key, written

WINDOW, SHINGLE = 10, 3
#: Starts of a chunk, by which a text's words are looked at.
CHUNK = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "_key binary, win_id long, start int, length int"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of digits, letters a-z and all beyond ASCII; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingles(w: Column, size: int, first: Column | int = 0, most: int | None = None) -> Column:
    """A hash for each run of `size` words from the start `first` on, `most` at most if given. w is a column: it is read at every start."""
    first = F.lit(first) if isinstance(first, int) else first
    n = F.size(w) - size + 1 - first if most is None else F.least(F.size(w) - size + 1 - first, F.lit(most))
    of = lambda i: F.xxhash64(*[w[i + k] for k in range(size)])
    return F.when(n > 0, F.transform(F.sequence(first, first + n - 1), of)).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item_id, win (array of words) of every item; an item without words has none."""
    w = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, F.lit(window)))).alias("win")).distinct()


def chunks(docs: DataFrame, more: int) -> DataFrame:
    """_key, n_words, at (a word's number), before and w: CHUNK words from `at` on, `before` words ahead of them and `more` behind.

    So no row repeats a whole text, however long.
    """
    w = docs.select("_key", words(F.col("_text")).alias("w")).select("_key", "w", F.size("w").alias("n_words")).where("n_words > 0")
    ahead = lambda i: F.least(i, F.lit(more))
    parts = F.transform(F.sequence(F.lit(0), F.col("n_words") - 1, F.lit(CHUNK)), lambda i: F.struct(i.alias("at"), ahead(i).alias("before"), F.slice("w", i - ahead(i) + 1, ahead(i) + CHUNK + more).alias("w")))
    return w.select("_key", "n_words", F.explode(parts).alias("c")).select("_key", "n_words", "c.at", "c.before", "c.w")


def found_windows(docs: DataFrame, wins: DataFrame, window: int, shingle: int, n_wins: int, most_sent: int) -> DataFrame:
    """_key, win_id, start, length of every occurrence of windows (win_id, win) in documents.

    What is broadcast are shingles, rows of a fixed size, if there are at most `most_sent`. The windows themselves are joined to
    candidates alone.
    """
    sent = F.broadcast if n_wins * window <= most_sent else (lambda df: df)
    sized = wins.withColumn("length", F.size("win")).withColumn("q", F.least("length", F.lit(shingle)))
    out = None
    for q in [r[0] for r in sized.select("q").distinct().collect()]:  # at most `shingle` values
        own = written(sized.where(F.col("q") == q).select("win_id", "length", F.posexplode(shingles(F.col("win"), q)).alias("offset", "shingle")), "shingles")
        # rarity orders a window's shingles; of this pass over the documents counts alone are kept, summed before the shuffle
        seen = docs.select(words(F.col("_text")).alias("w")).select(F.explode(shingles(F.col("w"), q)).alias("shingle"))
        count = seen.join(sent(own.select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
        # one shingle that no document has rules its window out
        least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle", "length")).alias("s")
        first = written(own.join(count, "shingle", "left").groupBy("win_id").agg(least).where("s.n > 0").select("win_id", "s.shingle", "s.offset", "s.length"), "prefixes")
        at = chunks(docs, window + q).select("_key", "n_words", "at", "before", "w", F.posexplode(shingles(F.col("w"), q, F.col("before"), CHUNK)).alias("pos", "shingle"))
        start = F.col("at") + F.col("pos") - F.col("offset")
        near = at.join(sent(first), "shingle").withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        near = near.select("_key", "win_id", "start", "length", F.slice("w", F.greatest(F.lit(1), F.col("before") + F.col("pos") - F.col("offset") + 1), F.col("length")).alias("own"))
        # digests leave next to nothing else for the exact comparison
        exact = near.where(F.xxhash64("own") == F.col("win_id")).join(wins, "win_id").where(F.col("own") == F.col("win")).select("_key", "win_id", "start", "length")
        out = exact if out is None else out.unionByName(exact)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def covered(spans: Column) -> Column:
    """How many words the (start, length) spans cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], s["start"] + s["length"]).alias("reach")
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = 200_000) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (array of start, length in words).

    Null and empty texts have no words, and items without words no windows. Items are counted by id: repeated ids
    once, null ids never, though their windows still hit. Repeated rows of docs get equal results. Columns of the added
    names in docs are replaced. Windows are searched in blocks of about `block`, whose shingles are broadcast; documents
    are read twice for each block. Time is linear in a text's length.
    """
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
    keep = [c for c in docs.columns if c not in names]
    keyed = docs.select(*keep, F.col(text).alias("_text"), row_key(doc_id, text).alias("_key"))
    of_items = written(windows_of(items, item_id, item_text, window), "windows")
    wins = of_items.select("win").distinct().withColumn("win_id", F.xxhash64("win"))
    of_items = of_items.select("item_id", F.xxhash64("win").alias("win_id")).distinct()
    n_wins = wins.count()
    blocks = max(1, -(-n_wins // block))
    found = None
    for b in range(blocks):
        some = found_windows(keyed, wins.where(F.pmod("win_id", F.lit(blocks)) == b), window, shingle, n_wins // blocks, 2 * block * window)
        found = some if found is None else found.unionByName(some)
    found = written(found.distinct(), "found")
    spans = found.groupBy("_key").agg(F.collect_set(F.struct("start", "length")).alias("hit_spans"))
    names_of = found.select("_key", "win_id").distinct().join(of_items, "win_id").groupBy("_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    hits = spans.join(names_of, "_key", "left")
    out = keyed.withColumn("n_words", F.size(words(F.col("_text"))).cast("long")).drop("_text").join(hits.hint("merge"), "_key", "left")  # hits grow with the documents: at no size broadcast
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        *keep,
        "n_words",
        F.coalesce(covered(F.col("hit_spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("hit_spans").isNotNull().alias("contaminated"),
        "hit_spans",
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
