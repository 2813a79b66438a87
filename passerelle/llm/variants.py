"""Spelling variants: words of a corpus that are one edit apart, by walking a trie of all words with joins.

The trie is a table of edges whose labels are strings: (node, first letter, label, child). It is read off the sorted words: what two neighbours have
in common is a node, and a node's or word's parent is what it has in common with the one before it. The frontier is a table of states (word, position,
node) without an edit; each round joins it with the edges, and an edge's label takes a state on with no edit or with one. Behind the edit a walk can only go
one way, to the word that the node and the letters left spell, so that it isn't walked: one join with the words at the end tells which there are. Near words share a half: either at least (length - 1) // 2 letters at the front or as many at the back. So
there are two tries, of words and of reversed words, and each allows edits behind such a front only, where nodes have few edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from passerelle.llm.common import read, written

SHORTEST, LEAST, EVERY, TIMES = 5, 3, 97, 2
#: Letters of the nodes where walks begin: all words share more with what they find.
START = (SHORTEST - 1) // 2
#: In place of a letter where a word ends.
END = "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word, n of the words with `shortest` letters and `least` occurrences, after one letter of some occurrences is dropped."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode_outer(found).alias("raw")).where(F.col("raw").isNotNull())
    low = F.when(F.col("raw").rlike("[À-Þ]"), F.translate("raw", UPPER, LOWER)).otherwise(F.lower("raw"))  # A-Z only, the fast way where it is the same
    runs = runs.select("id", low.alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))
    words = runs.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))
    # length and count in one term: a filter by the word alone is pushed below, where it works out every run's digest and letters a second time
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.least(F.char_length("word") - shortest, F.col("n") - least) >= 0)


@F.pandas_udf(IntegerType())
def shared(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Letters that two texts have in common at the front; a null has none."""
    for a, b in parts:
        yield pd.Series([len(commonprefix((x, y))) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)], dtype="int32")


def with_previous(rows: DataFrame) -> DataFrame:
    """rows (rev, key, ...), one for each key, with `before`: the key before it in order of its rev, null for the first.

    Rows are dealt by ranges; a block's first row gets the last key of the blocks before it, a row for each block.
    """
    dealt = rows.repartitionByRange("rev", "key").sortWithinPartitions("rev", "key")
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sorted")
    inside, ends = Window.partitionBy("part").orderBy("at"), Window.orderBy("part")
    last = dealt.groupBy("part").agg(F.max(F.struct("at", F.struct("rev", "key").alias("own")))["own"].alias("own"))
    last = last.select("part", F.lag("own").over(ends).alias("_last"))
    out = dealt.withColumn("_lag", F.lag(F.struct("rev", "key")).over(inside)).join(last, "part")
    near = F.coalesce("_lag", "_last")
    return out.withColumn("before", F.when(near["rev"] == F.col("rev"), near["key"])).drop("part", "at", "_lag", "_last")


def trie_edges(words: DataFrame, start: int = START) -> DataFrame:
    """rev, node, first, label, child, ends (child is a word); nodes are named by their letters.

    words: rev, key. Nodes have `start` letters or more, and a node has an edge for each letter of the alphabet at most.
    """
    front = F.substring("key", 1, start)
    forks = with_previous(words).withColumn("common", shared("before", "key")).where(F.col("common") > start).select("rev", F.substring(F.col("key"), F.lit(1), F.col("common")).alias("key"))
    named = words.withColumn("ends", F.lit(1)).unionByName(forks.unionByName(words.select("rev", front.alias("key"))).withColumn("ends", F.lit(0)))
    named = named.groupBy("rev", "key").agg((F.max("ends") == 1).alias("ends"))
    size = F.col("common")
    found = with_previous(named).withColumn("common", shared("before", "key")).where(F.char_length("key") > start)
    found = found.select("rev", F.substring(F.col("key"), F.lit(1), size).alias("node"), F.substring(F.col("key"), size + 1, F.char_length("key")).alias("label"), F.col("key").alias("child"), "ends")
    return written(found.withColumn("first", F.substring("label", 1, 1)), "edges")


def seconds(edges: DataFrame) -> DataFrame:
    """The edges by their second letter: a row for each letter that may follow the first, in the label or behind the child, END where a word ends there."""
    firsts = edges.select("rev", F.col("node").alias("child"), F.col("first").alias("second")).distinct()
    one = edges.where(F.char_length("label") == 1)
    behind = one.join(firsts.hint("shuffle_hash"), ["rev", "child"]).unionByName(one.where("ends").withColumn("second", F.lit(END)))
    long = edges.where(F.char_length("label") > 1).withColumn("second", F.substring("label", 2, 1))
    return written(long.unionByName(behind), "seconds")


def rest(by: Column | int, n: Column | int) -> Column:
    """n letters of the word, `by` letters behind the state's position."""
    return F.substring(F.col("word"), F.col("pos") + by + 1, n if isinstance(n, Column) else F.lit(n))


def letter(by: int) -> Column:
    """The letter `by` letters behind the position; END at the word's end, null behind it."""
    left = F.char_length("word") - F.col("pos") - by
    return F.when(left > 0, rest(by, 1)).when(left == 0, F.lit(END))


def taken(states: DataFrame, edges: DataFrame, behind: DataFrame) -> DataFrame:
    """The states (rev, word, front, node, pos) without an edit that these lead to, and where the one edit is spent instead `near`, what the word then reads.

    A state takes the edge of its next letter: with the whole label, or with one edit inside it. Behind the front it can also drop that letter,
    or take any first letter, inserted or in place of its own, on edges whose second letter it has next.
    """
    size = F.char_length("label")
    here = ["rev", "word", "front", "node", "pos"]
    may = F.col("pos") >= F.col("front")
    join = lambda df, other, on: df.join(other.hint("shuffle_hash"), ["rev", "node", on])
    ended = lambda node, by: F.concat(node, F.substring(F.col("word"), F.col("pos") + by + 1, F.char_length("word")))
    spent = lambda df, near: df.select("rev", "word", *[F.lit(None).cast(kind).alias(c) for c, kind in (("front", "int"), ("node", "string"), ("pos", "int"))], near.alias("near"))

    dropped = spent(states.where(may & (F.col("pos") < F.char_length("word"))), ended(F.col("node"), F.lit(1)))
    own = join(states.select(*here).withColumn("first", letter(0)), edges, "first")
    exact = F.when(rest(0, size) == F.col("label"), F.struct(size.alias("by"), F.lit(0).alias("edits")))
    free = F.col("pos") + size > F.col("front")
    inner = [F.when(free & (F.col("pos") + size + d <= F.char_length("word")) & (F.levenshtein(rest(0, size + d), F.col("label"), 1) == 1), F.struct((size + d).alias("by"), F.lit(1).alias("edits"))) for d in (-1, 0, 1)]
    own = own.withColumn("s", F.explode(F.array_compact(F.array(exact, *inner))))
    kept = lambda c: F.when(F.col("s.edits") == 0, c)
    own = own.select("rev", "word", kept(F.col("front")).alias("front"), kept(F.col("child")).alias("node"), kept(F.col("pos") + F.col("s.by")).alias("pos"), F.when(F.col("s.edits") == 1, ended(F.col("child"), F.col("s.by"))).alias("near"))

    asked = states.where(may).withColumn("way", F.explode(F.array(F.struct(F.lit(0).alias("by"), letter(0).alias("second")), F.struct(F.lit(1).alias("by"), letter(1).alias("second")))))
    other = join(asked.select(*here, F.col("way.by").alias("by"), F.col("way.second").alias("second")).where("second is not null"), behind, "second")
    fits = (F.col("first") != rest(0, 1)) & (rest(F.col("by"), size - 1) == F.substring(F.col("label"), F.lit(2), size))
    return own.unionByName(dropped).unionByName(spent(other.where(fits), ended(F.col("child"), F.col("by") + size - 1)))


def near_words(words: DataFrame, start: int = START, most_rounds: int = 100_000) -> DataFrame:
    """word, near: every ordered pair of words (of 2 * start + 1 letters or more) that are one inserted, deleted or replaced letter apart."""
    both = words.select(F.lit(0).alias("rev"), F.col("word").alias("key")).unionByName(words.select(F.lit(1).alias("rev"), F.reverse("word").alias("key")))
    both = written(both, "words")
    edges = trie_edges(both, start)
    behind = seconds(edges)
    front = F.floor((F.char_length("key") - 1) / 2).cast("int")
    states = both.select("rev", F.col("key").alias("word"), front.alias("front"), F.substring("key", 1, start).alias("node"), F.lit(start).alias("pos"))
    found = []
    for _ in range(most_rounds):
        step = written(taken(states, edges, behind), "frontier")
        found.append(step.where("near is not null").select("rev", "word", "near"))
        states = step.where("near is null").drop("near")
        if not states.head(1):
            break
    else:
        raise RuntimeError(f"walks didn't end in {most_rounds} rounds")
    pairs = reduce(DataFrame.unionByName, found)
    turned = lambda c: F.when(F.col("rev") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
    known = both.where("rev = 0").select(F.col("key").alias("near"))
    return pairs.select(turned("word"), turned("near")).join(known, "near", "left_semi").select("word", "near").distinct()


def followed(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """word, root: where a word's forms lead. A form is `TIMES` as frequent, so chains are short, and each round doubles what it follows."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(most_rounds):
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("_on")), "root", "left")
        now = written(step.select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "roots")
        if not now.where("moved").head(1):
            break
        now = now.drop("moved")
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each frequent word: its most frequent near word, if that is `times` as frequent, and where forms lead.

    Words are runs of Latin letters with A-Z lowered, in which one letter of some occurrences is dropped as by a typing error; equal counts take the
    smallest word. Null texts have no words, a null doc_id counts as the empty text, rows that repeat count again. Runs of any length are words.
    An empty table has no rows. Other columns are not read.
    """
    words = written(word_counts(docs, doc_id, text, shortest, least, every), "words")
    near = near_words(words.select("word"), (shortest - 1) // 2)
    near = near.join(words.select(F.col("word").alias("near"), "n"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    named = words.join(best, "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    named = written(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    roots = followed(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))
