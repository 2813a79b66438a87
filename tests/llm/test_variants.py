"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from passerelle.llm import variants
from passerelle.llm.queries import OP12

SCHEMA = "doc_id long, text string"


def brute(rows):
    low = str.maketrans(variants.UPPER, variants.LOWER)
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: {v for v in words if one_edit(w, v)} for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def corpus(rng):
    """Words with edits at any place, words that others begin with, one-letter alphabets, runs of thousands of letters, and letters of Latin 1."""
    words = ["abcde", "abcdf", "abcdef", "abcd", "bcdef", "aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaa", "straße", "strasse", "Éclair", "éclair", "z" * 3000, "z" * 2999 + "y", "z" * 1500 + "q" + "z" * 1499]
    for _ in range(60):
        word = "".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9)))
        i = rng.randrange(len(word) + 1)
        words += [word, word[:i] + "x" + word[i:], word[:i] + word[i + 1 :], word[: max(0, i - 1)] + "ö" + word[i:]]
    weights = [16 if i % 4 == 0 else 2 ** rng.randrange(4) for i in range(len(words))]
    pick = lambda: rng.choices(words, weights)[0]
    rows = [(i, " ".join(pick().capitalize() if rng.random() < 0.2 else pick() for _ in range(rng.randrange(60))) + rng.choice([".", "1", "\n"])) for i in range(150)]
    rows += [(i, " ".join(w for w in words if len(w) > 1000)) for i in range(200, 204)]
    return rows + [(None, "abcde abcde abcde abcde"), (900, None), (901, "")] + rows[:5]


def test_variants_are_those_of_brute_force(spark):
    rows = corpus(random.Random(1))
    want = brute(rows)
    assert sum(v[3] for v in want.values()) > 100 and any(v[0] and v[1] != v[0] for v in want.values())  # some forms have forms
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("x"), "n": F.lit(1), "rev": F.lit(2)})
    assert got(variants.spelling_variants(df)) == want


def test_sql():
    """The SQL that the driver compares with, on the same rows."""
    rows = corpus(random.Random(1))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(OP12).fetchall()} == brute(rows)


def test_edges_of_a_trie(spark):
    words = spark.createDataFrame([(0, w) for w in ("abcde", "abcdf", "abxyz", "abcdef", "qrstu")], "rev int, key string")
    edges = variants.trie_edges(words)
    assert {(r.node, r.first, r.label, r.child, r.ends) for r in edges.collect()} == {
        ("ab", "c", "cd", "abcd", False), ("ab", "x", "xyz", "abxyz", True), ("abcd", "e", "e", "abcde", True), ("abcd", "f", "f", "abcdf", True), ("abcde", "f", "f", "abcdef", True), ("qr", "s", "stu", "qrstu", True)
    }
    assert {(r.node, r.label, r.second) for r in variants.seconds(edges).collect()} == {("ab", "cd", "d"), ("ab", "xyz", "y"), ("abcd", "e", "f"), ("abcd", "e", "$"), ("abcd", "f", "$"), ("abcde", "f", "$"), ("qr", "stu", "t")}


def test_an_edit_ends_a_walk(spark):
    """What goes on to the next round has no edit; a spent one gives the letters that the word then reads."""
    edges = variants.trie_edges(spark.createDataFrame([(0, w) for w in ("abcde", "abcdf", "abxyz", "abcdef")], "rev int, key string"))
    states = spark.createDataFrame([(0, "abcde", 2, "ab", 2)], "rev int, word string, front int, node string, pos int")
    rows = variants.taken(states, edges, variants.seconds(edges)).collect()
    assert {(r.node, r.pos) for r in rows if r.near is None} == {("abcd", 4)}
    assert "abde" in {r.near for r in rows} and all(one_edit("abcde", r.near) for r in rows if r.near is not None)


def test_nothing(spark):
    assert got(variants.spelling_variants(spark.createDataFrame([], SCHEMA))) == {}
    assert got(variants.spelling_variants(spark.createDataFrame([(1, "some words once")], SCHEMA))) == {}


def test_runs_are_digested_once(spark):
    """A filter by the word below the aggregation worked out each run's digest twice."""
    docs = spark.createDataFrame([(i, "Words of five letters, again and again words") for i in range(5)], "doc_id long, text string")
    found = variants.word_counts(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("crc32") == 1
    assert {r.word for r in found.collect()} >= {"words", "again"}
