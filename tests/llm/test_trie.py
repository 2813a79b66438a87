"""The prefix trie against brute force, and tree contraction on shapes that take rounds."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from passerelle.llm import trie
from passerelle.llm.queries import OP11

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    members, kids, out = {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    total = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        total[k] = (sum(total[x][0] for x in kids.get(k, [])) or 1, own + sum(total[x][1] for x in kids.get(k, [])))
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *total[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def conversations(rng):
    """Shared openings, copies, turns without numbers, equal numbers, repeated rows, nulls and a long conversation."""
    texts = ["hello", "é😀", "", None, "thanks", "x" * 50]
    rows = []
    for c in [*range(0, 130), 300, 305, 399, 512, 701]:
        rows += [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(rng.randrange(1, 9))]
    rows += [(77, 500 + t, "user", f"t{t % 3}") for t in range(300)]
    return rows + rng.sample(rows, 20) + [(None, 1, "user", "nobody's")]


def test_trie_is_that_of_brute_force(spark):
    rows = conversations(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "n_convs": F.lit(1), "id": F.lit("clash")})
    assert got(trie.prefix_trie(df)) == brute(rows)


def test_sql(spark):
    """The SQL that the driver compares with, on rows with nulls and ties."""
    rows = conversations(random.Random(4))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {tuple(r[:2]): tuple(r[2:]) for r in con.execute(OP11).fetchall()} == brute(rows)


def test_turnless_and_empty(spark):
    assert got(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == {}
    # the first of these loses its only turn and takes none, as there is no conversation at the start of its group
    only = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(only, 0, "user", "gone")]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert list(brute(rows)) == [(only, 0)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb", "forest"])
def test_totals(spark, shape):
    rng, n = random.Random(9), 300
    above = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i), "comb": lambda i: i - 1 if i % 2 else max(0, i - 2), "forest": lambda i: None if i % 50 == 0 else i - 1}[shape]
    parent = {0: None, **{i: above(i) for i in range(1, n)}}
    value = {i: rng.randrange(100) for i in parent}
    want = dict(value)
    for i in range(n - 1, 0, -1):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    df = spark.createDataFrame([(i * 7 - 100, None if p is None else p * 7 - 100, value[i]) for i, p in parent.items()], "id long, parent long, v long")
    assert {(r.id + 100) // 7: r.v for r in trie.subtree_totals(df, ["v"]).collect()} == want


def test_digests_of_many_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = {r.k: r.sha256 for r in trie.joined_digests(df, ["k"], "id", per_row=7).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(k, 1000, 3)).encode()).hexdigest() for k in range(3)}
