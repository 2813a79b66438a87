"""The pipeline's near copies against exact Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
from passerelle.llm import nearcopies

DOCS = "doc_id long, text string"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_groups(rows, like=0.8):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= like * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


def planted(rng, groups, words=300):
    """Texts, each with copies at similarities from 0.75 to 0.97."""
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        texts.append(" ".join(base))
        for edits in (1, 3, 5, 6, 7, 8):
            copy = list(base)
            for at in rng.sample(range(words), edits):
                copy[at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    return texts


def kept(spark, rows, **how):
    return sorted(r["doc_id"] for r in nearcopies.representatives(spark.createDataFrame(rows, DOCS), **how).collect())


def test_planted_copies_are_the_groups_of_exact_similarity(spark):
    texts = planted(random.Random(1), 40) + [None, "", " \n", "One", "one", "two words", "alone in the dark"]
    rows = list(enumerate(texts))
    want = sorted(set(brute_groups(rows)))
    assert kept(spark, rows) == want
    # the stage itself, which linked only what differs in 3 of 64 bits
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "").collect()) == want


def test_large_buckets(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice((1, 2, 3))):
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, t) for i, t in enumerate(planted(rng, 5))]
    at = brute_groups(rows)
    assert kept(spark, rows) == sorted({rows[i][0] for i in at})


def edited(base, edits, rng, mark):
    copy = list(base)
    for at in rng.sample(range(len(base)), edits):
        copy[at] = f"x{mark}_{at}"
    return " ".join(copy)


def test_copies_of_one_template_that_are_mostly_too_far_apart(spark):
    """500 texts with 2 to 4 of 120 words changed: only exact comparison across groups tells which are linked."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(base, rng.choice((2, 3, 4)), rng, i)) for i in range(500)]
    want = sorted(set(brute_groups(rows)))
    assert 300 < len(want) < 400
    assert kept(spark, rows) == want


def test_families(spark):
    """Twelve families of 40 with up to 4 of 200 words changed."""
    rng = random.Random(6)
    rows = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(200)]
        rows += [(f * 40 + i, edited(base, rng.choice((1, 2, 3, 4)), rng, f"{f}_{i}")) for i in range(40)]
    assert kept(spark, rows) == sorted(set(brute_groups(rows)))


def test_frequent_passages_join_nothing(spark):
    """A passage of 40 words in every text, with words of their own around it."""
    rng = random.Random(7)
    shared = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"o{i}_{k}" for k in range(rng.choice((5, 8, 12)))])) for i in range(60)]
    assert kept(spark, rows) == sorted(set(brute_groups(rows)))


def test_blocks_hold_every_pair(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [edited(base, 1, rng, i) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").select("node", nearcopies.shingled("text").alias("set"))
    named = df.select("node", "node").toDF("node", "root")
    for block in (3, 1024):
        got = {(r.a, r.b) for r in nearcopies.alike(nearcopies.crossing(named, df, 0.8, block), df, 0.8).collect()}
        sets = [brute_set(t) for t in texts]
        assert got == {(i, j) for j in range(40) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def linked(pairs, n):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


def test_copies_of_one_text_are_not_paired_with_each_other(spark):
    """Lists of many sets go by differences from a centre: few pairs, and the groups of brute force, with the text itself and without, with two texts in one list."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(140)]
    other = base[:100] + [f"v{i}" for i in range(40)]
    copies = [edited(base, rng.choice((1, 2, 2, 3, 3, 4)), rng, i) for i in range(300)]
    twins = [edited(base, 3, rng, i % 40) for i in range(40)] + [edited(other, rng.choice((1, 2, 3)), rng, f"o{i}") for i in range(60)]
    for texts, large, most in (([" ".join(base), *copies], 64, 3000), (copies, 64, 3000), (copies[:100] + twins, 4, 10**9)):
        df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").select("node", nearcopies.shingled("text").alias("set"))
        named = df.select("node", "node").toDF("node", "root")
        pairs = nearcopies.crossing(named, df, 0.8, large=large)
        assert pairs.count() < most
        assert linked([tuple(r) for r in nearcopies.alike(pairs, df, 0.8).collect()], len(texts)) == brute_groups(list(enumerate(texts)))


def test_no_rows_and_equal_rows(spark):
    assert kept(spark, []) == []
    assert kept(spark, [(1, "same row"), (1, "same row")]) == [1]


def test_keys_with_nulls_and_separators(spark):
    """(null, '5|x') and ('5', 'x') are two rows, whatever stands between their values."""
    from passerelle.llm import simhash

    rows = spark.createDataFrame([(None, "5|x y z"), ("5", "x y z"), ("5|x y z", None)], "doc_id string, text string")
    for module in (nearcopies, simhash):
        assert sorted(r["doc_id"] or "" for r in module.representatives(rows).collect()) == ["", "5", "5|x y z"]


def test_a_group_is_one_row_of_a_bucket(spark):
    """Of 300 nodes in one group and a lone one that share all keys, only the lone one makes a pair."""
    keys = list(range(24))
    nodes = spark.createDataFrame([(i, 10, keys) for i in range(301)], "node long, size int, keys array<long>")
    roots = spark.createDataFrame([(i, 0) for i in range(300)], "node long, root long")
    pairs = nearcopies.across(nodes, roots, 0.8)
    assert pairs.count() == 22 and [tuple(r) for r in pairs.distinct().collect()] == [(300, 0)]


def test_copies_without_a_partner_leave_the_lists_of_their_shingles(spark, monkeypatch):
    """Each has so much of its own that no other shares enough of the rest: nothing is recoded, where lists of over 4 were before."""
    rng = random.Random(10)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(base, 5, rng, i) for i in range(60)]
    assert brute_groups(list(enumerate(texts))) == list(range(60))
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").select("node", nearcopies.shingled("text").alias("set"))
    levels = []
    monkeypatch.setattr(nearcopies, "recoded", lambda rows, *a, of=nearcopies.recoded: levels.append(rows) or of(rows, *a))
    assert nearcopies.alike(nearcopies.crossing(df.select("node", "node").toDF("node", "root"), df, 0.8, large=4), df, 0.8).count() == 0
    assert not levels
