"""SimHash near-duplicates and repeated windows, against brute force."""

import hashlib
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from passerelle.llm import simhash, substrings

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius):
    root = {p: p for p in points}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in points}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_masks_cover_every_pair():
    masks = [m % (1 << 64) for m in simhash.masks(3)]
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not x & m for m in masks)


def clustered(rng, n):
    """Points in tight groups, so that buckets are large and distances 1 to 5 all occur."""
    out = set()
    for _ in range(n // 20):
        center = rng.getrandbits(64)
        free = rng.sample(range(64), 9)
        for _ in range(20):
            out.add(center ^ sum(1 << b for b in rng.sample(free, rng.randint(0, 4))))
    return sorted(out)


def test_links_give_the_components_of_all_pairs(spark):
    points = clustered(random.Random(5), 120)
    nodes = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    want = brute_components(points, 3)
    for large in (256, 3):  # pair by pair, and through flipped keys
        got = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(nodes, 3, large)).collect()}
        named = {p: got.get(p, signed(p)) for p in points}
        pairs = {(want[p], named[p]) for p in points}
        assert len(pairs) == len({w for w, _ in pairs}) == len({g for _, g in pairs})


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert all(got.get(i, 0) == 0 for i in range(41)) and got[101] == 100
    assert simhash.components(links.where("false")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400)]
    near = base[:200] + ["zz"] + base[201:]
    texts = [" ".join(base), " ".join(near), " ".join(base).upper(), None, "", " \n", "One", "one", "two words", "  two\twords "]
    docs = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)] + [(None, "alone in the dark")], DOCS).withColumn("fp", F.lit("clash"))
    rows = simhash.near_duplicates(docs).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    for i, t in enumerate(texts):
        assert prints[10 - i] == f"{brute_fingerprint(t):016x}"
    component = {r["doc_id"]: r["component_id"] for r in rows}
    want = brute_components(sorted({brute_fingerprint(t) for t in texts} | {brute_fingerprint("alone in the dark")}), 3)
    for i, t in enumerate(texts):
        assert component[10 - i] == min(10 - k for k, u in enumerate(texts) if want[brute_fingerprint(u)] == want[brute_fingerprint(t)])
    kept = simhash.representatives(docs).collect()
    assert len(kept) == len(set(want.values())) and all(r["fp"] == "clash" for r in kept)


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    twice = spark.createDataFrame([(1, "same row"), (1, "same row")], DOCS)
    assert simhash.representatives(twice).count() == 1


def brute_removal(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removal(spark, rows, window, gram):
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash"))
    got = substrings.remove_repeats(docs, window=window, gram=gram).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str)


def test_repeated_windows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(30)]
    passage = " ".join(f"w{i}" for i in range(9))
    rows += [(100, f"x {passage} y"), (101, f"{passage}\n z"), (102, None), (103, ""), (104, "a"), (105, "same text here for all of us"), (105, "same text here for all of us"), (None, "no id at all but words"), (106, "é ü " * 8)]
    assert removal(spark, rows, 5, 2) == brute_removal(rows, 5)
    assert removal(spark, rows, 8, 8) == brute_removal(rows, 8)


def test_windows_in_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "AT_ONCE", 50)
    rng = random.Random(4)
    rows = [(0, " ".join(rng.choice("ab") for _ in range(3000))), (1, " ".join(f"u{i}" for i in range(3000))), (2, " ".join(f"u{i}" for i in range(2000, 2040)))]
    assert removal(spark, rows, 12, 4) == brute_removal(rows, 12)


def test_no_documents(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_flipped_keys_of_large_buckets_are_no_part_of_the_plan(spark):
    """The driver copies and keeps plans: some 8,000 patterns of bits as literals made 700 KB of text."""
    rng = random.Random(12)
    free = [b for b in range(64) if not simhash.masks(3)[0] >> b & 1]
    fps = {sum(1 << b for b in rng.sample(free, rng.randrange(1, 6))) for _ in range(80)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, 16)
    assert len(found._jdf.queryExecution().toString()) < 50_000
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    joined = lambda pairs: {tuple(r) for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert near and joined([tuple(r) for r in found.collect()]) == joined(near)
