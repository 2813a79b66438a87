"""WARC round trips, packing, and quotation links."""

import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from passerelle.llm import packing, quotes, warc
from passerelle.llm.common import shared_dir

PAGES = "page_id long, url string, html string"


def round_trip(spark, pages):
    archives = warc.write_archives(warc.archive_records(pages), shared_dir(spark, "a"), most=2000)
    return warc.read_records(warc.normalise(archives, shared_dir(spark, "b"))).collect()


def test_round_trip(spark):
    long = "x" * 100 + "\r\n\r\n"
    rows = [(3, "u\r\nX: y", long), (1, None, long), (2, "u", long), (2, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", long), (9, "u", "WARC/1.1\r\n" * 300_000)]
    got = round_trip(spark, spark.createDataFrame(rows, PAGES))
    assert len(got) == len(rows)
    kinds = sorted((r["page"] or "", r["kind"], r["refers"] or "") for r in got)
    assert kinds == [("", "revisit", "1"), ("1", "response", ""), ("2", "revisit", "1"), ("2", "revisit", "1"), ("3", "revisit", "1"), ("4", "response", ""), ("5", "response", ""), ("6", "response", ""), ("7", "response", ""), ("8", "revisit", "7"), ("9", "response", "")]
    by_id = {str(i) if i is not None else None: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert (r["payload_bytes"], r["payload_digest"]) == (len(by_id[r["page"]]), hashlib.sha256(by_id[r["page"]]).hexdigest())
        assert r["kind"] == "revisit" or bytes(r["stored"]) == by_id[r["page"]]
    assert round_trip(spark, spark.createDataFrame([], PAGES)) == []


def test_text_ids_come_back_as_they_are(spark):
    """Spaces, line ends, percent signs, the empty id and none; what revisits the empty id says so."""
    ids = ["", " a", "b\n", "b%0A", "%", "%25", "é ü ", "d\r\ne: f", "x-page-id: y", None]
    rows = [(i, "https://a.example/", "p" * 200) for i in ids] + [(f" {i} ", None, f"short {i}") for i in ids[:3]]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").withColumn("kind", F.lit("clash"))
    archives = warc.write_archives(warc.archive_records(pages), warc.shared_dir(spark, "warc"))
    got = warc.read_records(warc.normalise(archives, warc.shared_dir(spark, "members"))).collect()
    assert sorted((r["page"] is not None, r["page"] or "", r["kind"], r["refers"]) for r in got) == sorted(
        [(i is not None, i or "", "response" if i == "" else "revisit", None if i == "" else "") for i in ids] + [(True, f" {i} ", "response", None) for i in ids[:3]], key=lambda x: x[:3]
    )


def test_normaliser_writes_members(spark, tmp_path):
    records = b"".join(warc.record("response", str(i), "u", b"p" * i * 1000, "d", None, "t") for i in range(5))
    (tmp_path / "m.warc.gz").write_bytes(gzip.compress(records[:3000]) + gzip.compress(records[3000:]))
    done = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/m.warc.gz", 5)], warc.MANIFEST), f"file://{tmp_path}/out").head()
    assert done["records"] == 5
    body = open(done["path"].removeprefix("file://"), "rb").read()
    assert gzip.decompress(body) == records
    first = zlib.decompressobj(warc.GZIP)
    assert first.decompress(body) == warc.record("response", "0", "u", b"", "d", None, "t") and first.unused_data


def test_truncated_archives_raise():
    record = warc.record("response", "1", "u", b"payload", "d", None, "t")
    for cut in (10, len(record) - 3):
        inflated = warc.Inflated(io.BytesIO(gzip.compress(record[:cut])))
        with pytest.raises(ValueError, match="ends within"):
            head = inflated.until(b"\r\n\r\n")
            list(inflated.take(int(warc.parsed(head)["content-length"]) + 4))


def test_plan_places_everything_tightly():
    rng = random.Random(1)
    count = defaultdict(int)
    for _ in range(4000):
        count[min(256, int(rng.paretovariate(0.7)) + 5)] += 1
    patterns = packing.plan(dict(count), 256, gap=2e-3)
    got = defaultdict(int)
    for p, k in patterns.items():
        assert sum(p) <= 256 and k > 0
        for n in p:
            got[n] += k
    assert got == count
    least = -(-sum(n * k for n, k in count.items()) // 256)
    assert sum(patterns.values()) <= 1.02 * least + 1
    assert packing.plan({}, 256) == {}


def all_patterns(lengths, size):
    if not lengths:
        return [()]
    n, *rest = lengths
    return [(n,) * k + p for k in range(size // n + 1) for p in all_patterns(rest, size - n * k)]


def fewest(pieces, size):
    """The fewest sequences for a few pieces, by trying every subset with the largest one."""
    from functools import lru_cache

    @lru_cache(maxsize=None)
    def of(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for pick in range(1 << len(rest)):
            own = [x for i, x in enumerate(rest) if pick >> i & 1]
            if first + sum(own) <= size:
                best = min(best, 1 + of(tuple(x for i, x in enumerate(rest) if not pick >> i & 1)))
        return best

    return of(tuple(sorted(pieces, reverse=True)))


def test_program_is_within_its_gap_of_the_optimum():
    import numpy as np

    rng = random.Random(11)
    for _ in range(12):
        size = rng.choice([12, 20, 31])
        count = {n: rng.randint(1, 3) for n in rng.sample(range(2, size), 4)}
        program = packing.solve(count, size, gap=0.02)
        met = defaultdict(float)
        for p, a in program.amounts.items():
            assert sum(p) <= size
            for n in p:
                met[n] += a
        assert all(met[n] >= k - 1e-6 for n, k in count.items())
        assert abs(sum(program.amounts.values()) - program.value) < 1e-6 and program.value <= 1.02 * program.bound
        # no packing beats the bound, and whole sequences can't be fewer than it
        best = fewest([n for n, k in count.items() for _ in range(k)], size)
        assert program.bound <= best + 1e-9
        assert sum(packing.plan(count, size).values()) <= best + 1
    # exact optima: no two share a sequence; two shapes; thirds with fractional amounts
    for count, size, optimum in (({6: 5, 7: 2}, 10, 7), ({6: 3, 4: 3}, 10, 3), ({3: 10}, 10, 10 / 3), ({5: 3, 4: 4, 3: 4}, 12, 43 / 12)):
        program = packing.solve(count, size, gap=0.01, grain=48)
        assert program.bound <= optimum * 1.0001 and program.value >= optimum * 0.9999 and program.value <= 1.011 * optimum
    # the knapsack's prices are those of all patterns
    lengths, prices = np.array([3, 5, 7]), np.array([0.31, 0.5, 0.72])
    best = packing.worths(lengths, prices, 20)
    value = dict(zip(lengths.tolist(), prices.tolist(), strict=True))
    for room in range(21):
        assert abs(best[room] - max(sum(value[n] for n in p) for p in all_patterns([3, 5, 7], room))) < 1e-9


def test_the_program_places_nearly_all_pieces():
    rng = random.Random(12)
    count = defaultdict(int)
    for _ in range(6000):
        count[min(511, int(rng.lognormvariate(4.6, 1)) + 2)] += 1
    whole, left = packing.rounded(dict(count), packing.solve(dict(count), 512, gap=2e-3).amounts)
    assert sum(left.values()) <= 0.05 * 6000
    n = sum(packing.plan(dict(count), 512, gap=2e-3).values())
    assert n <= 1.005 * sum(a * k for a, k in count.items()) / 512 + 1


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_packed(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "<|endoftext|>", "ü", "😀", "12", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "a" * 3000, " " * 2000 + "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")), size=32, chunk_rows=20).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 32)):
            want[i, k] = (a, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + n])))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 32
    assert len(sequences) <= 1.05 * sum(r["length"] for r in out) / 32 + 1
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quotes(spark):
    first = "Hello there, how does one build a bridge?\n\nA second paragraph of this message."
    rows = [
        (1, 0, first),
        (1, 1, "> Hello there, how does one build a bridge?\n\nWith stone, I would say."),
        (1, 2, "> > Hello there, how does one build a bridge?\n> With stone, I would say.\nWhich stone, then?"),
        (1, 3, ">A  SECOND paragraph of this message.\nok"),
        (1, 4, None),
        (1, 5, ""),
        (1, 6, "> nobody ever said such a thing"),
        (2, 1, "> With stone, I would say."),
        (None, 0, "> With stone, I would say."),
    ]
    out = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn int, text string").withColumn("depth", F.lit("clash"))).collect()
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"], r["max_level"]) for r in out}
    assert got[1, 1] == (0, 0, 1, 1) and got[1, 2] == (1, 0, 2, 2) and got[1, 3] == (0, 0, 1, 1)
    assert got[1, 0][:3] == (None, 0, 0) and got[1, 6][:3] == (None, 6, 0) and got[2, 1][0] is None and got[None, 0][0] is None
    own = {(r["conv_id"], r["turn"]): r["own_text"] for r in out}
    assert own[1, 0] == first and own[1, 2] == "Which stone, then?" and own[1, 4] is None and own[1, 5] == ""
    assert quotes.linked(spark.createDataFrame([], "conv_id long, turn int, text string")).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, i, f"> this is the saying of number {i - 1}\nthis is the saying of number {i}") for i in range(20)]
    out = {r["turn"]: (r["thread"], r["depth"]) for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn int, text string")).collect()}
    assert out == {i: (0, i) for i in range(20)}
