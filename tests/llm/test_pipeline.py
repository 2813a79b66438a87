"""Each stage of the corpus pipeline on its own input, against brute force."""

import re
import zlib
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from passerelle.llm import packing, secrets, toxicity
from passerelle.llm.common import fold, read, written
from tests.llm.test_native import brute_base, brute_contamination
from tests.llm.test_nearcopies import brute_groups

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = read(spark, SF, "documents").withColumn("text", F.when(F.col("doc_id") == 7, F.lit(None)).otherwise(F.col("text")))
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_copies", "decontamination", "secrets", "packing"]

    model = toxicity.fit(docs, read(spark, SF, "labels").where(fold("doc_id", 4) != 2))
    scores = {i: r["toxic_score"] for i, r in rows(toxicity.predict(docs, model)).items()}
    kept = written(stage["toxicity"](spark, docs, SF), "t")
    assert kept.columns == columns and set(rows(kept)) == {i for i, s in scores.items() if s < 0.3}

    before = sorted((i, r["text"]) for i, r in rows(kept).items())
    kept = written(stage["near_copies"](spark, kept, SF), "n")
    assert kept.columns == columns and set(rows(kept)) == {before[k][0] for k in brute_groups(before)}

    before = rows(kept)
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    clean = {r[0] for r in brute_contamination([(i, r["text"]) for i, r in before.items()], items, 10) if not r[5]}
    kept = written(stage["decontamination"](spark, kept, SF), "d")
    assert kept.columns == columns and set(rows(kept)) == clean

    before = rows(kept)
    found = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in secrets.find(kept).collect()}
    kept = written(stage["secrets"](spark, kept, SF), "s")
    after = rows(kept)
    assert kept.columns == columns and set(after) == set(before)
    for i, r in before.items():
        text, want, at = r["text"] or "", "", 0
        assert set(brute_base(text)) <= set(found[i])
        for start, _, _, end in sorted(found[i]):
            if start >= at:
                want += text[at:start] + corpus_pipeline.MARK
            at = max(at, end)
        assert (after[i]["text"] or "") == want + text[at:]
        assert after[i]["n_chars"] == (len(after[i]["text"]) if found[i] else r["n_chars"])
        assert not re.search("AKIA[A-Z0-9]{16}", after[i]["text"] or "")

    out = stage["packing"](spark, kept, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, r in after.items():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 2048)):
            want[i, k] = (a, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + n])))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048


def test_stages_take_an_empty_table(spark):
    docs = read(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
