"""Language identification and toxicity: held-out accuracy and edge cases."""

import random

from pyspark.sql import functions as F

from passerelle.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    out = langid.op1(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    rng = random.Random(1)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(60))
    train = [(i, make(["ka", "ro", "mi"]), "x") for i in range(20)] + [(50 + i, make(["üt", "esch", "ng"]), "y") for i in range(20)] + [(99, "no label", None), (98, None, "x")]
    models = langid.fit(spark.createDataFrame(train, "id long, text string, lang string"), "id", "text", "lang")
    assert sorted(models) == ["x", "y"]
    tests = spark.createDataFrame([(1, make(["ka", "ro", "mi"])), (2, make(["üt", "esch", "ng"])), (3, None), (4, ""), (5, "123 %%"), (6, "KAROMI " * 20_000)], "id long, text string").withColumn("score", F.lit("clash"))
    rows = {r["id"]: r for r in langid.predict(tests, models).collect()}
    assert [rows[i]["lang_pred"] for i in range(1, 7)] == ["x", "y", "und", "und", "und", "x"]
    assert rows[3]["rejected"] and not rows[1]["rejected"]
    assert langid.predict(tests.where("false"), models).count() == 0
    assert {r["lang_pred"] for r in langid.predict(tests, {}).collect()} == {"und"}


def test_toxicity_held_out():
    rng = random.Random(7)
    plain = lambda n: [rng.choice(["the", "of", "house", "tree", "river", "walks", "green", "slowly"]) + rng.choice(["", "s", "er"]) for _ in range(n)]

    def text(bad):
        words = plain(rng.randint(5, 80))
        for _ in range(2 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["gribbl", "snorv"]) + rng.choice(["y", "en", "ist", "o"]))
        return " ".join(words)

    labels = [int(i % 4 == 0) for i in range(600)]
    texts = [text(y) for y in labels]
    model = toxicity.train(texts[:450], labels[:450])
    import numpy as np

    right = 0
    for t, y in zip(texts[450:], labels[450:], strict=True):
        words = toxicity.TOKEN.findall(t)
        scores = np.array([model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words])
        x = toxicity.document_features(toxicity.token_marginals(scores, np.array([len(words)]), model.stay))
        right += (1 / (1 + np.exp(-(x @ model.logistic))) >= 0.3) == bool(y)
    assert right >= 147


def test_marginals_are_those_of_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 7):
        e, stay = rng.normal(size=n), rng.normal(size=(2, 2))
        total, on, moves, none = 0.0, np.zeros(n), np.zeros((2, 2)), 0.0
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[i] * s for i, s in enumerate(path)) + sum(stay[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            on += w * np.array(path)
            none += w * (not any(path))
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += w
        # rows of three tokens: messages cross the edges
        for row in (3, 64):
            toxicity.ROW = row
            got = toxicity.chains(np.concatenate([e, e[:1], e]), np.array([n, 0, 1, n]), stay, moves=True)
            toxicity.ROW = 64
            assert np.allclose(got.p[:n], on / total) and np.allclose(got.p[-n:], on / total)
            assert np.allclose(got.moves[[0, 3]], moves / total) and not got.moves[1:3].any()
            assert np.allclose(np.exp(got.clean[[0, 3]]), none / total) and got.clean[1] == 0


def test_a_span_is_found_wherever_it_stands(spark):
    """Whole texts are learned from and scored: toxic words come after 30,000 characters only, across the edge of two rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices(["ka", "lo", "mi", "ten", "su", "ra"], k=rng.randint(1, 5))) for _ in range(3000)]
    plain = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts, labels = [], []
    for i in range(60):
        bad = int(i % 3 == 0)
        texts.append(plain(6000 if bad else 6010) + (" zorkig zorkend zorkable" if bad else "") + " " + plain(20))
        labels.append(bad)
    model = toxicity.train(texts, labels)
    rows = spark.createDataFrame([(1, texts[0]), (2, plain(6000))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.predict(rows, model).collect()}
    at = texts[0].index("zorkig")
    assert [(s["start"], s["end"]) for s in got[1]["toxic_spans"]] == [(at, at + len("zorkig zorkend zorkable"))]
    assert got[1]["toxic_score"] > 0.7 and got[2]["toxic_score"] < 0.3


def test_toxic_spans_and_edges(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [rng.choice("aeiou") + rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnp") for _ in range(20)]
        if i % 3 == 0:
            words[4], words[15] = "zork", "zork"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    tests = spark.createDataFrame([(1, "İ é zork."), (2, None), (3, ""), (4, "fine " * 50_000)], "doc_id long, text string").withColumn("toxic_score", F.lit("clash"))
    got = {r["doc_id"]: r for r in toxicity.predict(tests, model).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["toxic_spans"]] == [(4, 8)]
    assert got[2]["toxic_score"] == got[3]["toxic_score"] and not got[2]["toxic_spans"] and not got[4]["toxic_spans"]
    assert toxicity.predict(tests.where("false"), model).count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert all(0 <= r["toxic_score"] <= 1 for r in toxicity.predict(tests, none).collect())
