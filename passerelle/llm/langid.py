"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of the whole texts of a bounded sample of its labelled rows.
A text is compressed block by block with every dictionary; the language with the smallest total wins,
and a narrow margin between the best two marks the row as rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passerelle.llm.common import fold, read, sampled

LETTERS = re.compile(r"[^\W\d_]+")
#: zstandard level of every block, short or long.
LEVEL = 6
SCHEMA = "lang_pred string, score double, margin double, rejected boolean"


def letters(text: str) -> bytes:
    """The text's words of letters, in lower case, joined by one space."""
    return " ".join(LETTERS.findall(text.lower())).encode()


def fit(labelled: DataFrame, key: str, text: str, lang: str, docs_per_lang: int = 40) -> dict[str, bytes]:
    """A dictionary for each language: the whole texts of about 1.1 * docs_per_lang + 40 labelled rows, repeats once, in the order of a hash."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    picked = sampled(rows, lang, key, docs_per_lang).select(F.col(lang), F.col(text), F.xxhash64(F.lit(5), text)).collect()
    found: dict[str, dict[bytes, int]] = {}
    for value, body, h in picked:
        if words := letters(body):
            found.setdefault(value, {})[words] = h
    return {value: b" ".join(sorted(own, key=lambda w: (own[w], w))) for value, own in found.items()}


@lru_cache(maxsize=8)
def compressors(items: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, object]]:
    import zstandard

    out = []
    for value, body in items:
        d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((value, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, models: tuple[tuple[str, bytes], ...], block: int, level: int, narrow: float) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of a whole text."""
    body = letters(text) if text else b""
    if not body or not models:
        return "und", 0.0, 0.0, True
    sizes = sorted((sum(len(c.compress(body[i : i + block])) for i in range(0, len(body), block)), value) for value, c in compressors(models, level))
    best = sizes[0][0]
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0, False
    heat = 2.0 + 0.01 * best
    score = 1.0 / sum(math.exp((best - n) / heat) for n, _ in sizes)
    margin = (sizes[1][0] - best) / sizes[1][0]
    return sizes[0][1], min(1.0, score), margin, margin < narrow


def predict(docs: DataFrame, models: dict[str, bytes], text: str = "text", block: int = 1024, level: int = LEVEL, narrow: float = 0.02) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin and rejected.

    A null text and one without letters give `und`, score 0 and rejected. Equal sizes go to the smaller name,
    with margin 0. Columns of these names in docs are replaced; docs may be empty.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tuple(sorted(models.items())))

    @F.pandas_udf(SCHEMA)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([classify(t, sent.value, block, level, narrow) for t in part], columns=["lang_pred", "score", "margin", "rejected"])

    names = ("lang_pred", "score", "margin", "rejected")
    return docs.drop(*names).withColumn("_lang", of(F.col(text))).select(*[c for c in docs.columns if c not in names], "_lang.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    models = fit(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    return predict(docs.select("doc_id", "held_out", "text"), models).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
