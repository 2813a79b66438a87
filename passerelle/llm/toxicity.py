"""Toxic spans by a linear-chain conditional random field.

The field has two states, features of a token's word, prefixes and suffixes, and transitions; its chain runs over a whole text.
Documents are labelled as wholes. Training starts from weak token labels (in toxic documents, tokens with a feature
that is telling of toxic documents) and goes on with the documents' labels themselves: the likelihood that a clean text
has no toxic token and a toxic one has any. Forward-backward gives each token's marginal and each pair's; a logistic
model turns a document's marginals into its score, and runs of high marginals are its toxic spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passerelle.llm.common import fold, read, sampled

TOKEN = re.compile(r"[^\W\d_]+")
#: Tokens of a row: chains are computed a row at a time, and messages go on from each row to the next.
ROW = 64
#: Characters that a worker or a step of training looks at together; a longer text goes alone.
LOT = 1 << 20
#: Words whose features a worker remembers.
MEMO = 400_000


@dataclass
class Model:
    weights: dict[int, float]  # by the feature's hash
    bias: float
    stay: np.ndarray  # transition scores, [from, to]
    logistic: np.ndarray  # of 1 and the document's features
    rate: float  # score where nothing was learned


def features(word: str) -> list[int]:
    """Hashes of the word and of its prefixes and suffixes."""
    parts = ["w" + word, *(f"p{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k), *(f"s{word[-k:]}" for k in (3, 4, 5) if len(word) > k)]
    return [zlib.crc32(p.encode()) for p in parts]


@dataclass
class Chains:
    """What forward-backward says of texts: P(toxic) of each token, the expected transitions [text, from, to], and log P(no toxic token)."""

    p: np.ndarray
    moves: np.ndarray
    clean: np.ndarray


def chains(scores: np.ndarray, lengths: np.ndarray, stay: np.ndarray, moves: bool = False) -> Chains:
    """Forward-backward over whole texts, whose tokens' scores for the toxic state are concatenated.

    Rows of ROW tokens are run together. A first pass gives each row's transfer matrix; by these the messages pass from row to
    row of a text, in order, and enter the second pass from both sides. Messages are scaled to a sum of one.
    """
    n_texts = len(lengths)
    if not len(scores):
        return Chains(scores, np.zeros((n_texts, 2, 2)), np.zeros(n_texts))
    rows_of = -(-lengths // ROW)
    text = np.repeat(np.arange(n_texts), rows_of)
    top = np.cumsum(rows_of) - rows_of
    turn = np.arange(len(text)) - top[text]
    within = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = np.repeat(top, lengths) + within // ROW, within % ROW
    e, present = np.ones((ROW, len(text))), np.zeros((ROW, len(text)), bool)
    e[col, row], present[col, row] = np.exp(np.clip(scores, -30, 30)), True
    t = np.exp(stay)
    ahead = lambda a: np.stack([a[0] * t[0, 0] + a[1] * t[1, 0], a[0] * t[0, 1] + a[1] * t[1, 1]])
    behind = lambda c: np.stack([t[0, 0] * c[0] + t[0, 1] * c[1], t[1, 0] * c[0] + t[1, 1] * c[1]])
    enter, leave = np.full((2, len(text)), 0.5), np.ones((2, len(text)))
    if rows_of.max() > 1:
        m = np.zeros((2, 2, len(text)))  # [state, state on entering, row]
        m[0, 0], m[1, 1] = 1.0, e[0]
        for k in range(1, ROW):
            step = ahead(m)
            step[1] *= e[k]
            m = np.where(present[k], step / step.sum((0, 1)), m)
        order = np.argsort(turn, kind="stable")
        by_turn = np.split(order, np.cumsum(np.bincount(turn))[:-1])
        for now in by_turn[1:]:
            end = (m[:, :, now - 1] * enter[:, now - 1]).sum(1)
            enter[:, now] = ahead(end / end.sum(0))
        for now in by_turn[:0:-1]:
            got = behind((m[:, :, now] * leave[:, None, now]).sum(0))
            leave[:, now - 1] = got / got.sum(0)
    a = np.empty((ROW, 2, len(text)))
    b = np.empty((ROW, 2, len(text)))
    now = enter
    for k in range(ROW):
        step = np.stack([now[0], now[1] * e[k]]) if k == 0 else ahead(now) * np.stack([np.ones(len(text)), e[k]])
        now = np.where(present[k], step / step.sum(0), now)
        a[k] = now
    now = b[-1] = leave
    for k in range(ROW - 2, -1, -1):
        step = behind(now * np.stack([np.ones(len(text)), e[k + 1]]))
        b[k] = now = np.where(present[k + 1], step / step.sum(0), now)
    both = a * b
    p = both[:, 1] / both.sum(1)
    if not moves:
        return Chains(p[col, row], np.zeros((n_texts, 2, 2)), np.zeros(n_texts))
    # pairs of neighbours within rows, then over the edges between them
    into = np.stack([b[:, 0], b[:, 1] * e], 1)
    later = np.flatnonzero(turn > 0)
    total, off = np.zeros((n_texts, 2, 2)), np.zeros(n_texts)
    for before, after, held, own in ((a[:-1], into[1:], present[1:], np.broadcast_to(text, (ROW - 1, len(text)))), (a[-1][:, later - 1][None], into[0][:, later][None], np.ones((1, len(later)), bool), text[later][None])):
        pair = before[:, :, None] * t[None, :, :, None] * after[:, None]
        pair /= pair.sum((1, 2))[:, None, None]
        for i in (0, 1):
            for j in (0, 1):
                total[:, i, j] += np.bincount(own[held], pair[:, i, j][held], n_texts)
        stays = np.log(np.maximum(pair[:, 0, 0], 1e-300)) - np.log(np.maximum(pair[:, 0].sum(1), 1e-300))
        off += np.bincount(own[held], stays[held], n_texts)
    off += np.bincount(text[turn == 0], np.log(np.maximum(1 - p[0, turn == 0], 1e-300)), n_texts)
    return Chains(p[col, row], total, off)


def token_marginals(scores: np.ndarray, lengths: np.ndarray, stay: np.ndarray) -> np.ndarray:
    return chains(scores, np.asarray(lengths), stay).p


def document_features(p: np.ndarray) -> np.ndarray:
    """1, the two highest marginals, log of the expected toxic tokens, and their share of the text."""
    top = np.sort(np.concatenate([[0.0, 0.0], p]))[-2:]
    expected = p[p > 0.05].sum()
    return np.array([1.0, top[1], top[0], np.log1p(expected), expected / max(1, len(p)) ** 0.5])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def train(texts: list[str], toxic: list[int], steps: int = 40, more: int = 20, ridge: float = 1e-4, field_docs: int = 300) -> Model:
    """The field and the document model, from labelled whole texts; texts without both labels give a constant score.

    All texts tell which features are telling and fit the document model; the field learns from `field_docs` of each label, evenly
    drawn from those that are no near copies.
    """
    y = np.array(toxic, float)
    rate = float((y.sum() + 0.5) / (len(y) + 5))
    if not 0 < y.sum() < len(y):
        return Model({}, -9.0, np.zeros((2, 2)), np.zeros(5), rate)

    # texts as numbers of words, words as numbers of features
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in TOKEN.findall(t.lower())], np.int32) for t in texts]
    own = np.zeros((len(numbers), 8), np.uint32)
    padding = np.zeros((len(numbers), 8), bool)
    for w, i in numbers.items():
        f = features(w)
        own[i, : len(f)], own[i, len(f) :], padding[i, len(f) :] = f, f[0], True
    numbers.clear()
    known, own = np.unique(own, return_inverse=True)
    own = own.reshape(-1, 8).astype(np.int32)

    # features told by document; near copies, which share the smallest hash of their shingles, count once
    seen, df, n, single = set(), np.zeros((2, len(known))), [1, 1], ([], [])
    for i, (d, label) in enumerate(zip(docs, toxic, strict=True)):
        if len(d) and sign(d) not in seen:
            seen.add(sign(d))
            single[label].append(i)
            n[label] += 1
            df[label, np.unique(own[d])] += 1
    # rates with a tenth of a document more, so that a feature of one or two tells nothing
    odds = np.log((df[1] + 0.1) / (n[1] + 1)) - np.log((df[0] + 0.1) / (n[0] + 1))
    common = df[1] >= max(4, 0.012 * n[1])
    telling = (common & (odds > 3.5))[own].any(1)
    k = int(common.sum())
    # the last weight is the bias, which every word has
    index = np.where(padding, k + 1, np.where(common, np.cumsum(common) - 1, k + 1)[own])

    def lots(some: list[int]) -> Iterator[list[int]]:
        """The texts LOT / 8 tokens at a time, or a longer one alone."""
        held, size = [], 0
        for i in some:
            if held and size + len(docs[i]) > LOT // 8:
                yield held
                held, size = [], 0
            held.append(i)
            size += len(docs[i])
        if held:
            yield held

    chosen = sorted({own[j] for own in single for j in np.linspace(0, len(own) - 1, min(len(own), field_docs)).astype(int)})
    learned = [(np.concatenate([docs[i] for i in part]), np.array([len(docs[i]) for i in part]), y[part]) for part in lots(chosen)]
    used = len(chosen)

    theta = np.zeros(k + 1 + 4)
    theta[k] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + more + 1):
        score = np.append(theta[: k + 1], 0.0)[index].sum(1) + theta[k]
        grad = np.zeros_like(theta)
        for tokens, lengths, labels in learned:
            got = chains(score[tokens], lengths, theta[k + 1 :].reshape(2, 2), moves=True)
            if step <= steps:
                # maximum likelihood of the weak labels: expected minus observed counts
                goal = telling[tokens] & np.repeat(labels > 0, lengths)
                gap = got.p - goal
                inner = np.ones(len(goal) - 1, bool)
                inner[np.cumsum(lengths)[:-1] - 1] = False
                was, then = goal[:-1][inner].astype(int), goal[1:][inner].astype(int)
                moves = got.moves.sum(0) - np.bincount(2 * was + then, minlength=4).reshape(2, 2)
            else:
                # of the documents' labels: a clean text has no toxic token, a toxic one has any
                none = np.exp(np.clip(got.clean, -700, -1e-9))
                weight = np.where(labels > 0, -np.minimum(none / (1 - none), 50.0), 1.0)
                gap = got.p * np.repeat(weight, lengths)
                moves = got.moves.copy()
                moves[:, 0, 0] -= lengths - 1
                moves = (moves * weight[:, None, None]).sum(0)
            by_word = np.bincount(tokens, gap, len(own))
            grad[: k + 1] += np.bincount(index.ravel(), np.repeat(by_word, 8), k + 2)[: k + 1]
            grad[k] += gap.sum()
            grad[k + 1 :] += moves.ravel()
        grad = grad / used + ridge * np.concatenate([theta[:k], np.zeros(1), theta[k + 1 :]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= (0.3 if step <= steps else 0.05) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weight = np.zeros(len(known))
    weight[common] = theta[:k]
    weight[np.abs(weight) < 0.05] = 0
    model = Model(dict(zip(known[weight != 0].tolist(), weight[weight != 0].tolist(), strict=True)), float(theta[k]), theta[k + 1 :].reshape(2, 2), np.zeros(5), rate)
    word_score = model.bias + np.where(padding, 0.0, weight[own]).sum(1)
    x = []
    for part in lots(list(range(len(docs)))):
        sizes = np.array([len(docs[i]) for i in part])
        p = token_marginals(word_score[np.concatenate([docs[i] for i in part])], sizes, model.stay)
        x += map(document_features, np.split(p, np.cumsum(sizes)[:-1]))
    model.logistic = logistic(np.array(x), y)
    return model


def sign(d: np.ndarray) -> int:
    """The smallest hash of a text's runs of three words."""
    if len(d) < 3:
        return hash(d.tobytes())
    x = d.astype(np.uint64)
    x = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
    return int(((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).min())


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_label: int = 3000) -> Model:
    """Train on the whole texts of at most about 1.2 * per_label + 60 documents of each label.

    Which documents may be learned from is the caller's choice: pass only their labels. The sample is a bounded
    number of ids, so they are broadcast. Null labels and null ids are left out.
    """
    rows = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("_y")).distinct()
    ids = sampled(rows, "_y", "_id", per_label)
    got = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id").where("_text is not null").collect()
    got.sort(key=lambda r: (r["_id"], r["_y"], r["_text"]))
    return train([r["_text"] for r in got], [r["_y"] for r in got])


def predict(docs: DataFrame, model: Model, text: str = "text", span_at: float = 0.5) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_spans: array of (start, end, p), code points, end exclusive.

    Neighbouring toxic tokens make one span, whose p is their highest marginal. Null and empty texts have no
    spans and the score of a text without toxic tokens.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("toxic_score double, toxic_spans array<struct<start:int,end:int,p:double>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, memo = sent.value, {}

        def score(word: str) -> float:
            s = memo[word] = model.bias + sum(model.weights.get(f, 0.0) for f in features(word))
            return s

        for part in parts:
            if len(memo) > MEMO:
                memo.clear()
            out, texts = [], [t or "" for t in part]
            # lower() may change a text's length, so offsets are those of the text as it is
            ends = np.cumsum([len(t) for t in texts]) // LOT
            for lot in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                words = [TOKEN.findall(texts[i]) for i in lot]
                flat = [memo[w] if w in memo else score(w) for ws in words for w in map(str.lower, ws)]
                sizes = np.array([len(ws) for ws in words], "int64")
                p = token_marginals(np.array(flat, float), sizes, model.stay)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                for i, a, b in zip(lot, edges, edges[1:], strict=False):
                    own = p[a:b]
                    x = document_features(own)
                    s = 1 / (1 + np.exp(-np.clip(x @ model.logistic, -30, 30))) if model.weights else model.rate
                    out.append((float(s), spans(texts[i], own, span_at) if x[1] >= span_at else []))
            yield pd.DataFrame(out, columns=["toxic_score", "toxic_spans"])

    names = ("toxic_score", "toxic_spans")
    return docs.drop(*names).withColumn("_toxic", of(F.col(text))).select(*[c for c in docs.columns if c not in names], "_toxic.*")


def spans(text: str, p: np.ndarray, span_at: float) -> list[tuple[int, int, float]]:
    out, last = [], -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= span_at:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[i])))
            else:
                out.append((m.start(), m.end(), float(p[i])))
            last = i
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = predict(docs, fit(docs, labels)).withColumnRenamed("toxic_score", "score")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.to_json("toxic_spans").alias("spans"))
