"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each sees the learned text
features and the probabilities of the categories before it.  While training, those
probabilities come from models that did not see the row (out-of-fold), so later models
learn from predictions as uncertain as they will meet.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.llm.common import packed, released, unpacked, written
from launchsift.llm.sample import fold, labelled_sample

#: Labelled documents used for fitting, half of them of either label where there are as many.
SAMPLE = 12_000
#: Learned terms; a term is a word, or a word's first 4 to 7 letters followed by an asterisk.
TERMS = 400
#: Documents of the sample that hold a term, at least.
LEAST = 4
FOLDS = 5
#: Share of toxic documents that the threshold is calibrated for.
PRIOR = 0.1
CATEGORIES = ("explicit", "severe", "toxic")
#: Words whose terms one worker remembers.
REMEMBERED = 100_000

_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(4, min(8, len(word) + 1)))]


@dataclass
class Chain:
    """Terms by column, and per category weights over (terms, length, earlier probabilities) and a bias."""

    terms: dict[str, int]
    weights: list[np.ndarray]
    threshold: float

    def features(self, texts: list[str], memory: dict | None = None) -> np.ndarray:
        memory = {} if memory is None else memory
        x = np.zeros((len(texts), len(self.terms) + 1), np.float32)
        for row, text in enumerate(texts):
            words = Counter(_LETTERS.findall(text.lower()))
            for word, times in words.items():
                columns = memory.get(word)
                if columns is None:
                    columns = memory[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
                for c in columns:
                    x[row, c] += times
            x[row, -1] = sum(words.values())
            if len(memory) > REMEMBERED:
                memory.clear()
        return np.log1p(x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            out = np.column_stack((out, _sigmoid(np.column_stack((x, out)) @ w[:-1] + w[-1])))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient descent; the bias is last."""
    one = np.column_stack((x, np.ones(len(x), np.float32)))  # single precision, as the features are
    w = np.zeros(one.shape[1], np.float32)
    if not 0 < y.mean() < 1:
        w[-1] = 30.0 * (1 if len(y) and y.mean() == 1 else -1)
        return w
    # Power iteration bounds the curvature.
    y, v = y.astype(np.float32), np.ones(one.shape[1], np.float32)
    for _ in range(20):
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v)
    step = np.float32(1) / (0.25 * np.linalg.norm(one.T @ (one @ v)) / len(one) * 1.1 + penalty)
    ahead, t = w, 1.0
    keep = np.append(np.full(one.shape[1] - 1, penalty), 0).astype(np.float32)
    for _ in range(rounds):
        new = ahead - step * (one.T @ (_sigmoid(one @ ahead) - y) / len(one) + keep * ahead)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + np.float32((t - 1) / t_next) * (new - w), new, t_next
    return w.astype(np.float64)


def fit_chain(x: np.ndarray, targets: list[np.ndarray], folds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights per category, and the out-of-fold probabilities (rows, categories)."""
    held_out = np.zeros((len(x), 0), np.float32)
    weights = []
    for y in targets:
        given = np.column_stack((x, held_out))
        weights.append(_logistic(given, y))
        p = np.zeros(len(x), np.float32)
        for f in np.unique(folds):
            w = _logistic(given[folds != f], y[folds != f])
            p[folds == f] = _sigmoid(given[folds == f] @ w[:-1] + w[-1])
        held_out = np.column_stack((held_out, p))
    return weights, held_out


def _threshold(p: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The probability with the best F1 when ``prior`` of all documents are toxic."""
    if not 0 < y.mean() < 1:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order]) / y.sum() * prior
    false = np.cumsum(1 - y[order]) / (1 - y).sum() * (1 - prior)
    f1 = 2 * hit / (hit + false + prior)
    last = np.append(p[order][1:] != p[order][:-1], True)
    best = int(np.argmax(np.where(last, f1, -1)))
    after = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + after) / 2)


def learn_terms(sample: DataFrame, terms: int = TERMS, least: int = LEAST) -> list[str]:
    """The terms that tell toxic sample documents best from the others, by likelihood ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                held = {t for word in set(_LETTERS.findall(text.lower())) for t in terms_of(word)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.string()), pa.array([label] * len(held), pa.int32())], names=["term", "label"]
                )

    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return []
    held = written(
        sample.select("text", F.col("label").cast("int").alias("label"))
        .mapInArrow(run, "term string, label int")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("label").alias("bad"))
        .filter(F.col("docs") >= least),
        "terms",
    )
    # A ratio above the logarithm of the number of terms is unlikely by chance for any of them.
    by_chance = math.log(max(1, held.count())) + 1
    good, rest, clean = F.col("docs") - F.col("bad"), toxic - F.col("bad"), n - toxic

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = F.col("docs") / n
    ratio = (
        part(F.col("bad"), share * toxic) + part(good, share * clean)
        + part(rest, (1 - share) * toxic) + part(clean - good, (1 - share) * clean)
    )
    best = held.filter(F.col("bad") / toxic > good / clean).withColumn("ratio", F.round(ratio, 6))
    best = best.filter(F.col("ratio") >= by_chance)
    return [r["term"] for r in best.orderBy(F.desc("ratio"), "term").limit(terms).collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Chain:
    """Fits the chain on at most ``rows`` labelled documents.

    ``labels`` marks toxicity alone, so the two categories before it are weak ones that
    learned terms give: ``explicit`` marks toxic documents with a learned term and ``severe``
    those with three places of them.  Without labels of both kinds nothing is toxic.
    """
    sample = labelled_sample(docs, labels, "toxic", rows, True)
    terms = learn_terms(sample)
    chain = Chain({t: k for k, t in enumerate(terms)}, [], 2.0)
    found: dict = {}
    ids, xs, ys = [], [], []
    rows_ = sample.select(fold(F.col("doc_id"), FOLDS).alias("fold"), "text", "label")
    for part in _slices(rows_.toLocalIterator(), 500):
        xs.append(chain.features([r["text"] for r in part], found))
        ys += [r["label"] for r in part]
        ids += [r["fold"] for r in part]
    y = np.array(ys, np.float64)
    if not terms or not 0 < y.mean() < 1:
        none = np.zeros(len(terms) + 2)
        none[-1] = -30.0
        chain.weights = [np.insert(none, -1, np.zeros(k)) for k in range(len(CATEGORIES))]
        return chain
    x = np.concatenate(xs)
    xs.clear()
    strong = x[:, : len(terms)][:, [not t.endswith("*") for t in terms]]
    places = np.expm1(strong).sum(1) + (np.expm1(x[:, : len(terms)]) > 0.5).any(1)
    targets = [y * (places >= 1), y * (places >= 4), y]
    chain.weights, held_out = fit_chain(x, targets, np.array(ids))
    chain.threshold = _threshold(held_out[:, -1], y, PRIOR)
    return chain


def _slices(rows, size: int) -> Iterator[list]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns of ``docs`` in ``row``, a probability ``p_<category>`` per category, and ``toxic``.

    Whole texts are read; null and empty texts have no term and no word and are scored as
    such.  Rows are independent, so repeated rows get equal scores.
    """
    rows = packed(docs)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in released(batches):
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts = [t or "" for t in part.column("row").field("text").to_pylist()]
                p = chain.probabilities(chain.features(texts, memory))
                p = np.round(p, 9).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= chain.threshold)],
                    names=["row", *names, "toxic"],
                )

    schema = T.StructType(
        [rows.schema["row"], *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("toxic", T.BooleanType())]
    )
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, the probability of every category, toxic."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, rows))
    return scored.select("row.doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The documents, all columns, that the chain does not call toxic."""
    scored = score(docs, train(docs, labels, rows))
    return unpacked(scored.filter(~F.col("toxic")), docs.columns)
