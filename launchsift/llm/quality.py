"""Quality by attention over passages (multiple-instance learning).

A document is a bag of passages and carries the only label.  Every passage becomes a vector
of measures and a learned encoding; a gated attention learns from the document labels how
much each passage counts; the weighted mean of the encodings gives the score.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchsift.llm.common import packed
from launchsift.llm.sample import fold, labelled_sample

#: Words of a passage; the last one of a document may be shorter.
PASSAGE = 128
#: Labelled documents used for fitting.
SAMPLE = 6_000
ENCODED, GATED, EPOCHS, BATCH = 12, 8, 40, 256
#: Ids whose CRC-32 has this remainder are never learned from.
FOLDS, HELD_OUT = 3, 1

# Fixed classes of bytes: letters by case, digits, white space, non-ASCII and single marks.
_MARKS = b".,;:!?|*#$%&@\"'()-/=<>"
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5
for _k, _m in enumerate(_MARKS):
    _CLASS[_m] = 6 + _k
_CLASSES = 6 + len(_MARKS)
_OTHER = 9
MEASURES = _CLASSES + _OTHER


def passages(text: str) -> np.ndarray:
    """(passages, measures) of a whole text; one row of zeros for a text without words."""
    words = text.split()
    if not words:
        return np.zeros((1, MEASURES), np.float32)
    out = np.zeros((-(-len(words) // PASSAGE), MEASURES), np.float32)
    seen: set[str] = set()
    for row, at in enumerate(range(0, len(words), PASSAGE)):
        part = words[at : at + PASSAGE]
        n, distinct = len(part), set(part)
        raw = " ".join(part).encode("utf-8", "replace")
        out[row, :_CLASSES] = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=_CLASSES) / len(raw)
        lower = sum(map(str.islower, part)) / n
        out[row, _CLASSES:] = (
            len(distinct) / n,
            sum(map(operator.eq, part, part[1:])) / n,
            len(distinct & seen) / len(distinct),
            lower,
            sum(map(str.isupper, part)) / n,
            sum(map(str.isalpha, part)) / n,
            min(len(raw) / n, 40.0) / 10,
            max(map(len, part)) ** 0.5 / 10,
            np.log1p(n) / 5,
        )
        seen |= distinct
    return out


@dataclass
class Attention:
    """Standardisation and weights; ``score`` takes bags as one array of rows and their sizes."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, rows: np.ndarray, sizes: np.ndarray):
        w, starts = self.w, np.concatenate(([0], np.cumsum(sizes)[:-1]))
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["encode"] + w["encode_b"])
        t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
        return x, h, t, g, a, z, p

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.forward(rows, sizes)[-1]

    def gradients(self, rows: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x, h, t, g, a, z, p = self.forward(rows, sizes)
        d = (p - y) / len(y)
        dz = d[:, None] * w["out"]
        bag = np.repeat(np.arange(len(sizes)), sizes)
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.bincount(bag, a * da, len(sizes))[bag])
        dtg = de[:, None] * w["attend"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = dh + dt @ w["tanh"].T + dg @ w["gate"].T
        dx = dh * (1 - h * h)
        return {
            "encode": x.T @ dx, "encode_b": dx.sum(0), "tanh": h.T @ dt, "gate": h.T @ dg,
            "attend": (t * g).T @ de, "out": z.T @ d, "out_b": np.array(d.sum()),
        }


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 7, penalty: float = 1e-4) -> Attention:
    """Adam on the log loss of documents; without both labels every score is the labels' mean."""
    rows = np.concatenate(bags) if bags else np.zeros((1, MEASURES), np.float32)
    random = np.random.default_rng(seed)
    scale = rows.std(0)
    shapes = {
        "encode": (MEASURES, ENCODED), "encode_b": (ENCODED,), "tanh": (ENCODED, GATED),
        "gate": (ENCODED, GATED), "attend": (GATED,), "out": (ENCODED,), "out_b": (),
    }
    w = {k: random.normal(0, 1 / max(1, s[0] if s else 1) ** 0.5, s) for k, s in shapes.items()}
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    w["encode_b"], w["out_b"] = np.zeros(ENCODED), np.array(np.log(share / (1 - share)))
    model = Attention(rows.mean(0), np.where(scale > 1e-6, scale, 1.0), w)
    if len(y) == 0 or y.min() == y.max():
        w["out"] = np.zeros(ENCODED)
        return model
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 5e-4
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            part = [bags[i] for i in chosen]
            grads = model.gradients(np.concatenate(part), np.array([len(b) for b in part]), y[chosen])
            step += 1
            for k, g in grads.items():
                g = g + penalty * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Attention:
    """Fits on at most ``rows`` labelled documents outside the held-out third of the ids."""
    mine = labels.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    sample = labelled_sample(docs, mine, "quality", rows, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                bags = [passages(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(bags, pa.binary()), part.column("label")], names=["doc_id", "bag", "label"]
                )

    kind = sample.schema
    measured = sample.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(
        run, f"doc_id {kind['doc_id'].dataType.simpleString()}, bag binary, label int"
    )
    got = sorted(measured.collect(), key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, MEASURES) for r in got]
    return fit(bags, np.array([r["label"] for r in got], np.float64))


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    ``score`` is the probability of label 1, from the whole text alone; null and empty texts
    are one empty passage.  ``predicted`` is 1 from 0.5 on.  Without labels every score is
    0.5; with one label only, it is close to that label.
    """
    model = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                bags = [passages(t or "") for t in part.column("text").to_pylist()]
                p = model.score(np.concatenate(bags), np.array([len(b) for b in bags]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(p, 9))], names=["doc_id", "score"])

    rows_ = packed(docs).select("row.doc_id", "row.text")
    kind = rows_.schema["doc_id"].dataType.simpleString()
    return rows_.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
