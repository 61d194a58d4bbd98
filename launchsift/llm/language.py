"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A run of three letters is bound into one
vector: the first letter's vector permuted twice, the second's once, the third's as it is,
multiplied element by element.  A text is the bundle (sum) of its runs; a language is the
bundle of its texts, each scaled to length one.  A text gets the language whose profile has
the highest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import packed, released, text_key, written
from launchsift.llm.sample import fold

#: Dimensions of the vectors.
SIZE = 1024
#: Documents of a language used for its profile, those with the lowest hash of id and text.
SAMPLE = 1_500
#: A label set with more values than this is refused, as profiles go to every task.
LANGUAGES = 5_000
#: Ids whose CRC-32 has this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

#: Characters of a piece of text, and of the pieces bundled in one product.
PIECE, GROUP = 16_384, 131_072
#: Runs multiplied at once.
RUNS = 4_096
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=8192)
def letter_vector(code: int, size: int) -> np.ndarray:
    """The random vector of a letter (or of the gap between words), the same everywhere."""
    bits = np.random.Generator(np.random.PCG64([code, size])).integers(0, 2, size, dtype=np.int8)
    return bits * 2 - 1


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points, every run of other characters as one space.

    Texts with a letter begin and end with a space; texts without one have no symbols.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    after = np.empty(len(letter) + 1, bool)
    after[0], after[1:] = False, letter
    # A letter, or a gap right behind one.
    kept = np.flatnonzero(letter | after[:-1])
    out = np.empty(len(kept) + 2, np.uint32)
    out[0] = _SPACE
    out[1:-1] = np.where(letter[kept], codes[kept], _SPACE)
    out[-1] = _SPACE
    return out if letter[-1] else out[:-1]


def _bundled(parts: list[np.ndarray], size: int) -> np.ndarray:
    """Bundles of several pieces of symbols."""
    codes, whole = np.unique(np.concatenate(parts), return_inverse=True)
    n, first = len(codes), 0
    runs, rows = [], []
    for row, part in enumerate(parts):
        s = whole[first : first + len(part)]
        first += len(part)
        runs.append((s[:-2] * n + s[1:-1]) * n + s[2:])
        rows.append(np.full(len(part) - 2, row))
    runs, rows = np.concatenate(runs), np.concatenate(rows)
    if n**3 <= 1 << 22:
        there = np.zeros(n**3, bool)
        there[runs] = True
        distinct = np.flatnonzero(there)
        place = (np.cumsum(there) - 1)[runs]
    else:
        distinct, place = np.unique(runs, return_inverse=True)
    k = len(distinct)
    vectors = [np.stack([np.roll(letter_vector(int(c), size), shift) for c in codes]) for shift in (2, 1, 0)]
    out = np.zeros((len(parts), size), np.float32)
    order = np.argsort(place, kind="stable") if k > RUNS else None
    for at in range(0, k, RUNS):
        chosen = distinct[at : at + RUNS]
        if order is None:
            r, p = rows, place
        else:
            some = order[np.searchsorted(place, at, sorter=order) : np.searchsorted(place, at + RUNS, sorter=order)]
            r, p = rows[some], place[some] - at
        counts = np.bincount(r * len(chosen) + p, minlength=len(parts) * len(chosen)).reshape(len(parts), -1)
        bound = vectors[0][chosen // n // n] * vectors[1][chosen // n % n] * vectors[2][chosen % n]
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def bundles(texts: list[str | None], size: int = SIZE) -> np.ndarray:
    """One vector a text, zero without letters; long texts are bundled piece by piece."""
    out = np.zeros((len(texts), size), np.float64)
    parts: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def add() -> None:
        np.add.at(out, owners, _bundled(parts, size))
        parts.clear()
        owners.clear()

    for k, text in enumerate(texts):
        s = symbols(text or "")
        for at in range(0, len(s) - 2, PIECE):
            part = s[at : at + PIECE + 2]
            parts.append(part)
            owners.append(k)
            held += len(part)
            if held >= GROUP:
                add()
                held = 0
    if parts:
        add()
    return out


@dataclass
class Profiles:
    """Names of the languages and their vectors of length one."""

    names: list[str]
    vectors: np.ndarray

    def closest(self, bundled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, cosine) of the closest profile; ties go to the lower name."""
        length = np.linalg.norm(bundled, axis=1)
        cosine = bundled @ self.vectors.T / np.where(length > 0, length, 1)[:, None]
        best = np.argmax(cosine, axis=1)
        return best, cosine[np.arange(len(best)), best]


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def learn(docs: DataFrame, rows: int = SAMPLE, size: int = SIZE) -> Profiles:
    """Profiles of the languages of ``docs`` outside the held-out ids.

    At most ``rows`` documents of a language are bundled, in the tasks that hold them; only
    one vector a language and task leaves a task, and one a language the shuffle.
    """
    mine = packed(docs).select("row.doc_id", "row.text", F.col("row.lang").cast("string").alias("lang")).filter(
        (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    order = F.xxhash64(F.col("doc_id"), text_key(F.col("text")), F.lit(23))
    counts = mine.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "language-counts")
    if counts.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # A threshold on the uniform hash leaves about twice the rows wanted, so that few are ranked.
    share = F.least(F.lit(1.0), F.lit(2.0 * rows + 200) / F.col("n"))
    near = mine.withColumn("_order", order).join(F.broadcast(counts), "lang").filter(
        F.col("_order") / F.lit(2.0**64) + 0.5 <= share
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id"))
    ids = near.select("lang", "_order", "doc_id", rank.alias("rank")).filter(F.col("rank") <= rows)
    # At most ``rows`` ids a language; the texts are found again by a second scan.
    ids = written(ids.select("lang", "_order", "doc_id"), "language-sample")
    chosen = mine.withColumn("_order", order).join(F.broadcast(ids), ["lang", "_order", "doc_id"], "left_semi")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                vectors = _unit(bundles(part.column("text").to_pylist(), size))
                for lang, v in zip(part.column("lang").to_pylist(), vectors):
                    sums[lang] = sums.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "vector"],
        )

    sums = chosen.select("lang", "text").mapInArrow(bundle, "lang string, vector array<double>")
    each = sums.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x")
    got = sorted(whole.collect(), key=lambda r: r["lang"])
    vectors = np.array([r["x"] for r in got], np.float64).reshape(len(got), size)
    kept = np.linalg.norm(vectors, axis=1) > 0
    return Profiles([r["lang"] for r, k in zip(got, kept) if k], _unit(vectors[kept]))


def languages(docs: DataFrame, rows: int = SAMPLE, size: int = SIZE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Texts without a letter (null and empty ones too) are ``und`` with score 0, and so is every
    text if no language can be learned.  ``score`` is the cosine with the language's profile, at
    least 0.  Rows that repeat an id are judged one by one; a null id is never learned from.
    """
    profiles = learn(docs, rows, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                bundled = bundles(part.column("text").to_pylist(), size)
                named = bundled.any(axis=1) & bool(profiles.names)
                names, scores = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                if named.any():
                    best, cosine = profiles.closest(bundled[named])
                    names[named] = np.array(profiles.names, object)[best]
                    scores[named] = np.clip(np.round(cosine, 9), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)],
                    names=["doc_id", "lang_pred", "score"],
                )

    texts = packed(docs).select("row.doc_id", "row.text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    judged = texts.mapInArrow(lambda b: released(run(b)), f"doc_id {kind}, lang_pred string, score double")
    return judged.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
