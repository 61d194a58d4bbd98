"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Spark partitions the texts; inside a task the words not met before form one flat numpy array
of symbols.  Every round finds the best-ranked pair of each word with a segmented minimum,
merges it at its leftmost places in all words at once and compacts the array; words without
a pair left drop out.  Rounds end when no word has a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.llm.common import packed, released, unpacked

SPACE = "▁"
#: Words remembered with their ids by one worker; the memory is emptied when it is full.
REMEMBERED = 200_000
#: Longer words are cut where no piece can reach across, and are not remembered.
LONG = 48
#: Documents encoded or decoded together.
SLICE = 256

_RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_NONE = np.int32(2**31 - 1)
_SHIFT = 21  # bits of a symbol: a piece id, or the piece count plus a code point


class PairTable:
    """Maps pairs of symbols to a value; whole arrays are looked up at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        left = np.array([p[0] for p in pairs], np.int64)
        right = np.array([p[1] for p in pairs], np.int64)
        keys, values = (left << _SHIFT) | right, np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            stored = self.keys[slot] == keys
            self.values[slot[stored]] = values[stored]
            keys, values, slot = keys[~stored], values[~stored], (slot[~stored] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, or -1."""
        keys = (left.astype(np.int64) << _SHIFT) | right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class Pieces:
    """One BPE model file with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kind = model.normalizer_spec, schema.ModelProto.SentencePiece
        if (
            model.trainer_spec.model_type != model.trainer_spec.BPE
            or not model.trainer_spec.byte_fallback
            or norm.precompiled_charsmap
            or not norm.add_dummy_prefix
            or norm.remove_extra_whitespaces
        ):
            raise ValueError("a BPE model with byte fallback, identity rules and dummy prefix is needed")
        self.count = len(model.pieces)
        self.end = model.trainer_spec.eos_id
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_ids = [0] * 256
        self.shown = [b""] * self.count
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.shown[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                self.shown[i] = " ⁇ ".encode()
            elif p.type != kind.CONTROL:
                self.shown[i] = p.piece.replace(SPACE, " ").encode()
        self.shown = np.array(self.shown, object)
        scores = sorted({-model.pieces[i].score for i in normal.values()})
        order = {s: r for r, s in enumerate(scores)}
        rank = np.full(self.count + 1, _NONE, np.int32)  # the last stands for "no pair"
        for i in normal.values():
            rank[i] = order[-model.pieces[i].score]
        self.rank = rank

        self.symbols = np.arange(0x110000, dtype=np.int32) + self.count
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i

        def symbol(part: str) -> int | None:
            return int(self.symbols[ord(part)]) if len(part) == 1 else normal.get(part)

        pairs, neighbours = {}, {}
        # The best rank of any merge that a piece takes part in: if it is worse than the
        # piece's own, making the piece everywhere at once equals making it one by one.
        part_of = np.full(self.count, _NONE, np.int64)
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
                    for x in (a, b):
                        if x < self.count:
                            part_of[x] = min(part_of[x], rank[i])
                neighbours[int(self.symbols[ord(piece[k - 1])]), int(self.symbols[ord(piece[k])])] = 1
        self.pairs, self.neighbours = PairTable(pairs), PairTable(neighbours)
        alone = np.bincount(rank[list(normal.values())], minlength=len(scores)) == 1
        self.at_once = (part_of > rank[:-1]) & alone[np.minimum(rank[:-1], len(scores) - 1)]
        #: No piece holds a line feed among other characters, so words may end at it.
        self.line_alone = not any("\n" in piece and len(piece) > 1 for piece in normal)
        self.shared = np.array(range(self.count + 1), object)
        self.known: dict[str, tuple[int, ...]] = {"": ()}

    # ------------------------------------------------------------------------------ encoding

    def _merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, one after the other, and how many each has."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        owner = np.arange(len(lengths))  # the word that each remaining segment is
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        made = self._pairs_at(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            starts = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
            sizes = np.diff(np.append(starts, len(word)))
            ranks = self.rank[made]
            best = np.minimum.reduceat(ranks, starts)
            over = best == _NONE
            if over.any():
                stay = np.repeat(~over, sizes)
                done.append((owner[over], sizes[over], symbols[~stay]))
                symbols, made, ranks = symbols[stay], made[stay], ranks[stay]
                owner, sizes, best = owner[~over], sizes[~over], best[~over]
                word = np.repeat(np.arange(len(owner), dtype=np.int32), sizes)
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(best, sizes))
            first = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            run = np.concatenate(([True], np.diff(at) != 1))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[first | (self.at_once[made[at]] & (place % 2 == 0))]
            symbols = symbols.copy()
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay)[at] - 1
            symbols, word, made = symbols[stay], word[stay], made[stay]
            fresh = np.concatenate((moved, moved[moved > 0] - 1))
            made[fresh] = self._pairs_at(symbols, word, fresh)
        counts = np.zeros(len(lengths), np.int64)
        for words, sizes, _ in done:
            counts[words] = sizes
        begins = np.cumsum(counts) - counts
        flat = np.empty(counts.sum(), np.int32)
        for words, sizes, final in done:
            inside = np.arange(len(final)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat[np.repeat(begins[words], sizes) + inside] = final
        return flat, counts

    def _pairs_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The piece that each place and its right neighbour make, -1 (no pair) at word ends."""
        right = np.minimum(at + 1, len(symbols) - 1)
        found = self.pairs(symbols[at], symbols[right])
        found[(word[at] != word[right]) | (right == at)] = -1
        return found

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words, none of them empty."""
        symbols = self.symbols[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        cuts = [0]
        if lengths.max(initial=0) > LONG:
            inside = np.repeat(lengths > LONG, lengths)
            inside[ends - 1] = False
            at = np.flatnonzero(inside)
            cuts = at[self.neighbours(symbols[at], symbols[at + 1]) < 0] + 1
        bounds = np.union1d(ends, np.asarray(cuts, np.int64))
        bounds = bounds[bounds > 0]
        flat, counts = self._merge(symbols, np.diff(np.concatenate(([0], bounds))))
        upto = np.cumsum(counts)[np.searchsorted(bounds, ends)]
        unknown = np.flatnonzero(flat >= self.count)
        ids, at = self.shared[np.minimum(flat, self.count)].tolist(), [0, *upto.tolist()]
        out = [tuple(ids[b:e]) for b, e in zip(at, at[1:])]
        for w in np.unique(np.searchsorted(upto, unknown, side="right")).tolist():
            out[w] = tuple(self._with_bytes(flat[at[w] : at[w + 1]].tolist()))
        return out

    def _with_bytes(self, ids: list[int]) -> Iterator[int]:
        for i in ids:
            if i < self.count:
                yield i
            else:
                yield from (self.byte_ids[b] for b in chr(i - self.count).encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text, the end id last.  An empty text has the end id alone."""
        split = []
        for text in texts:
            if not text:
                split.append([])
                continue
            clean = SPACE not in text and "  " not in text and text[0] != " "
            text = SPACE + text.replace(" ", f" {SPACE}" if clean else SPACE)
            if self.line_alone:
                text = text.replace("\n", " \n ")
            split.append(text.split(" ") if clean else [r for w in text.split(" ") for r in _RUN.findall(w)])
        found = self.known
        if len(found) > REMEMBERED:
            found.clear()
            found[""] = ()
        new = list(set(chain.from_iterable(split)).difference(found))
        found.update(zip(new, self._words(new), strict=True)) if new else None
        out = [list(chain.from_iterable(map(found.__getitem__, words))) for words in split]
        for w in new:
            if len(w) > LONG:
                del found[w]
        for ids in out:
            ids.append(self.end)
        return out

    # ------------------------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: control ids vanish, the dummy prefix goes, byte ids join to characters."""
        text = b"".join(self.shown[ids].tolist()).decode("utf-8", "replace") if len(ids) else ""
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _model(path: str) -> Pieces:
    return Pieces(path)


def _slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Adds ``column``: the ids of ``text`` with the end id last; a null text counts as empty.

    ``path`` names the model file, which every worker reads where it stands.  One row per
    input row, all columns kept (an own column of that name is replaced).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in released(batches):
            for part in _slices(batch):
                ids = model.encode([t or "" for t in part.column("row").field("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"]
                )

    return _mapped(docs, run, "ids", T.ArrayType(T.IntegerType()), column)


def decode(df: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Adds ``column``: the text of the ids in column ``ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in released(batches):
            for part in _slices(batch):
                lists = [i.values for i in part.column("row").field(ids)]
                texts = [model.decode([] if i is None else i.to_numpy(zero_copy_only=False)) for i in lists]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"]
                )

    return _mapped(df, run, "decoded", T.StringType(), column)


def _mapped(df: DataFrame, run, name: str, kind: T.DataType, column: str) -> DataFrame:
    rows = packed(df)
    schema = T.StructType([rows.schema["row"], T.StructField(name, kind)])
    made = rows.mapInArrow(run, schema)
    columns = [c for c in df.columns if c != column]
    return unpacked(made, [*columns, column], **{column: F.col(name)})
