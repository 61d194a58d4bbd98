"""License scan by diagonal voting.

Rolling hashes of word k-grams of every document are joined with the positions of the same
grams in the license templates.  A match votes for its diagonal, the difference of the two
positions; votes on neighbouring diagonals are merged to spans, and every span is verified
on the words themselves.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import packed, small_or_shuffled, text_key, written

#: Words of a gram; shorter templates take all their words, down to two.
GRAM = 4
#: Diagonals at most so far apart belong to one span (inserted or left-out words).
NEIGHBOURS = 3
#: Share of a template's grams that must vote, and of its words that must be verified.
VOTES, VERIFIED = 0.5, 0.7
#: Words remembered with their hash by one worker.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


# The base phrases, then customary notices.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("mit-notice", "Released under the MIT License."),
    Template(
        "mit-terms",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    Template(
        "bsd-terms",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    Template(
        "gpl-terms",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    Template(
        "as-is",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not '
        "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ),
    Template("all-rights-reserved", "All rights reserved."),
)


def words_of(text: str | None) -> list[str]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_UPPER))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, from the hashes of the words."""
    if len(h) < k:
        return np.zeros(0, np.int64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _word_hashes(words: list[str], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def template_grams(spark, templates) -> DataFrame:
    """(k, gram, template, place): as many rows as the templates have words."""
    rows, known = [], _Hashes()
    for at, t in enumerate(templates):
        h = _word_hashes(words_of(t.text), known)
        k = min(GRAM, len(h))
        if not t.exact or k <= 2:
            sizes = (k,)
        else:
            sizes = (2,)
        for k in sizes:
            rows += [(k, int(g), at, p) for p, g in enumerate(rolling(h, k))]
    return spark.createDataFrame(rows, "k int, gram long, template int, place int")


def document_grams(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, key, k, grams): rolling hashes of whole texts, an array per gram size."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                if len(known) > REMEMBERED:
                    known.clear()
                hashes = [_word_hashes(words_of(t), known) for t in part.column("text").to_pylist()]
                for k in sizes:
                    grams = [rolling(h, k) for h in hashes]
                    ends = np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("key"), pa.array([k] * len(part), pa.int32()), lists],
                        names=["doc_id", "key", "k", "grams"],
                    )

    return rows.mapInArrow(run, f"doc_id {kind}, key long, k int, grams array<long>")


def voted_spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, key, template, first, last, votes): spans whose diagonals have enough votes.

    ``first`` and ``last`` are the words of the document that the span covers, ``votes`` the
    distinct places of the template that voted.  Base phrases stand on one diagonal with all
    their grams; other templates tolerate NEIGHBOURS, but fewer than they have words.  A span
    holds one diagonal with enough votes of its own at most, so a notice that is repeated
    gives a span each time.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates)  # bounded by the templates, so it is broadcast
    sizes = sorted({r["k"] for r in grams.select("k").distinct().collect()})
    votes = (
        document_grams(docs, sizes)
        .select("doc_id", "key", "k", F.posexplode("grams").alias("pos", "gram"))
        .join(F.broadcast(grams), ["k", "gram"])
        .withColumn("diagonal", F.col("pos") - F.col("place"))
        .groupBy("doc_id", "key", "template", "diagonal")
        .agg(
            F.collect_set("place").alias("places"),
            F.min("place").alias("low"), F.max(F.col("place") + F.col("k")).alias("high"),
        )
    )
    need = spark.createDataFrame(
        [(at, 1.0 if t.exact else VOTES, len(words_of(t.text))) for at, t in enumerate(templates)],
        "template int, share double, words int",
    )
    grams_of = grams.groupBy("template").agg(F.count(F.lit(1)).alias("grams"))
    need = F.broadcast(need.join(grams_of, "template"))
    span = ["doc_id", "key", "template"]
    along = Window.partitionBy(*span).orderBy("diagonal")
    within = Window.partitionBy(*span, "stretch").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0)
    apart = F.col("diagonal") - F.lag("diagonal").over(along)
    # A template repeated back to back lies a template's length apart.
    reach = F.when(F.col("share") == 1.0, 0).otherwise(F.least(F.lit(NEIGHBOURS), F.col("words") - 1))
    enough = F.col("share") * F.col("grams")
    return (
        votes.join(need, "template")
        .withColumn("new", F.when(apart <= reach, 0).otherwise(1))
        .withColumn("stretch", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        # A diagonal with enough votes is a place of the template; the next one is another place.
        .withColumn("strong", F.count(F.when(F.size("places") >= enough, 1)).over(within))
        .groupBy(*span, "stretch", F.greatest("strong", F.lit(1)).alias("strong"), "share", "grams")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"),
            F.min(F.col("diagonal") + F.col("low")).alias("first"),
            (F.max(F.col("diagonal") + F.col("high")) - 1).alias("last"),
        )
        .filter(F.col("votes") >= enough)
        .select(*span, "first", "last", "votes")
    )


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, base (places), labels, spans, score.

    ``base`` lists the first words of verified base phrases; ``spans`` holds (label, first,
    last, score) of every verified span; ``score`` is the highest of them, 0 without any.
    Null, empty and wordless texts have no words and no spans; repeated rows get equal results.
    """
    rows = packed(docs).select("row.doc_id", "row.text")
    spans = written(voted_spans(rows, templates), "license-spans")
    held = written(
        spans.groupBy(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"))
        .agg(F.collect_set(F.struct("template", "first", "last")).alias("spans")),
        "license-documents",
    )
    joined = rows.join(
        small_or_shuffled(held, 50_000),
        F.col("doc_id").eqNullSafe(F.col("s_id")) & (text_key(F.col("text")) == F.col("s_key")),
        "left",
    ).select("doc_id", "text", "spans")
    wanted = [words_of(t.text) for t in templates]
    kind = joined.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])

    def verified(words: list[str], found) -> Iterator[tuple[dict, bool]]:
        for s in found or []:
            want, exact = wanted[s["template"]], templates[s["template"]].exact
            text = words[s["first"] : s["last"] + 1]
            if exact:
                share = float(text == want)
            else:
                blocks = difflib.SequenceMatcher(None, want, text, autojunk=False).get_matching_blocks()
                share = round(sum(b.size for b in blocks) / max(len(want), len(text)), 6)
            if share >= VERIFIED:
                yield {"label": templates[s["template"]].label, "first": s["first"], "last": s["last"], "score": share}, exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                counts, bases, every = [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = words_of(text)
                    good = sorted(verified(words, found), key=lambda g: (g[0]["first"], g[0]["label"], g[0]["last"]))
                    counts.append(len(words))
                    bases.append([g for g, exact in good if exact])
                    every.append([g for g, _ in good])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(bases, pa.list_(span)), pa.array(every, pa.list_(span))],
                    names=["doc_id", "n_words", "base", "spans"],
                )

    shown = "array<struct<label:string,first:long,last:long,score:double>>"
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, base {shown}, spans {shown}").withColumn(
        "score", F.coalesce(F.array_max("spans.score"), F.lit(0.0))
    )
