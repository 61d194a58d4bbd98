"""Benchmark decontamination through a positional inverted index (DataFrame functions only).

Benchmark items are cut into phrases (windows of consecutive words).  Term counts over the
whole corpus tell each phrase's rarest terms; postings (term, document, position) of those
anchor terms are stored, shifted by the term's offset in the phrase and intersected, which
leaves (document, phrase, start) candidates.  The remaining terms are intersected in the
same way over the postings of the candidate documents only, so an exact match needs every
word of the phrase at its place.  No text is compared and none is sent to another task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import (
    packed,
    small_or_shuffled,
    sorted_digest,
    text_key,
    unpacked,
    words,
    written,
)

#: Consecutive words of a phrase; shorter items are one phrase.
WINDOW = 10
#: Rarest terms of a phrase whose posting lists are stored and intersected first.
ANCHORS = 2

#: Words by which a term of a near phrase may be out of place, and the share that may be missing.
NEAR, MISSING = 1, 0.2
#: Words of a block in which near phrases are looked at.
BLOCK = 64

KEY = ["doc_id", "key"]


def benchmark_phrases(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Written tables (phrase, n, off, term) and (phrase, item_id).

    Equal phrases of several items are one phrase, named by the SHA-256 of its words.  Null,
    empty and wordless items have none.
    """
    cut = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    phrases = cut.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, window))).alias("p"))
    named = phrases.select(F.sha2(F.array_join("p", " ").cast("binary"), 256).alias("phrase"), "item_id", "p")
    terms = (
        named.groupBy("phrase").agg(F.first("p").alias("p"))
        .select("phrase", F.size("p").alias("n"), F.posexplode("p").alias("off", "term"))
    )
    return written(terms, "phrase-terms"), written(named.select("phrase", "item_id").distinct(), "phrase-items")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, key, term, pos) of every place where one of ``terms`` stands in ``docs``."""
    return docs.select(
        "doc_id", text_key(F.col("text")).alias("key"), F.posexplode(words(F.col("text"))).alias("pos", "term")
    ).join(terms, "term")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, places): how often each of ``terms`` stands in the corpus; absent terms are left out."""
    return (
        docs.select(F.explode(words(F.col("text"))).alias("term"))
        .join(terms, "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("places"))
    )


def exact_matches(docs: DataFrame, phrase_terms: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, key, phrase, n, start): every exact occurrence of a phrase in any document.

    ``phrase_terms`` is the first table of :func:`benchmark_phrases`.  ``key`` tells texts
    under a repeated doc_id apart; rows that repeat both count once.
    """
    vocabulary = small_or_shuffled(written(phrase_terms.select("term").distinct(), "vocabulary"))
    counts = written(term_counts(docs, vocabulary), "term-counts")

    # Phrases with an absent term cannot occur; of the others the rarest terms are anchors.
    rarest = Window.partitionBy("phrase").orderBy("places", "off")
    ranked = (
        phrase_terms.join(counts, "term")
        .withColumn("present", F.count(F.lit(1)).over(Window.partitionBy("phrase")))
        .filter("present = n")
        .withColumn("rank", F.row_number().over(rarest))
    )
    anchor = written(
        ranked.filter(F.col("rank") <= anchors)
        .select("phrase", "term", "off", F.least("n", F.lit(anchors)).alias("needed")),
        "anchors",
    )
    stored = written(
        postings(docs, small_or_shuffled(written(anchor.select("term").distinct(), "anchor-terms"))), "postings"
    )
    candidate = written(
        stored.join(anchor, "term")
        .withColumn("start", F.col("pos") - F.col("off"))
        .filter("start >= 0")
        .groupBy(*KEY, "phrase", "needed", "start")
        .agg(F.count_distinct("off").alias("met"))
        .filter("met = needed")
        .select(*KEY, "phrase", "start"),
        "phrase-candidates",
    )
    # Every word of the candidates, against the postings of the documents that hold them.
    wanted = candidate.join(phrase_terms, "phrase").select(
        *KEY, "phrase", "n", "start", "term", (F.col("start") + F.col("off")).alias("pos")
    )
    holders = small_or_shuffled(
        written(candidate.select(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key")).distinct(), "holders")
    )
    held = docs.select("doc_id", "text").join(
        holders,
        F.col("doc_id").eqNullSafe(F.col("c_id")) & (text_key(F.col("text")) == F.col("c_key")),
        "left_semi",
    )
    full = postings(held, vocabulary).select(
        F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), F.col("pos").alias("p_pos"), F.col("term").alias("p_term")
    ).distinct()
    same_place = (
        F.col("doc_id").eqNullSafe(F.col("p_id"))
        & (F.col("key") == F.col("p_key"))
        & (F.col("pos") == F.col("p_pos"))
        & (F.col("term") == F.col("p_term"))
    )
    return (
        wanted.join(full, same_place, "left_semi")
        .groupBy(*KEY, "phrase", "n", "start")
        .agg(F.count(F.lit(1)).alias("met"))
        .filter("met = n")
        .drop("met")
    )


def proximity_matches(docs: DataFrame, phrase_terms: DataFrame, within: int = NEAR, missing: float = MISSING) -> DataFrame:
    """(doc_id, key, phrase, start, met, terms): places where at most ``missing`` of a phrase's
    distinct terms do not stand within ``within`` words of where the phrase would put them.

    ``met`` of the phrase's ``terms`` distinct terms are near; ``start`` may lie before the
    text's first word by ``within``.  Of a phrase that may miss k terms, any k + 1 contain one
    that is met: the rarest k + 1 propose the places, each posting every start from which it
    would be near, so no place is lost.  With ``within`` 0 and ``missing`` 0 the places are the
    exact ones, but that terms may change places with equal ones.  Null, empty and wordless
    texts hold no place; repeated rows count once and tell the same.
    """
    vocabulary = written(phrase_terms.select("term").distinct(), "vocabulary")
    spread = small_or_shuffled(vocabulary)
    counts = written(term_counts(docs, spread), "term-counts")
    each = Window.partitionBy("phrase")
    distinct = phrase_terms.select("phrase", "term").distinct().join(counts, "term", "left")
    allowed = F.floor(F.count(F.lit(1)).over(each) * F.lit(missing)).cast("int")
    ranked = (
        distinct.withColumn("terms", F.count(F.lit(1)).over(each).cast("int"))
        .withColumn("left", allowed - F.count(F.when(F.col("places").isNull(), 1)).over(each).cast("int"))
        # Terms that no text holds use up what may be missing.
        .filter("left >= 0 and places is not null")
        .withColumn("rank", F.row_number().over(each.orderBy("places", "term")))
    )
    anchor = written(
        ranked.filter(F.col("rank") <= F.col("left") + 1).select("phrase", "term", "terms").join(phrase_terms, ["phrase", "term"])
        .select("phrase", "term", "off", "terms"),
        "near-anchors",
    )
    stored = written(
        postings(docs, small_or_shuffled(written(anchor.select("term").distinct(), "anchor-terms"))).distinct(), "postings"
    )
    shift = F.explode(F.sequence(F.lit(-within), F.lit(within)))
    starts = (
        stored.join(anchor, "term")
        .select(*KEY, "phrase", "terms", (F.col("pos") - F.col("off")).alias("at"))
        .distinct()
        .select(*KEY, "phrase", "terms", shift.alias("by"), "at")
        .select(*KEY, "phrase", "terms", (F.col("at") + F.col("by")).alias("start"))
        .distinct()
    )
    # A phrase as one row: its terms with the places around each of them, counted from the start.
    shapes = phrase_terms.groupBy("phrase").agg(F.max("n").alias("n"), F.collect_list(F.struct("term", "off")).alias("shape"))
    asked = starts.join(shapes, "phrase").withColumn("block", F.floor(F.col("start") / BLOCK).cast("int"))
    # Every block also holds what a phrase that starts in it can reach.
    reach = phrase_terms.agg(F.max("n")).first()[0] or 0
    tokens = words(F.col("text"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), tokens.alias("w")).filter(F.size("w") > 0).distinct()
    begin = F.greatest(F.col("block") * BLOCK - within, F.lit(0))
    length = F.greatest((F.col("block") + 1) * BLOCK + reach + within - begin, F.lit(0))
    blocks = rows.select(
        F.col("doc_id").alias("b_id"), F.col("key").alias("b_key"), "w",
        F.explode(F.sequence(F.lit(-1), F.floor(F.size("w") / BLOCK).cast("int"))).alias("b_no"),
    ).withColumn("block", F.col("b_no")).select(
        "b_id", "b_key", "b_no", begin.alias("begin"), F.slice("w", begin + 1, length).alias("part")
    )
    here = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("key") == F.col("b_key")) & (F.col("block") == F.col("b_no"))
    first = F.col("start") - F.col("begin") - within

    def near(item):
        low = first + item["off"]
        from_, to = F.greatest(low, F.lit(0)), low + 2 * within
        return F.array_contains(F.slice("part", from_ + 1, F.greatest(to - from_ + 1, F.lit(0))), item["term"])

    met = F.size(F.array_distinct(F.transform(F.filter("shape", near), lambda item: item["term"])))
    return (
        asked.join(blocks, here)
        .select(*KEY, "phrase", "start", met.alias("met"), "terms")
        .filter(F.col("met") >= F.col("terms") - F.floor(F.col("terms") * F.lit(missing)))
    )


def hits_per_document(matches: DataFrame, phrase_items: DataFrame) -> DataFrame:
    """(h_id, h_key, n_hit, items): words inside any occurrence, and the items they belong to."""
    before = Window.partitionBy(*KEY).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    covered = (
        matches.groupBy(*KEY, "start").agg(F.max("n").alias("n"))
        .withColumn("from", F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
        .groupBy(*KEY)
        .agg(F.sum(F.greatest(end - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    )
    items = (
        matches.select(*KEY, "phrase").distinct()
        .join(phrase_items, "phrase")
        .groupBy(F.col("doc_id").alias("i_id"), F.col("key").alias("i_key"))
        .agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).alias("items"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("key") == F.col("i_key"))
    return covered.join(items, same).select(
        F.col("doc_id").alias("h_id"), F.col("key").alias("h_key"), "n_hit", "items"
    )


def _with_hits(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    rows = packed(docs)
    narrow = rows.select("row.doc_id", "row.text")
    phrase_terms, phrase_items = benchmark_phrases(items, window)
    hits = hits_per_document(written(exact_matches(narrow, phrase_terms), "matches"), phrase_items)
    return rows.withColumn("key", text_key(F.col("row.text"))), hits


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items, contaminated.

    A word is hit if it lies inside any occurrence of a ``window``-word phrase of an item (or
    of a whole shorter item).  Null, empty and wordless texts have no words and no hits; an
    empty benchmark hits nothing.  Repeated rows each get the same result.
    """
    rows, hits = _with_hits(docs, items, window)
    flat = rows.select("row.doc_id", "key", F.size(words(F.col("row.text"))).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key"))
    return flat.join(hits, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The result of :func:`contamination` with the item list as a digest."""
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", sorted_digest(F.col("items")).alias("items_sha256"), "contaminated"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, that hold no phrase of an item."""
    rows, hits = _with_hits(docs, items, window)
    same = F.col("row.doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key"))
    return unpacked(rows.join(hits.select("h_id", "h_key"), same, "left_anti"), docs.columns)
