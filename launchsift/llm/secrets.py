"""Secret scan through a trigram inverted index (DataFrame functions only).

Each rule's regular expression yields a Boolean query over trigrams: an AND of clauses, a
clause an OR of literals, a literal an AND of its trigrams.  Postings of those trigrams are
built from all documents, intersected per literal, and only the documents that satisfy a
rule's query are searched with its expression.  Rules without a mandatory trigram search
every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import (
    lower_ascii,
    packed,
    small_or_shuffled,
    text_key,
    unpacked,
    written,
)

#: Literals of one clause; a longer alternative list is cut into the next clause.
MOST_LITERALS = 16


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; ``least`` characters in ``group``."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False


# The base kinds in listed order, then widely published token formats.
RULES = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)",
        6,
        2,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# ---------------------------------------------------------------------------- trigram queries


def _exact(op, value) -> set[str] | None:
    """All strings a small construct can match, or None if they are too many to list."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value)}
    if name == "IN":
        found = set()
        for kind, item in value:
            if str(kind) == "LITERAL":
                found.add(chr(item))
            elif str(kind) == "RANGE" and item[1] - item[0] < MOST_LITERALS:
                found.update(chr(c) for c in range(item[0], item[1] + 1))
            else:
                return None
        return found if len(found) <= MOST_LITERALS else None
    if name == "SUBPATTERN":
        return _exact_sequence(value[-1])
    if name == "BRANCH":
        parts = [_exact_sequence(branch) for branch in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[:2] == (0, 1):
        once = _exact_sequence(value[2])
        return None if once is None else once | {""}
    return None


def _exact_sequence(nodes) -> set[str] | None:
    strings = {""}
    for op, value in nodes:
        one = _exact(op, value)
        if one is None or len(one) * len(strings) > MOST_LITERALS:
            return None
        strings = {a + b for a, b in product(strings, one)}
    return strings


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses (AND) of literals (OR) of trigrams (AND) that every match must contain.

    Letters are folded to lower case, as in the index.  An empty list means that the
    pattern has no mandatory trigram.
    """
    clauses, run = [], {""}

    def close() -> None:
        literals = {s.lower() for s in run}
        if all(len(s) >= 3 for s in literals):
            clauses.append([sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(literals)])

    for op, value in re._parser.parse(pattern):
        one = _exact(op, value)
        if one is not None and len(one) * len(run) <= MOST_LITERALS:
            run = {a + b for a, b in product(run, one)}
            continue
        close()
        run = one if one is not None else {""}
    close()
    return clauses


def query_table(spark, rules) -> DataFrame:
    """(rule, n_clauses, clause, literal, n_trigrams, trigram): as long as the rules are."""
    rows = []
    for at, rule in enumerate(rules):
        clauses = trigram_query(rule.pattern)
        for c, literals in enumerate(clauses):
            for k, trigrams in enumerate(literals):
                rows += [(at, len(clauses), c, k, len(trigrams), t) for t in trigrams]
    return spark.createDataFrame(
        rows, "rule int, n_clauses int, clause int, literal int, n_trigrams int, trigram string"
    )


# --------------------------------------------------------------------------------- the index


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key")
    )


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Stored postings (trigram, doc_id, key) of the given trigrams over all documents."""
    held = F.array_compact(
        F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in sorted(trigrams)])
    )
    return written(
        _keyed(docs)
        .select("doc_id", "key", lower_ascii(F.col("text")).alias("low"))
        .select("doc_id", "key", F.explode(held).alias("trigram")),
        "trigrams",
    )


def candidates(index: DataFrame, rules) -> DataFrame:
    """(doc_id, key, rules): documents whose postings satisfy each rule's Boolean query.

    The query table is as small as the rules are, so it is broadcast.
    """
    query = F.broadcast(query_table(index.sparkSession, rules))
    doc = ["doc_id", "key"]
    return (
        index.join(query, "trigram")
        .groupBy(*doc, "rule", "n_clauses", "clause", "literal", "n_trigrams")
        .agg(F.count_distinct("trigram").alias("held"))
        .filter("held = n_trigrams")
        .groupBy(*doc, "rule", "n_clauses")
        .agg(F.count_distinct("clause").alias("met"))
        .filter("met = n_clauses")
        .groupBy(*doc)
        .agg(F.collect_set("rule").alias("rules"))
    )


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, key, rule, start, end, value_start): every match that is long enough.

    Leftmost non-overlapping per rule; offsets in code points, ends exclusive.  ``rule`` is
    the position in ``rules``, ``key`` tells texts under a repeated doc_id apart, and rows
    that repeat both id and text count once.  Null and empty texts have no match.
    """
    spark = docs.sparkSession
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = {t for q in queries for clause in q for literal in clause for t in literal}
    texts = _keyed(docs)
    if wanted:
        chosen = written(candidates(build_index(docs, sorted(wanted)), rules), "candidates")
        chosen = small_or_shuffled(
            chosen.select(
                F.col("doc_id").alias("c_id"), F.col("key").alias("c_key"), F.col("rules")
            )
        )
        texts = texts.join(
            chosen, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")), "left"
        )
    else:
        texts = texts.withColumn("rules", F.lit(None).cast("array<int>"))

    def searched(at: int, rule: Rule) -> Column:
        text, pattern = F.col("text"), F.lit(rule.pattern)
        found = F.struct(
            F.lit(at).alias("rule"),
            F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all(text, pattern, 0), F.length).alias("whole"),
            F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("part"),
        )
        # A run shorter than needed cannot pass, so one cheap test saves the three searches.
        probe = text.rlike(rule.pattern[:-1] + f"{{{rule.least},}}") if _plain_run(rule) else text.rlike(rule.pattern)
        if queries[at]:
            probe = F.array_contains("rules", at) & probe
        return F.when(probe, found)

    each = (
        texts.select(
            "doc_id", "key", F.explode(F.array_compact(F.array(*[searched(*x) for x in enumerate(rules)]))).alias("m")
        )
        .select("doc_id", "key", "m.rule", F.posexplode(F.arrays_zip("m.gap", "m.whole", "m.part")).alias("i", "z"))
        .filter("z.whole is not null")
        .select("doc_id", "key", "rule", "i", "z.gap", "z.whole", "z.part")
        .distinct()
    )
    so_far = Window.partitionBy("doc_id", "key", "rule").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    return (
        each.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("whole")).over(so_far))
        .filter(F.col("part") >= least)
        .select(
            "doc_id", "key", "rule", (F.col("end") - F.col("whole")).alias("start"), "end",
            (F.col("end") - F.col("part")).alias("value_start"),
        )
    )


def _plain_run(rule: Rule) -> bool:
    """One repeated class and nothing else: its matches are the maximal runs."""
    return rule.group == 0 and re.fullmatch(r"\[[^\]\\]+\]\+", rule.pattern) is not None


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per input row: doc_id, a count ``n_<kind>`` per base rule, ``base_spans`` and ``spans``.

    Span lists hold ``kind:start:end`` by start, then by the order of the rules; documents
    without a match (also null and empty ones) have zero counts and empty lists.
    """
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.array(*[F.lit(r.base) for r in rules])
    hits = find_secrets(docs, rules).withColumn("base", F.element_at(base, F.col("rule") + 1))
    spot = F.struct("start", "rule", "end")

    def shown(spots: Column) -> Column:
        return F.transform(
            F.array_sort(spots),
            lambda s: F.concat_ws(":", F.element_at(kinds, s.rule + 1), s.start.cast("string"), s.end.cast("string")),
        )

    per_doc = hits.groupBy(F.col("doc_id").alias("h_id"), F.col("key").alias("h_key")).agg(
        *[F.count(F.when(F.col("rule") == at, 1)).alias(f"n_{r.kind}") for at, r in enumerate(rules) if r.base],
        shown(F.collect_list(F.when(F.col("base"), spot))).alias("base_spans"),
        shown(F.collect_list(spot)).alias("spans"),
    )
    none = F.array().cast("array<string>")
    return (
        docs.select("doc_id", text_key(F.col("text")).alias("key"))
        .join(per_doc, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left")
        .select(
            "doc_id",
            *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base],
            F.coalesce("base_spans", none).alias("base_spans"),
            F.coalesce("spans", none).alias("spans"),
        )
    )


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found value replaced by ``mark``; other texts stay as they are.

    Where spans of several rules overlap, their union is replaced once.  Of an assignment
    only the value goes, its name stays.  All columns are kept; ``n_chars``, if there is
    one, follows the new text.
    """
    hits = find_secrets(docs, rules).select("doc_id", "key", F.col("value_start").alias("start"), "end")
    before = Window.partitionBy("doc_id", "key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = (
        hits.withColumn("reach", F.max("end").over(before))
        .withColumn("run", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(upto))
        .groupBy("doc_id", "key", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy(F.col("doc_id").alias("h_id"), F.col("key").alias("h_key"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    )
    text = F.col("row.text")
    zero, size = F.lit(0).cast("long"), F.size("cuts")

    def last_end(i: Column) -> Column:
        return F.when(i == 0, zero).otherwise(F.get(F.col("cuts.end"), i - 1))

    kept = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.substring(
            text,
            (last_end(i) + 1).cast("int"),
            (
                F.when(i == size, F.length(text).cast("long")).otherwise(F.get(F.col("cuts.start"), i))
                - last_end(i)
            ).cast("int"),
        ),
    )
    joined = packed(docs).withColumn("key", text_key(text)).join(
        merged, F.col("row.doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left"
    )
    hit = F.col("cuts").isNotNull()
    new = F.when(hit, F.array_join(kept, mark)).otherwise(text)
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(new).cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(joined, docs.columns, **changed)
