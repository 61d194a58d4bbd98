"""Repair of conversation structure by iterative-deepening A*.

A conversation is a sequence of rows in the order of their turns.  Edits keep, delete and
rerole rows and insert empty ones until the roles read ``(s?(ua)+)?``.  The search goes depth
first through the edits in ASCII order (D, I, K, R) under a cost bound that rises to the next
possible cost; states that failed keep what the rest costs at least, so they are entered again
only with a higher bound.  The first accepting path is the cheapest and, among the cheapest,
the ASCII-least.

Longer conversations are cut into blocks of rows.  The same search finds the path of a block
for every pair of states at its ends, blocks in parallel; the costs are then added from the
last block back and the paths chosen from the first block on.  A path through a block ends
with an edit that uses up the block's last row, so the parts join to the very same answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.llm.common import packed, written
from launchsift.llm.inorder import pieces

#: Rows that one search takes at once.
BLOCK = 24

# White space, costs of the edits, faults and initials by number.
SPACE = "\t\n\x0b\x0c\r "
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua"
#: States: nothing yet, after system, after user, after assistant; END accepts.
NOTHING, SYSTEM, USER, ASSISTANT, END = range(5)
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
_NEVER = 1 << 60


@lru_cache(maxsize=1 << 16)
def cheapest(codes: str, entry: int, target: int) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then ASCII-least path through the rows, or None.

    ``codes`` has a hex digit a row: 4 * fault + initial.  With ``target`` END the path
    accepts at the conversation's end; otherwise it reaches that state by using up the last row.
    """
    rows = [divmod(int(c, 16), 4) for c in codes]
    n = len(rows)
    floor = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][0]
        floor[i] = floor[i + 1] + (DELETE if fault >= BLANK else CUT if fault == TRUNCATED else 0)
    accepts = (NOTHING, ASSISTANT) if target == END else (target,)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def search(i: int, state: int, left: int) -> int | None:
        """None once a path within ``left`` is found, else what the rest costs at least."""
        if state > target < USER:
            return _NEVER
        least = failed.get((i, state), floor[i])
        if least > left:
            return least
        if i == n and state in accepts:
            return None
        moves = []
        if i < n:
            fault, initial = rows[i]
            moves.append(("D", i + 1, state, DELETE))
        if i < n or target == END:
            moves.append(("I", i, NEXT[state], INSERT))
        if i < n and fault < BLANK:
            cut = CUT if fault == TRUNCATED else 0
            if initial in KEEP[state]:
                moves.append(("K", i + 1, KEEP[state][initial], cut))
            moves.append(("R", i + 1, NEXT[state], REROLE + cut))
        best = _NEVER
        for edit, row, after, cost in moves:
            path.append(edit)
            rest = search(row, after, left - cost)
            if rest is None:
                return None
            path.pop()
            best = min(best, cost + rest)
        failed[i, state] = best
        return best

    bound = floor[0]
    while bound < _NEVER:
        more = search(0, entry, bound)
        if more is None:
            return bound, "".join(path)
        bound = more
    return None


def block_paths(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, edits) for every possible pair of states at a block's ends."""
    out = []
    for entry in (NOTHING,) if first else (NOTHING, SYSTEM, USER, ASSISTANT):
        for target in (END,) if last else (NOTHING, SYSTEM, USER, ASSISTANT):
            found = cheapest(codes, entry, target)
            if found:
                out.append((entry, target, *found))
    return out


def chained(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and edits of the whole conversation from the paths of its blocks."""
    ahead = [{END: 0}]
    for paths in reversed(blocks):
        rest: dict[int, int] = {}
        for entry, target, cost, _ in paths:
            if target in ahead[-1]:
                rest[entry] = min(rest.get(entry, _NEVER), cost + ahead[-1][target])
        ahead.append(rest)
    state, edits = NOTHING, []
    for paths, rest in zip(blocks, reversed(ahead[:-1])):
        _, edit, state = min(
            (cost + rest[target], edit, target)
            for entry, target, cost, edit in paths
            if entry == state and target in rest
        )
        edits.append(edit)
    return ahead[-1][NOTHING], "".join(edits)


def illegal_pairs(codes: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initial = np.frombuffer(codes.encode(), np.uint8)
    initial = np.where(initial > 57, initial - 87, initial - 48) % 4
    pair = initial[:-1] * 4 + initial[1:]
    return int((~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after faults that follow from CRC-32 of ``conv_id:turn`` % 20.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 sets
    the role user.  Null roles and texts, and null ids and turns in the key, are one space.
    """
    blank = F.lit(" ")

    def shown(name: str) -> Column:
        return F.coalesce(F.col(f"row.{name}").cast("string"), blank)

    harm = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    rows = packed(conversations).select(
        "row.conv_id", "row.turn", shown("role").alias("role"), shown("text").alias("text"), harm.alias("harm")
    ).filter("harm <> 0")
    text = (
        F.when(F.col("harm") == 1, F.lit(""))
        .when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """(conv_id, known, turn, role, text, digest); null roles and texts are empty."""
    return packed(rows).select(
        "row.conv_id",
        F.col("row.turn").isNotNull().alias("known"),
        "row.turn",
        F.coalesce("row.role", F.lit("")).alias("role"),
        F.coalesce("row.text", F.lit("")).alias("text"),
    ).withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


#: Rows of a conversation follow their turns, nulls first; repeated turns role and digest.
ORDER = ["known", "turn", "role", "digest"]


def _coded(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """(conv_id, ORDER, copies, code): equal rows as one, with their number and the first one's code."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(F.length(bare) == 0, BLANK)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    initial = F.lit(len(INITIALS))
    for k, letter in enumerate(INITIALS):
        initial = F.when(F.left("role", F.lit(1)) == letter, k).otherwise(initial)
    slim = _keyed(rows).select("conv_id", *ORDER, fault.alias("fault"), initial.alias("initial"))
    alike = slim.groupBy("conv_id", *ORDER).agg(
        F.count(F.lit(1)).alias("copies"), F.min("fault").alias("fault"), F.min("initial").alias("initial")
    )
    alike = written(alike, "conversation-rows")
    # A row seen earlier has an earlier turn with the same role and text, or is a further copy.
    when = F.struct("known", "turn")
    seen = alike.groupBy("conv_id", "digest").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("times"))
    seen = seen.filter("times > 1").select(F.col("conv_id").alias("of"), F.col("digest").alias("said"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("said"))
    coded = alike.join(seen, same, "left").withColumn(
        "fault",
        F.when((F.col("fault") != BLANK) & (when > F.col("first")), DUPLICATE).otherwise(F.col("fault")),
    )

    def digit(fault: Column) -> Column:
        return F.lower(F.hex(fault * 4 + F.col("initial")))

    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    letters = F.concat(digit(F.col("fault")), F.repeat(digit(again), (F.col("copies") - 1).cast("int")))
    out = coded.select("conv_id", *ORDER, letters.alias("codes"))
    if ids is None:
        return out
    marks = ids.select("conv_id").distinct().select(
        "conv_id", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ORDER], F.lit("").alias("codes")
    )
    return out.unionByName(marks)


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id and SUMMARY.

    Rows need conv_id, turn, role and text.  Null roles and texts count as empty, null turns
    come first and null ids are one conversation; rows of one turn follow role and a hash of
    role and text.  ``ids`` adds conversations without rows: all zero and an empty audit.
    One digit a row is gathered per conversation, just as its audit has one letter an edit.
    """
    coded = written(_coded(rows, ids), "conversation-codes")
    turns = coded.filter("codes <> ''").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    span = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    ).select(F.col("conv_id").alias("of"), "gaps")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "piece"))), lambda p: p["piece"])
    whole = pieces(coded, ["conv_id"], ORDER, "codes", "").groupBy("conv_id").agg(F.array_join(ordered, "").alias("codes"))
    cut = F.regexp_extract_all("codes", F.lit(f"([0-9a-f]{{1,{BLOCK}}})"), 1)
    blocks = whole.select("conv_id", F.posexplode_outer(cut).alias("block", "codes"), F.size(cut).alias("blocks"))
    blocks = blocks.repartition("conv_id", "block")
    paths_type = "array<struct<entry: int, exit: int, cost: bigint, edits: string>>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            rows = (batch.column(c).to_pylist() for c in ("block", "codes", "blocks"))
            for block, codes, count in zip(*rows):
                paths = block_paths(codes or "", not block, not block and count <= 0 or block == count - 1)
                found.append([dict(zip(("entry", "exit", "cost", "edits"), p)) for p in paths])
            kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), batch.column("codes"), pa.array(found, kind)],
                names=["conv_id", "block", "codes", "paths"],
            )

    conv = rows.schema["conv_id"].dataType.simpleString()
    searched = blocks.mapInArrow(search, f"conv_id {conv}, block int, codes string, paths {paths_type}")
    gathered = searched.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(0)).alias("block"), "codes", "paths"))).alias("blocks")
    ).select("conv_id", "blocks.codes", "blocks.paths")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, blocks in zip(batch.column("codes").to_pylist(), batch.column("paths").to_pylist()):
                cost, edits = chained([[(p["entry"], p["exit"], p["cost"], p["edits"]) for p in b] for b in blocks])
                text = "".join(c or "" for c in codes)
                faults = [sum(text.count(f"{4 * f + k:x}") for k in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
                out.append((*faults, illegal_pairs(text), cost, edits))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string())],
                names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
            )

    kinds = SUMMARY.removeprefix("gaps bigint, ")
    done = gathered.mapInArrow(chain, f"conv_id {conv}, {kinds}")
    return done.join(span, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )


class _Mend:
    """Applies an audit to the rows of its conversation as they come."""

    def __init__(self, audit: str) -> None:
        self.edits, self.at = audit, 0
        kept = len(audit) - audit.count("D")
        self.place, self.system = 0, kept % 2

    def _role(self) -> str:
        return "assistant" if (self.place - self.system) % 2 else "user"

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            yield self.place, self._role(), ""
            self.at, self.place = self.at + 1, self.place + 1

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserted()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit != "D":
            yield self.place, role if edit == "K" else self._role(), text
            self.place += 1


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list]]:
    """(summary row of a conversation that begins or None, repaired rows) in order."""
    mend = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                yield None, list(mend.inserted()) if mend else []
                mend = _Mend(row["audit"])
                yield row, []
            else:
                yield None, list(mend.row(row["role"], row["text"]))
    if mend:
        yield None, list(mend.inserted())


def _streamed(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The audit of every conversation and then its rows, dealt by conversation and sorted."""
    texts = _keyed(rows).withColumn("is_row", F.lit(True))
    heads = audited.withColumn("is_row", F.lit(False))
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *ORDER).drop("digest", "known", "turn", "is_row")


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, places from 0.

    Rows stream through in order next to their audit; none is held.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, conv_id = None, [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = (kind, pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "place", "role", "text"])

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for head, mended in _mended(noted()):
            if head is not None:
                conv_id = head["conv_id"]
            out.extend((conv_id, *m) for m in mended)
            if len(out) >= 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    return _streamed(rows, audited).mapInArrow(run, f"conv_id {conv}, place bigint, role string, text string")


def repaired_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``audited`` with repaired_sha256, the hash of the repaired rows as ``role:text`` lines."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = [c for c in audited.columns if c != "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, head, digest, empty = None, [], None, None, True

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            types = [kind, *[pa.string() if n == "audit" else pa.int64() for n in names], pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *names, "repaired_sha256"])

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for begun, mended in _mended(noted()):
            for _, role, text in mended:
                digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False
            if begun is not None:
                if head is not None:
                    done.append((head["conv_id"], *[head[n] for n in names], digest.hexdigest()))
                head, digest, empty = begun, hashlib.sha256(), True
                if len(done) >= 1000:
                    yield flush()
                    done = []
        if head is not None:
            done.append((head["conv_id"], *[head[n] for n in names], digest.hexdigest()))
        if done:
            yield flush()

    return _streamed(rows, audited).mapInArrow(run, f"conv_id {conv}, {SUMMARY}, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of all conversations."""
    audited = written(audits(rows, ids), "conversation-audits")
    return audited, repaired(rows, audited)
