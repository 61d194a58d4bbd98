"""Languages, conversation repair and the prefix trie against plain Python models."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from launchsift.llm import conversations as talk
from launchsift.llm import inorder, language, trie
from launchsift.llm.common import written

SPACE = "\t\n\x0b\x0c\r "
TABLE = "conv_id bigint, turn bigint, role string, text string, `row` string, part int, place string, node int, `a.b` string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 1, "clash") for r in rows], TABLE).repartition(3)


def first_null(key):
    return (key is not None, key)


# ---------------------------------------------------------------------------------- languages


def words(letters, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))


def plain_bundle(text, size):
    """Bundles run by run, letter by letter."""
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    clean = re.sub(" +", " ", f" {clean} ")
    out = np.zeros(size)
    if clean.strip():
        for a, b, c in zip(clean, clean[1:], clean[2:]):
            x, y, z = (language.letter_vector(ord(k), size).astype(float) for k in (a, b, c))
            out += np.roll(x, 2) * np.roll(y, 1) * z
    return out


def test_bundles_equal_plain_ones(monkeypatch):
    texts = ["Hello, wörld", None, "", " 12 - ", "a", "ÀÉ! x\u0000y", "中文 字 mixed " * 40, words("abcdefgh", 300, 1)]
    for piece, group, runs in ((16_384, 131_072, 4_096), (7, 20, 5)):
        monkeypatch.setattr(language, "PIECE", piece)
        monkeypatch.setattr(language, "GROUP", group)
        monkeypatch.setattr(language, "RUNS", runs)
        got = language.bundles(texts, 64)
        assert np.array_equal(got, np.array([plain_bundle(t, 64) for t in texts]))
    many = "".join(chr(0x4E00 + i) for i in range(400))
    assert np.array_equal(language.bundles([many], 64)[0], plain_bundle(many, 64))


def test_languages(spark):
    kinds = {"xx": "abcde", "yy": "defgh", "": "klmné"}
    rows = [(i, words(letters, 60, i), lang) for k, (lang, letters) in enumerate(kinds.items()) for i in range(k * 100, k * 100 + 60)]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "12 .. ", None), (903, words("abcde", 30, 9), None), (None, words("defgh", 30, 8), "xx")]
    rows += [(904, words("klmné", 60_000, 7), "xx"), (5, words("abcde", 60, 5), "xx"), (5, words("defgh", 60, 77), "yy")]
    docs = spark.createDataFrame([(*r, "clash", "clash", 1.0) for r in rows], "doc_id bigint, text string, lang string, `row` string, lang_pred string, score double")
    found = [tuple(r) for r in language.languages(docs).collect()]
    assert len(found) == len(rows)
    said = {(i, lang) for i, _, lang, _ in found}
    assert {(900, "und"), (901, "und"), (902, "und"), (903, "xx"), (None, "yy"), (904, ""), (5, "xx"), (5, "yy")} <= said
    for i, held, lang, score in found:
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= score <= 1 and (score == 0) == (lang == "und")
        if i is not None and i < 300 and i != 5:
            assert lang == list(kinds)[i // 100]


def test_profiles_equal_plain_ones(spark):
    rows = [(i, words("abcdefgh"[i % 2 * 3 :][:5], 20, i), "xy"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    got = language.learn(docs, rows=1000, size=128)
    assert got.names == ["x", "y"]
    for k, lang in enumerate("xy"):
        total = np.zeros(128)
        for i, text, other in rows:
            if other == lang and zlib.crc32(str(i).encode()) % 4 != 2:
                b = plain_bundle(text, 128)
                total += b / np.linalg.norm(b)
        assert np.allclose(got.vectors[k], total / np.linalg.norm(total))
    assert language.learn(docs, rows=3, size=16).names == ["x", "y"]


def test_languages_without_any(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [tuple(r)[2:] for r in language.languages(docs).collect()] == [("und", 0.0)]
    assert language.languages(docs.limit(0)).count() == 0


# --------------------------------------------------------------------------------- the repair


def cheapest(rows):
    """Uniform-cost search: (cost, edits, repaired rows); equal costs by the edits' letters."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, edits, out
        after = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[after]
        heapq.heappush(heap, (cost + 3, edits + "I", i, after, (*out, (name, ""))))
        if i == len(rows):
            continue
        role, text, forced, cut = rows[i]
        heapq.heappush(heap, (cost + 4, edits + "D", i + 1, last, out))
        if not forced:
            if role[:1] == after or (role[:1] == "s" and last == ""):
                heapq.heappush(heap, (cost + 3 * cut, edits + "K", i + 1, role[:1], (*out, (role, text))))
            heapq.heappush(heap, (cost + 3 + 3 * cut, edits + "R", i + 1, after, (*out, (name, text))))


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        if k:
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def repair_model(ids, rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        by[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    out, mended = [], []
    for c in ids | set(by):
        seen, faults, shown = set(), [], []
        for _, _, r, _, x in sorted(by[c]):
            bare = x.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((r, x))
            faults.append(fault)
            shown.append((r, x, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for known, t, *_ in by[c] if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(shown, shown[1:]))
        cost, edits, rows_out = cheapest(shown)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in rows_out).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest))
        mended += [(c, k, r, x) for k, (r, x) in enumerate(rows_out)]
    return sorted(out, key=lambda r: first_null(r[0])), sorted(mended, key=lambda r: (first_null(r[0]), r[1]))


def random_talk(seed, conversations, lengths):
    r, rows = random.Random(seed), []
    for c in [None, *range(conversations)]:
        for t in range(r.choice(lengths)):
            rows.append((
                c, r.choice([None, t, t, t, t * 3, 1]),
                r.choice(["user", "assistant", "system", "s", "ultra", "tool", "User", "", None]),
                r.choice(["a.", "b!", "c", "", " \t", "same.", "d?  \n", None, "é", "f" + "." * 9, "x\n.\x0b"]),
            ))
    return rows


def check_repair(spark, rows, ids=()):
    df = clashing(spark, rows)
    more = spark.createDataFrame([(i,) for i in ids], "conv_id bigint") if ids else None
    audits, repaired = talk.repair(df, more)
    want, mended = repair_model(set(ids), rows)
    got = talk.repaired_digests(df, audits)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: first_null(r[0])) == want
    assert sorted((tuple(r) for r in repaired.collect()), key=lambda r: (first_null(r[0]), r[1])) == mended


def test_searches_against_uniform_cost(spark):
    r = random.Random(6)
    for _ in range(400):
        rows, codes = [], ""
        for k in range(r.randint(0, 14)):
            fault, initial = r.choice([0, 0, 0, 1, 2, 3]), r.randrange(4)
            rows.append(("suax"[initial], f"t{k}", fault >= 2, fault == 1))
            codes += f"{4 * fault + initial:x}"
        cost, edits, _ = cheapest(rows)
        assert talk.cheapest(codes, talk.NOTHING, talk.END) == (cost, edits)
        for size in (1, 3, 5):
            cut = [codes[i : i + size] for i in range(0, len(codes), size)] or [""]
            paths = [talk.block_paths(c, k == 0, k == len(cut) - 1) for k, c in enumerate(cut)]
            assert talk.chained(paths) == (cost, edits)
    assert talk.cheapest("2", talk.USER, talk.NOTHING) is None
    assert talk.cheapest("1", talk.NOTHING, talk.SYSTEM) is None


def test_repair(spark):
    check_repair(spark, random_talk(1, 60, [1, 2, 3, 5, 9, 23, 24, 25, 49, 80]), ids=[3, 777])


def test_repair_of_damaged_rows(spark):
    rows = random_talk(2, 60, [1, 4, 8])
    df = talk.damage(clashing(spark, rows))
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, damaged(rows)))
    check_repair(spark, damaged(rows), ids=sorted({c for c, *_ in rows if c is not None}))


def test_repair_of_long_and_empty(spark):
    check_repair(spark, [(1, 0, "user", "y" * 300_000), (1, 1, "assistant", "z" * 300_000 + "."), (2, 5, "system", "Only.")])
    empty = clashing(spark, [])
    audits, repaired = talk.repair(empty)
    assert audits.count() == repaired.count() == talk.repaired_digests(empty, audits).count() == talk.damage(empty).count() == 0


# ----------------------------------------------------------------------------------- the trie


def trie_model(paths):
    """Rows of the trie of {conv_id: [(role, text)]}."""
    members, kids = defaultdict(list), defaultdict(list)
    for c, s in paths.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    out, leaves, saved = [], {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
        ends = ",".join(str(c) for c in sorted(members[n]) if len(paths[c]) == len(n))
        parent = min(members[n[:-1]]) if n else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[n]), len(n), parent, len(members[n]), len(kids[n]), leaves[n], saved[n], digest))
    return sorted(out)


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said = f"{len(r or '')}:{r or ''}{x or ''}"
            own[c].append((t is not None, t or 0, hashlib.md5(said.encode()).hexdigest(), r or "", x or ""))
    turns = {c: [r[3:] for r in sorted(s)] for c, s in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return {c: turns.get(c - c % 5, [])[: h[c]] + s[h[c] :] for c, s in turns.items()}


def check_trie(spark, rows, height):
    ids, steps = trie.rebuild(trie.numbered_turns(clashing(spark, rows)))
    got = trie.prefix_trie(ids, steps, height)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == trie_model(rebuilt(rows))


def test_trie(spark):
    r, rows = random.Random(11), []
    for c in [0, 1, 2, 3, 4, 6, 7, 9, 10, 12, 14, 23, 24, 1001, *range(40, 60)]:
        for t in range(r.choice([1, 2, 3, 8, 9, 12])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["same", "other é", None, ""])))
    rows += [(None, 1, "user", "no conversation")] * 3 + [(3, 0, "user", "again")] * 2
    check_trie(spark, rows, 16)
    check_trie(spark, rows, 2)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CELL", 16)
    r = random.Random(12)
    rows = [(c, t, "user", "é" * (t % 7)) for c in (0, 5, 10, 11) for t in range(70)]
    rows += [(c, t, "user", "é" * (t % 7) if t < 50 else r.choice("ab")) for c in range(12, 30) for t in range(65)]
    rows += [(31, 0, "user", "x" * 200_000), (36, 0, "user", "x" * 200_000)]
    check_trie(spark, rows, 4)


def test_trie_without_conversations(spark):
    assert trie.prefix_trie(*trie.rebuild(trie.numbered_turns(clashing(spark, [])))).count() == 0
    check_trie(spark, [(7, None, None, None)], 16)


def test_pieces_and_digests(spark):
    rows = [(k, i, str(i)) for k in (None, 1, 2) for i in range(500 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "k int, i int, s string").repartition(4)
    got = {r["k"]: r["h"] for r in inorder.digests(written(inorder.pieces(df, ["k"], ["i"], "s", ","), "pieces"), ["k"], ",", "h").collect()}
    for k in (None, 1, 2):
        assert got[k] == hashlib.sha256(",".join(s for q, _, s in rows if q == k).encode()).hexdigest()
