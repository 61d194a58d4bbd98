"""Named queries of the operators over the given tables, with checking SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchsift.llm import (
    conversations,
    decontaminate,
    language,
    licenses,
    minhash,
    pieces,
    quality,
    secrets,
    shards,
    toxicity,
    trie,
    urls,
    vectors,
)
from launchsift.llm.common import sorted_digest, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# --------------------------------------------------------------------------------- toxicity


@query("op1_toxicity")
def op1(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


# -------------------------------------------------------------------------- decontamination

OP2_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrase AS (
  SELECT item_id, list_slice(w, i + 1, i + 10) AS p
  FROM item, unnest(range(greatest(len(w) - 10, 0) + 1)) AS t(i) WHERE len(w) > 0),
named AS (SELECT DISTINCT item_id, array_to_string(p, ' ') AS p, len(p) AS n FROM phrase),
place AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS p
  FROM doc, (SELECT DISTINCT n FROM named), unnest(range(len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, named.n, item_id FROM place JOIN named USING (p, n)),
word AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(n)) AS t(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_decontaminate", OP2_SQL)
def op2(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.digest(found)


# ------------------------------------------------------------------------------ near vectors

OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y
  ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN link ON r = a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id) USING (vec_id)
"""


@query("op3_projection_passes", OP3_SQL)
def op3(spark, folder):
    return vectors.near_vectors(table(spark, folder, "embeddings"), 0.9)


# ------------------------------------------------------------------------------ near copies

OP4_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 4), ' ') AS s
  FROM doc, unnest(range(greatest(len(w) - 4, 0) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y USING (s)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT reach.doc_id, b FROM reach JOIN link ON r = a)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc.doc_id = c AS kept
FROM doc LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""


@query("op4_minhash", OP4_SQL)
def op4(spark, folder):
    found = minhash.near_duplicates(table(spark, folder, "documents"), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


# -------------------------------------------------------------------------------------- urls


@query("op5_url_model")
def op5(spark, folder):
    return urls.judge_urls(table(spark, folder, "pages"))


# ------------------------------------------------------------------------- quality, licenses


@query("op6_quality")
def op6(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_licenses")
def op7(spark, folder):
    found = licenses.scan_licenses(table(spark, folder, "documents"))

    def joined(label_lists):
        return F.array_join(F.array_sort(F.array_distinct(label_lists)), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.col("spans.label")).alias("labels"),
        "score",
    )


# --------------------------------------------------------------------------------- sharding


@query("op8_rendezvous_shards")
def op8(spark, folder):
    return shards.shard_documents(table(spark, folder, "documents"), [1.0] * 8)


# ----------------------------------------------------------------------------- secret scans


def _secret_sql() -> str:
    parts = []
    for at, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {at} AS rule, '{r.kind}' AS kind, {r.base} AS base, unnest(generate_series(1, len(whole))) AS i,
    list_transform(gaps, lambda x: length(x)) AS gap, list_transform(whole, lambda x: length(x)) AS n,
    length(part[i]) AS part, {r.least} AS least
  FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps,
    regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {r.group}) AS part
    FROM text)""")
    return f"""
WITH text AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
span AS (
  SELECT doc_id, rule, kind, base, list_sum(gap[1:i]) + coalesce(list_sum(n[1:i-1]), 0) AS s,
    list_sum(gap[1:i]) + list_sum(n[1:i]) AS e FROM found WHERE part >= least),
shown AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM span),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, rule) FILTER (base) AS base,
    string_agg(span, ',' ORDER BY s, rule) AS spans FROM shown GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM text LEFT JOIN per USING (doc_id)
"""


@query("op10_secrets", _secret_sql())
def op10(spark, folder):
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        sorted_digest(F.col("base_spans")).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


# ------------------------------------------------------------------------------- tokenizing


@query("op9_pieces")
def op9(spark, folder):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


# -------------------------------------------------------------------------------- languages


@query("op11_language")
def op11(spark, folder):
    return language.languages(table(spark, folder, "documents"))


# ----------------------------------------------------------------------------- conversations


def _crc(bytes_list: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    return f"""xor(list_reduce(list_concat([4294967295], {bytes_list}),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
    lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""


def _ascii(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"


def _step(*ways: str) -> str:
    """The least of (cost, edits) after appending edits, as 'state+cost+letter'."""
    parts = [w.split("+") for w in ways]
    return f"least({', '.join(f"{{'c': x.{s}.c + {c}, 'e': x.{s}.e || '{e}'}}" for s, c, e in parts)})"


_NO_WAY = "{'c': 1000000000000, 'e': ''}"
# State of the search: n nothing yet, s after system, u after user, a after assistant.  Inserts
# come first, then the row's own edit; f is its fault, r its role's initial.
_INSERTED = f"""{{'n': x.n, 's': x.s, 'f': '', 'r': '',
  'u': {_step("u+0+", "n+3+I", "s+3+I", "a+3+I")}, 'a': {_step("a+0+", "u+3+I", "n+6+II", "s+6+II")}}}"""


def _either(*states: str) -> str:
    """Ways to a user's or assistant's row: rerole from each state, keep where the initial fits."""
    to = states[0]
    ways = [f"CASE WHEN f.f < 2 THEN {{'c': x.{q}.c + 3 + 3 * f.f, 'e': x.{q}.e || 'R'}} ELSE {_NO_WAY} END" for q in states[1:]]
    ways += [
        f"CASE WHEN f.f < 2 AND f.r = '{to}' THEN {{'c': x.{q}.c + 3 * f.f, 'e': x.{q}.e || 'K'}} ELSE {_NO_WAY} END" for q in states[1:]
    ]
    return f"least({{'c': x.{to}.c + 4, 'e': x.{to}.e || 'D'}}, {', '.join(ways)})"


OP12_SQL = f"""
WITH harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc(_ascii("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"))} % 20 AS k
  FROM conversations),
fresh AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harmed, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS i,
  rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM fresh),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f,
    left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r_before FROM placed),
talk AS (
  SELECT conv_id, list({{'f': f, 'r': r}} ORDER BY i) AS rows, max(i) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 2) AS blank, count(*) FILTER (f = 3) AS duplicate, count(*) FILTER (f = 1) AS truncated,
    count(*) FILTER (i > 1 AND r_before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
searched AS (
  SELECT *, list_reduce(list_concat(
      [{{'n': {{'c': 0, 'e': ''}}, 's': {_NO_WAY}, 'u': {_NO_WAY}, 'a': {_NO_WAY}, 'f': 0, 'r': ''}}],
      list_transform(rows, lambda y: {{'n': {_NO_WAY}, 's': {_NO_WAY}, 'u': {_NO_WAY}, 'a': {_NO_WAY}, 'f': y.f, 'r': y.r}})),
    lambda w, f: list_transform([{_INSERTED.replace("x.", "w.").replace("'f': '', 'r': ''", "'f': 0, 'r': ''")}], lambda x: {{
      'n': {{'c': x.n.c + 4, 'e': x.n.e || 'D'}},
      's': least({{'c': x.s.c + 4, 'e': x.s.e || 'D'}}, CASE WHEN f.f < 2 AND f.r = 's' THEN {{'c': x.n.c + 3 * f.f, 'e': x.n.e || 'K'}} ELSE {_NO_WAY} END),
      'u': {_either("u", "n", "s", "a")}, 'a': {_either("a", "u")}, 'f': 0, 'r': ''}})[1]) AS x
  FROM talk),
best AS (SELECT *, least(x.n, {_step("a+0+", "u+3+I", "n+6+II", "s+6+II")}) AS found FROM searched),
letter AS (
  SELECT conv_id, p, found.e[p] AS e, len(replace(found.e, 'D', '')) % 2 AS odd FROM best, unnest(range(1, len(found.e) + 1)) AS t(p)),
counted AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM letter
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
mended AS (
  SELECT c.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
  FROM counted c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.i = c.i WHERE e <> 'D' GROUP BY c.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(found.c, 0) AS cost,
  coalesce(found.e, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN mended ON mended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@query("op12_conversation_repair", OP12_SQL)
def op12(spark, folder):
    original = table(spark, folder, "conversations")
    rows = conversations.damage(original)
    audited = written(conversations.audits(rows, original), "conversation-audits")
    return conversations.repaired_digests(rows, audited)


OP13_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
led AS (SELECT c, w, c - c % 5 AS base, CAST({_crc(_ascii('CAST(c AS VARCHAR)'))} % 9 AS BIGINT) AS h FROM own),
seq AS (
  SELECT led.c, list_concat(coalesce(list_slice(own.w, 1, h), []), list_slice(led.w, h + 1, len(led.w))) AS s
  FROM led LEFT JOIN own ON own.c = led.base),
step AS (
  SELECT c, d, sha256(CAST(to_json(list_slice(s, 1, d)) AS VARCHAR)) AS k, d = len(s) AS final,
    CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].t) END AS b
  FROM seq, unnest(range(len(s) + 1)) AS u(d)),
node AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n, min(b) AS b,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (final), '')) AS ends
  FROM step GROUP BY d, k),
path AS (SELECT c, d, conv_id FROM step JOIN node USING (d, k)),
linked AS (SELECT node.*, path.conv_id AS parent FROM node LEFT JOIN path ON path.c = node.conv_id AND path.d = node.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (conv_id, d)),
total AS (
  SELECT path.conv_id, path.d, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n - 1) * y.b) AS saved
  FROM full_node y JOIN path ON path.c = y.conv_id AND path.d <= y.d GROUP BY ALL)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM full_node JOIN total USING (conv_id, d)
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark, folder):
    return trie.prefix_trie(*trie.rebuild(trie.numbered_turns(table(spark, folder, "conversations"))))
