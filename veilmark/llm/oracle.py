"""The registered queries that SQL can express, for DuckDB."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = (
        "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], "
        "lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    )
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"


EXACT_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(content) AS text_sha256
FROM texts
WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id)
"""


def _way(state: str, edit: str, more: str = "0") -> str:
    return f"{{'c': {state}.c + {more}, 'a': {state}.a || '{edit}'}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _if(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} ELSE {{'c': 1000000::BIGINT, 'a': ''}} END"


def _user_from(*states: str) -> list[str]:
    """Ways to a user's turn: a user's kept, or any other turn given that role."""
    return [
        way
        for s in states
        for way in (
            _if("NOT m.doomed AND m.initial = 'u'", _way(f"w.{s}", "K", "m.cut")),
            _if("NOT m.doomed", _way(f"w.{s}", "R", "m.cut + 1")),
        )
    ]


# One row a conversation and turn: the best (cost, edits) of each role state, walked in order.
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
hashed AS (SELECT *, {_crc32('name')} % 20 AS fault FROM given),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER o AS i, row_number() OVER (PARTITION BY conv_id, role, text
           ORDER BY turn NULLS FIRST, copy) AS seen,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, left(role, 1) AS initial
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
marks AS (
  SELECT *, body = '' AS blank, body <> '' AND seen > 1 AS again,
         body = '' OR seen > 1 AS doomed,
         CASE WHEN body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS again,
         count(*) FILTER (cut > 0) AS cut,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marks GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000::BIGINT, 'a': ''}} AS s1,
         {{'c': 5::BIGINT, 'a': 'I'}} AS s2, {{'c': 10::BIGINT, 'a': 'II'}} AS s3
  FROM counts
  UNION ALL
  SELECT conv_id, i, s0, s1, u2, {_least('s3', _way('u2', 'I', '5'))}
  FROM (
    SELECT conv_id, i, s0, s1, s3,
           {_least('s2', _way('s0', 'I', '5'), _way('s1', 'I', '5'), _way('s3', 'I', '5'))} AS u2
    FROM (
      SELECT m.conv_id, m.i, {_way('w.s0', 'D', '2')} AS s0,
             {_least(_way('w.s1', 'D', '2'), _if("NOT m.doomed AND m.initial = 's'", _way('w.s0', 'K', 'm.cut')))} AS s1,
             {_least(_way('w.s2', 'D', '2'), *_user_from('s0', 's1', 's3'))} AS s2,
             {_least(_way('w.s3', 'D', '2'), _if("NOT m.doomed AND m.initial = 'a'", _way('w.s2', 'K', 'm.cut')),
                     _if("NOT m.doomed", _way('w.s2', 'R', 'm.cut + 1')))} AS s3
      FROM walk w JOIN marks m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1))),
final AS (
  SELECT c.*, {_least('w.s0', 'w.s3')} AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i),
letters AS (
  SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS p, best.a AS audit FROM final),
edits AS (
  SELECT conv_id, p, substring(audit, p, 1) AS e,
         sum((substring(audit, p, 1) <> 'I')::INTEGER) OVER o AS i,
         sum((substring(audit, p, 1) <> 'D')::INTEGER) OVER o AS k
  FROM letters WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
turned AS (
  SELECT e.conv_id, e.p, e.e, e.k, m.role, m.text,
         max((e.k = 1 AND e.e = 'K' AND m.initial = 's')::INTEGER) OVER (PARTITION BY e.conv_id) AS shift
  FROM edits e LEFT JOIN marks m
    ON e.e <> 'I' AND m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i
  WHERE e.e <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(
           CASE WHEN e = 'K' THEN role WHEN (k - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text
  FROM turned GROUP BY conv_id)
SELECT a.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
       coalesce(f.again, 0)::BIGINT AS duplicate, coalesce(f.cut, 0)::BIGINT AS truncated,
       coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(f.best.c, 0)::BIGINT AS cost,
       coalesce(f.best.a, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""

# Subtree sums by the smallest member's path: it holds all nodes above a node.
PREFIX_TRIE = rf"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT DISTINCT c, c::VARCHAR AS name FROM own),
conv AS (SELECT c, c - c % 20 AS first, {_crc32('name')} % 4 AS h FROM named),
sequence AS (
  SELECT conv.c, 0 AS part, k, r, t FROM conv JOIN own ON own.c = conv.first AND own.k <= conv.h
  UNION ALL SELECT conv.c, 1, k, r, t FROM conv JOIN own ON own.c = conv.c AND own.k > conv.h),
turned AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, r, t FROM sequence),
paths AS (
  SELECT c, 0::BIGINT AS d, []::VARCHAR[] AS key, 0::BIGINT AS words FROM conv
  UNION ALL
  SELECT c, d, list(length(r) || ':' || r || t) OVER (PARTITION BY c ORDER BY d),
         len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT FROM turned),
whole AS (SELECT c, max(d) AS total FROM paths GROUP BY c),
node AS (
  SELECT key, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(words) AS words,
         string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = total) AS ends
  FROM paths JOIN whole USING (c) GROUP BY key),
kid AS (SELECT p.key, count(*) AS n FROM node w JOIN paths p ON p.c = w.c AND p.d = w.d - 1 GROUP BY p.key),
grown AS (SELECT w.*, coalesce(kid.n, 0) AS kids FROM node w LEFT JOIN kid USING (key)),
below AS (
  SELECT p.key, count(*) FILTER (w.kids = 0) AS leaves, sum((w.n - 1) * w.words) AS saved
  FROM grown w JOIN paths p ON p.c = w.c AND p.d <= w.d GROUP BY p.key),
above AS (
  SELECT w.key, up.c FROM node w JOIN paths p ON p.c = w.c AND p.d = w.d - 1 JOIN node up ON up.key = p.key)
SELECT g.c AS conv_id, g.d AS depth, a.c AS parent_conv_id, g.n AS n_convs,
       g.kids::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens,
       sha256(coalesce(g.ends, '')) AS ends_sha256
FROM grown g JOIN below b USING (key) LEFT JOIN above a USING (key)
"""


# All pairs of a label, and every vector that links lead to.
EMBEDDING_DEDUP = """
WITH RECURSIVE vector AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
fit AS (
  SELECT * FROM vector
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id, vec_id AS other FROM vector
  UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
part AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT p.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, p.component_id, p.vec_id = p.component_id AS kept
FROM part p LEFT JOIN degree d ON d.a = p.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": EMBEDDING_DEDUP,
        "op3_exact_dedup": EXACT_DEDUP,
        "op11_conversation_repair": CONVERSATION_REPAIR,
        "op13_prefix_trie": PREFIX_TRIE,
    }
