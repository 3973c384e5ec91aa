"""The registered queries again, as SQL for DuckDB.

Written independently of the Spark code: rules run in DuckDB's own regex engine
with the fixed patterns as they are, and overlaps are resolved by a recursive
query that walks the candidates of a text in order.
"""

from __future__ import annotations

from veilmark.functions.fixed import (
    INSPECT_INFO_TYPES,
    LIKELIHOOD_SCORES,
    RULE_PATTERNS,
    TOKEN_PATTERN,
)
from veilmark.plans.queries import INFO_TYPES, NOW, SALT, TERMS

ALL = list(RULE_PATTERNS)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _token(entity: str, value: str) -> str:
    return (
        f"('[[CMPL_' || {entity} || '_' || "
        f"left(sha256({_quote(SALT)} || chr(0) || {value}), 16) || ']]')"
    )


def _matches(table: str, key: str, text: str, rules: dict[str, str], score: float) -> str:
    """CTE chain ending in spans(key, ord, entity_type, s, e, score, value)."""
    hits = " UNION ALL ".join(
        f"SELECT {key} AS key, {i} AS ord, {_quote(rule)} AS entity_type, "
        f"regexp_extract_all({text}, {_quote(p)}) AS m, "
        f"string_split_regex({text}, {_quote(p)}) AS g "
        f"FROM {table} WHERE regexp_matches({text}, {_quote(p)})"
        for i, (rule, p) in enumerate(rules.items())
    )
    return f"""
      hits AS ({hits}),
      each_hit AS (
        SELECT key, ord, entity_type, m, g, unnest(range(1, len(m) + 1)) AS k FROM hits),
      placed AS (
        SELECT key, ord, entity_type, m[k] AS value,
               (list_sum(list_transform(g[1:k], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0)
               )::INTEGER AS s
        FROM each_hit),
      spans AS (
        SELECT key, ord, entity_type, s, (s + length(value))::INTEGER AS e,
               {score}::DOUBLE AS score, value FROM placed)"""


def _rules(names: list[str] = ALL) -> dict[str, str]:
    return {n: RULE_PATTERNS[n] for n in names}


def _documents_spans(names: list[str] = ALL) -> str:
    return _matches("documents", "doc_id", "text", _rules(names), 1.0)


def _choose(source: str = "spans") -> str:
    """CTEs ending in chosen(key, entity_type, s, e, score): greedy and disjoint."""
    return f"""
      cand AS (
        SELECT key, entity_type, s, e, score,
               row_number() OVER (PARTITION BY key ORDER BY s, e DESC, score DESC, ord) AS rn
        FROM {source}),
      walk AS (
        SELECT key, entity_type, s, e, score, rn, TRUE AS kept, e AS reached
        FROM cand WHERE rn = 1
        UNION ALL
        SELECT c.key, c.entity_type, c.s, c.e, c.score, c.rn, c.s >= w.reached,
               CASE WHEN c.s >= w.reached THEN c.e ELSE w.reached END
        FROM walk w JOIN cand c ON c.key = w.key AND c.rn = w.rn + 1),
      chosen AS (SELECT key, entity_type, s, e, score FROM walk WHERE kept)"""


def _splice(table: str, key: str, text: str, token: str = "token") -> str:
    """CTEs ending in redacted(key, text) with all rows of ``table``; also
    cut(key, entity_type, s, e, value, token)."""
    return f"""
      cut AS (
        SELECT c.key, c.entity_type, c.s, c.e,
               substring(t.{text}, c.s + 1, c.e - c.s) AS value,
               {_token('c.entity_type', f'substring(t.{text}, c.s + 1, c.e - c.s)')} AS token,
               coalesce(lag(c.e) OVER (PARTITION BY c.key ORDER BY c.s), 0) AS before
        FROM chosen c JOIN {table} t ON t.{key} = c.key),
      spliced AS (
        SELECT c.key,
               string_agg(substring(t.{text}, c.before + 1, c.s - c.before) || {token},
                          '' ORDER BY c.s)
               || substring(any_value(t.{text}), max(c.e) + 1) AS text
        FROM cut c JOIN {table} t ON t.{key} = c.key GROUP BY c.key),
      redacted AS (
        SELECT t.{key} AS key, coalesce(s.text, t.{text}) AS text,
               CASE WHEN s.key IS NULL THEN 'unchanged' ELSE 'redacted' END AS status
        FROM {table} t LEFT JOIN spliced s ON s.key = t.{key})"""


_REDACTED_DOCUMENTS = (
    f"WITH RECURSIVE {_documents_spans()}, {_choose()}, "
    f"{_splice('documents', 'doc_id', 'text')}"
)


def _findings(key: str, source: str = "spans") -> str:
    return (
        f'SELECT key AS {key}, entity_type, s AS "start", e AS "end", score FROM {source}'
    )


def _detect(names: list[str] = ALL) -> str:
    return f"WITH {_documents_spans(names)} {_findings('doc_id')}"


def _crowded(tail: str) -> str:
    return f"""WITH RECURSIVE {_documents_spans()},
      crowd AS (
        SELECT key, ord * 3 AS ord, entity_type, s, e, score FROM spans
        UNION ALL SELECT key, ord * 3 + 1, 'EARLY', s - 2, e - 3, 0.7 FROM spans
        UNION ALL SELECT key, ord * 3 + 2, 'WEAK', s, e, 0.4 FROM spans),
      {tail}"""


def _select_spans() -> str:
    valid = """valid AS (SELECT c.* FROM crowd c JOIN documents d ON d.doc_id = c.key
                 WHERE c.s >= 0 AND c.s < c.e AND c.e <= length(d.text)), """
    return _crowded(valid + _choose("valid")) + _findings("doc_id", "chosen")


def _dictionary() -> str:
    """Terms do not overlap themselves, so plain splitting finds every place."""
    literal = {t: t for t in TERMS}
    body = _matches("documents", "doc_id", "text", literal, 0.9)
    names = " ".join(f"WHEN {_quote(t)} THEN {_quote(e)}" for t, e in TERMS.items())
    return f"""{body},
      named AS (
        SELECT key, ord, CASE entity_type {names} END AS entity_type, s, e, score, value
        FROM spans)"""


def _pages_column(column: str, suffix: str) -> str:
    chain = ", ".join(
        [
            _matches("pages", "page_id", column, _rules(), 1.0).strip(),
            _choose().strip(),
            _splice("pages", "page_id", column).strip(),
        ]
    )
    return f"SELECT key AS page_id, text AS {suffix} FROM (WITH RECURSIVE {chain} SELECT key, text FROM redacted)"


def _case(column: str, table: dict, default: str) -> str:
    whens = " ".join(
        f"WHEN {_quote(k)} THEN {v if isinstance(v, float) else _quote(v)}"
        for k, v in table.items()
    )
    return f"CASE {column} {whens} ELSE {default} END"


_TIMED_VAULT = f"""{_REDACTED_DOCUMENTS},
      timed AS (
        SELECT token, value, entity_type,
               TIMESTAMP '2026-01-01 00:00:00' + to_hours((key % 48)::INTEGER) AS written,
               TIMESTAMP '2026-01-02 00:00:00' + to_hours((key % 48)::INTEGER) AS expires
        FROM cut)"""
_SHOWN = """token, value, entity_type,
      strftime(written, '%Y-%m-%d %H:%M:%S') AS written_at,
      strftime(expires, '%Y-%m-%d %H:%M:%S') AS expires_at"""


def _live(now: str) -> str:
    return f"""{_TIMED_VAULT},
      newest AS (
        SELECT *, row_number() OVER (PARTITION BY token ORDER BY written DESC) AS n
        FROM timed)
      SELECT {_SHOWN} FROM newest
      WHERE n = 1 AND expires >= TIMESTAMP '{now}'"""


_ORDER_TOKENS = f"""
      tokens AS (
        SELECT o_orderkey, o_custkey,
               {_token("'PERSON'", "('Customer#' || lpad(o_custkey::VARCHAR, 9, '0'))")} AS token
        FROM orders),
      live AS (SELECT c_name, c_custkey FROM customer WHERE c_custkey % 3 <> 0)"""

_INSPECT = f"""WITH {_documents_spans()},
      found AS (
        SELECT key, {_case('entity_type', {k: INSPECT_NAME for k, INSPECT_NAME in
                           ((k, {v: c for c, v in INSPECT_INFO_TYPES.items()}.get(v, v))
                            for k, v in INFO_TYPES.items())}, 'NULL')} AS entity_type, s, e,
               [0.9, 0.7, 0.5, 0.3, 0.1, 0.5][s % 6 + 1]::DOUBLE AS score
        FROM spans)"""


def _policy(failed_text: str, failed_status: str) -> str:
    return f"""{_REDACTED_DOCUMENTS}
      SELECT key AS doc_id,
             CASE WHEN key % 7 = 0 THEN {failed_text} ELSE r.text END AS text,
             CASE WHEN key % 7 = 0 THEN '{failed_status}' ELSE status END AS status
      FROM redacted r JOIN documents d ON d.doc_id = r.key"""


_WHOLE_STREAMS = """
      SELECT doc_id AS stream_id, 0::BIGINT AS block, {text} AS text
      FROM {source} WHERE length({text}) > 0"""


_SESSION_VERSION = "least((c.key - c.key % 50) // 200, 2)"
_SESSION_TOKEN = (
    "('[[CMPL_' || c.entity_type || '_' || left(sha256('s' || (c.key % 50) || 'v' || "
    f"{_SESSION_VERSION} || chr(0) || c.value), 16) || ']]')"
)
_SESSIONS = (
    f"WITH RECURSIVE {_documents_spans()}, {_choose()}, "
    f"{_splice('documents', 'doc_id', 'text', _SESSION_TOKEN)}"
)

_POLICY = f"""WITH RECURSIVE {_documents_spans()}, {_choose()},
      rule AS (
        SELECT 'src' || n_nationkey AS ns, ['', '/v1', '/v1/en', '/v1/de/1'][n_nationkey % 4 + 1] AS route,
               ['*', 'EMAIL_ADDRESS', 'CREDIT_CARD'][n_nationkey % 3 + 1] AS entity,
               ['audit', 'tokenize', 'mask', 'block', 'mask'][n_nationkey % 5 + 1] AS action
        FROM nation
        UNION ALL SELECT '*', ['', '/v1/en', '/v1/en/1', '/v1/fr', '/v1/en'][r_regionkey % 5 + 1],
               ['*', 'EMAIL_ADDRESS', '*', 'PHONE_NUMBER', 'EMAIL_ADDRESS'][r_regionkey % 5 + 1],
               ['audit', 'mask', 'block', 'tokenize', 'tokenize'][r_regionkey % 5 + 1]
        FROM region),
      place AS (SELECT DISTINCT source, '/v1/' || lang || '/' || (doc_id % 4) AS route FROM documents),
      best AS (
        SELECT p.source, p.route, r.entity, r.action,
               row_number() OVER (
                 PARTITION BY p.source, p.route, r.entity
                 ORDER BY r.ns <> '*' DESC, length(r.route) DESC,
                          list_position(['audit', 'tokenize', 'mask', 'block'], r.action) DESC) AS n
        FROM place p JOIN rule r
          ON r.ns IN (p.source, '*')
         AND (r.route = '' OR p.route = r.route OR starts_with(p.route, r.route || '/'))),
      acted AS (
        SELECT c.key, c.entity_type, c.s, c.e,
               coalesce(own.action, other.action, 'tokenize') AS action,
               substring(d.text, c.s + 1, c.e - c.s) AS value,
               coalesce(lag(c.e) OVER (PARTITION BY c.key ORDER BY c.s), 0) AS before
        FROM chosen c JOIN documents d ON d.doc_id = c.key
        LEFT JOIN best own ON own.n = 1 AND own.source = d.source
              AND own.route = '/v1/' || d.lang || '/' || (d.doc_id % 4) AND own.entity = c.entity_type
        LEFT JOIN best other ON other.n = 1 AND other.source = d.source
              AND other.route = '/v1/' || d.lang || '/' || (d.doc_id % 4) AND other.entity = '*'),
      done AS (
        SELECT a.key, bool_or(action = 'block') AS blocked,
               bool_or(action IN ('tokenize', 'mask')) AS touched,
               count(*) FILTER (action = 'tokenize') AS tokens,
               string_agg(concat_ws(':', entity_type, action, s, e), ',' ORDER BY s) AS audit,
               string_agg(substring(d.text, a.before + 1, a.s - a.before) || CASE action
                   WHEN 'tokenize' THEN {_token('a.entity_type', 'a.value')}
                   WHEN 'mask' THEN '<' || a.entity_type || '>' ELSE a.value END, '' ORDER BY s)
                 || substring(any_value(d.text), max(a.e) + 1) AS text
        FROM acted a JOIN documents d ON d.doc_id = a.key GROUP BY a.key)
      SELECT doc_id, CASE WHEN x.key IS NULL THEN d.text WHEN NOT x.blocked THEN x.text END AS text,
             CASE WHEN x.key IS NULL THEN 'unchanged' WHEN x.blocked THEN 'blocked'
                  WHEN x.touched THEN 'redacted' ELSE 'audited' END AS status,
             CASE WHEN x.key IS NULL OR x.blocked THEN 0 ELSE x.tokens END::INTEGER AS mappings,
             coalesce(x.audit, '') AS audit
      FROM documents d LEFT JOIN done x ON x.key = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    shout = "[A-Z]{3,}"
    ssn_text = """(SELECT c_custkey,
        'no ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-'
        || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-'
        || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
        || CASE c_custkey % 3 WHEN 0 THEN '5 end' WHEN 1 THEN 'é end' ELSE ' end' END
        AS text FROM customer)"""
    page_text = "(SELECT page_id, url || ' ' || html AS text FROM pages)"
    documents = "SELECT doc_id, text FROM documents"
    return {
        "detect_regex_documents": _detect(),
        "detect_email": _detect(["EMAIL_ADDRESS"]),
        "detect_credit_card": _detect(["CREDIT_CARD"]),
        "detect_phone": _detect(["PHONE_NUMBER"]),
        "detect_ip": _detect(["IP_ADDRESS"]),
        "detect_allowlist": _detect(["EMAIL_ADDRESS", "IP_ADDRESS"]),
        "detect_ssn_customers": f"""WITH {_matches(ssn_text, 'c_custkey', 'text',
            _rules(['US_SSN']), 1.0)} {_findings('c_custkey')}""",
        "detect_url_pages": f"""WITH {_matches(page_text, 'page_id', 'text',
            _rules(['URL']), 1.0)} {_findings('page_id')}""",
        "detect_dictionary": f"WITH {_dictionary()} {_findings('doc_id', 'named')}",
        "detect_with_custom": f"""WITH {_matches('pages', 'page_id', 'html',
            {'SHOUT': shout}, 0.75)} {_findings('page_id')}""",
        "ingest_analyzer": f"""WITH {_documents_spans()}
            {_findings('doc_id')} WHERE key % 7 <> 0""",
        "ingest_inspect": f"{_INSPECT} {_findings('doc_id', 'found')} WHERE score >= 0.5",
        "ingest_inspect_allowlist": f"""{_INSPECT} {_findings('doc_id', 'found')}
            WHERE entity_type IN ('CREDIT_CARD', 'CRYPTO')""",
        "canonical_entity": """SELECT p_partkey,
            CASE p_size % 3 WHEN 0 THEN 'US_SSN' WHEN 1 THEN 'PERSON' ELSE p_type END
            AS entity_type FROM part""",
        "likelihood_score": f"""SELECT p_partkey, {_case(
            "['VERY_LIKELY', 'LIKELY', 'POSSIBLE', 'UNLIKELY', 'VERY_UNLIKELY'][p_size % 7 + 1]",
            LIKELIHOOD_SCORES, '0.5')}::DOUBLE AS score FROM part""",
        "filter_score": _crowded("kept AS (SELECT * FROM crowd WHERE score >= 0.7)")
        + _findings("doc_id", "kept"),
        "allow_entities": _crowded(
            "kept AS (SELECT * FROM crowd WHERE entity_type IN ('EARLY', 'PHONE_NUMBER'))"
        )
        + _findings("doc_id", "kept"),
        "select_spans": _select_spans(),
        "select_spans_long": _select_spans(),
        "redact_documents": f"""{_REDACTED_DOCUMENTS}
            SELECT key AS doc_id, text, status FROM redacted""",
        "redact_dictionary": f"""WITH RECURSIVE {_dictionary()}, {_choose('named')},
            {_splice('documents', 'doc_id', 'text')}
            SELECT key AS doc_id, text FROM redacted""",
        "redact_columns_pages": f"""SELECT page_id, url, html
            FROM ({_pages_column('url', 'url')}) JOIN ({_pages_column('html', 'html')})
            USING (page_id)""",
        "make_token": f"""SELECT c_custkey, {_token("'PERSON'", 'c_name')} AS token
            FROM customer""",
        "normalize_entity": """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'PII'
            ELSE trim(regexp_replace(upper(p_type || '/' || p_name || '!!'),
                      '[^A-Z0-9_]+', '_', 'g'), '_') END AS label FROM part""",
        "extract_mappings": f"""{_REDACTED_DOCUMENTS}
            SELECT DISTINCT token, value, entity_type FROM cut""",
        "vault_put": f"{_TIMED_VAULT} SELECT {_SHOWN} FROM timed",
        "vault_live": _live(NOW),
        "vault_purge": _live("2026-01-02 20:00:00"),
        "vault_get": f"""WITH {_ORDER_TOKENS}
            SELECT o_orderkey, token, c_name AS value
            FROM tokens LEFT JOIN live ON c_custkey = o_custkey""",
        "detokenize": f"""WITH {_ORDER_TOKENS}
            SELECT o_orderkey, coalesce(c_name, token) AS token
            FROM tokens LEFT JOIN live ON c_custkey = o_custkey""",
        "find_tokens": f"""{_REDACTED_DOCUMENTS},
            listed AS (SELECT key, regexp_extract_all(text, {_quote(TOKEN_PATTERN)}) AS t
                       FROM redacted)
            SELECT key AS doc_id, (unnest(range(1, len(t) + 1)) - 1)::INTEGER AS pos,
                   unnest(t) AS token FROM listed""",
        "rehydrate_documents": documents,
        "rehydrate_repeated_keys": documents,
        "vault_compact_then_write": _live(NOW),
        "detect_terms": """
            WITH named AS (SELECT o_orderkey, c_name, length(c_name)::INTEGER AS n
                           FROM orders JOIN customer ON o_custkey = c_custkey),
            spans AS (SELECT o_orderkey, 3 AS start, n FROM named
                      UNION ALL SELECT o_orderkey, 4 + n, n FROM named)
            SELECT o_orderkey, 'PERSON' AS entity_type, start::INTEGER AS start,
                   (start + n)::INTEGER AS "end", 0.9::DOUBLE AS score FROM spans""",
        "detect_by_name_regex": _detect(),
        "sanitize_prompts": f"""
            SELECT doc_id, concat('{{ "n" : 1.50, "prompt":"',
                     CASE doc_id % 3 WHEN 0 THEN source || ' ' || {_token(
                         "'EMAIL_ADDRESS'", "'a' || doc_id || '@b.co'")}
                       WHEN 1 THEN '   ' ELSE 'né ' || source END,
                     '" , "x":12345678901234567890}}') AS body,
                   CASE doc_id % 3 WHEN 0 THEN 'redacted' ELSE 'unchanged' END AS status
            FROM documents""",
        "rechunk_small_blocks": f"""{_REDACTED_DOCUMENTS}
            SELECT key AS stream_id, strlen(text)::BIGINT AS bytes,
                   len(regexp_extract_all(text, {_quote(TOKEN_PATTERN)}))::BIGINT AS tokens
            FROM redacted WHERE length(text) > 0""",
        "vault_two_writers": f"{_TIMED_VAULT} SELECT {_SHOWN} FROM timed",
        "rehydrate_partly_expired": f"""WITH RECURSIVE {_documents_spans()}, {_choose()},
            {_splice('documents', 'doc_id', 'text',
                     "CASE c.entity_type WHEN 'EMAIL_ADDRESS' THEN c.value ELSE c.token END")}
            SELECT key AS doc_id, text FROM redacted""",
        "round_trip_documents": """SELECT doc_id, length(text)::INTEGER AS restored_length,
            TRUE AS same FROM documents""",
        "extract_texts": """
            SELECT doc_id AS body_id, 'system' AS path, NULL::INTEGER AS pos,
                   NULL::INTEGER AS part_pos, source AS text
            FROM documents WHERE doc_id % 5 <> 0 AND source IS NOT NULL
            UNION ALL SELECT doc_id, 'input', NULL, 0, lang FROM documents
            WHERE doc_id % 5 <> 0 AND lang IS NOT NULL
            UNION ALL SELECT doc_id, 'input', NULL, 2, text FROM documents
            WHERE doc_id % 5 <> 0 AND text IS NOT NULL
            UNION ALL SELECT doc_id, 'messages', 1, NULL, text FROM documents
            WHERE doc_id % 5 <> 0 AND text IS NOT NULL""",
        "extract_texts_conversations": """SELECT conv_id * 1000 + turn AS body_id,
            'messages' AS path, 0::INTEGER AS pos, NULL::INTEGER AS part_pos, text
            FROM conversations WHERE text IS NOT NULL""",
        "sanitize_requests": f"""{_REDACTED_DOCUMENTS}
            SELECT doc_id AS body_id,
                   CASE WHEN doc_id % 5 = 0 THEN 'unchanged' ELSE status END AS status,
                   CASE WHEN doc_id % 5 = 0 THEN d.text ELSE r.text END AS part_text,
                   CASE WHEN doc_id % 5 = 0 THEN d.text ELSE r.text END AS message_text,
                   doc_id::VARCHAR AS seed
            FROM redacted r JOIN documents d ON d.doc_id = r.key""",
        "sanitize_requests_custom": f"""
            WITH counted AS (
              SELECT doc_id, doc_id % 5 = 0 AS skipped,
                     (len(regexp_extract_all(text, '{shout}')) * 2
                      + len(regexp_extract_all(lang, '{shout}'))
                      + len(regexp_extract_all(source, '{shout}')))::INTEGER AS n,
                     contains(text || lang || source, 'É') AS failed
              FROM documents)
            SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 END AS body_id,
                   CASE WHEN skipped THEN 'unchanged' WHEN failed THEN 'rejected'
                        WHEN n > 0 THEN 'redacted' ELSE 'unchanged' END AS status,
                   CASE WHEN skipped OR failed THEN 0 ELSE n END AS mappings,
                   CASE WHEN skipped OR NOT failed THEN doc_id::VARCHAR END AS seed
            FROM counted""",
        "rebuild_bodies": """SELECT doc_id AS body_id, text AS part_text,
            CASE WHEN doc_id % 5 = 0 THEN text ELSE '<' || text || '>' END AS message_text,
            doc_id::VARCHAR AS seed FROM documents""",
        "fail_policy_open": _policy("d.text", "passed_uninspected"),
        "fail_policy_closed": _policy("NULL", "rejected"),
        "rechunk_batch": f"""{_REDACTED_DOCUMENTS}
            SELECT key AS stream_id, 0::BIGINT AS block, text FROM redacted
            WHERE length(text) > 0""",
        "rehydrate_chunks_batch": _WHOLE_STREAMS.format(text="text", source="documents"),
        "rechunk_stream": f"""{_REDACTED_DOCUMENTS}
            SELECT key AS stream_id, 0::BIGINT AS block, text FROM redacted
            WHERE length(text) > 0""",
        "tool_calls": f"""{_REDACTED_DOCUMENTS}
            SELECT key AS doc_id, text, 'a@b.com' AS user, status FROM redacted""",
        "detection_metrics": f"""{_REDACTED_DOCUMENTS}
            SELECT strftime(TIMESTAMP '2026-01-01 00:00:00' + to_hours(key), '%Y-%m-%d') AS day,
                   entity_type, count(*) AS findings
            FROM cut GROUP BY ALL""",
        "detection_metrics_rollup": f"""{_REDACTED_DOCUMENTS}
            SELECT entity_type, count(*) AS findings, count(DISTINCT token) AS tokens,
                   count(DISTINCT key) AS requests, TRUE AS tokens_close, TRUE AS requests_close
            FROM cut GROUP BY entity_type""",
        "transactions": f"""{_REDACTED_DOCUMENTS},
            pair AS (
              SELECT d.doc_id, d.text AS plain, r.text AS tokens, d.doc_id % 7 AS kind,
                     coalesce(length(d.text), 0) > 0 AND d.doc_id % 7 <> 5 AS answered
              FROM documents d JOIN redacted r ON r.key = d.doc_id)
            SELECT doc_id AS request_id, 'restored' AS status, plain AS text
            FROM pair WHERE answered AND kind NOT IN (3, 4)
            UNION ALL SELECT doc_id + CASE kind WHEN 3 THEN 10000000 ELSE 0 END, 'no_request', tokens
            FROM pair WHERE answered AND kind IN (3, 4)
            UNION ALL SELECT doc_id, 'no_response', NULL FROM pair
            WHERE NOT answered OR kind IN (3, 4)""",
        "requests_files": f"""
            WITH judged AS (
              SELECT doc_id, doc_id % 5 = 0 AS skipped,
                     NOT doc_id % 5 = 0 AND contains(text || lang || source, 'É') AS failed,
                     len(regexp_extract_all(text, '{shout}')) + len(regexp_extract_all(lang, '{shout}'))
                     + len(regexp_extract_all(source, '{shout}')) AS n
              FROM documents)
            SELECT t.name || CASE WHEN failed THEN '-bad' ELSE '-out' END AS target,
                   CASE WHEN failed THEN 'rejected' WHEN skipped OR n = 0 THEN 'unchanged'
                        ELSE 'redacted' END AS status,
                   CASE WHEN NOT failed THEN doc_id::VARCHAR END AS seed
            FROM judged CROSS JOIN (VALUES ('table'), ('lines')) t(name)""",
        "session_redact": f"""{_SESSIONS}
            SELECT c.key AS doc_id, c.key % 50 AS session_id, {_SESSION_VERSION}::INTEGER AS salt_version,
                   text, status FROM redacted c""",
        "session_round_trip": f"""{_SESSIONS}
            SELECT d.doc_id, d.doc_id % 50 + CASE d.doc_id % 4 WHEN 0 THEN 100 ELSE 0 END AS session_id,
                   CASE d.doc_id % 4 WHEN 0 THEN r.text ELSE d.text END AS text
            FROM documents d JOIN redacted r ON r.key = d.doc_id""",
        "redact_by_policy": _POLICY,
        "outbound_detect_chunks": f"""WITH {_documents_spans()}
            SELECT key AS stream_id, entity_type, s::BIGINT AS "start", e::BIGINT AS "end", score
            FROM spans""",
        "outbound_redact_chunks": f"""{_REDACTED_DOCUMENTS}
            SELECT key AS stream_id, text FROM redacted WHERE length(text) > 0""",
        "outbound_redact_stream": f"""{_REDACTED_DOCUMENTS}
            SELECT key AS stream_id, text FROM redacted WHERE length(text) > 0""",
        "late_chunks": """
            WITH chunk AS (
              SELECT doc_id, unnest(range(0, greatest(1, (length(text) + 299) // 300))) AS seq, text
              FROM documents WHERE text IS NOT NULL),
            cut AS (
              SELECT doc_id, seq, substring(text, seq * 300 + 1, 300) AS chunk,
                     doc_id % 3 > 0 AND (doc_id + seq) % 5 = 3 AS late
              FROM chunk)
            SELECT doc_id AS stream_id,
                   nullif(string_agg(chunk, '' ORDER BY seq) FILTER (NOT late), '') AS text,
                   nullif(string_agg(chunk, '' ORDER BY seq) FILTER (late), '') AS late_text
            FROM cut GROUP BY doc_id HAVING length(string_agg(chunk, '')) > 0""",
        "rehydrate_stream": _WHOLE_STREAMS.format(text="text", source="documents"),
    }
