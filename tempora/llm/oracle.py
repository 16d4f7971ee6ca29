"""DuckDB restatements of the ``opN_`` queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_ESCAPED = ("length({0}) + 4 * (length({0}) - length(replace({0}, '&', ''))) + 3 * (length({0}) - length(replace({0}, '<', '')))"
            " + 5 * (length({0}) - length(replace({0}, '[', '')))")

ORACLE["op3_chat_schemas"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({_ESCAPED.format("role")} + 3 * (length(role) - length(replace(role, chr(10), '')))
      + {_ESCAPED.format("text")} + length('<|turn|>') + 1 + length('<|end|>') + 1)::BIGINT AS formatted_chars,
  CASE WHEN list(role ORDER BY turn, role, text) = ['user', 'assistant'] THEN 'prompt-response'
       WHEN list(role ORDER BY turn, role, text) = ['system', 'user', 'assistant'] THEN 'instruction-system'
       WHEN abs(conv_id) % 2 = 1 AND bool_and(role IN ('system', 'user', 'assistant')) THEN 'from-value'
       ELSE 'messages' END AS layout
FROM turns GROUP BY conv_id
"""

ORACLE["op6_maxscore_top_k"] = """
WITH fine AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE["op11_indexed_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, payload,
    max(page_id) OVER (PARTITION BY payload) AS kept
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM d
"""
