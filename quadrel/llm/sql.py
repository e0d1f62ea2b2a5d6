"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .sharding import SHARDS, SLOTS, fill

_ESC = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"

OP2 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + 32)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op4() -> str:
    """The table is configuration, not data, so it stands in the SQL as a list."""
    table = fill([f"shard-{i:03d}" for i in range(SHARDS)], SLOTS)
    return f"""
WITH lookup AS (SELECT {table} AS shards),
k AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INT AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1]::INT AS shard FROM k, lookup
"""


OP7 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM n JOIN g USING (body)
"""


def oracle() -> dict[str, str]:
    return {"op2_chat": OP2, "op4_sharding": op4(), "op7_exact_dedup": OP7}
