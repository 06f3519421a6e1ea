"""DuckDB SQL for the engine's queries."""

from __future__ import annotations

from .functions.prompts import LABELS, STYLES
from .functions.text import JSWS
from .schema import LOCAL_SETTING

# DuckDB's regular expressions take the same class; NBSP and the like by code.
WS = JSWS

_LINES = """lines AS (
    SELECT doc_id, line, content, doc_id || '-' || line AS uuid, source || '/' || doc_id AS page_name
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents))"""

_MARKED = """marked AS (
    SELECT doc_id, line, uuid, page_name, CASE line % 8
        WHEN 0 THEN '[[' || content || ']] linked' WHEN 1 THEN '#tag ' || content || ' #end' WHEN 2 THEN 'https://example.org/ ' || content
        WHEN 3 THEN chr(12288) || content || chr(160) || ' end' WHEN 4 THEN '**' || content || '** bold' WHEN 5 THEN '*' || content || '* italic'
        WHEN 6 THEN doc_id || '-' || line || ', 3.5' ELSE content END AS content
    FROM lines)"""


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def _processed(source: str, name: str = "cleaned") -> str:
    x = _trim(f"regexp_replace(content, '[{WS}]+', ' ', 'g')")
    for pattern, by in ((r"\[\[([^\]]+)\]\]", r"\1"), ("#[A-Za-z0-9_]+", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"{name} AS (SELECT *, {_trim(x)} AS processed FROM {source})"


_FAULT = rf"""CASE WHEN content IS NULL OR {_trim("content")} = '' THEN 'blank' WHEN length(processed) < 10 THEN 'short' WHEN length(processed) > 2000 THEN 'long'
    WHEN regexp_matches(processed, '\A[0-9{WS}\-.,]+\z') THEN 'numeric' WHEN regexp_matches(processed, '\Ahttps?://') THEN 'url' ELSE 'keep' END"""

_DEDUP = f"""{_LINES}, {_processed("lines")}, good AS (SELECT * FROM cleaned WHERE {_FAULT} = 'keep'),
    blocks AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY processed ORDER BY doc_id, line) = 1)"""

_CHANGES = f"""{_DEDUP}, cur AS (SELECT * FROM blocks WHERE doc_id % 10 <> 2),
    old AS (SELECT uuid, CASE WHEN doc_id % 10 = 1 THEN processed || ' (old)' ELSE processed END AS processed FROM blocks WHERE doc_id % 10 <> 0),
    seen AS (SELECT coalesce(cur.uuid, old.uuid) AS block_uuid, cur.processed AS content, old.processed AS stored_content,
        CASE WHEN old.uuid IS NULL THEN 'new' WHEN cur.uuid IS NULL THEN 'deleted' WHEN cur.processed = old.processed THEN 'unchanged' ELSE 'modified' END AS status
        FROM cur FULL JOIN old ON cur.uuid = old.uuid)"""

_VEC = "vec AS (SELECT vec_id, vec_id::VARCHAR AS block_uuid, 'label/' || label AS page_name, 'vector ' || vec_id AS block_content, embedding::DOUBLE[] AS v FROM embeddings)"


def _scored(query: int, store: str = "v") -> str:
    return f"{_VEC}, q AS (SELECT v AS qv FROM vec WHERE vec_id = {query}), scored AS (SELECT vec.*, round(list_cosine_similarity({store}, qv), 6) AS score FROM vec, q)"


def _top(query: int, k: int, threshold: float, store: str = "v") -> str:
    return f"{_scored(query, store)}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id, block_uuid) AS rank FROM scored WHERE score > {threshold} QUALIFY rank <= {k})"


_ROUND4 = "list_transform(v, lambda x: floor(x * 10000 + 0.5) / 10000)"
_GONE = "(vec_id // 100 % 3 = 1 OR (vec_id % 7 = 3 AND vec_id // 100 % 3 = 0))"
_SHARDED = f"{_VEC}, s AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM vec), sharded AS (SELECT *, k // 100 AS shard_id FROM s)"
_TOKENS = f"""{_DEDUP}, tok AS (SELECT uuid, unnest(string_split(lower(processed), ' ')) AS token FROM blocks),
    emb AS (SELECT uuid, ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS weight FROM tok WHERE token <> '' GROUP BY ALL)"""
_TREE = """tree AS (SELECT conv_id AS page_ord, 'conv/' || conv_id AS page_name, conv_id || '-' || turn AS uuid,
        CASE WHEN turn > 0 THEN conv_id || '-' || ((turn - 1) // 2) END AS parent_uuid, turn AS sibling_ord, text AS content FROM conversations),
    walk AS (SELECT uuid, page_name, page_ord, [sibling_ord] AS path FROM tree WHERE parent_uuid IS NULL
        UNION ALL SELECT t.uuid, t.page_name, t.page_ord, list_append(w.path, t.sibling_ord) FROM walk w JOIN tree t ON t.parent_uuid = w.uuid AND t.page_ord = w.page_ord)"""
_STYLES = "styles(key, name) AS (VALUES ('warm', 'Warm'), ('sharp', 'Sharp'), ('thoughtProvoking', 'Questions'), ('sparks', 'Sparks'), ('cosmic', 'Cosmic'))"
_PROMPTS = "styles(key, prompt) AS (VALUES " + ", ".join(f"('{key}', '{prompt}')" for key, _, _, prompt in STYLES) + ")"
# The index run sees raw lines, of which the old ones are altered before cleaning.
_BUILT = f"""{_LINES}, now AS (SELECT * FROM lines WHERE doc_id % 10 <> 2), {_processed("now")},
    good AS (SELECT * FROM cleaned WHERE {_FAULT} = 'keep')"""

ORACLE_SQL = {
    "search_topk": f"WITH {_top(0, 50, 0.25)} SELECT block_uuid, page_name, block_content, score, rank FROM top",
    "search_threshold_default": f"WITH {_top(0, 50, 0.5)} SELECT block_uuid, score FROM top",
    "search_all_above": f"WITH {_scored(1)} SELECT block_uuid, score FROM scored WHERE score > 0.1",
    "search_rounded_index": f"WITH {_top(3, 20, 0.2, _ROUND4)} SELECT block_uuid, score, rank FROM top",
    "search_near": f"WITH {_top(3, 20, 0.2, _ROUND4)} SELECT block_uuid, score, rank FROM top",
    "search_each_near": f"""WITH {_VEC}, s AS (SELECT q.vec_id AS query_id, round(list_cosine_similarity({_ROUND4.replace("(v,", "(vec.v,")}, q.v), 6) AS score
        FROM vec q, vec WHERE q.vec_id % 50 = 0), t AS (SELECT * FROM s WHERE score > 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC) <= 10)
        SELECT query_id, count(*) AS n, sum(score::DECIMAL(10, 6))::DECIMAL(20, 6)::VARCHAR AS total, min(score) AS least FROM t GROUP BY 1""",
    "notes_folder": """SELECT doc_id // 1000 AS page, NULL::VARCHAR AS parent, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) - 1 AS sibling_ord, 'document ' || doc_id AS content FROM documents
        UNION ALL SELECT doc_id // 1000, 'd' || doc_id, i - 1, l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "store_compaction": f"WITH {_VEC} SELECT block_uuid, len(v) AS dim, 1::BIGINT AS segments FROM vec WHERE vec_id % 9 <> 0",
    "topk_per_query": f"""WITH {_VEC}, s AS (SELECT q.vec_id AS query_id, vec.vec_id, vec.block_uuid, round(list_cosine_similarity(vec.v, q.v), 6) AS score FROM vec, vec q)
        SELECT query_id, block_uuid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, block_uuid) AS rank FROM s WHERE score > 0.25 QUALIFY rank <= 3""",
    "vector_round4": f"WITH {_VEC} SELECT block_uuid, generate_subscripts(v, 1) - 1 AS i, unnest({_ROUND4}) AS x FROM vec",
    "vector_norms": f"WITH {_VEC} SELECT block_uuid, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM vec",
    "blocks_scan": f"WITH {_LINES} SELECT uuid, page_name, content FROM lines",
    "preprocess_text": f"WITH {_LINES}, {_MARKED}, {_processed('marked')} SELECT uuid, processed FROM cleaned",
    "text_lengths": f"WITH {_LINES} SELECT uuid, length(content) AS units, strlen(content) AS bytes FROM lines",
    "filter_worth": f"WITH {_LINES}, {_MARKED}, {_processed('marked')} SELECT uuid, processed FROM cleaned WHERE {_FAULT} = 'keep'",
    "filter_reasons": f"WITH {_LINES}, {_MARKED}, {_processed('marked')} SELECT {_FAULT} AS fault, count(*) AS n FROM cleaned GROUP BY 1",
    "blocks_dedup": f"WITH {_DEDUP} SELECT uuid, page_name, processed FROM blocks",
    "dedup_last_wins": f"WITH {_DEDUP} SELECT uuid, processed FROM good QUALIFY row_number() OVER (PARTITION BY processed ORDER BY doc_id DESC, line DESC) = 1",
    "change_status": f"WITH {_CHANGES} SELECT block_uuid, status FROM seen",
    "change_counts": f"WITH {_CHANGES} SELECT status, count(*) AS n FROM seen GROUP BY 1",
    "total_changes": f"WITH {_CHANGES} SELECT count(*) AS changes FROM seen WHERE status <> 'unchanged'",
    **{f"{s}_blocks": f"WITH {_CHANGES} SELECT block_uuid, content, stored_content FROM seen WHERE status = '{s}'" for s in ("new", "modified", "deleted", "unchanged")},
    "to_index_union": f"""WITH {_CHANGES} SELECT block_uuid AS uuid, content AS processed, 0::BIGINT AS phase FROM seen WHERE status = 'new'
        UNION ALL SELECT block_uuid, content, 1 FROM seen WHERE status = 'modified'""",
    "survivors": f"WITH {_CHANGES} SELECT block_uuid, stored_content AS block_content FROM seen WHERE status = 'unchanged'",
    "apply_changes": f"WITH {_CHANGES} SELECT block_uuid, content AS block_content FROM seen WHERE status <> 'deleted'",
    "shard_assign": f"WITH {_SHARDED} SELECT block_uuid, k AS ord, shard_id FROM sharded",
    "store_scan": f"WITH {_SHARDED} SELECT block_uuid, page_name, block_content, k AS ord, shard_id FROM sharded",
    "shard_index": f"WITH {_SHARDED} SELECT shard_id, string_agg(block_uuid, ',' ORDER BY block_uuid) AS uuids, count(*) AS record_count FROM sharded GROUP BY 1",
    "append_layout": f"WITH {_SHARDED} SELECT shard_id, count(*) AS n FROM sharded GROUP BY 1",
    "delete_by_key": f"WITH {_SHARDED} SELECT block_uuid, shard_id FROM sharded WHERE NOT {_GONE}",
    "delete_touched_shards": f"WITH {_SHARDED} SELECT DISTINCT shard_id FROM sharded WHERE {_GONE}",
    "update_by_key": f"""WITH {_VEC} SELECT block_uuid, CASE WHEN vec_id % 5 = 0 THEN 'updated' ELSE page_name END AS page_name,
        CASE WHEN vec_id % 5 = 0 THEN block_content || ' new' ELSE block_content END AS block_content FROM vec""",
    "store_stats": f"WITH {_SHARDED} SELECT count(*) AS record_count, max(len(v)) AS dim, count(DISTINCT shard_id) AS total_chunks, sum(strlen(block_content))::BIGINT AS text_bytes FROM sharded",
    "store_integrity": f"""WITH {_SHARDED} SELECT true AS has_file, false AS can_load, count(*) FILTER (shard_id <> 1) AS data_count, false AS is_valid, 'missing shards: 1' AS issues,
        count(DISTINCT shard_id) - 1 AS actual_chunks, count(DISTINCT shard_id) AS expected_chunks FROM sharded""",
    "hash_embedding": f"WITH {_TOKENS} SELECT uuid, bucket, weight FROM emb",
    "embed_blocks": f"WITH {_TOKENS} SELECT uuid, bucket, weight FROM emb",
    "semantic_search": f"""WITH {_TOKENS}, n AS (SELECT uuid, sqrt(sum(weight * weight)) AS n FROM emb GROUP BY 1), placed AS (SELECT uuid, doc_id, doc_id * 1000000 + line AS ord FROM blocks),
        q AS (SELECT emb.uuid, ord AS query_id, bucket, weight AS qw FROM emb JOIN placed USING (uuid) WHERE doc_id % 50 = 0),
        d AS (SELECT query_id, q.uuid AS own, emb.uuid, sum(weight * qw) AS d FROM emb JOIN q USING (bucket) GROUP BY ALL),
        s AS (SELECT query_id, d.uuid AS block_uuid, ord, round(d / (a.n * b.n), 6) AS score FROM d JOIN n a ON a.uuid = d.uuid JOIN n b ON b.uuid = own JOIN placed ON placed.uuid = d.uuid)
        SELECT query_id, block_uuid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, block_uuid) AS rank FROM s WHERE score > 0.5 QUALIFY rank <= 10""",
    "index_build": f"""WITH {_BUILT} SELECT uuid AS block_uuid, processed AS block_content FROM good
        QUALIFY row_number() OVER (PARTITION BY processed ORDER BY doc_id, line) = 1""",
    "tree_flatten": f"WITH RECURSIVE {_TREE} SELECT uuid, page_name, len(path) AS depth, array_to_string(path, '/') AS path FROM walk",
    "tree_order": f"WITH RECURSIVE {_TREE} SELECT uuid, row_number() OVER (ORDER BY page_ord, path) - 1 AS ord FROM walk",
    "tree_preorder": f"""WITH RECURSIVE {_TREE}, sizes AS (SELECT a.uuid, count(*) AS size FROM walk a JOIN walk b ON b.page_ord = a.page_ord AND b.path[1:len(a.path)] = a.path GROUP BY 1)
        SELECT uuid, page_ord, len(path) AS depth, size, row_number() OVER (PARTITION BY page_ord ORDER BY path) - 1 AS place FROM walk JOIN sizes USING (uuid)""",
    "page_blocks": f"WITH RECURSIVE {_TREE} SELECT uuid, parent_uuid, sibling_ord, content FROM tree WHERE page_name = 'conv/1'",
    "result_refs": f"""WITH {_top(0, 10, 0.25)} SELECT 'query' AS parent, 0::BIGINT AS ord, count(*) || ' related notes' AS content FROM top
        UNION ALL SELECT 'query', rank, '((' || block_uuid || '))' FROM top""",
    "result_nested": f"WITH {_top(0, 10, 0.25)} SELECT block_content AS content, block_uuid AS uuid, page_name, score FROM top",
    "selection_concat": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations WHERE trim(text) <> '' GROUP BY 1",
    "summary_context": f"WITH {_top(0, 10, 0.25)} SELECT string_agg(block_content, chr(10) ORDER BY rank) AS context FROM top",
    "style_lookup": f"""WITH {_STYLES}, r AS (SELECT conv_id, turn, CASE turn WHEN 0 THEN 'sharp' WHEN 1 THEN 'cosmic' WHEN 2 THEN 'sparks' ELSE 'warm' END AS key FROM conversations)
        SELECT conv_id, turn, key, name FROM r JOIN styles USING (key)""",
    "progress_batches": f"""WITH {_VEC}, n AS (SELECT count(*) AS n FROM vec)
        SELECT block_uuid, vec_id // 15 AS batch, floor(least((vec_id // 15 + 1) * 15, n) / n * 100 + 0.5)::BIGINT AS percent, vec_id // 15 // 34 AS flush FROM vec, n""",
    "compact_rows": f"WITH {_VEC} SELECT block_uuid, page_name, block_content, round(sqrt(list_sum(list_transform({_ROUND4}, lambda x: x * x))), 6) AS norm, 1::BIGINT AS last_updated_ms FROM vec",
    "record_keys": """SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN '' END, ''), CASE WHEN turn % 2 = 0 THEN 'b' END, conv_id::VARCHAR) AS key,
        substr(text, 1, 8) AS short FROM conversations""",
    "round4_special": f"""WITH {_VEC}, e AS (SELECT block_uuid, vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) * 1e17::DOUBLE AS x FROM vec)
        SELECT block_uuid, i, vec_id % 4 = 0 AS is_nan, vec_id % 4 = 1 AS is_inf, vec_id % 4 = 2 AS is_minus_inf,
            CASE WHEN vec_id % 4 < 3 THEN 0.0 WHEN abs(x * 10000) >= 4503599627370496 THEN x * 10000 / 10000 ELSE floor(x * 10000 + 0.5) / 10000 END AS x FROM e""",
    "styled_response": f"""WITH {_PROMPTS}, p AS (SELECT conv_id, turn, 'Write 50 to 150 words of plain text in the language of the note.' || chr(10) || 'Manner: ' || prompt || chr(10) || 'Note:' || chr(10) || text AS prompt
            FROM conversations JOIN styles ON key = ['warm', 'sharp', 'thoughtProvoking', 'sparks', 'cosmic'][turn % 5 + 1])
        SELECT conv_id, turn, prompt, list_filter(list_transform(string_split(prompt, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] AS answer FROM p""",
    "search_prompts": """WITH t AS (SELECT *, chr(10) || 'Mind the dates: today is day ' || turn AS note,
            'List the search keywords of this question, one a line.' || chr(10) || 'Question: ' || text AS k,
            'Summarise these notes in the writer''s own voice, then answer the question in its language.' || chr(10) || 'Question: ' || role || chr(10) || 'Notes:' || chr(10) || text AS s FROM conversations)
        SELECT conv_id, turn, k AS keywords, k || note AS dated_keywords, 'From 0 to 10, how well does the note answer the question? Give the number alone.' || chr(10) || 'Question: ' || role || chr(10) || 'Note: ' || text AS relevance,
            s AS summary, s || note AS dated_summary FROM t""",
    "summary_texts": f"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) || text || chr(9) ELSE text END AS text FROM conversations)
        SELECT conv_id, turn, CASE WHEN {_trim('text')} <> '' THEN '```markdown' || chr(10) || {_trim('text')} || chr(10) || '```' END AS fenced, CASE WHEN text = '' THEN '' ELSE chr(10) || text || chr(10) END AS padded FROM t""",
    "size_texts": """SELECT doc_id, printf('%.2fKB', floor(strlen(text) * 100 / 1024.0 + 0.5) / 100) AS kb, printf('%.2f', floor(strlen(text)::BIGINT * 10000 / 1048576.0 + 0.5) / 100) AS mb FROM documents""",
    "retry_delays": "SELECT conv_id, turn, i, least(2.0 ** (i - 1), 5.0)::DOUBLE AS seconds FROM (SELECT conv_id, turn, unnest(range(1, turn % 6 + 1)) AS i FROM conversations)",
    "store_lifecycle": """WITH n AS (SELECT count(*) FILTER (vec_id % 2 = 0) AS even, count(*) FILTER (vec_id % 3 = 0) AS third, count(*) FILTER (vec_id % 2 = 0 OR vec_id % 3 = 0) AS stored,
            count(*) FILTER (vec_id % 9 = 0) AS ninth, count(*) FILTER (vec_id % 4 = 0 AND vec_id % 9 <> 0) AS fourth FROM embeddings)
        SELECT unnest(['empty', 'cached', 'rebuilt', 'saved on top', 'has data', 'preloaded', 'kept', 'scanned', 'deleted', 'deleted again', 'updated', 'left', 'valid', 'cleared', 'scanned after']) AS step,
            unnest([0, 0, even, third, 1, stored, stored, stored, ninth, 0, fourth, stored - ninth, 1, 0, 0]) AS n FROM n""",
    "json_rows": f"WITH {_VEC} SELECT block_uuid, page_name, block_content, round(sqrt(list_sum(list_transform({_ROUND4}, lambda x: x * x))), 6) AS norm, 1::BIGINT AS last_updated_ms FROM vec",
    "service_answers": "SELECT conv_id, turn, text AS local, text AS cloud, true AS wrong, conv_id / 2 + turn AS local_sum, conv_id / 2 + turn AS cloud_sum, true AS wrong_vector FROM conversations",
    "settings_choice": f"""WITH names AS (SELECT ['', '{LOCAL_SETTING}', 'another cloud service', 'hashing', {", ".join(f"'{label} / style'" for label, _ in LABELS)}] AS n, ['warm', 'warm', 'warm', 'warm', {", ".join(f"'{key}'" for _, key in LABELS)}] AS s),
            t AS (SELECT conv_id, turn, (conv_id + turn) % len(n) + 1 AS i, n, s FROM conversations, names)
        SELECT conv_id, turn, n[i] AS setting, CASE WHEN i <= 2 THEN 'local' WHEN i = 4 THEN 'hashing' ELSE 'cloud' END AS provider, CASE WHEN i <= 2 THEN 768 WHEN i = 4 THEN 256 ELSE 1024 END::BIGINT AS dimension, s[i] AS style FROM t""",
    "refresh_changes": f"WITH {_CHANGES} SELECT block_uuid, status, content, stored_content FROM seen",
    "store_clock": f"WITH {_VEC} SELECT block_uuid, 1::BIGINT AS last_updated_ms FROM vec",
    "selections": """SELECT 'selected' AS "case", (SELECT string_agg(text, chr(10) || chr(10) ORDER BY turn) FROM conversations WHERE conv_id = 1 AND trim(text) <> '') AS content
        UNION ALL VALUES ('blank', ' not cleaned '), ('nothing', NULL)""",
    "engine_states": """WITH s(step, ready, storage, has_data, cached) AS (VALUES ('made', false, false, false, false), ('opened', true, false, false, false), ('stored', true, true, true, false), ('opened again', true, true, true, true), ('cleared', true, false, false, false))
        SELECT step, unnest(['ready', 'storage', 'has_data', 'cached']) AS name, unnest([ready, storage, has_data, cached]) AS value FROM s
        UNION ALL VALUES ('opened again', 'blank query finds', false), ('opened again', 'summary without results', false)""",
    "summary_sink": f"""WITH {_top(0, 10, 0.25)} SELECT 'query' AS parent, 0::BIGINT AS ord, count(*) || ' related notes' AS content FROM top UNION ALL SELECT 'query', rank, '((' || block_uuid || '))' FROM top
        UNION ALL SELECT 'query', 2147483648, '```markdown' || chr(10) || 'all of it' || chr(10) || '```'""",
    "response_sink": f"""WITH t AS (SELECT * FROM conversations WHERE conv_id = 1 AND trim(text) <> ''), last AS (SELECT max(turn) AS turn, arg_max(text, turn) AS text FROM t)
        SELECT 'AIResponse' AS page_name, 0::BIGINT AS sibling_ord, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] AS content, 'r1' AS uuid, NULL::VARCHAR AS after, true AS new_page FROM last
        UNION ALL SELECT 'conv/1', turn + 1, '((r1))', NULL, '1-' || turn, false FROM last""",
    "engine_search": f"""WITH {_TOKENS}, q AS (SELECT ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS qw FROM (SELECT unnest(string_split(lower(content), ' ')) AS token FROM lines WHERE uuid = '0-1') WHERE token <> '' GROUP BY 1),
        n AS (SELECT uuid, sqrt(sum(weight * weight)) AS n FROM emb GROUP BY 1), d AS (SELECT uuid, sum(weight * qw) AS d FROM emb JOIN q USING (bucket) GROUP BY 1),
        s AS (SELECT uuid, round(d / (n * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS score FROM d JOIN n USING (uuid))
        SELECT uuid AS block_uuid, score, row_number() OVER (ORDER BY score DESC, doc_id, line) AS rank FROM s JOIN blocks USING (uuid) WHERE score > 0.5 QUALIFY rank <= 50""",
    "streaming_refresh": f"WITH {_DEDUP} SELECT uuid AS block_uuid, processed AS block_content FROM blocks",
}
