"""SQL, for DuckDB, of the queries in `ordered`."""

from ..functions import chat
from .oracles import D, PAIRS, M, lit, measured, strip
from .ordered import NAV, SHARES, TOOLS

_SHARES = ", ".join(f"{q}::DOUBLE" for q in SHARES)
_U = lambda seed, key: f"((('0x' || sha256('{seed}:' || {key})[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
_H32 = lambda x: f"('0x' || md5({x})[1:8])::BIGINT"
_NAV = "[" + ", ".join(f"struct_pack(h := {_H32(f'''\'4217:nav:{i}:\' || doc_id''')}, i := {i}, v := '{v}')" for i, v in enumerate(NAV)) + "]"
_VERSIONS = """a AS (SELECT doc_id % 100 AS doc_id, lang, substr(source, 1, 3) AS text FROM documents),
b AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 5 THEN text || ' (revised)' ELSE text END AS text FROM a, unnest(range(CASE WHEN doc_id % 5 = 2 THEN 3 ELSE 1 END)) WHERE doc_id % 7 <> 3)"""
_NULLS = f"""k AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN substr(text, 1, 3) END AS key, CASE WHEN doc_id % 4 <> 0 THEN CAST(length(text) AS BIGINT) END AS n FROM {D}),
r AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE doc_id % 6 = 0)"""


def _quantiles(value: str, table: str) -> str:
    return f"""WITH v AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS r, count(*) OVER () AS n FROM {table}), q AS (SELECT unnest([{_SHARES}]) AS share)
SELECT share, v AS value FROM q JOIN v ON r = least(n - 1, CAST(floor(n * share) AS BIGINT))"""


_ONE = lambda c: f"round(sum(coalesce(CAST({c} AS INT), 0)) OVER w::DOUBLE / count(*) OVER w, 3)"

SQL = {
    "length_quantiles": _quantiles("CAST(length(text) AS BIGINT)", D),
    "price_quantiles": _quantiles("CAST(round(l_extendedprice * 100) AS BIGINT)", "lineitem"),
    "running_summaries": f"""SELECT conv_id, turn, count(*) OVER w AS n, {_ONE('is_empty')} AS empty_share, {_ONE('relevant')} AS relevance_rate, {_ONE('followed')} AS instruction_following, {_ONE('lang_ok')} AS language_correct,
  round(CAST(sum(CAST(repetition AS DECIMAL(18, 6))) OVER w AS DOUBLE) / count(*) OVER w, 3) AS mean_repetition, max(repetition) OVER w AS worst FROM {measured('answer')} WINDOW w AS (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)""",
    "running_user_values": """SELECT event_id, count(*) OVER w AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, max(CAST(round(value * 100) AS BIGINT)) OVER w AS most,
  last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS bought FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "sampled_documents": f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_U(42, 'doc_id')}, doc_id) AS place FROM documents QUALIFY place <= 25",
    "weighted_sample": f"SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY -ln({_U(42, 'doc_id')}) / length(text), doc_id) AS place FROM {D} WHERE length(text) > 0 QUALIFY place <= 25",
    "sampled_slots": f"SELECT doc_id, array_to_string(list_transform(list_sort({_NAV})[1:4], lambda x: x.v), ' | ') AS bar FROM documents",
    "purchases_as_of_views": """SELECT p.event_id, CASE WHEN v.ts >= p.ts - INTERVAL 1 DAY THEN v.event_id END AS view_id, CASE WHEN v.ts >= p.ts - INTERVAL 1 DAY THEN v.value END AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "shipments_in_order_windows": """WITH o AS (SELECT o_orderkey, o_custkey % 25 AS place, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS a, CASE WHEN o_orderkey % 50 = 0 THEN 200 WHEN o_orderkey % 7 = 0 THEN 30 ELSE o_orderkey % 5 END AS len FROM orders WHERE o_orderkey % 4 = 0),
i AS (SELECT l_orderkey, l_suppkey % 25 AS place, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS x FROM lineitem)
SELECT o_orderkey, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, min(x) AS first_ship, max(x) AS last_ship FROM o JOIN i ON o.place = i.place AND x BETWEEN a AND a + len GROUP BY o_orderkey""",
    "overlapping_sessions": """WITH e AS (SELECT event_id AS id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS a, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + CAST(round(value * 60) AS BIGINT) AS b FROM events WHERE event_type = 'error')
SELECT x.id AS a_id, count(*) AS n, CAST(sum(y.id) AS BIGINT) AS ids FROM e x JOIN e y ON x.a <= y.b AND y.a <= x.b AND x.id < y.id GROUP BY x.id""",
    "moving_user_sums": """SELECT event_id, count(*) OVER w AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
    "bag_difference": f"WITH {_VERSIONS} SELECT * FROM a EXCEPT ALL SELECT * FROM b",
    "bag_intersection": f"WITH {_VERSIONS} SELECT * FROM a INTERSECT ALL SELECT * FROM b",
    "corpus_changes": """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN text || ' (revised)' ELSE text END AS text, lang, source FROM documents, unnest(range(CASE WHEN doc_id % 5 = 2 THEN 3 ELSE 1 END)) WHERE doc_id % 7 <> 3)
SELECT doc_id, md5(coalesce(text, '')) AS md5, CAST(sum(x) AS BIGINT) AS change FROM (SELECT doc_id, text, lang, source, -1 AS x FROM documents UNION ALL SELECT *, 1 FROM b) GROUP BY doc_id, text, lang, source HAVING sum(x) <> 0""",
    "keep_first_with_nulls": f"WITH {_NULLS} SELECT * FROM r QUALIFY rank() OVER (PARTITION BY key ORDER BY n NULLS FIRST, doc_id) = 1",
    "appended_without_keys": f"""WITH {_NULLS}, e AS (SELECT * FROM r WHERE doc_id % 2 = 0), ek AS (SELECT DISTINCT key FROM e WHERE key IS NOT NULL)
SELECT key AS stem, CAST(NULL AS BIGINT) AS unkeyed, CAST(0 AS BIGINT) AS odd FROM (SELECT DISTINCT key, doc_id FROM e WHERE key IS NOT NULL)
UNION ALL SELECT key, NULL, doc_id % 2 FROM (SELECT DISTINCT key, doc_id FROM r WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM ek))
UNION ALL SELECT NULL, doc_id, doc_id % 2 FROM (SELECT * FROM e WHERE key IS NULL UNION ALL SELECT * FROM r WHERE key IS NULL)""",
    "sketched_sources": f"SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, true AS distinct_fits, true AS median_fits, true AS p95_fits FROM {D} GROUP BY source",
    "builds_prompt_dedup": f"SELECT conv_id, turn FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY substr(lower({strip("regexp_replace(prompt, '\\s+', ' ', 'g')")}), 1, 300) ORDER BY conv_id, turn) = 1",
    "runner_answers": f"""SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN {strip("'<think>' || text || '</think>'")} WHEN 1 THEN CASE WHEN {strip('text')} = '' THEN '<think>why</think>' ELSE {strip('text')} END WHEN 2 THEN 'a</think>b' ELSE {strip('text')} END) AS md5 FROM {D}""",
    "tool_chats": f"""SELECT conv_id, md5('<|im_start|>system' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'Be brief.' || chr(10) || chr(10) WHEN m[1].role = 'system' THEN m[1].content || chr(10) || chr(10) ELSE '' END || {lit(chat.TOOLS_HEAD + chr(10) + chr(10).join(TOOLS) + chat.TOOLS_TAIL)} || e
  || coalesce(array_to_string(list_transform(range(CASE WHEN conv_id % 2 = 1 AND m[1].role = 'system' THEN 2 ELSE 1 END, len(m) + 1), lambda i: s || m[i].role || chr(10) || m[i].content || e), ''), '')
  || s || 'assistant' || chr(10) || '<think>' || chr(10) || 'hm' || chr(10) || '</think>' || chr(10) || chr(10) || 'Wait.' || chr(10) || '<tool_call>' || chr(10) || '{{"name": "search", "arguments": {{}}}}' || chr(10) || '</tool_call>' || chr(10) || '<tool_call>' || chr(10) || '{{"name": "time", "arguments": {{}}}}' || chr(10) || '</tool_call>' || e
  || s || 'user' || chr(10) || '<tool_response>' || chr(10) || 'one' || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || 'two' || chr(10) || '</tool_response>' || e || s || 'assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS md5
FROM (SELECT *, '<|im_start|>' AS s, '<|im_end|>' || chr(10) AS e FROM {M})""",
}
