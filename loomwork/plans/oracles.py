"""SQL, for DuckDB, of the queries that SQL can express; an independent statement of each result."""

from ..functions import constants as C

D = "(SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)"
lit = lambda s: "'" + s.replace("'", "''") + "'"
words = lambda x: f"list_filter(string_split_regex({x}, '\\s+'), lambda y: y <> '')"
grams = lambda w, n: f"(CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n} - 1], ' ')) ELSE [] END)"
rep = lambda w, low: f"(CASE WHEN len({w}) < {low} THEN 0.0::DOUBLE ELSE (len({grams(w, 3)}) - len(list_distinct({grams(w, 3)})))::DOUBLE / len({grams(w, 3)}) END)"
most = lambda w, n: f"(CASE WHEN len({w}) < {n} THEN 1 ELSE list_max(map_values(list_histogram({grams(w, n)}))) END)"
uniq = lambda w: f"(len(list_distinct({w}))::DOUBLE / greatest(1, len({w})))"
chars = lambda x, cls: f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))"
times = lambda x, p: f"((length({x}) - length(replace({x}, {lit(p)}, ''))) // {len(p)})"
total = lambda x, ps: "(" + " + ".join(times(x, p) for p in ps) + ")"
strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
matches = lambda x, ps: "(" + " OR ".join(f"regexp_matches({x}, {lit(p)})" for p in ps) + ")"
ARABIC, WIDE = r"\x{0600}-\x{06FF}", r"\x{0600}-\x{06FF}\x{0750}-\x{077F}"
PLACEHOLDER = C.PREP_PLACEHOLDER
M = "(SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS m, count(*) AS turns FROM conversations GROUP BY conv_id)"
said = lambda role: f"array_to_string(list_transform(list_filter(m, lambda y: y.role = '{role}'), lambda y: coalesce(y.content, '')), ' ')"
first = lambda role: f"list_filter(m, lambda y: y.role = '{role}')[1].content"
PAIRS = "(SELECT conv_id, turn, coalesce(text, '') AS prompt, coalesce(answer, '') AS answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


def language(x: str) -> str:
    en, ar, fa, letters, size = chars(x, "A-Za-z"), total(x, C.ARABIC_MARKERS), total(x, C.PERSIAN_MARKERS), chars(x, C.PERSIAN_LETTERS), f"greatest(1, length({x}))"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'other' WHEN {en} > 0.7 * {size} THEN 'en' WHEN {letters} >= 1 AND {fa} >= {ar} THEN 'fa' WHEN {ar} >= 3 AND {fa} = 0 AND {letters} = 0 THEN 'ar' WHEN {chars(x, WIDE)} > 0.3 * {size} THEN CASE WHEN {fa} > 0 OR {letters} > 0 THEN 'fa' ELSE 'mixed' END WHEN {en} > 0.3 * {size} THEN 'mixed' ELSE 'other' END)"


def talk(m: str) -> str:
    n = lambda k: f"len(list_filter(l, lambda z: z = '{k}'))"
    return f"(SELECT CASE WHEN {n('ar')} > 0 AND {n('ar')} >= {n('fa')} THEN 'ar' WHEN {n('fa')} > 0 AND {n('en')} > 0 THEN 'fa_en' WHEN {n('fa')} > 0 THEN 'fa' WHEN {n('en')} > 0 THEN 'en' ELSE 'mixed' END FROM (SELECT list_transform(list_filter({m}, lambda y: y.role = 'user'), lambda y: {language('y.content')}) AS l))"


def tokens(x: str) -> tuple[str, str]:
    t = f"regexp_replace(regexp_replace(regexp_replace({x}, '```[\\s\\S]*?```', ' ', 'g'), '`[^`\\n]+`', ' ', 'g'), 'https?://\\S+', ' ', 'g')"
    w = f"regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_{WIDE}]+')"
    hits = lambda ws: f"len(list_filter({w}, lambda y: y IN ({', '.join(map(lit, ws))})))"
    fa, ar, letters, en, arabic = hits(C.PERSIAN_WORDS), hits(C.ARABIC_WORDS), chars(t, C.PERSIAN_LETTERS), chars(t, "A-Za-z"), chars(t, ARABIC)
    case = lambda *v: f"(CASE WHEN {strip(x)} = '' OR len({w}) = 0 THEN {v[0]} WHEN {en} > 5 AND {en} > {arabic} * 2 THEN {v[1]} WHEN {letters} >= 2 AND {fa} >= {ar} THEN {v[2]} WHEN {ar} >= 2 AND {fa} = 0 AND {letters} = 0 THEN {v[3]} WHEN {arabic} >= 5 THEN CASE WHEN {fa} = 0 AND {ar} >= 1 THEN {v[4]} ELSE {v[5]} END WHEN {fa} >= 1 THEN {v[6]} ELSE {v[7]} END)"
    return case("'other'", "'en'", "'fa'", "'ar'", "'ar'", "'fa'", "'fa'", "'other'"), case("0.0::DOUBLE", "0.8::DOUBLE", f"least(1.0, 0.55 + 0.08 * {letters} + 0.05 * {fa})::DOUBLE", f"least(1.0, 0.5 + 0.1 * {ar})::DOUBLE", "0.6::DOUBLE", "0.55::DOUBLE", "0.5::DOUBLE", "0.3::DOUBLE")


LANG, CONF = tokens("text")
BASE = f"(SELECT *, {said('assistant')} AS a, {said('user')} AS u FROM {M})"
REASON = f"""(SELECT conv_id, turns, CASE
  WHEN NOT coalesce(m[1].role = 'user' AND m[len(m)].role = 'assistant' AND len(list_filter(range(2, len(m) + 1), lambda i: m[i].role = m[i - 1].role)) = 0, false) THEN 'bad_role_structure'
  WHEN fault IS NOT NULL THEN fault WHEN {talk('m')} = 'ar' THEN 'arabic_language'
  WHEN length(a) < 60 THEN 'answer_too_short' WHEN length(u) < 10 THEN 'prompt_too_short' WHEN length(a) > 4000 OR (length(a) + length(u)) / 2 > 3072 * 0.9 THEN 'too_long'
  WHEN {rep('w', 5)} > 0.45 OR {most('w', 12)} >= 3 THEN 'repetitive' WHEN len(w) > 40 AND {uniq('w')} < 0.12 THEN 'low_lexical_diversity'
  WHEN regexp_matches(a, {lit(PLACEHOLDER)}) THEN 'placeholder_artifact' WHEN {" OR ".join(f"ends_with(rtrim(a, chr(10) || ' '), {lit(e)})" for e in C.UNFINISHED)} THEN 'unfinished' WHEN {times('a', '```')} % 2 = 1 THEN 'unfinished_code_fence'
  WHEN {matches('a', C.SECRETS)} OR {matches('u', C.SECRETS)} THEN 'secret_like' ELSE 'ok' END AS reason
  FROM (SELECT *, {words('a')} AS w, list_filter(list_transform(m, lambda y: CASE WHEN y.content IS NULL THEN 'malformed' WHEN {strip('y.content')} = '' THEN 'empty_content' WHEN contains(y.content, chr(65533)) THEN 'corrupted_unicode' END), lambda y: y IS NOT NULL)[1] AS fault FROM {BASE}))"""
SMALL = C.SECRETS[:-1]
MALFORMED = f"CASE WHEN {times('text', '```')} % 2 = 1 THEN 'unclosed_fence' WHEN regexp_matches(text, {lit(C.METRIC_PLACEHOLDER)}) THEN 'placeholder' END"
BUCKET = "CAST(('0x' || array_to_string(list_transform(range(8, 0, -1), lambda i: substr({h}, 2 * i - 1, 2)), ''))::UBIGINT % 1000 AS BIGINT)"
split_of = lambda key: BUCKET.format(h=f"sha256('42:' || {key})")
SCORED = f"""(SELECT doc_id, source, CAST(CASE WHEN doc_id % 10 = 0 THEN 3 ELSE 1 END AS BIGINT) AS turns, round(2.0::DOUBLE * least(1.0::DOUBLE, length(text)::DOUBLE / 900) + 1.5::DOUBLE * least(1.0::DOUBLE, {chars('text', chr(0x200C))}::DOUBLE / 8) + 1.5::DOUBLE * (1.0::DOUBLE - {rep('w', 5)}) + 1.5::DOUBLE * least(1.0::DOUBLE, {uniq('w')})
  + CASE WHEN doc_id % 10 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + 0.8::DOUBLE * least(1.0::DOUBLE, length(string_split(text, chr(10))[1])::DOUBLE / 120), 6) AS score FROM (SELECT *, {words('text')} AS w FROM {D}))"""
JUDGED = f"""(SELECT id, seq, expect, category, text, text = '' AS empty, CASE WHEN text = '' THEN 'empty' ELSE {LANG} END AS got, CASE WHEN text <> '' THEN {MALFORMED} END AS malformed, text <> '' AND {rep('w', 12)} > 0.45 AS repetitive
  FROM (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS seq, coalesce(e, 'fa') AS expect, coalesce(c, 'unknown') AS category, {strip('d.text')} AS text, {words('d.text')} AS w
  FROM {D} d LEFT JOIN (SELECT item_id, ['fa', 'ar', 'en'][item_id % 3 + 1] AS e, 'c' || (item_id % 4) AS c FROM benchmark) b ON b.item_id = d.doc_id))"""
EXPECTED = "NOT empty AND expect IN ('fa', 'ar', 'en')"
AVG = "(sum(CASE WHEN empty THEN 0 ELSE length(text) END)::DOUBLE / greatest(1, count(*) FILTER (NOT empty)))"


def measured(answer: str) -> str:
    """Answers of the tables hold no code blocks, so blocks play no part here."""
    a = answer
    hits = " + ".join(f"CAST(contains(lower({a}), {lit(v)}) AS INT)" for v in C.RELEVANCE)
    bad = " + ".join(f"CAST(contains(lower({a}), {lit(v.lower())}) AS INT)" for v in C.BAD_MARKERS)
    build = " OR ".join(f"contains(lower(prompt), {lit(w)})" for w in C.BUILD_WORDS)
    return f"""(SELECT conv_id, turn, CAST(length({a}) AS BIGINT) AS answer_chars, false AS has_code, length({strip(a)}) < 30 AS is_empty, round({rep('w', 12)}, 3) AS repetition, CAST({bad} AS BIGINT) AS n_bad_markers,
      {chars(a, ARABIC)}::DOUBLE / greatest(1, length({a})) <= 0.15 AS lang_ok, CAST({hits} AS BIGINT) AS relevance_hits, {hits} >= 2 AS relevant, CASE WHEN {build} THEN false ELSE length({a}) > 120 END AS followed
      FROM (SELECT *, {words(a)} AS w FROM {PAIRS}))"""


def share(c: str) -> str:
    return f"round((count(*) FILTER ({c}))::DOUBLE / greatest(1, count(*)), 3)"


def inverted(c: str) -> str:
    return f"round(1 - (count(*) FILTER ({c}))::DOUBLE / greatest(1, count(*)), 3)"


KEY = lambda x: f"substr(lower({strip(f'regexp_replace({x}, chr(92) || chr(115) || chr(43), chr(32), chr(103))')}), 1, 180)"
FOLD = lambda x: f"lower({strip(f'regexp_replace({x}, chr(92) || chr(115) || chr(43), chr(32), chr(103))')})"
SHINGLE = f"(SELECT doc_id, list_min(list_transform(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {grams('w', 5)} END, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT)) AS k FROM (SELECT doc_id, {words('text')} AS w FROM {D}))"
SEGMENT = "text"
for _p, _to in ((r"\r\n|\r", "chr(10)"), (r"[ \t]+\n", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
    SEGMENT = f"regexp_replace({SEGMENT}, {lit(_p)}, {_to}, 'g')"


SETS = f"(SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {grams('w', 5)} END AS s FROM (SELECT doc_id, {words('text')} AS w FROM {D}))"


def affine(n: int) -> list[tuple[int, int]]:
    c, out = 0x9E3779B9, []
    for _ in range(2 * n):
        c = (c * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(1 + (c >> 34))
    return list(zip(out[::2], out[1::2]))


def choice(name: str, values: list[str]) -> str:
    return f"[{', '.join(map(lit, values))}][('0x' || substr(md5('4217:{name}:' || doc_id), 1, 8))::BIGINT % {len(values)} + 1]"


ORACLE_SQL = {
    "reason_counts": f"SELECT reason, count(*) AS n FROM {REASON} GROUP BY reason",
    "conversation_reasons": f"SELECT conv_id, turns, reason FROM {REASON}",
    "small_corpus_reasons": f"""SELECT conv_id, CASE WHEN len(m) < 2 THEN 'bad_messages' WHEN m[1].role = 'system' AND NOT coalesce(starts_with(m[1].content, 'You are'), false) THEN 'foreign_system'
      WHEN {first('user')} IS NULL OR {first('assistant')} IS NULL THEN 'missing_roles' WHEN len(list_filter(m, lambda y: y.content IS NULL OR length({strip('y.content')}) < 5)) > 0 THEN 'empty_content' WHEN length({first('assistant')}) < 40 THEN 'answer_too_short'
      WHEN length({first('user')}) > 4000 OR length({first('assistant')}) > 24000 THEN 'too_long' WHEN {rep('w', 12)} > 0.45 THEN 'repetitive' WHEN {matches(first('assistant'), SMALL)} OR {matches(first('user'), SMALL)} THEN 'secret_like' ELSE 'ok' END AS reason,
      {chars(f"coalesce({first('user')}, '')", ARABIC)}::DOUBLE / greatest(1, length(coalesce({first('user')}, ''))) <= 0.45 AS language_fits FROM (SELECT *, {words(f"coalesce({first('assistant')}, '')")} AS w FROM {M})""",
    "conversation_structure": f"""SELECT conv_id, len(m) >= 2 AND len(m) % 2 = 0 AND len(list_filter(range(1, len(m) + 1), lambda i: NOT coalesce(m[i].role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AND length({strip('m[i].content')}) >= CASE WHEN i % 2 = 1 THEN 4 ELSE 40 END, false))) = 0 AS strict,
      len(list_filter(m, lambda y: NOT coalesce(y.role IN ('system', 'user', 'assistant') AND {strip('y.content')} <> '', false))) = 0 AS valid, md5(array_to_string(list_transform(m[greatest(1, len(m) - 5):], lambda y: y.content), '|')) AS history_md5 FROM {M}""",
    "exact_dedup_conversations": f"SELECT min(conv_id) AS conv_id, any_value(turns) AS turns FROM {M} GROUP BY m",
    "exact_dedup_documents": f"SELECT doc_id, source FROM {D} QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "prompt_key_dedup": f"SELECT conv_id, turn FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY {KEY('prompt')} ORDER BY conv_id, turn) = 1",
    "prompt_answer_dedup": f"SELECT conv_id, turn FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY {FOLD('prompt')}, substr({FOLD('answer')}, 1, 600) ORDER BY conv_id, turn) = 1",
    "near_dedup_min_shingle": f"SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY k) > 60 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY k) END AS group_id FROM {SHINGLE}",
    "minhash_signatures": f"SELECT doc_id, md5(array_to_string([{', '.join(f'list_min(list_transform(h, lambda x: (x * {a} + {b}) % 4294967311))' for a, b in affine(32))}], ',')) AS md5 FROM (SELECT doc_id, list_transform(s, lambda y: ('0x' || substr(md5(y), 1, 8))::BIGINT) AS h FROM {SETS})",
    "similar_shingle_pairs": f"""WITH c AS (SELECT s, min(doc_id) AS k FROM (SELECT doc_id, list_sort(list_distinct(s)) AS s FROM {SETS}) GROUP BY s), e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM c),
      p AS (SELECT l.k AS a, r.k AS b, l.n AS na, r.n AS nb, count(*) AS m FROM e l JOIN e r ON l.x = r.x AND l.k < r.k GROUP BY ALL) SELECT a, b, round(m::DOUBLE / (na + nb - m), 6) AS jaccard FROM p WHERE m::DOUBLE / (na + nb - m) >= 0.8::DOUBLE""",
    "shingle_classes": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM (SELECT doc_id, list_sort(list_distinct(s)) AS s FROM {SETS})",
    "template_product": """SELECT format('bench-{:04d}', 6 * d + 2 * q + y + 1) AS id, ['history', 'science', 'poetry'][d + 1] AS domain, ['what', 'why', 'how'][q + 1] AS question, ['Briefly,', 'In detail,'][y + 1] AS style,
      ['Briefly,', 'In detail,'][y + 1] || ' ' || ['history', 'science', 'poetry'][d + 1] || ': ' || ['what', 'why', 'how'][q + 1] AS prompt FROM range(3) a(d), range(3) b(q), range(2) c(y)""",
    "document_text_measures": f"SELECT doc_id, round({rep('w', 5)}, 6) AS rep5, round({rep('w', 12)}, 6) AS rep12, CAST({most('w', 12)} AS BIGINT) AS max_gram, round({uniq('w')}, 6) AS uniq FROM (SELECT doc_id, {words('text')} AS w FROM {D})",
    "document_script_measures": f"SELECT doc_id, round({chars('text', ARABIC)}::DOUBLE / greatest(1, length(text)), 6) AS arabic, round({chars('text', 'A-Za-z')}::DOUBLE / greatest(1, length(text)), 6) AS latin, 0.0::DOUBLE AS corruption, CAST({chars('text', 'ضطظعغفقحخثصشسجرذدز')} AS BIGINT) AS arabic_only, round(length(text)::DOUBLE / 2.0, 1) AS est_tokens FROM {D}",
    "document_languages": f"SELECT doc_id, {language('text')} AS by_substrings, {LANG} AS by_tokens, {CONF} AS conf, CASE WHEN {strip('text')} = '' THEN 'code' ELSE {LANG} END AS response FROM {D}",
    "conversation_languages": f"SELECT conv_id, {talk('m')} AS lang FROM {M}",
    "document_flags": f"SELECT doc_id, {matches('text', C.SECRETS)} AS secret, regexp_matches(text, {lit(PLACEHOLDER)}) AS placeholder, {' OR '.join(f'ends_with(rtrim(text, chr(10) || chr(32)), {lit(e)})' for e in C.UNFINISHED)} AS unfinished, {times('text', '```')} % 2 = 1 AS odd_fences, {MALFORMED} AS malformed FROM {D}",
    "normalized_segments": f"SELECT doc_id, md5({SEGMENT}) AS md5 FROM {D}",
    "split_conversations": f"SELECT conv_id, {split_of('conv_id')} AS bucket, CASE WHEN {split_of('conv_id')} < 100 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations)",
    "sliced_split": f"SELECT doc_id, CASE WHEN r <= n THEN 'validation' WHEN r <= 2 * n THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS r, CAST(floor(count(*) OVER () * 0.05) AS BIGINT) AS n FROM {D})",
    "quality_ranks": f"SELECT doc_id, source, turns, score FROM {SCORED}",
    "best_per_source": f"SELECT doc_id, source, turns, score FROM {SCORED} QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 20",
    "balanced_sample": f"""WITH s AS MATERIALIZED (SELECT * FROM {SCORED}), n AS (SELECT count(*) FILTER (turns > 1) AS multi, count(DISTINCT source) AS groups FROM s),
      c AS (SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM s WHERE turns = 1), p AS (SELECT c.*, row_number() OVER (ORDER BY score DESC, doc_id) AS g FROM c, n WHERE r <= greatest(1, (400 - multi) // greatest(1, groups)))
      SELECT doc_id, source, turns, score FROM s WHERE turns > 1 UNION ALL SELECT doc_id, source, turns, score FROM p, n WHERE g <= greatest(0, 400 - multi)""",
    "length_statistics": f"SELECT count(*) AS n, round(avg(v), 1) AS mean, max(v) FILTER (r = n // 2) AS p50, max(v) FILTER (r = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(v) AS max FROM (SELECT CAST(length(text) AS BIGINT) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS r, count(*) OVER () AS n FROM {D})",
    "distributions": f"SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM {D} GROUP BY GROUPING SETS ((lang), (source), ())",
    "length_batches": f"SELECT doc_id, batch, sha256('42:' || batch) AS batch_order FROM (SELECT doc_id, (row_number() OVER (ORDER BY length(text), doc_id) - 1) // 16 AS batch FROM {D})",
    "shortest_documents": f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM {D} ORDER BY length(text), doc_id LIMIT 24",
    "round_robin_pick": f"SELECT doc_id, source FROM (SELECT *, regexp_replace(source, '-?[0-9]+$', '') AS cat FROM {D}) QUALIFY row_number() OVER (PARTITION BY cat ORDER BY doc_id) <= 50 ORDER BY row_number() OVER (PARTITION BY cat ORDER BY doc_id), cat LIMIT 50",
    "benchmark_metrics": f"""SELECT count(*) AS n_prompts, round((count(*) FILTER (expect = 'fa' AND got = 'fa'))::DOUBLE / nullif(count(*) FILTER (NOT empty AND expect = 'fa'), 0), 4) AS persian_response_rate, round((count(*) FILTER ({EXPECTED} AND expect = got))::DOUBLE / nullif(count(*) FILTER ({EXPECTED}), 0), 4) AS language_compliance,
      round((count(*) FILTER (expect = 'fa' AND got = 'ar'))::DOUBLE / nullif(count(*) FILTER (NOT empty AND expect = 'fa'), 0), 4) AS arabic_leakage_rate_on_fa, round((count(*) FILTER (empty))::DOUBLE / nullif(count(*), 0), 4) AS empty_response_rate, round((count(*) FILTER (repetitive))::DOUBLE / nullif(count(*), 0), 4) AS repetition_rate,
      round((count(*) FILTER (malformed IS NOT NULL))::DOUBLE / nullif(count(*), 0), 4) AS malformed_response_rate, round({AVG}, 1) AS average_response_length_chars, round({AVG} / 2.2::DOUBLE, 1) AS average_response_length_tokens_est, count(*) FILTER (empty OR (expect IN ('fa', 'ar', 'en') AND expect <> got)) AS misclassified_total FROM {JUDGED}""",
    "benchmark_by_category": f"SELECT category, count(*) AS n, count(*) FILTER (empty) AS empty, count(*) FILTER (malformed IS NOT NULL) AS malformed, count(*) FILTER (repetitive) AS repetitive, " + ", ".join(f"count(*) FILTER (NOT empty AND expect = '{x}') AS {x}_expect, count(*) FILTER (expect = '{x}' AND got = '{x}') AS {x}_ok" for x in ("fa", "ar", "en")) + f" FROM {JUDGED} GROUP BY category",
    "misclassified_examples": f"SELECT id, expect, got, substr(text, 1, 200) AS response FROM {JUDGED} WHERE empty OR (expect IN ('fa', 'ar', 'en') AND expect <> got) ORDER BY seq LIMIT 40",
    "answer_measures": f"SELECT * FROM {measured('answer')}",
    "answer_summary": f"SELECT count(*) AS n, {inverted('is_empty')} AS empty_rate, {share('is_empty')} AS empty_share, {share('has_code')} AS code_production_rate, {share('followed')} AS instruction_following, {share('lang_ok')} AS language_correct, {share('relevant')} AS relevance_rate, CAST(0 AS BIGINT) AS syntax_checked, 0.0::DOUBLE AS syntax_valid_rate, {inverted('n_bad_markers > 0')} AS bad_marker_rate, {share('n_bad_markers > 0')} AS bad_marker_share, round(avg(repetition), 3) AS mean_repetition FROM {measured('answer')}",
    "running_answer_counts": f"SELECT conv_id, turn, count(*) OVER w AS n, CAST(sum(CAST(relevant AS INT)) OVER w AS BIGINT) AS relevant FROM {measured('answer')} WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)",
    "side_by_side": " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT CAST({x} AS DOUBLE) FROM {measured('answer')}) AS a, (SELECT CAST({x} AS DOUBLE) FROM {measured('prompt')}) AS b" for m, x in (("n", "count(*)"), ("empty_share", share("is_empty")), ("relevance_rate", share("relevant")), ("mean_repetition", "round(avg(repetition), 3)"))),
    "chat_templates": f"""SELECT conv_id, md5(array_to_string(list_transform(m, lambda y: '<|im_start|>' || y.role || chr(10) || y.content || '<|im_end|>' || chr(10)), '')) AS md5, CAST(length(array_to_string(list_transform(m[1:greatest(1, len(m) - 1)], lambda y: '<|im_start|>' || y.role || chr(10) || y.content || '<|im_end|>' || chr(10)), '')) + length('<|im_start|>assistant') + 1 AS BIGINT) AS prompt_chars FROM {M}""",
    "label_masks": f"""SELECT doc_id, batch, max(n) OVER (PARTITION BY batch) AS width, CAST(5 + max(n) OVER (PARTITION BY batch) - n AS BIGINT) AS ignored, n AS real FROM (SELECT doc_id, len({words('text')}) AS n, (row_number() OVER (ORDER BY length(text), doc_id) - 1) // 16 AS batch FROM {D}) WHERE n > 5""",
    "budgeted_answers": f"""SELECT doc_id, CAST(coalesce(max(c) FILTER (c - 1 < 500), 1) - 1 AS BIGINT) AS kept_chars FROM (SELECT doc_id, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {D})) GROUP BY doc_id""",
    "planned_batches": f"SELECT category, need, unnest(range(0, CAST(ceil(need / 4) AS BIGINT))) AS batch FROM (SELECT source AS category, greatest(0.0::DOUBLE, 600.0::DOUBLE - count(*)) AS need FROM {D} GROUP BY source)",
    "unlabelled_documents": f"SELECT doc_id, source FROM {D} WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "corpus_union": f"SELECT 'document' AS origin, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM {D} UNION ALL SELECT 'conversation', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations",
    "task_matrix": """SELECT format('{}-{}-{:03d}', kind, lang, i) AS id, kind, lang, ['easy', 'medium', 'hard'][i % 3 + 1] AS difficulty FROM (SELECT kind, lang, unnest(range(n)) AS i FROM (VALUES ('page', 'fa', 110), ('page', 'en', 130), ('style', 'fa', 90), ('script', 'en', 40)) v(kind, lang, n))""",
    "prompt_cycle": """SELECT format('prompt-{:05d}', i) AS id, ['table', 'form', 'menu', 'card', 'chart'][i % 5 + 1] AS subject, ['write', 'fix', 'explain', 'extend'][(i // 5 + i) % 4 + 1] AS mode FROM range(110) r(i)""",
    "filled_templates": f"SELECT doc_id, 'A ' || {choice('colour', ['red', 'green', 'blue'])} || ' ' || {choice('kind', ['page', 'form', 'table', 'menu', 'card'])} || ' with a ' || {choice('part', ['header', 'footer'])} || '.' AS text FROM documents",
    "prompts_in_turn": "SELECT doc_id, item_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % (SELECT count(*) FROM benchmark) AS p FROM documents) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark) USING (p)",
    "prompts_zipped": "SELECT item_id, doc_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS p FROM benchmark) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) USING (p)",
    "extracted_files": f"""SELECT doc_id, 'pages/' || source || '.html' AS path, md5({strip("translate(text, '`*', '')")}) AS md5 FROM {D} UNION ALL SELECT doc_id, 'styles.css', md5('body {{ margin: 0 }}') FROM {D} UNION ALL SELECT doc_id, 'file3.sql', md5('SELECT 1') FROM {D}""",
    "salvaged_json": """SELECT doc_id, CAST(0 AS BIGINT) AS place, '{"id": ' || doc_id || ', "lang": "' || lang || '", "mark": "} ] {"}' AS object FROM documents UNION ALL SELECT doc_id, 1, '{"source": "' || source || '", "more": {"n": [1, 2]}}' FROM documents""",
    "learning_rates": "SELECT i AS step, round(1e6::DOUBLE * CASE WHEN i < 4 THEN 2e-4::DOUBLE * (i + 1) / 4 ELSE 2e-4::DOUBLE * 0.5 * (1 + cos(pi() * (i - 4) / greatest(1, n - 4))) END, 6) AS micro_rate FROM (SELECT n, unnest(range(n)) AS i FROM (SELECT (count(*) + 15) // 16 AS n FROM documents))",
    "long_enough_pairs": f"SELECT conv_id, turn FROM {PAIRS} WHERE length(prompt) >= 10 AND length(answer) >= 40",
    "training_log": "SELECT event_id // 64 AS step, count(*) AS n, CAST(sum(coalesce(length(props), 0)) AS BIGINT) AS tokens, round(avg(value), 6) AS mean_loss FROM events GROUP BY 1",
    "split_presence": f"SELECT w AS split, count(s) AS n, count(s) > 0 AS present FROM (VALUES ('train'), ('validation'), ('test')) v(w) LEFT JOIN (SELECT CASE WHEN {split_of('conv_id')} < 100 THEN 'validation' ELSE 'train' END AS s FROM (SELECT DISTINCT conv_id FROM conversations)) ON s = w GROUP BY w",
    "budgeted_sample": f"SELECT doc_id, source FROM {D} ORDER BY sha256('42:' || doc_id), doc_id LIMIT 120",
    "config_hashes": """SELECT source, sha256('{"last":' || max(doc_id) || ',"rows":' || count(*) || ',"source":"' || source || '"}') AS sha256 FROM documents GROUP BY source""",
    "fitting_configs": "SELECT CAST(coalesce(max(512 * (n_nationkey + 1)), 2048) AS BIGINT) AS seq_len FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey * 0.75 + 3 < 14.5",
    "labelled_documents": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "streamed_turns": f"SELECT conv_id, turn, md5(text) AS md5, round({rep('w', 12)}, 6) AS repetition, {matches('text', C.SECRETS)} AS secret, CASE WHEN {split_of('conv_id')} < 100 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, {words('text')} AS w FROM (SELECT conv_id, turn, {SEGMENT} AS text FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)))",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price FROM lineitem GROUP BY ALL",
    "streamed_event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}


SIGNED = f"(SELECT doc_id, [{', '.join(f'list_min(list_transform(h, lambda x: (x * {a} + {b}) % 4294967311))' for a, b in affine(32))}] AS g FROM (SELECT doc_id, list_transform(s, lambda y: ('0x' || substr(md5(y), 1, 8))::BIGINT) AS h FROM {SETS}))"
DIGEST = "md5(array_to_string(list_transform(m, lambda y: y.role || ':' || y.content), '|'))"

PREPARED = f"""ok AS (SELECT c.conv_id, c.m, CAST(len(c.m) // 2 AS BIGINT) AS turns FROM {REASON} r JOIN {M} c ON r.conv_id = c.conv_id WHERE reason = 'ok' AND len(c.m) >= 2),
u AS (SELECT *, array_to_string(list_transform(m, lambda y: y.content), ' ') AS text FROM ok QUALIFY row_number() OVER (PARTITION BY m ORDER BY conv_id) = 1),
h AS (SELECT *, list_min(list_transform(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {grams('w', 5)} END, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT)) AS k FROM (SELECT *, {words('text')} AS w FROM u)),
kept AS (SELECT conv_id, m, turns FROM h QUALIFY count(*) OVER (PARTITION BY k) > 60 OR conv_id = min(conv_id) OVER (PARTITION BY k)),
s AS (SELECT conv_id, turns, 'd' || (conv_id % 5) AS domain, 2.0::DOUBLE * least(1.0::DOUBLE, length(a)::DOUBLE / 900) + 1.5::DOUBLE * least(1.0::DOUBLE, {chars('a', chr(0x200C))}::DOUBLE / 8) + 1.5::DOUBLE * (1.0::DOUBLE - {rep('w', 5)}) + 1.5::DOUBLE * least(1.0::DOUBLE, {uniq('w')})
  + CASE WHEN turns > 2 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + 0.8::DOUBLE * least(1.0::DOUBLE, length(x)::DOUBLE / 120) AS score FROM (SELECT *, {words('a')} AS w FROM (SELECT *, {said('assistant')} AS a, {said('user')} AS x FROM kept))),
b AS (SELECT greatest(1, (40 - count(*) FILTER (turns > 1)) // greatest(1, (SELECT count(DISTINCT conv_id % 5) FROM conversations))) AS cap, greatest(0, 40 - count(*) FILTER (turns > 1)) AS room FROM s),
one AS (SELECT s.* FROM s, b WHERE turns = 1 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score DESC, conv_id) <= cap),
picked AS (SELECT *, CASE WHEN {split_of('conv_id')} < 100 THEN 'validation' ELSE 'train' END AS split FROM (SELECT * FROM s WHERE turns > 1 UNION ALL SELECT one.* FROM one, b QUALIFY row_number() OVER (ORDER BY score DESC, conv_id) <= room))"""
ORACLE_SQL |= {
    "normalized_texts": f"SELECT doc_id, md5(text || chr(10) || 'کتاب ی ' || doc_id || ' `ي ك`') AS md5 FROM {D}",
    "normalized_conversations": f"SELECT conv_id, turns, md5(array_to_string(list_transform(m, lambda y: y.role || ':' || y.content || ' ی'), '|')) AS md5 FROM {M}",
    "folded_texts": f"SELECT doc_id, md5(lower({strip(f"regexp_replace(nfc_normalize(text), '{chr(92)}s+', ' ', 'g')")})) AS md5 FROM {D}",
    "lsh_near_duplicates": f"""WITH RECURSIVE g AS MATERIALIZED {SIGNED}, b AS (SELECT doc_id, unnest(range(8)) AS band, unnest(list_transform(range(8), lambda i: array_to_string(g[4 * i + 1:4 * i + 4], ','))) AS h FROM g),
      c AS (SELECT *, count(*) OVER (PARTITION BY band, h) AS n FROM b), p AS (SELECT DISTINCT l.doc_id AS a, r.doc_id AS b FROM c l JOIN c r ON l.band = r.band AND l.h = r.h AND l.doc_id < r.doc_id WHERE l.n <= 60),
      v AS MATERIALIZED (SELECT a, b FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE len(list_filter(range(1, 33), lambda i: x.g[i] = y.g[i])) / 32.0 >= 0.85),
      e AS (SELECT a, b FROM v UNION ALL SELECT b, a FROM v), r AS (SELECT a AS s, a AS x FROM e UNION SELECT r.s, e.b FROM r JOIN e ON r.x = e.a)
      SELECT d.doc_id, coalesce(min(x), d.doc_id) AS group_id FROM documents d LEFT JOIN r ON r.s = d.doc_id GROUP BY d.doc_id""",
    "truncated_answers": f"""SELECT doc_id, CASE WHEN length(k) > 0 AND length(k) >= 0.1 * w THEN md5(k) END AS md5 FROM (SELECT doc_id, w, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c <= 500), ''), '\\s+$', '') AS k
      FROM (SELECT doc_id, i, line, w, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, length(regexp_replace(text, '\\s+$', '')) AS w FROM {D})) GROUP BY doc_id, w)""",
    "preparation_stats": f"""WITH {PREPARED} SELECT (SELECT count(*) FROM {M}) AS n_raw, (SELECT count(*) FROM {M}) - (SELECT count(*) FROM ok) AS n_rejected, (SELECT count(*) FROM ok) - (SELECT count(*) FROM u) AS n_exact, (SELECT count(*) FROM u) - (SELECT count(*) FROM kept) AS n_near,
      (SELECT count(*) FROM kept) AS n_kept, count(*) AS n_picked, count(*) FILTER (turns > 1) AS n_multi, count(*) FILTER (split = 'validation') AS n_validation, CAST(0 AS BIGINT) AS gap, CAST(0 AS BIGINT) AS split_gap FROM picked""",
    "preparation_picked": f"WITH {PREPARED} SELECT conv_id, turns, domain, round(score, 6) AS score, split FROM picked",
    "split_distributions": f"SELECT turns, domain, lang, count(*) AS n FROM (SELECT turns, 'd' || (conv_id % 5) AS domain, {talk('m')} AS lang, conv_id FROM {M}) WHERE {split_of('conv_id')} >= 100 GROUP BY GROUPING SETS ((turns), (domain), (lang))",
    "cut_answers": f"SELECT conv_id, turn, substr(prompt, 1, 120) AS prompt, substr(answer, 1, 1200) AS answer FROM {PAIRS}",
    "languages_with_model": f"""SELECT doc_id, CASE WHEN own THEN l ELSE g END AS lang, round(CASE WHEN own THEN c ELSE p END, 6) AS conf FROM (SELECT *, doc_id % 4 = 0 OR (p < 0.75 AND l IN ('fa', 'ar') AND l <> g AND c > p) AS own
      FROM (SELECT doc_id, {LANG} AS l, {CONF} AS c, ['en', 'fa', 'other'][doc_id % 3 + 1] AS g, (doc_id % 10)::DOUBLE / 10 AS p FROM {D}))""",
    "derived_configs": """SELECT n_nationkey, CASE WHEN gpu THEN 'cuda' ELSE 'cpu' END AS device, greatest(1, cores) AS threads, CAST(CASE WHEN gpu OR ram >= 12 THEN 768 WHEN ram >= 8 THEN 384 ELSE 256 END AS BIGINT) AS max_seq_len,
      CAST(CASE WHEN roomy THEN 2 ELSE 1 END AS BIGINT) AS batch_size, CAST(CASE WHEN roomy THEN 4 ELSE 8 END AS BIGINT) AS accumulation, CAST(CASE WHEN roomy THEN 16 ELSE 12 END AS BIGINT) AS lora_r, CAST(CASE WHEN roomy THEN 32 ELSE 24 END AS BIGINT) AS lora_alpha, CASE WHEN roomy THEN 1.5e-4::DOUBLE ELSE 1.2e-4::DOUBLE END AS learning_rate
      FROM (SELECT n_nationkey, n_nationkey * 0.75 AS ram, CAST(n_nationkey % 9 AS BIGINT) AS cores, n_nationkey % 7 = 0 AS gpu, n_nationkey % 7 = 0 OR n_nationkey * 0.75 >= 8 AS roomy FROM nation)""",
    "validated_files": "SELECT 'css' AS kind, count(*) AS n, count(*) FILTER (doc_id % 3 <> 0) AS valid FROM documents UNION ALL SELECT 'html', count(*), count(*) FILTER (doc_id % 5 <> 0) FROM documents",
    "json_lines_round_trip": f"SELECT 'd' || (conv_id % 5) AS domain, 'raw' AS source, {DIGEST} AS md5 FROM {M}",
    "malformed_lines": "SELECT count(*) FILTER (doc_id % 7 = 0 OR doc_id % 11 <> 0) AS rows, count(*) FILTER (doc_id % 7 = 0) AS malformed, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 11 <> 0) AS ids, count(*) FILTER (doc_id % 7 = 0 OR doc_id % 11 <> 0) AS lines, count(*) FILTER (doc_id % 7 = 0) AS by_file FROM documents",
    "split_files": f"SELECT CASE WHEN {split_of('conv_id')} < 100 THEN 'validation' ELSE 'train' END AS split, false AS lineage, count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY ALL",
    "resumed_append": "SELECT count(*) FILTER (conv_id % 5 < 3) AS first, count(*) FILTER (conv_id % 5 >= 3) AS second, CAST(0 AS BIGINT) AS third, count(*) AS rows, CAST(3 AS BIGINT) AS logged FROM (SELECT DISTINCT conv_id FROM conversations)",
    "domain_parquet_round_trip": "SELECT 'd' || (conv_id % 5) AS domain, count(*) AS n, true AS stable FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1",
    "documents_and_reports": """SELECT 'b.html' AS file, CAST(4 AS BIGINT) AS bytes, sha256('<p>' || chr(10)) AS sha256 UNION ALL SELECT 'e.css', 4, sha256('q{}' || chr(10)) UNION ALL SELECT v.f, v.n, NULL FROM (SELECT unnest([struct_pack(f := 'prompts', n := count(*)), struct_pack(f := 'stats', n := count(*)), struct_pack(f := 'removed', n := 3),
      struct_pack(f := 'fine', n := 1), struct_pack(f := 'died', n := 0), struct_pack(f := 'files', n := 2), struct_pack(f := 'lines', n := count(*) + 3), struct_pack(f := 'title', n := 1), struct_pack(f := 'done', n := 8), struct_pack(f := 'none', n := 1)]) AS v FROM benchmark)""",
}
