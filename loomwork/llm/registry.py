"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe_encode_decode
from .collocations import op13_collocations
from .decontam import op5_decontamination
from .fim import op11_fill_in_middle
from .line_dedup import op9_line_dedup
from .packing import op12_packing
from .pii import op1_pii
from .quality import op7_quality_classifier
from .rules import DELTA, RISK, RULES, op8_quality_rules
from .simhash import op2_simhash_near_dedup
from .substring_dedup import op10_substring_dedup
from .token_counts import op4_token_counts
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_pii, op2_simhash_near_dedup, op3_bpe_encode_decode, op4_token_counts, op5_decontamination, op6_toxicity, op7_quality_classifier, op8_quality_rules, op9_line_dedup, op10_substring_dedup, op11_fill_in_middle, op12_packing, op13_collocations)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '')"
_CLEAN_LINE = r"trim(translate({x}, chr(9) || chr(11) || chr(12) || chr(13), '    '))"

_SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
own AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM win JOIN own USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, line, {_CLEAN_LINE.format(x="line")} AS x FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c WHERE x <> ''),
w AS (SELECT doc_id, p, lead(p, 2) OVER s AS last, struct_pack(a := x, b := lead(x) OVER s, c := lead(x, 2) OVER s) AS k FROM r WINDOW s AS (PARTITION BY doc_id ORDER BY p)),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w WHERE last IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest([0, 1, 2]) AS k)),
kept AS (SELECT c.doc_id, c.i, c.line, c.x, gone.p IS NOT NULL AS out FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND c.i = r.i LEFT JOIN gone ON r.doc_id = gone.doc_id AND r.p = gone.p)
SELECT doc_id, CAST(count(*) FILTER (out) AS BIGINT) AS n_removed, CAST(count(*) FILTER (NOT out AND x <> '') AS BIGINT) AS n_left,
  sha256(CASE WHEN count(*) FILTER (out) > 0 AND count(*) FILTER (NOT out AND x <> '') = 0 THEN '' ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '') END) AS kept_sha256
FROM kept GROUP BY doc_id
"""

_HEAD = "CASE WHEN {k} = 0 THEN '' WHEN {k} >= n THEN text ELSE array_to_string(p[1:{k}], chr(10)) || chr(10) END"
_FIM = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS p, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, CAST(len(p) - (p[len(p)] = '')::INT AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
c AS (SELECT *, {_HEAD.format(k="a")} AS to_a, {_HEAD.format(k="b")} AS to_b FROM f),
x AS (SELECT *, to_a AS prefix, to_b[length(to_a) + 1:] AS middle, text[length(to_b) + 1:] AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM x
"""

_PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM d),
u AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM u),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
c3 AS (SELECT f3.*, x.f AS l1, y.f AS r1, z.f AS l2, t.f AS r2 FROM f3 JOIN f1 x ON f3.lang = x.lang AND f3.w1 = x.w1 JOIN f2 y ON f3.lang = y.lang AND f3.w2 = y.w1 AND f3.w3 = y.w2
  JOIN f2 z ON f3.lang = z.lang AND f3.w1 = z.w1 AND f3.w2 = z.w2 JOIN f1 t ON f3.lang = t.lang AND f3.w3 = t.w1),
s3 AS (SELECT *, CAST(1000000 * a::HUGEINT * a // (l1::HUGEINT * r1) AS BIGINT) AS s1, CAST(1000000 * a::HUGEINT * a // (l2::HUGEINT * r2) AS BIGINT) AS s2 FROM c3),
over AS (SELECT lang, w1, w2, max(a) AS m FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
c2 AS (SELECT b.lang, b.w1, b.w2, b.f AS a, x.f AS l, y.f AS r FROM f2 b JOIN f1 x ON b.lang = x.lang AND b.w1 = x.w1 JOIN f1 y ON b.lang = y.lang AND b.w2 = y.w1 LEFT JOIN over o ON b.lang = o.lang AND b.w1 = o.w1 AND b.w2 = o.w2
  WHERE b.f >= 10 AND (o.m IS NULL OR 100 * o.m < 50 * b.f)),
every AS (SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, least(s1, s2) AS score FROM s3
  UNION ALL SELECT lang, w1 || ' ' || w2, a, l, r, CAST(1000000 * a::HUGEINT * a // (l::HUGEINT * r) AS BIGINT) FROM c2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT r.lang, rank, phrase, a, l, r.r, CAST(n.n AS BIGINT) AS n, score FROM ranked r JOIN n ON r.lang = n.lang WHERE rank <= 2000
"""


def _rules_sql() -> str:
    counts = ", ".join(f"({r!r}, {float(c)}, count(*) FILTER ({expr.replace(' / ', '::DOUBLE / ')} > {c}))" for r, (expr, grid) in RULES.items() for c in grid)
    over = " OR ".join(f"coalesce({expr.replace(' / ', '::DOUBLE / ')} > c.{r}, false)" for r, (expr, _) in RULES.items())
    wide = ", ".join(f"max(cutoff) FILTER (rule = {r!r}) AS {r}" for r in RULES)
    risk = RISK / len(RULES)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_CLEAN_LINE.format(x="x")} <> '') AS l FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS k FROM t WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY 1),
f AS (SELECT t.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_marks,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
held AS (SELECT b.* FROM b SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) q ON b.doc_id = q.doc_id WHERE NOT base_failed),
strata AS (SELECT lang, count(*) AS n FROM held GROUP BY lang),
tests AS (SELECT lang, x.r AS rule, x.c AS cutoff, x.k AS k FROM (SELECT lang, unnest([{counts.replace("('", "struct_pack(r := '").replace("', ", "', c := ").replace(", count", ", k := count")}]) AS x FROM held GROUP BY lang)),
tails AS (SELECT tests.*, n, (SELECT count(*) FROM strata) AS m, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk}))) FROM (SELECT unnest(range(0, k + 1)) AS j)) AS tail FROM tests JOIN strata ON tests.lang IS NOT DISTINCT FROM strata.lang),
ok AS (SELECT *, k < n * {risk} AND tail <= {DELTA} / {len(RULES)} / m AS ok FROM tails),
cuts AS (SELECT lang, rule, min(cutoff) AS cutoff FROM (SELECT *, max(cutoff) FILTER (NOT ok) OVER (PARTITION BY lang, rule) AS stop FROM ok) WHERE ok AND (stop IS NULL OR cutoff > stop) GROUP BY 1, 2),
c AS (SELECT lang, {wide} FROM cuts GROUP BY lang)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over}) AS kept FROM b LEFT JOIN c ON b.lang = c.lang
"""


ORACLE_SQL = {"op11_fill_in_middle": _FIM, "op13_collocations": _PHRASES, "op8_quality_rules": _rules_sql(), "op9_line_dedup": _LINES, "op10_substring_dedup": _SUBSTRINGS}
