"""DuckDB counterparts of the corpus queries."""
from .quality_rules import STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
# Characters that separate words, as DuckDB writes them.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(" ".join(STOP_WORDS.values()).split())))

SQL["op3_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') ws, list_filter(string_split(t, chr(10)), lambda l: translate(l, {SPACES}, '') <> '') ls FROM d),
g AS (SELECT doc_id, unnest(ws) a, generate_subscripts(ws, 1) i FROM w),
h AS (SELECT doc_id, i, a, lead(a) OVER x b, lead(a, 2) OVER x c FROM g WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) n FROM h WHERE c IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT i + k) n_repeat FROM r, (VALUES (0), (1), (2)) s(k) WHERE n >= 2 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT n_words, length(translate(t, {SPACES}, ''))::BIGINT word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT n_symbols, len(ls)::BIGINT n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT n_repeat_words,
  len(list_filter(ws, lambda x: regexp_replace(translate(x, {A_Z}), '[.,;:!?]+$', '') IN ({_STOP})))::BIGINT n_stop_words,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*[-*•]')))::BIGINT n_bullet_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$')))::BIGINT n_ellipsis_lines
  FROM w LEFT JOIN p USING (doc_id)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END::DOUBLE word_length, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END::DOUBLE symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END::DOUBLE stop_word_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END::DOUBLE duplicate_line_ratio,
  CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0 END::DOUBLE bullet_line_ratio, CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END::DOUBLE ellipsis_line_ratio,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m)
SELECT *, NOT base_failed AND word_length >= 2 AND word_length <= 20 AND symbol_ratio <= 0.1 AND stop_word_ratio >= 0.005 AND duplicate_line_ratio <= 0.5
  AND bullet_line_ratio <= 0.9 AND ellipsis_line_ratio <= 0.3 kept FROM q"""

SQL["op4_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN first <> page_id THEN first END refers_to FROM f"""

_URL_PARTS = f"""
WITH a AS (SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') h FROM a),
c AS (SELECT page_id, html, coalesce(translate(h, {A_Z}), '') host, coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') path,
  regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') q FROM b),
u AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END canonical FROM c),
k AS (SELECT canonical, min(canonical) OVER (PARTITION BY sha256(html)) first FROM u WHERE strlen(html) >= 100 AND canonical IS NOT NULL),
listed AS (SELECT canonical FROM k WHERE canonical > first UNION SELECT canonical FROM u WHERE canonical IS NOT NULL AND (len(regexp_extract_all(html, '###|[*][*][*]|%%%')) >= 10 OR len(regexp_extract_all(html, '<p>')) < 2))"""

SQL["op9_url_filter"] = _URL_PARTS + """,
rules(outcome, rule, domain, prefix) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
j AS (SELECT page_id, arg_max(rule, length(rule)) rule, arg_max(outcome, length(rule)) outcome FROM u JOIN rules
  ON (host = domain OR suffix(host, '.' || domain)) AND prefix(path, rules.prefix) GROUP BY page_id)
SELECT u.page_id, host, path, j.rule, coalesce(outcome, CASE WHEN u.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) verdict
FROM u LEFT JOIN j USING (page_id)"""

SQL["op1_mix_sources"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT size FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, 2 * sum(size)::DOUBLE most, row_number() OVER (ORDER BY source NULLS LAST) - 1 place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE weight FROM s),
b AS (SELECT 1.5 * sum(source_size)::DOUBLE budget FROM s),
o AS (SELECT *, coalesce(sum(most) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) dry, sum(weight) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) rest
  FROM w WINDOW x AS (ORDER BY most / weight, place)),
l AS (SELECT arg_min((budget - dry) / rest, (most / weight, place)) FILTER (WHERE most / weight > (budget - dry) / rest) water FROM o, b),
t AS (SELECT *, CASE WHEN water IS NULL THEN most ELSE least(most, weight * water) END target FROM w, l),
q AS (SELECT doc_id, size, source_size, target, weight, place,
  sum(size) OVER (PARTITION BY place ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size) served FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (served + k * source_size) / weight finish, served + k * source_size pos FROM q, (VALUES (0), (1)) v(k)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, place, k, pos) run FROM c)
SELECT doc_id, size, source_size, target, sum(CASE WHEN run <= budget THEN size ELSE 0 END)::BIGINT taken FROM r, b GROUP BY ALL"""

SQL["op7_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
l AS (SELECT r, generate_subscripts(ls, 1) i, unnest(ls) line FROM d),
k AS (SELECT r, i, line, translate(trim(line, {SPACES}), {A_Z}) key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT r, i, line, f.key IS NOT NULL gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, n::BIGINT n_lines, g::BIGINT n_dropped, sha256(coalesce(t, '')) kept_sha256
FROM (SELECT r, count(*) n, count(*) FILTER (gone) g, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) t FROM j GROUP BY r) JOIN d USING (r)"""

SQL["op11_exact_dedup"] = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') t FROM documents),
g AS (SELECT t, min(doc_id) keep_id, count(*)::BIGINT group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(t) text_sha256 FROM d JOIN g USING (t)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL["op12_ranked_search"] = f"""
WITH p AS (SELECT doc_id, term, count(*)::BIGINT tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {A_Z}), '{_TERM}')) term FROM documents) GROUP BY ALL),
q AS (SELECT item_id, term, count(*)::BIGINT times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {A_Z}), '{_TERM}')) term FROM benchmark) GROUP BY ALL),
z AS (SELECT doc_id, sum(tf)::BIGINT n FROM p GROUP BY doc_id), a AS (SELECT count(*)::BIGINT all_docs, sum(n)::BIGINT all_terms FROM z),
f AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1)))::BIGINT w FROM p, a GROUP BY term, all_docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))))::BIGINT score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN z USING (doc_id), a GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
