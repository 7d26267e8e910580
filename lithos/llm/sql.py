"""The queries as DuckDB SQL over the same tables, where SQL can express them."""

from __future__ import annotations

from . import chat_format, line_dedup, mixing, quality, url_filter

_W = r"[^\x20\x09-\x0D]+"
_B = r"[\x20\x09-\x0D]+"
_U, _L = url_filter.UPPER, url_filter.LOWER


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_length(col: str) -> str:
    control = "|".join("".join("\\" + c if c in "|[]/<>" else c for c in s) for s in chat_format.CONTROL)
    control = control.replace("\\/", "/").replace("\\<", "<").replace("\\>", ">")
    doubled = f"replace({col}, '\\', '\\\\')"
    return f"length({doubled}) + len(regexp_extract_all({doubled}, {_lit(control)}))"


_CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.OPEN) + len(chat_format.CLOSE) + 2} + {_escaped_length('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped_length('text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_WARC = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first, count(*) OVER (PARTITION BY hex) AS n FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g3 AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g3) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY r),
l AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, host, text, line, trim(regexp_replace(lower(line), '{_B}', ' ', 'g')) AS plain FROM l WHERE regexp_matches(line, '{_W}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r),
total AS (SELECT host, count(DISTINCT text) AS total FROM d GROUP BY host),
often AS (SELECT lw.host, plain FROM lw JOIN total ON lw.host IS NOT DISTINCT FROM total.host GROUP BY lw.host, plain, total HAVING count(DISTINCT text) >= {quality.LEAST} AND count(DISTINCT text) > {quality.SHARE} * total),
gone AS (SELECT r, sum(len(string_split(plain, ' ')))::BIGINT AS n_common_words FROM lw WHERE EXISTS (SELECT 1 FROM often o WHERE o.plain = lw.plain AND o.host IS NOT DISTINCT FROM lw.host) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_common_words, 0) AS n_common_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_words - n_common_words < {quality.REST} * n_words) AS kept FROM j
"""

_weights = ", ".join(f"({i}, {float(w)})" for i, w in enumerate(mixing.WEIGHTS))
_MIX = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM d GROUP BY source),
sw AS (SELECT s.*, w, {float(mixing.EPOCHS)}::DOUBLE * source_size AS cap, {mixing.TOTAL}::DOUBLE * sum(source_size) OVER () AS everything FROM s JOIN (VALUES {_weights}) v(k, w) ON n % {len(mixing.WEIGHTS)} = k),
o AS (SELECT *, everything - coalesce(sum(cap) OVER before, 0) AS left_over, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights FROM sw WINDOW before AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, left_over::DOUBLE / weights::DOUBLE AS level, cap > w * (left_over::DOUBLE / weights::DOUBLE) AS open FROM o),
t AS (SELECT source, source_size, (CASE WHEN open THEN w * (SELECT arg_min(level, (cap / w, n)) FROM l WHERE open) ELSE cap END)::DOUBLE AS target FROM l),
b AS (SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS whole, floor(target)::BIGINT % greatest(source_size, 1) AS rest FROM t),
k AS (SELECT d.*, b.source_size, target, whole, rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size), doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(rest - start, 0)))::BIGINT AS taken FROM k
"""

_T = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LEAKS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_U}', '{_L}'), '{_T}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_U}', '{_L}'), '{_T}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, dw.k, i, item FROM dw JOIN win USING (k, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def _reputation_sql() -> str:
    def level(name: str, source: str, key: str, parent: str, on: str) -> str:
        return f"""
{name}_g AS (SELECT g.*, p.mean AS m0, p.known AS known0 FROM ({source}) g JOIN {parent} p ON {on}),
{name}_k AS (SELECT least(greatest(1 / greatest(coalesce((sum(CASE WHEN n > 1 THEN (bad - n * m0) ** 2 / n END) - sum(CASE WHEN n > 1 THEN m0 * (1 - m0) END)) / nullif(sum(CASE WHEN n > 1 THEN (n - 1) * m0 * (1 - m0) END), 0), 0), 1e-9) - 1, 1), 1000) AS k FROM {name}_g),
{name} AS (SELECT *, (bad + k * m0) / (n + k) AS mean, n + k AS known FROM (SELECT {name}_g.*, least(k, known0) AS k FROM {name}_g, {name}_k))"""

    two = ", ".join(map(_lit, url_filter.DOUBLE))
    part = lambda n: f"array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - {n - 1}, 1), NULL), '.')"
    names = ", ".join(f"({_lit(v)}, {_lit(h)}, {_lit(p)})" for v, h, p in url_filter.RULES)
    return f"""
WITH r AS (SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_U}', '{_L}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
y AS (SELECT host, (toxic IS NOT DISTINCT FROM 1 OR quality IS NOT DISTINCT FROM 0)::INT AS bad FROM r JOIN labels ON page_id = doc_id WHERE host <> ''),
hosts AS (SELECT host, CASE WHEN {part(2)} IN ({two}) THEN {part(2)} ELSE {part(1)} END AS suffix, CASE WHEN {part(2)} IN ({two}) THEN {part(3)} ELSE {part(2)} END AS domain, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM y GROUP BY host),
everything AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean, coalesce(sum(n), 0) + 2 AS known FROM hosts),
{level('suffixes', 'SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix', 'suffix', 'everything', 'true')},
{level('domains', 'SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain', 'domain', 'suffixes', 'g.suffix = p.suffix')},
{level('posts', 'SELECT host, domain, n, bad FROM hosts', 'host', 'domains', 'g.domain = p.domain')},
scores AS (SELECT host, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (known + 1)) AS score FROM posts),
rules(what, h, p) AS (VALUES {names}),
fit AS (SELECT r, arg_max((what, h || p), length(h || p)) AS best FROM r JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, r.host, path, best[2] AS rule, coalesce(best[1], CASE WHEN score > {url_filter.MOST} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN fit USING (r) LEFT JOIN scores ON r.host = scores.host
"""


_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, text, coalesce(text, '') AS safe FROM documents),
l AS (SELECT r, host, safe, unnest(string_split(safe, chr(10))) AS line, generate_subscripts(string_split(safe, chr(10)), 1) AS i FROM d),
lw AS (SELECT *, trim(regexp_replace(lower(line), '{_B}', ' ', 'g')) AS plain FROM l),
total AS (SELECT host, count(DISTINCT safe) AS total FROM d GROUP BY host),
often AS (SELECT lw.host, plain FROM lw JOIN total ON lw.host IS NOT DISTINCT FROM total.host WHERE plain <> '' GROUP BY lw.host, plain, total HAVING count(DISTINCT safe) >= {line_dedup.LEAST} AND count(DISTINCT safe) > {line_dedup.RATIO} * total),
x AS (SELECT lw.*, o.plain IS NOT NULL AS gone FROM lw LEFT JOIN often o ON o.plain = lw.plain AND o.host IS NOT DISTINCT FROM lw.host),
a AS (SELECT r, count(*) FILTER (plain <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM x GROUP BY r)
SELECT doc_id, n_lines, n_dropped, CASE WHEN text IS NOT NULL THEN length(kept) END::BIGINT AS kept_chars, md5(kept) AS kept_md5 FROM d JOIN a USING (r)
"""

ORACLES: dict[str, str] = {
    "op1_chat_format": _CHAT,
    "op5_warc": _WARC,
    "op6_quality_rules": _QUALITY,
    "op7_mixing": _MIX,
    "op8_decontamination": _LEAKS,
    "op9_url_filter": _reputation_sql(),
    "op10_line_dedup": _LINES,
}
