"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

import re

from . import license_scan, quality_rules, url_filter

_SPACE = r"[\x20\x09-\x0D]+"


def _op1() -> str:
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in url_filter.RULES)
    z, alike = url_filter.Z, url_filter.ALIKE

    def level(name: str, key: str, source: str) -> str:
        return f"""
{name}_a AS (SELECT greatest(1.0, least({alike}, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 END, {alike}))) AS a FROM (
  SELECT (sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0.0) AS rho FROM {source})),
{name}_m AS (SELECT {key}, n, k, (k + a * m) / (n + a) AS m, a FROM {source}, {name}_a)"""

    return rf"""
WITH p AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
host AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, n, k FROM (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k FROM p LEFT JOIN o USING (page_id) GROUP BY 1)),
domain AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM host GROUP BY ALL),
suffix AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domain GROUP BY ALL),
suffix_j AS (SELECT suffix, n, k, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM host) AS m FROM suffix),
{level("suffix", "suffix", "suffix_j")},
domain_j AS (SELECT domain, d.n, d.k, m FROM domain d JOIN suffix_m USING (suffix)),
{level("domain", "domain", "domain_j")},
host_j AS (SELECT host, h.n, h.k, m FROM host h JOIN domain_m USING (domain)),
{level("host", "host", "host_j")},
rep AS (SELECT host, n, least(1.0, m + {z} * sqrt(m * (1 - m) / (n + a + 1))) AS upper FROM host_m),
r(rule, rh, rp, v) AS (VALUES {rules}),
hit AS (SELECT u.host, u.path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM (SELECT DISTINCT host, path FROM p) u JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.v, CASE WHEN rep.upper < {url_filter.RATIO} * (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM host) THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_labelled
FROM p LEFT JOIN rep USING (host) LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path
"""


OP2 = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.i <> q.i)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, coalesce(score, 0) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY coalesce(score, 0) DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""


def _op5() -> str:
    words = [(k, sorted({w for w in re.split(license_scan.BREAK, v.lower()) if w})) for k, v in license_scan.templates_listed()]
    t = ", ".join(f"('{k}', {ws!r})" for k, ws in words)
    b = ", ".join(f"('{k}', {v.split()!r})" for k, v in license_scan.BASE.items())
    cut = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{cut}') AS w FROM documents),
base(label, phrase) AS (VALUES {b}), tpl(label, ws) AS (VALUES {t}),
pos AS (SELECT i, label, unnest(list_filter(range(len(w)), lambda j: w[j + 1 : j + len(phrase)] = phrase)) AS j FROM d, base),
hits AS (SELECT i, count(*) AS n, min(j) AS a, max(j) AS z, list_distinct(list(label)) AS ls FROM pos GROUP BY 1),
blk AS (SELECT row_number() OVER () AS k, i, list_distinct(regexp_extract_all(lower(x), '{cut}')) AS ws FROM (
  SELECT i, unnest(string_split(regexp_replace(regexp_replace(text, '\n[ \t\n\x0B\f\r*#/]*\n', chr(1), 'g'), '([.!?;])[ \t\n\x0B\f\r]', '\1' || chr(1), 'g'), chr(1))) AS x FROM d)),
near AS (SELECT DISTINCT k, i, blk.ws FROM (SELECT k, i, ws, unnest(ws) AS x FROM blk) blk JOIN (SELECT DISTINCT unnest(ws) AS x FROM tpl) USING (x)),
m AS (SELECT k, i, label, len(tpl.ws) AS size, len(list_intersect(near.ws, tpl.ws)) / len(tpl.ws) AS c FROM near, tpl
  WHERE len(list_intersect(near.ws, tpl.ws)) >= ceil(0.8 * len(tpl.ws) - 1e-9)),
best AS (SELECT i, label, c FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, size DESC, label DESC) = 1),
g AS (SELECT i, list(label) AS ls, max(c) AS c FROM best GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(hits.ls), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(hits.ls, []), coalesce(g.ls, [])))), ',') AS labels,
  CAST(CASE WHEN hits.n > 0 THEN 1.0 ELSE coalesce(g.c, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN hits USING (i) LEFT JOIN g USING (i)
"""


def _op8() -> str:
    bits = " + ".join(f"CASE WHEN {r} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality_rules.RULES.values()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
tri AS (SELECT i, j, w[j] AS a, w[j + 1] AS b, w[j + 2] AS c FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS j FROM d WHERE len(w) > 2)),
rep AS (SELECT i, j FROM (SELECT i, j, count(*) OVER (PARTITION BY i, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT i, count(DISTINCT j + k) AS n FROM rep, (VALUES (0), (1), (2)) t(k) GROUP BY 1),
l AS (SELECT i, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
q AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d JOIN l USING (i) LEFT JOIN cov USING (i)),
b AS (SELECT *, {bits} AS bits FROM q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (bits & {quality_rules.mask("base")}) <> 0 AS base_failed, (bits & {quality_rules.mask("v1")}) = 0 AS kept, CAST(bits AS BIGINT) AS bits
FROM b
"""


SQL = {"op1_url_filters": _op1(), "op2_topk_search": OP2, "op5_license_scans": _op5(), "op8_quality_rules": _op8()}
