"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations


def _found(kind: str, number: int, pattern: str, group: int, least: int, text: str = "t") -> str:
    """Spans of one rule: matches and the gaps between them give the offsets."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, z.s AS s, z.e AS e FROM (
  SELECT doc_id, unnest(list_transform(range(len(m)), lambda i: {{
      's': list_sum(list_transform(g[:i + 1], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:i], lambda x: length(x))), 0)::BIGINT,
      'e': list_sum(list_transform(g[:i + 1], lambda x: length(x)))::BIGINT + list_sum(list_transform(m[:i + 1], lambda x: length(x)))::BIGINT,
      'n': length(p[i + 1])}})) AS z
  FROM (SELECT doc_id, regexp_extract_all({text}, '{p}') AS m, regexp_extract_all({text}, '{p}', {group}) AS p,
               string_split_regex({text}, '{p}') AS g FROM d)) WHERE z.n >= {least}"""


OP7 = ("WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join([
    _found("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    _found("access", 1, "AKIA[A-Z0-9]+", 0, 16),
    _found("hex", 2, "[0-9a-f]{32,}", 0, 32),
    _found("github", 3, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    _found("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    _found("pem", 5, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
]) + """)
SELECT d.doc_id, count(*) FILTER (k = 0)::BIGINT AS n_assign, count(*) FILTER (k = 1)::BIGINT AS n_access,
  count(*) FILTER (k = 2)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k >= 0), '') AS spans
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""WITH i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
wi AS (SELECT DISTINCT item_id, list_slice(w, p, p + 9) AS win FROM (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM wi),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
wd AS (SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, p, n, item_id FROM wd JOIN wi USING (win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id),
it AS (SELECT CAST(item_id AS VARCHAR) AS s, w, len(list_distinct(w)) AS n_terms, row_number() OVER () AS k FROM i WHERE item_id IS NOT NULL AND len(w) > 0),
kt AS (SELECT k, s, n_terms, unnest(list_distinct(w)) AS term FROM it),
po AS (SELECT doc_id, p, w[p] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0)
  WHERE w[p] IN (SELECT term FROM kt)),
ct AS (SELECT term, count(*) AS c FROM po GROUP BY term),
rk AS (SELECT k, s, n_terms, term, row_number() OVER (PARTITION BY k ORDER BY c, term) AS r, count(*) OVER (PARTITION BY k) AS known FROM kt JOIN ct USING (term)),
pk AS (SELECT * FROM rk WHERE r <= 4 AND known >= least(2, n_terms)),
an AS (SELECT a.k, a.s, least(a.known, 4) AS want, po.doc_id, po.p FROM pk a JOIN po USING (term) WHERE a.r = 1),
nr AS (SELECT doc_id, s FROM (
  SELECT an.k, an.s, an.want, an.doc_id, an.p, count(DISTINCT pk.r) AS got FROM an JOIN pk ON pk.k = an.k JOIN po ON po.term = pk.term
    AND po.doc_id = an.doc_id AND po.p BETWEEN an.p - 20 AND an.p + 20 GROUP BY ALL) WHERE got = want),
ng AS (SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS near FROM (SELECT DISTINCT doc_id, s FROM nr) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
  coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(ng.n_near, 0)::BIGINT AS n_near, sha256(coalesce(ng.near, '')) AS near_sha256
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN ng ON ng.doc_id = d.doc_id"""


_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', " \
          "((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '')"

OP6 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_BASE32.replace('(h,', '(p.h,')} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)"""


def _op11(k: int = 40, rounds: int = 5) -> str:
    """k-means by brute force: every distance, round by round."""
    out = [f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (
  SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d FROM (
  SELECT vec_id, v.x AS x, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM v, c{i}) GROUP BY vec_id)""")
        if i < rounds:
            out.append(f"""m{i} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (
  SELECT c, j, sum(y) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(out) + f"""
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{rounds}.c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


OP11 = _op11()


_W = "'[^\\x20\\x09-\\x0D]+'"

OP12 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
l AS (SELECT doc_id, source, line, len(lw) AS n, array_to_string(lw, ' ') AS norm FROM (
  SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_W}) AS lw
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)) WHERE len(lw) > 0),
h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
c AS (SELECT l.source, norm FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, norm, docs
  HAVING count(DISTINCT doc_id) > 6 AND count(DISTINCT doc_id) > 0.001 * docs),
r AS (SELECT doc_id, count(*) AS n_lines, sum(n) AS n_words FROM l JOIN c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY doc_id),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
p AS (SELECT doc_id, p, list_slice(w, p, p + 7) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
q AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS x FROM p
  JOIN (SELECT doc_id, win FROM p GROUP BY doc_id, win HAVING count(*) > 1) USING (doc_id, win)) GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words,
  coalesce(r.n_lines, 0)::BIGINT AS n_removed_lines, coalesce(r.n_words, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN u USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 2 * n_removed_words > n_words) AS kept FROM b"""


OP13 = """WITH u AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l FROM documents),
k AS (SELECT *, len(l) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(l) + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (len(l) + 1) AS two,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
       WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
z AS (SELECT *, coalesce(array_to_string(list_slice(l, 1, least(one, two)), ''), '') AS p,
  coalesce(array_to_string(list_slice(l, least(one, two) + 1, greatest(one, two)), ''), '') AS m,
  coalesce(array_to_string(list_slice(l, greatest(one, two) + 1, n), ''), '') AS s FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM z"""
