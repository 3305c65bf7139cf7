"""SQL, for the checking engine, of the training-data queries that it can express."""

_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links,
       min(b) AS component_id, a = min(b) AS kept
FROM reached r GROUP BY a"""

# windows as hashes of their bytes; a run of starts less than a window apart is one span
SUBSTRINGS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n
           FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100),
windows AS (SELECT doc_id, p, md5_number(h[p + 1:p + 100]) AS k FROM starts),
firsts AS (SELECT k, min(struct_pack(d := doc_id, p := p)) AS f FROM windows GROUP BY k HAVING count(*) > 1),
again AS (SELECT doc_id, p FROM windows JOIN firsts USING (k) WHERE f <> struct_pack(d := doc_id, p := p)),
marked AS (SELECT *, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100 AS gap FROM again),
numbered AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span
             FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM numbered GROUP BY doc_id, span),
edges AS (SELECT doc_id, a, z FROM spans
          UNION ALL SELECT doc_id, n, NULL FROM d),
pieces AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 0) AS start FROM edges),
kept AS (SELECT doc_id, string_agg(hex(h[start + 1:a]), '' ORDER BY a, start) AS t
         FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, n - CAST(len(t) // 2 AS BIGINT) AS n_removed,
       (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS n_spans,
       sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept USING (doc_id)"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
windows AS (SELECT doc_id, p, n, string_agg(x, ' ') OVER (
              PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM words),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r
          FROM windows WHERE p <= n - 19) x WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM again CROSS JOIN (SELECT unnest(range(0, 20)) AS i) y),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
item_windows AS (SELECT item_id, least(10, len(w)) AS n,
                        unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
                                              lambda i: array_to_string(w[i:i + 9], ' '))) AS k
                 FROM items WHERE len(w) > 0),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
listed AS (SELECT doc_id, p, list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)
             AS l FROM words),
sized AS (SELECT doc_id, p, n, array_to_string(l[1:n], ' ') AS k
          FROM listed JOIN (SELECT DISTINCT n FROM item_windows) s ON len(l) >= n),
hits AS (SELECT DISTINCT doc_id, p, s.n, item_id FROM sized s JOIN item_windows i ON i.k = s.k AND i.n = s.n),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM hits),
per_doc AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
per_item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS t
             FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN per_item USING (doc_id)"""


_ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(name: str, pattern: str) -> str:
    """(doc_id, text between matches, match) by place: matches are put between marks, then split there."""
    return f"""
{name}_parts AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS p
  FROM d) y),
{name}_all AS (SELECT doc_id, split_part(x, chr(57345), 1) AS m, i, sum(length(x) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (
  PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM {name}_parts),
{name} AS (SELECT doc_id, m, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS z FROM {name}_all WHERE i > 1)"""


# marks are characters of the private use area
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(57344)) AS owner, coalesce(text, '') AS t FROM documents),
{_matches("assigned", _ASSIGN)},
{_matches("access", "AKIA[A-Z0-9]+")},
{_matches("hexes", "[0-9a-f]+")},
{_matches("tokens", "[A-Za-z0-9_-]+")},
base AS (SELECT doc_id, 0 AS k, a, z, regexp_extract(m, '{_ASSIGN}', 2) AS v FROM assigned
         WHERE length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6
         UNION ALL SELECT doc_id, 1, a, z, m FROM access WHERE length(m) >= 20
         UNION ALL SELECT doc_id, 2, a, z, m FROM hexes WHERE length(m) >= 24),
bare AS (SELECT doc_id, 3 AS k, a, z, m AS v FROM tokens t WHERE length(m) >= 12
         AND regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]') AND len(list_distinct(string_split(m, ''))) >= 8
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.a < t.z AND t.a < b.z)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
counts AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT t) AS repositories, min(k) < 3 AS named
           FROM every JOIN d USING (doc_id) GROUP BY v),
spans AS (SELECT doc_id, k, a, z, (['assign', 'access', 'hex', 'live'])[k + 1] || ':' || a || ':' || z AS s
          FROM every JOIN counts USING (v)
          WHERE k < 3 OR owners = 1 AND repositories <= 10 AND (length(v) >= 20 OR named)),
texts AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
                 count(*) FILTER (k = 2) AS n_hex, string_agg(s, ',' ORDER BY a, k) FILTER (k < 3) AS base,
                 string_agg(s, ',' ORDER BY a, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (doc_id)"""


def _level(k: int) -> str:
    """Witten-Bell smoothing of the grams with k characters of context over those with one less."""
    low = "l.p_{0}" if k else "(1 / 256.0)"
    mixed = ", ".join(
        f"CASE WHEN {c}_all + {c}_kinds > 0 THEN (g.{c} + {c}_kinds * {low.format(c)}) / ({c}_all + {c}_kinds) "
        f"ELSE {low.format(c)} END AS p_{c}" for c in "ab")
    below = f"JOIN level_{k - 1} l ON l.g = substr(g.g, 2)" if k else ""
    return f"""
level_{k} AS (SELECT g.g, {mixed} FROM grams g JOIN contexts c ON c.k = g.k AND c.c = substr(g.g, 1, g.k) {below}
  WHERE g.k = {k})"""


def _fits(host: str, start: str) -> str:
    return f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{start}')"


URLS = f"""
WITH rests AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN contains(url, '://')
                 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_replace(u, '[0-9]', '0', 'g') AS t,
            translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (SELECT *, CASE WHEN {_fits("www.example.com", "/en/")} THEN 'www.example.com/en/'
            WHEN {_fits("example.com", "/en/")} THEN 'example.com/en/' WHEN {_fits("net", "/es/")} THEN 'net/es/'
            WHEN {_fits("net", "/fr/")} THEN 'net/fr/' WHEN {_fits("com", "/")} THEN 'com/' END AS rule FROM parts),
told AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END
           AS fixed FROM ruled),
texts AS (SELECT t, CAST(count(*) FILTER (fixed = 'allow') AS DOUBLE) AS a,
                 CAST(count(*) FILTER (fixed = 'block') AS DOUBLE) AS b FROM told GROUP BY t),
places AS (SELECT t, a, b, i, k, substr(repeat(chr(2), 4) || t || chr(3), i + 4 - k, k + 1) AS g
           FROM (SELECT *, unnest(range(1, length(t) + 2)) AS i FROM texts) x, (SELECT unnest(range(0, 5)) AS k) y),
grams AS (SELECT k, g, sum(a) AS a, sum(b) AS b FROM places WHERE a + b > 0 GROUP BY k, g),
contexts AS (SELECT k, substr(g, 1, k) AS c, sum(a) AS a_all, count(*) FILTER (a > 0) AS a_kinds,
                    sum(b) AS b_all, count(*) FILTER (b > 0) AS b_kinds FROM grams GROUP BY 1, 2),
{",".join(map(_level, range(5)))},
model AS ({" UNION ALL ".join(f"SELECT {k} AS k, g, ln(p_a) - ln(p_b) AS ratio FROM level_{k}" for k in range(5))}),
longest AS (SELECT t, i, arg_max(ratio, k) AS ratio FROM places JOIN model USING (k, g) GROUP BY t, i),
scores AS (SELECT t, sum(ratio) / (length(t) + 1) AS score FROM longest GROUP BY t),
means AS (SELECT sum(score * a) / sum(a) AS ma, sum(score * b) / sum(b) AS mb, sum(score * score * a) / sum(a) AS qa,
                 sum(score * score * b) / sum(b) AS qb FROM scores JOIN texts USING (t)),
spreads AS (SELECT ma, mb, sqrt(greatest(0, qa - ma * ma)) AS sa, sqrt(greatest(0, qb - mb * mb)) AS sb FROM means),
bound AS (SELECT CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END AS least FROM spreads)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN score < least THEN 'block' ELSE 'allow' END) AS verdict
FROM told LEFT JOIN scores USING (t), bound"""
