"""What SQL says to those operations that it can express, for DuckDB on the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

ANN = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""

# Suffixes of two names; as in the operation's options.
LONG = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'net.au', 'co.jp', 'ne.jp', 'com.br', 'co.nz', 'co.in', 'com.cn')"


def _level(name: str, rows: str, parent: str, keys: str) -> str:
    """Groups with their parent's rate, the level's strength and the shrunken rate."""
    return f"""
, {name}_in AS (SELECT {rows}.*, {parent} AS above FROM {rows} {keys})
, {name}_fit AS (SELECT CASE WHEN SUM((bad - n * above) * (bad - n * above) - n * above * (1 - above)) <= 0 THEN 1000.0
    ELSE least(greatest(SUM(n * above * (1 - above) * (n - 1)) / SUM((bad - n * above) * (bad - n * above) - n * above * (1 - above)) - 1, 1.0), 1000.0)
    END AS s FROM {name}_in)
, {name} AS (SELECT {name}_in.*, s, (bad + s * above) / (n + s) AS rate FROM {name}_in, {name}_fit)"""


URLS = rf"""
WITH rows AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), outcome AS (
  SELECT doc_id AS page_id, SUM(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad, COUNT(*) AS n
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1
), named AS (
  SELECT host, CAST(COALESCE(SUM(bad), 0) AS DOUBLE) AS bad, CAST(COALESCE(SUM(n), 0) AS DOUBLE) AS n,
    regexp_replace(host, '(?s)^.*@|:[0-9]*$|\.(:[0-9]*)?$', '', 'g') AS bare, string_split(bare, '.') AS p,
    regexp_matches(bare, '^[0-9]+(\.[0-9]+){{3}}$') OR starts_with(bare, '[') AS address
  FROM rows LEFT JOIN outcome USING (page_id) GROUP BY 1
), hosts AS (
  SELECT host, bad, n, CASE WHEN address THEN '(address)' WHEN len(p) > 2 AND array_to_string(p[-2:], '.') IN {LONG} THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
    CASE WHEN address THEN bare WHEN len(p) < 2 THEN p[-1] WHEN len(p) > 2 AND array_to_string(p[-2:], '.') IN {LONG} THEN array_to_string(p[-3:], '.')
      ELSE array_to_string(p[-2:], '.') END AS domain FROM named
), domains AS (SELECT suffix, domain, SUM(bad) AS bad, SUM(n) AS n FROM hosts GROUP BY 1, 2
), suffixes AS (SELECT suffix, SUM(bad) AS bad, SUM(n) AS n FROM domains GROUP BY 1
), overall AS (SELECT (COALESCE(SUM(bad), 0) + 1) / (COALESCE(SUM(n), 0) + 5) AS p FROM suffixes)
{_level("top", "suffixes", "p", ", overall")}
{_level("middle", "domains", "top.rate", "JOIN top ON domains.suffix = top.suffix")}
{_level("low", "hosts", "middle.rate", "JOIN middle ON hosts.suffix = middle.suffix AND hosts.domain = middle.domain")}
, sides AS (SELECT host, rate, (n + s) * rate AS a, (n + s) * (1 - rate) AS b, 0.5 < (a + 1) / (n + s + 2) AS below FROM low)
, tails AS (SELECT host, rate, below, CASE WHEN below THEN a ELSE b END AS u, CASE WHEN below THEN b ELSE a END AS v FROM sides)
, known AS (SELECT host, rate, list_sum([exp(lgamma(u + v + i) - lgamma(u + 1 + i) - lgamma(v) + (u + i) * ln(0.5) + v * ln(0.5))
    FOR i IN range(CAST(ceil(9 * sqrt((u + 1) / 0.5) + 160) AS BIGINT) + 1)]) AS tail, CASE WHEN below THEN 1 - tail ELSE tail END AS sure FROM tails)
, ruled AS (SELECT rows.*, round(rate, 6) AS rate, round(sure, 6) AS sure, sure >= 0.95 AS bad,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM rows JOIN known USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bad THEN 'block' ELSE 'allow' END AS verdict, rate, sure FROM ruled
"""

SUBSTRINGS = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)
, windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM docs, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35)
, again AS (SELECT k FROM windows GROUP BY 1 HAVING COUNT(*) > 1)
, gone AS (SELECT DISTINCT r, i + j AS pos FROM windows JOIN again USING (k), range(35) AS t(j))
, words AS (SELECT r, pos, w[pos] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(pos))
, left_over AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept, COUNT(*) AS n FROM words ANTI JOIN gone USING (r, pos) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - COALESCE(n, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (r)
"""

NEARDUP = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY 1
), shared AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT u, v FROM shared JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (SELECT u AS doc_id, v AS c FROM links UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.c = links.u
), least_id AS (SELECT doc_id, MIN(c) AS c FROM reach GROUP BY 1)
SELECT docs.doc_id, COALESCE(n, 0) AS n_shingles, least(docs.doc_id, COALESCE(c, docs.doc_id)) AS component_id,
  docs.doc_id = least(docs.doc_id, COALESCE(c, docs.doc_id)) AS kept
FROM docs LEFT JOIN sizes ON docs.doc_id = sizes.doc_id LEFT JOIN least_id ON docs.doc_id = least_id.doc_id
"""

NEGATIVES = """
WITH rows AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)
), one AS (SELECT id, MIN({'label': label, 'e': e}) AS x FROM rows GROUP BY 1
), v AS (SELECT id, x.label AS label, x.e AS e FROM one
), pairs AS (
  SELECT a.id AS anchor, v.id, a.label = v.label AS own, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.id % 100 = 0 AND a.id <> v.id AND len(a.e) = len(v.e)
), positives AS (
  SELECT anchor, id, score FROM pairs WHERE own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor = n.anchor AND NOT n.own AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


def _round(before: str, near: str, after: str) -> str:
    """The nearest entry of every part, and the codebooks that follow from it."""
    return f"""
, {near} AS (
  SELECT row, p, MIN({{'d': d, 'k': k}}) AS b FROM (
    SELECT row, p, k, CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS BIGINT) AS d
    FROM parts JOIN {before} USING (p)) GROUP BY 1, 2
), {after}_means AS (
  SELECT p, k, list(c ORDER BY i) AS c FROM (
    SELECT p, b.k AS k, i, floor(SUM(x[i]) / COUNT(*)) AS c FROM {near} JOIN parts USING (row, p), unnest(range(1, len(x) + 1)) AS t(i)
    GROUP BY 1, 2, 3) GROUP BY 1, 2
), {after} AS MATERIALIZED (SELECT p, k, coalesce(m.c, o.c) AS c FROM {before} o LEFT JOIN {after}_means m USING (p, k))"""


# For vectors of one length that four parts divide, as the table has them.
CODEBOOKS = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)
), parts AS MATERIALIZED (SELECT row, p, e[p * len(e) // 4 + 1:(p + 1) * len(e) // 4] AS x FROM v, range(4) AS t(p)
), starts AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, e FROM (SELECT vec_id, MIN(e) AS e FROM v WHERE vec_id IS NOT NULL GROUP BY 1)
  QUALIFY k < 256
), book0 AS MATERIALIZED (SELECT p, k, e[p * len(e) // 4 + 1:(p + 1) * len(e) // 4] AS c FROM starts, range(4) AS t(p))
{"".join(_round(f"book{i}", f"near{i}", f"book{i + 1}") for i in range(5))}
, coded AS (
  SELECT row, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, CAST(SUM(b.d) AS BIGINT) AS error FROM near4 GROUP BY 1
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i)) AS d FROM book4, unnest(range(1, len(c) + 1)) AS t(i)
)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM v LEFT JOIN coded USING (row), digest
"""

# The patterns and limits of the operation. Values and texts have no word character
# right behind a match, so that splitting sees the same word boundaries as searching.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "login": r"""(?i)\b(user|username|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""",
    "endpoint": r"""(?i)\b(?:(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?:host|hostname|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]+)""",
}
QUOTED = {name: pattern.replace("'", "''") for name, pattern in PATTERNS.items()}
MATCHES = " UNION ALL ".join(
    f"SELECT row, '{name}' AS source, regexp_extract_all(t, '{x}') AS f, string_split_regex(t, '{x}') AS b FROM d" for name, x in QUOTED.items()
)

SECRETS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), m AS ({MATCHES}
), placed AS (
  SELECT row, source, f[i] AS s, SUM(length(b[i]) + length(f[i])) OVER (PARTITION BY row, source ORDER BY i) AS e
  FROM m, unnest(range(1, len(f) + 1)) AS u(i)
), sized AS (
  SELECT row, source, CAST(e - length(s) AS BIGINT) AS a, CAST(e AS BIGINT) AS e,
    CASE WHEN source = 'assign' THEN length(regexp_extract(s, '{QUOTED["assign"]}', 2)) ELSE length(s) END AS n FROM placed
), kinds AS (
  SELECT row, a, e, CASE WHEN source = 'assign' AND n >= 12 THEN 'assign' WHEN source = 'assign' AND n >= 6 THEN 'weak_secret'
    WHEN source = 'access' AND n >= 18 THEN 'access' WHEN source = 'access' THEN 'weak_access'
    WHEN source = 'hex' AND n >= 16 THEN 'hex' WHEN source IN ('login', 'endpoint') THEN source END AS kind,
    CASE source WHEN 'assign' THEN 'secret' WHEN 'hex' THEN 'secret' WHEN 'endpoint' THEN 'endpoint' ELSE 'identifier' END AS role
  FROM sized
), parts AS MATERIALIZED (SELECT * FROM kinds WHERE kind IS NOT NULL
), weak AS (
  SELECT x.row, x.a, x.e, x.kind FROM parts x JOIN parts y ON x.row = y.row AND y.role NOT IN (x.role, 'endpoint') AND y.a <= x.e + 200 AND y.e >= x.a - 200
  WHERE x.kind NOT IN ('assign', 'access', 'hex') GROUP BY x.row, x.a, x.e, x.kind, x.role
  HAVING COUNT(DISTINCT y.role) >= CASE WHEN x.role = 'endpoint' THEN 2 ELSE 1 END
), spans AS (
  SELECT row, a, kind, kind || ':' || a || ':' || e AS span,
    list_position(['assign', 'access', 'hex', 'weak_secret', 'weak_access', 'login', 'endpoint'], kind) AS k
  FROM (SELECT row, a, e, kind FROM parts WHERE kind IN ('assign', 'access', 'hex') UNION ALL SELECT * FROM weak)
), listed AS (
  SELECT row, COUNT(*) FILTER (k = 1) AS n_assign, COUNT(*) FILTER (k = 2) AS n_access, COUNT(*) FILTER (k = 3) AS n_hex,
    string_agg(span, ',' ORDER BY a, k) FILTER (k <= 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM spans GROUP BY 1
)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
  sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN listed USING (row)
"""

QUERIES = {
    "op1_ann": ANN,
    "op4_secrets": SECRETS,
    "op11_negatives": NEGATIVES,
    "op12_codebooks": CODEBOOKS,
    "op2_urls": URLS,
    "op8_substrings": SUBSTRINGS,
    "op10_neardup": NEARDUP,
}
