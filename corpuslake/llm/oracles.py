"""DuckDB SQL for the queries that SQL can express."""

from corpuslake.llm.license_scan import BASE, MUST, NEVER, THRESHOLD, needed, template_lengths, template_words

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column: str) -> str:
    return f"regexp_extract_all({LOWER.format(column)}, '{WORD}')"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, w[s:s + 9] AS win FROM starts),
lengths AS (SELECT DISTINCT len(win) AS n FROM wins),
dpos AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lengths WHERE len(w) >= n),
dwin AS (SELECT doc_id, s, n, w[s:s + n - 1] AS win FROM dpos),
hits AS (SELECT doc_id, s, n, item_id FROM dwin JOIN wins USING (win)),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _license() -> str:
    cases = []
    for phrase, label in BASE.items():
        parts = phrase.split(" ")
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        cases.append(f"SELECT doc_id, i - 1 AS spot, '{label}' AS label FROM p WHERE {test}")
    values = ", ".join(f"('{k}', {len(v)}, {needed(len(v), THRESHOLD)}, {template_lengths()[k]}, {v!r}, {MUST[k]!r}, CAST({NEVER.get(k, [])!r} AS VARCHAR[]))" for k, v in template_words().items())
    return f"""
WITH d AS (SELECT doc_id, text, {_words('text')} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE list_contains(w, 'license')),
base AS ({" UNION ALL ".join(cases)}),
per AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
t(label, n, c, span, tokens, must, never) AS (VALUES {values}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
texts AS (SELECT doc_id, label, w FROM d, t WHERE len(list_intersect(w, tokens)) >= c AND list_has_all(w, must)),
spots AS (SELECT doc_id, label, w, unnest(generate_series(1, len(w))) AS i FROM texts),
blocks AS (SELECT doc_id, label, list_distinct({_words('line')}) AS b FROM lines, t
           UNION ALL SELECT doc_id, label, list_distinct(w[i:i + span - 1]) FROM spots JOIN t USING (label)),
met AS (SELECT doc_id, label, CAST(len(list_intersect(b, tokens)) AS DOUBLE) / n AS containment
        FROM blocks JOIN t USING (label) WHERE len(list_intersect(b, tokens)) >= c AND list_has_all(b, must) AND NOT list_has_any(b, never)),
best AS (SELECT doc_id, max(containment) AS best FROM met GROUP BY doc_id),
every AS (SELECT DISTINCT doc_id, label FROM (SELECT doc_id, label FROM met UNION ALL SELECT doc_id, label FROM base)),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN coalesce(n_base, 0) > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(best, CAST(0 AS DOUBLE)) END AS score
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""


# base 32 of a SHA-1: its 40 hexadecimal digits as 160 bits, taken five at a time
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
top AS (SELECT html, max(page_id) AS holder FROM p GROUP BY html),
bits AS (SELECT s, array_to_string(list_transform(range(1, 41), lambda j: lpad(bin(CAST('0x' || substr(s, j, 1) AS INTEGER)), 4, '0')), '') AS b FROM (SELECT DISTINCT s FROM p)),
digest AS (SELECT s, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(substr(b, CAST(5 * i + k + 1 AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 4 - k) AS INTEGER))) AS INTEGER), 1)), '') AS d FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM p JOIN top USING (html) JOIN digest USING (s)
"""


# the CRC-32 of an id's digits, bit by bit
TRIE = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
hs AS (SELECT c, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda s, b: list_reduce([xor(s, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda t, i: xor(t >> 1, CAST(3988292384 AS BIGINT) * (t & 1)))), CAST(4294967295 AS BIGINT)) % 6 AS h FROM ids),
t AS (SELECT conv_id AS c, said, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) - 1 AS pos
      FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, length(coalesce(text, '')) AS n FROM conversations)),
b AS (SELECT hs.c, 0 AS own, pos, said, n FROM hs JOIN t ON t.c = hs.c - hs.c % 100 WHERE pos < h
      UNION ALL SELECT hs.c, 1, pos, said, n FROM hs JOIN t USING (c) WHERE pos >= h),
l AS (SELECT c, list(said ORDER BY own, pos) AS w, list(n ORDER BY own, pos) AS sizes FROM b GROUP BY c),
r AS (SELECT c, d, md5(array_to_string(w[1:d], ',')) AS p, CASE WHEN d > 1 THEN md5(array_to_string(w[1:d - 1], ',')) ELSE '' END AS above, sizes[d] AS size, d = len(w) AS last
      FROM (SELECT c, w, sizes, unnest(generate_series(1, len(w))) AS d FROM l)
      UNION ALL SELECT ids.c, 0, '', NULL, 0, l.c IS NULL FROM ids LEFT JOIN l USING (c)),
nodes AS (SELECT d, p, min(above) AS above, min(c) AS c, count(*) AS n, min(size) AS size, string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ended FROM r GROUP BY d, p),
kids AS (SELECT above AS p, count(*) AS k FROM nodes WHERE above IS NOT NULL GROUP BY above),
own AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p)),
sums AS (SELECT r.p, sum((own.n - 1) * own.size) AS saved, sum(CASE WHEN own.k = 0 THEN 1 ELSE 0 END) AS leaves FROM own JOIN r ON r.c = own.c AND r.d <= own.d GROUP BY r.p)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, y.c AS parent_conv_id, x.n AS n_convs, CAST(x.k AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ended, '')) AS ends_sha256
FROM own x JOIN sums USING (p) LEFT JOIN nodes y ON y.p = x.above
"""


ORACLES = {"op2_warc": WARC, "op4_license_scan": _license(), "op10_decontamination": DECONTAMINATION, "op11_prefix_trie": TRIE}
