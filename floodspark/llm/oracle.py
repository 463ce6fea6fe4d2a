"""The same results in SQL, for the operators that SQL can express."""

_SHINGLES = r"""
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


def _uuid(*parts: str) -> str:
    digest = "md5(" + " || chr(10) || ".join(f"coalesce({x}, '')" for x in parts) + ")"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in cuts) + " || '>'"


def _plain_text(html: str) -> str:
    breaks = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|pre|title"
    text = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    hidden = "|".join(rf"{name}\b[^>]*>.*?</{name}" for name in ("script", "style", "noscript", "template"))
    text = rf"regexp_replace({text}, '(?is)<(?:{hidden})\s*>', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?is)<head\b[^>]*>.*?(</head\s*>|<body\b)', ' \1', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?({breaks})\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{character}')"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({text}, '^[ \n]+|[ \n]+$', '', 'g')"


_CRLF = "chr(13) || chr(10)"

# The published reflected polynomial, bit by bit.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), i -> ascii(s[i])::BIGINT)), "
    "lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"
).replace("i -> ", "lambda i: ")

ORACLE = {
    "op8_near_dedup": f"""
WITH RECURSIVE {_SHINGLES}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
""",
    "op9_decontamination": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i : i + 9] AS win FROM iw, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
runs AS (
  SELECT doc_id, i AS start, size, w[i : i + size - 1] AS win
  FROM dw, (SELECT DISTINCT len(win) AS size FROM win) s, unnest(range(1, greatest(len(w) - size + 2, 1))) AS t(i)),
hits AS (SELECT r.doc_id, r.start, r.size, v.item_id FROM runs r JOIN win v USING (win)),
words AS (SELECT DISTINCT doc_id, start + k AS word FROM hits, unnest(range(0, size)) AS t(k)),
hw AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op10_warc": f"""
WITH r AS (
  SELECT page_id, {_uuid("'response'", "page_id::VARCHAR", "url", "html")} AS response_id, url AS target_uri,
         '1970-01-01T00:00:00Z' AS date, coalesce(html, '') AS payload,
         'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: '
           || strlen(coalesce(html, '')) || {_CRLF} AS http_headers
  FROM pages),
s AS (SELECT *, 'sha256:' || sha256(payload) AS payload_digest FROM r),
b AS (
  SELECT *, 'metadata' AS warc_type, {_uuid("'metadata'", "response_id")} AS record_id, 'application/warc-fields' AS content_type,
         'source-payload-digest: ' || payload_digest || {_CRLF} || 'source-payload-length: ' || strlen(payload) || {_CRLF}
           || 'conversion-record: ' || {_uuid("'conversion'", "response_id")} || {_CRLF} || 'source-status-and-headers:'
           || {_CRLF} || http_headers AS block
  FROM s
  UNION ALL
  SELECT *, 'conversion', {_uuid("'conversion'", "response_id")}, 'text/plain; charset=utf-8', {_plain_text("payload")} FROM s)
SELECT page_id, warc_type, record_id, response_id AS refers_to, target_uri, date, content_type,
       strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest, http_headers, block
FROM b
""",
    "op12_prefix_trie": f"""
WITH o AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, {_CRC} % 9 AS h FROM (SELECT *, conv_id::VARCHAR AS s FROM o)),
c AS (
  SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l
  FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, d, l[1:d] AS p, d = len(l) AS ends FROM c, unnest(range(0, len(l) + 1)) AS t(d)),
n AS (
  SELECT md5(p::VARCHAR) AS k, p, d, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ids
  FROM p GROUP BY p, d),
e AS (SELECT k, d, CASE WHEN d = 0 THEN NULL ELSE md5(p[1:d - 1]::VARCHAR) END AS up FROM n),
ch AS (SELECT up AS k, count(*) AS n_children FROM e WHERE up IS NOT NULL GROUP BY up),
own AS (
  SELECT n.k, n.p, n.d, coalesce(n_children, 0) AS n_children, (n.n - 1) * (CASE WHEN n.d = 0 THEN 0 ELSE strlen(n.p[n.d].text) END) AS saved
  FROM n LEFT JOIN ch USING (k)),
sub AS (
  SELECT md5(p[1:a]::VARCHAR) AS k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM own, unnest(range(0, d + 1)) AS t(a) GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n AS n_convs, own.n_children, sub.n_leaves, sub.saved_tokens,
       sha256(n.ids) AS ends_sha256
FROM n JOIN e USING (k) JOIN own USING (k) JOIN sub USING (k) LEFT JOIN n m ON m.k = e.up
""",
    "op13_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
""",
}
