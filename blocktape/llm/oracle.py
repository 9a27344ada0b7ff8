"""SQL of the queries of operators 11 to 13, for the same tables."""

# The CRC-32 of a string's UTF-8 bytes, by the table of its polynomial.
_TABLE = """
crc AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({hex}), 2), lambda k: ('0x' || substr({hex}, k, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

OP11_SQL = (
    r"WITH RECURSIVE"
    + _TABLE
    + r""",
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run
  FROM documents),
p AS (SELECT run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, c, """
    + _CRC.format(hex="x")
    + r""" AS code FROM p, crc),
w AS (SELECT c, CASE WHEN code % 31 = 0 THEN substr(run, 1, code % length(run)) || substr(run, code % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
e AS (
  SELECT a.word, b.word AS other, b.n AS n_other FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY n_other DESC, other) AS other, max(n_other) AS n_other FROM e GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= 10 * n THEN other END AS form, CASE WHEN n_other >= 10 * n THEN n_other END AS form_n
  FROM v LEFT JOIN b ON b.word = v.word),
c AS (
  SELECT word, form AS root FROM f WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
l AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN l ON l.word = f.word
"""
)

OP12_SQL = (
    r"WITH RECURSIVE"
    + _TABLE
    + r""",
s AS (
  SELECT doc_id, lang, n_chars, """
    + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang"))
    + r""" AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS x
  FROM documents),
y AS (SELECT *, """
    + _CRC.format(hex="x")
    + r""" % 7 = 0 AS changed FROM s, crc),
z AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + changed::INT)::VARCHAR) || ':' || (n_chars + changed::INT), '-') || tail) AS claimed
  FROM y),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM z),
t AS (
  SELECT 0 AS k, coalesce('1' || lang, '0') AS g, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT k + 1, g, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, g, pos // 2, n),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS k, pos, subroot AS h, n FROM subs
  UNION ALL SELECT k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY k, pos // 2, n),
a AS (
  SELECT doc_id, leaf, coalesce('1' || lang, '0') AS g, pos, n, 0 AS k, claimed AS f, '' AS sib FROM leaves
  UNION ALL
  SELECT a.doc_id, a.leaf, a.g, a.pos // 2, (a.n + 1) // 2, a.k + 1, sha256(CASE WHEN a.pos % 2 = 1 THEN t.h || f ELSE f || coalesce(t.h, '') END), sib || coalesce(t.h, '')
  FROM a LEFT JOIN t ON t.k = a.k AND t.g = a.g AND t.pos = xor(a.pos, 1::BIGINT) WHERE a.n > 1),
b AS (
  SELECT a.doc_id, a.leaf, subs.subroot, subs.pos, subs.n, 0 AS k, a.f, a.sib FROM a JOIN subs ON subs.g = a.g WHERE a.n = 1
  UNION ALL
  SELECT b.doc_id, b.leaf, b.subroot, b.pos // 2, (b.n + 1) // 2, b.k + 1, sha256(CASE WHEN b.pos % 2 = 1 THEN u.h || f ELSE f || coalesce(u.h, '') END), sib || coalesce(u.h, '')
  FROM b LEFT JOIN u ON u.k = b.k AND u.pos = xor(b.pos, 1::BIGINT) WHERE b.n > 1)
SELECT b.doc_id, b.leaf, b.subroot, u.h AS root, sha256(b.sib) AS proof_sha256, b.f AS folded_root, b.f = u.h AS verified
FROM b, u WHERE b.n = 1 AND u.n = 1
"""
)

OP13_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT r, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS i)),
f AS (SELECT h, min(doc_id) AS earliest FROM x GROUP BY h),
g AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (h) WHERE doc_id > earliest),
o AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
k AS (SELECT r, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS kept_text FROM o ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(kept, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)
"""
