"""SQL twins of operators that SQL can express but that need generated tables."""

from __future__ import annotations

from .licenses import ANCHORS, LEAST, template_weights


def licenses_sql() -> str:
    """The licence scan over the documents as files, with the template weights as a table of values."""
    rows, unknown = template_weights()
    values = ", ".join(f"('{w}', {t}, '{name}', CAST({idf} AS DOUBLE), CAST({weight} AS DOUBLE))" for w, t, name, idf, weight in rows)
    return f"""
WITH weights(word, template, license, idf, weight) AS (VALUES {values}),
files AS (SELECT doc_id, source || '/' || CAST(doc_id // 50 AS VARCHAR) AS folder, doc_id % 50 = 0 AS is_license, string_split(lower(text), chr(10)) AS lines FROM documents),
said AS (SELECT doc_id, line, lines[line] AS said FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM files) q WHERE regexp_matches(lines[line], '{ANCHORS}')),
words AS (SELECT doc_id, line, word, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_split_to_array(said, '[^a-z0-9]+')) AS word FROM said) q WHERE word <> '' GROUP BY doc_id, line, word),
lengths AS (SELECT doc_id, line, sqrt(sum(pow(tf * coalesce(idf, {unknown}), 2))) AS length FROM words LEFT JOIN (SELECT DISTINCT word, idf FROM weights) i USING (word) GROUP BY doc_id, line),
dots AS (SELECT doc_id, line, template, license, sum(tf * idf * weight) AS dot FROM words JOIN weights USING (word) GROUP BY doc_id, line, template, license),
scores AS (SELECT doc_id, license, round(dot / length, 4) AS score FROM dots JOIN lengths USING (doc_id, line)),
stated AS (SELECT doc_id, license, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS n FROM scores WHERE score >= {LEAST}) q WHERE n = 1),
known AS (SELECT f.doc_id, f.folder, f.is_license, s.license, s.score FROM files f LEFT JOIN stated s USING (doc_id)),
licensed AS (SELECT folder, license FROM known WHERE is_license AND license IS NOT NULL)
SELECT k.doc_id, coalesce(k.license, l.license) AS license, k.score, CASE WHEN k.license IS NULL THEN l.folder END AS inherited_from
FROM known k LEFT JOIN licensed l ON l.folder = k.folder AND k.license IS NULL
"""


def repeats_sql(length: int = 200) -> str:
    """Texts without repeated strings: every start of every text by a hash of its window, spans, and what is left in hexadecimal digits."""
    n = 2 * length
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, c, substr(h, 256 * c + 1, {n + 256}) AS piece FROM (SELECT rid, h, unnest(range(0, (len(h) - {n}) // 256 + 1)) AS c FROM d WHERE len(h) >= {n}) q),
w AS (SELECT rid, 128 * c + j AS p, hash(substr(piece, 2 * j + 1, {n})) AS s FROM (SELECT *, unnest(range(0, least(128, len(piece) // 2 - {length - 1}))) AS j FROM c) q),
r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= {length} THEN 0 ELSE 1 END AS starts FROM w WHERE s IN (SELECT s FROM r)),
g AS (SELECT rid, p, sum(starts) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m),
sp AS (SELECT rid, min(p) AS a, max(p) + {length} AS b FROM g GROUP BY rid, g),
k AS (SELECT sp.rid, a, b, coalesce(lag(b) OVER w, 0) AS before, lead(a) OVER w IS NULL AS last FROM sp WINDOW w AS (PARTITION BY rid ORDER BY a)),
o AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (rid)
"""


#: Spelling variants with the table of crc32, and near words by joins of wildcards and deletions.
SPELLING_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hx AS (SELECT run, n, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS hx FROM own),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(hx) // 2), lambda i: CAST(CAST('0x' || substr(hx, 2 * i + 1, 2) AS INTEGER) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM hx, t),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) q WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
wild AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS w FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) q),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS w FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) q),
met AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.w = b.w AND a.word <> b.word UNION ALL SELECT c.word, c.n, v.word AS other, v.n AS m FROM cut c JOIN words v ON v.word = c.w UNION ALL SELECT v.word, v.n, c.word AS other, c.n AS m FROM cut c JOIN words v ON v.word = c.w),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -m, other := other)) AS b FROM met GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * n THEN b.other END AS form, CASE WHEN -b.less >= 5 * n THEN -b.less END AS form_n FROM words w LEFT JOIN best ON best.word = w.word),
up AS (SELECT word, word AS root FROM form UNION ALL SELECT u.word, f.form AS root FROM up u JOIN form f ON f.word = u.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, u.root FROM form f JOIN up u ON u.word = f.word JOIN form g ON g.word = u.root AND g.form IS NULL
"""
