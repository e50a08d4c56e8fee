"""SQL twins of the training-data queries, for DuckDB."""

from __future__ import annotations

from sigloom.llm.hilbert import curve_steps

VECTOR_CODES = """
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, len(embedding) // 16 AS w,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT rid, vec_id, p, v[p * w + 1:p * w + w] AS q FROM kept, range(16) AS t(p)
), b0 AS (
  SELECT p, e, q FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept) USING (rid) WHERE e < 64
)"""


def _round(k: int) -> str:
    """The k-th assignment and, but for the last, the entries that follow from it."""
    near = f"""(
  SELECT rid, p, min(d * 64 + e) AS best FROM (
    SELECT rid, a.p, b.e, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts AS a JOIN b{k} AS b ON a.p = b.p) GROUP BY rid, p)"""
    if k == 2:
        return f", a2 AS {near}"
    return f""", a{k} AS {near}, m{k} AS (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY k) AS q FROM (
    SELECT p, best % 64 AS e, k, sum(q[k]) AS s, count(*) AS n FROM parts JOIN a{k} USING (rid, p), range(1, 65) AS t(k) WHERE k <= len(q) GROUP BY ALL)
  GROUP BY p, e
), b{k + 1} AS (
  SELECT p, e, coalesce(m.q, b.q) AS q FROM b{k} AS b LEFT JOIN m{k} AS m USING (p, e))"""


VECTOR_CODES += _round(0) + _round(1) + _round(2) + """, codes AS (
  SELECT rid, string_agg(format('{:02x}', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(q) AS x, generate_subscripts(q, 1) AS k FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (rid), digest"""

#: Table of the 256 values that a CRC-32 looks up.
CRC32 = """crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))) ORDER BY b) AS crc_t
  FROM range(256) AS r(b))"""


def _crc32(hexed: str) -> str:
    """Unsigned CRC-32 of bytes given as hexadecimal digits."""
    byte = f"CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len({hexed}) // 2), lambda i: {byte})), "
            "lambda c, x: xor(c >> 8, crc_t[(xor(c, x) & 255) + 1])), 4294967295)")


def _cell(dim: str) -> str:
    return f"""c_{dim} AS (
  SELECT {dim} AS v, dense_rank() OVER (ORDER BY (upto - n) * 32 // total) - 1 AS cell FROM (
    SELECT {dim}, n, sum(n) OVER (ORDER BY {dim}) AS upto, sum(n) OVER () AS total
    FROM (SELECT {dim}, count(*) AS n FROM documents WHERE {dim} IS NOT NULL GROUP BY {dim})))"""


HILBERT = f"""
WITH {CRC32}, {", ".join(_cell(d) for d in ("source", "lang", "n_chars"))}, hexed AS (
  SELECT doc_id, source, lang, n_chars, hex(encode(coalesce(text, ''))) AS h FROM documents
), slim AS (
  SELECT doc_id, source, lang, n_chars, len(h) // 2 + 1 AS size, {_crc32("h")} AS text_crc32 FROM hexed, crc_table
), placed AS (
  SELECT doc_id, size, text_crc32, list_reduce(list_prepend(0, [4, 3, 2, 1, 0]), lambda a, b:
    ((a // 256 * 8 + ({curve_steps(3)}[(a % 256) * 8 + ((x >> b) & 1) + 2 * ((y >> b) & 1) + 4 * ((z >> b) & 1) + 1] & 7)) * 256
     + ({curve_steps(3)}[(a % 256) * 8 + ((x >> b) & 1) + 2 * ((y >> b) & 1) + 4 * ((z >> b) & 1) + 1] >> 3))) // 256 AS curve
  FROM (SELECT slim.*, CAST(coalesce(cs.cell, 0) AS BIGINT) AS x, CAST(coalesce(cl.cell, 0) AS BIGINT) AS y,
               CAST(coalesce(cn.cell, 0) AS BIGINT) AS z
        FROM slim LEFT JOIN c_source AS cs ON source = cs.v LEFT JOIN c_lang AS cl ON lang = cl.v LEFT JOIN c_n_chars AS cn ON n_chars = cn.v)
), run AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS n, sum(size) OVER () AS total FROM placed
  WINDOW w AS (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), shards AS (
  SELECT *, least(7, (2 * upto - size) * 8 // (2 * total)) AS k FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(k AS INT) AS shard, n - min(n) OVER (PARTITION BY k) AS slot,
       CAST(NULL AS INT) AS grown_shard, CAST(curve AS BIGINT) AS curve
FROM shards"""

CONVERSATION_TRIE = f"""
WITH {CRC32}, own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS seq,
         hex(encode(CAST(conv_id AS VARCHAR))) AS hexed
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taken AS (
  SELECT conv_id, seq, {_crc32("hexed")} % 9 AS h FROM own, crc_table
), rebuilt AS (
  SELECT t.conv_id, list_concat(coalesce(b.seq[1:h], []), t.seq[h + 1:]) AS seq
  FROM taken AS t LEFT JOIN own AS b ON b.conv_id = t.conv_id - t.conv_id % 5
), nodes AS (
  SELECT p, len(p) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256,
         CASE WHEN len(p) > 0 THEN (count(*) - 1) * strlen(p[len(p)].text) ELSE 0 END AS cost
  FROM (SELECT conv_id, seq[1:d] AS p, d = len(seq) AS last FROM rebuilt, range(0, len(seq) + 1) AS r(d)) GROUP BY p
), kids AS (
  SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), named AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)
), below AS (
  SELECT a.p, sum((b.n_children = 0)::INT) AS n_leaves, sum(b.cost) AS saved_tokens
  FROM named AS a JOIN named AS b ON b.depth >= a.depth AND b.p[1:a.depth] = a.p GROUP BY a.p
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM named AS n JOIN below USING (p) LEFT JOIN named AS up ON n.depth > 0 AND up.p = n.p[1:n.depth - 1]"""

NGRAM_JOIN = """
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM split
), rows AS MATERIALIZED (
  SELECT rid, len(g) AS n, unnest(g) AS g FROM sets
), links AS MATERIALIZED (
  SELECT u, v FROM (SELECT a.rid AS u, b.rid AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
    FROM rows AS a JOIN rows AS b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid)
  WHERE 100 * c >= 75 * (n + m - c)
), reach AS (
  SELECT rid, rid AS other FROM sets UNION SELECT reach.rid, links.v FROM reach JOIN links ON reach.other = links.u
)
SELECT s.doc_id, len(s.g) AS n_shingles, CASE WHEN len(s.g) > 0 THEN min(o.doc_id) ELSE s.doc_id END AS component_id
FROM sets AS s JOIN reach ON s.rid = reach.rid JOIN sets AS o ON reach.other = o.rid GROUP BY s.rid, s.doc_id, s.g"""

SUFFIX_DEDUP = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS MATERIALIZED (
  SELECT rid, i, hash(substr(h, 2 * i + 1, 800)) AS x FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM docs)
), again AS (
  SELECT rid, i FROM windows JOIN (SELECT x FROM windows GROUP BY x HAVING count(*) > 1) USING (x)
), steps AS (
  SELECT rid, i, coalesce(i - lag(i) OVER w > 400, true) AS fresh FROM again WINDOW w AS (PARTITION BY rid ORDER BY i)
), spans AS (
  SELECT rid, min(i) AS a, max(i) + 400 AS b FROM (
    SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM steps) GROUP BY rid, k
), cut AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(part, '' ORDER BY a) || any_value(tail) AS kept FROM (
    SELECT rid, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS part,
           substr(h, 2 * max(b) OVER (PARTITION BY rid) + 1) AS tail
    FROM spans JOIN docs USING (rid) WINDOW w AS (PARTITION BY rid ORDER BY a)) GROUP BY rid
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)"""

SQL: dict[str, str] = {
    "op2_ngram_join": NGRAM_JOIN,
    "op6_suffix_dedup": SUFFIX_DEDUP,
    "op11_vector_codes": VECTOR_CODES,
    "op12_hilbert_shards": HILBERT,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
