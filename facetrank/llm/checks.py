"""DuckDB SQL of those queries of this package that SQL can express.

The others search approximately, learn, sample, tokenize or link documents over many steps; tests hold them against
plain versions.
"""

from __future__ import annotations

from facetrank.llm.mixing import mix_sql
from facetrank.llm.queries import BASE_KINDS, BLOCK_OF_CONVERSATIONS, HEADS
from facetrank.llm.secrets import RULES
from facetrank.llm.spelling import LEAST, TIMES
from facetrank.llm.warc import MIN_REVISIT

_PAGES = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
digests AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM payloads),
groups AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM digests)
SELECT page_id, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN last END AS refers_to, payload_bytes, payload_digest
FROM groups"""


def _secrets_sql() -> str:
    def found(place: int, rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
        SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, i, m[i] AS own, g[i] AS tested, b[:i] AS before, m[:i-1] AS earlier,
               {"length(l[i])" if rule.lead else 0} AS lead
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
                     regexp_extract_all(t, '{pattern}', {rule.lead}) AS l,
                     string_split_regex(t, '{pattern}') AS b
              FROM texts WHERE regexp_matches(t, '{pattern}')), unnest(generate_series(1, len(m))) AS u(i)
        WHERE length(g[i]) >= {rule.at_least}"""

    every = " UNION ALL ".join(found(i, r) for i, r in enumerate(RULES, 1))
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    matches AS ({every}),
    placed AS (SELECT doc_id, kind, place, own, lead,
                      (list_sum(list_transform(before, lambda x: length(x))) + coalesce(list_sum(list_transform(earlier, lambda x: length(x))), 0))::BIGINT AS start
               FROM matches),
    spans AS (SELECT doc_id, kind, place, start + lead AS start, kind || ':' || (start + lead) || ':' || (start + length(own)) AS span FROM placed)
    SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (kind IN ({base})), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
    FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


#: crc_table: one row, the 256 remainders of CRC-32.
_CRC_TABLE = """
bits AS (SELECT n::BIGINT AS n, 0 AS k, n::BIGINT AS c FROM range(256) t(n)
         UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS crc_of FROM bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """SQL of the crc32 of a text's UTF-8 bytes; crc_of must be in scope."""
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(0, length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, crc_of[1 + (xor(a, b) & 255)]), 4294967295), 4294967295)"


_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns
        FROM told GROUP BY conv_id),
heads AS (SELECT conv_id, turns, ({_crc32("conv_id::VARCHAR")} % {HEADS})::BIGINT AS h FROM own, crc_table),
rebuilt AS (SELECT o.conv_id, coalesce(b.turns, []) [1:o.h] || o.turns[o.h + 1:] AS s
            FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {BLOCK_OF_CONVERSATIONS}),
prefixes AS (SELECT conv_id, d, s[1:d] AS k, len(s) = d AS ends FROM rebuilt, unnest(generate_series(0, len(s))) u(d)),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM prefixes GROUP BY d, k),
children AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children,
                   (n.n_convs - 1) * CASE WHEN n.d > 0 THEN length(n.k[n.d].text) ELSE 0 END AS saved
            FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.k = n.k),
subtrees AS (SELECT u.d, k[1:u.d] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved
             FROM counted c, unnest(generate_series(0, c.d)) u(d) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s ON s.d = n.d AND s.k = n.k
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]"""

_SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
         FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST} GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc_table),
edited AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word
           FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM words, unnest(generate_series(1, length(word))) u(i)),
pairs AS (SELECT p.word AS word, q.word AS other FROM places p JOIN places q ON p.i = q.i AND p.a = q.a AND p.b = q.b AND p.word <> q.word
          UNION SELECT p.word, w.word FROM places p JOIN words w ON w.word = p.a || p.b
          UNION SELECT w.word, p.word FROM places p JOIN words w ON w.word = p.a || p.b),
near AS (SELECT p.word, count(*) AS n_near, max(w.n) AS best_n FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
best AS (SELECT p.word, min(p.other) AS best FROM pairs p JOIN words w ON w.word = p.other JOIN near x ON x.word = p.word AND x.best_n = w.n
         GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.best_n >= {TIMES} * w.n THEN b.best END AS form,
                 CASE WHEN x.best_n >= {TIMES} * w.n THEN x.best_n END AS form_n
          FROM words w LEFT JOIN near x ON x.word = w.word LEFT JOIN best b ON b.word = w.word),
chains AS (SELECT word, word AS at FROM forms
           UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL"""

CHECKS: dict[str, str] = {
    "op3_zip_warc": _PAGES,
    "op6_poisson_mixture": mix_sql("documents"),
    "op10_blob_ledger": _secrets_sql(),
    "op11_truncation_peeling": _TRIE,
    "op12_fm_index": _SPELLING,
}
