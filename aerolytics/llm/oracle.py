"""DuckDB twins of the training-data queries that SQL expresses on whole tables.

The others (fingerprints by XXH64, suffix and licence scans, personal data with
checksums, tokenizers, fitted models, packing) are held against brute-force
versions in the tests.
"""

from __future__ import annotations

# The stop words, written out a second time so that a wrong list on either side fails.
STOP_WORDS = (
    "a an and are as at be been by for from had has have he her his in is it its not of on or that the "
    "their they this to was were which will with you "
    "als auch auf aus bei das dem den der des die ein eine einer es für ich im ist mit nicht sich sie "
    "und von war wird zu zum zur über "
    "au aux avec ce ces dans de du elle en est et il ils la le les leur mais ne par pas plus pour qui "
    "que se ses son sur un une "
    "al como con del el ella es esta este han las lo los más muy no o para pero por ser sin su sus también "
    "una y").split()

_STOP = ", ".join("'" + w + "'" for w in STOP_WORDS)

# A window of 35 words is its text, as words hold no spaces.
SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM win),
again AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM again, range(0, 35) r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words w ANTI JOIN gone g
         ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE first) AS spans
         FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS first FROM gone)
         GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256, coalesce(r.spans, 0) AS n_spans
FROM d LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
              count(*) FILTER (WHERE regexp_matches(line, '^\s*[-*•]\s')) AS n_bullet,
              count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)\s*$')) AS n_ellipsis
       FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS i, w FROM d WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM win)
          QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
st AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) WHERE lower(x) IN (STOP) GROUP BY doc_id),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 8) r(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_shouts,
             coalesce(st.n, 0) AS n_stop,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_bullet, 0) AS n_bullet,
             coalesce(n_ellipsis, 0) AS n_ellipsis, coalesce(rep.n, 0) AS n_repeat_words
      FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN st USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words
         AND 10 * n_shouts <= 3 * n_words AND 100 * n_stop >= n_words AND 2 * n_dup_lines <= n_lines
         AND 10 * n_bullet <= 9 * n_lines AND 10 * n_ellipsis <= 3 * n_lines AS kept
FROM b
""".replace("STOP", _STOP)

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

# crc32 of the decimal id bit by bit; a rebuilt conversation is the list of its
# turns, a node the first d of them; subtrees by joining nodes to their prefixes.
PREFIX_TRIE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p,
                  {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS said
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY p) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS first,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1),
                 lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
                 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                     lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h FROM own),
built AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
          FROM h a LEFT JOIN own b ON b.conv_id = a.first),
path AS (SELECT conv_id, len(turns) AS length, unnest(range(0, len(turns) + 1)) AS d, turns FROM built),
keyed AS (SELECT conv_id, length, d, CASE WHEN d > 0 THEN turns[d].x END AS said, turns[1:d]::VARCHAR AS k,
                 CASE WHEN d > 0 THEN turns[1:d - 1]::VARCHAR END AS up FROM path),
node AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n,
                coalesce(len(regexp_extract_all(any_value(said), '[^\x20\x09-\x0D]+')), 0) AS words,
                coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = d), '') AS ends
         FROM keyed GROUP BY k),
child AS (SELECT up AS k, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (k)),
under AS (SELECT DISTINCT a.k AS top, b.k, b.words, b.n, b.n_children
          FROM keyed b0 JOIN keyed a0 ON a0.conv_id = b0.conv_id AND a0.d <= b0.d
          JOIN full_node a ON a.k = a0.k JOIN full_node b ON b.k = b0.k),
sums AS (SELECT top AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n - 1) * words) AS saved FROM under GROUP BY top)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN sums s USING (k) LEFT JOIN node p ON p.k = f.up
"""

_KEPT = """v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, p AS c
  FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)"""
_NEAREST = """a{t} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(p) AS p, min({{'d': d, 'k': k}}) AS m
  FROM (SELECT v.*, k, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{t})
  GROUP BY i)"""
_MOVED = """c{n} AS MATERIALIZED (SELECT c{t}.k, coalesce(u.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c
    FROM (SELECT m.k AS k, j, sum(p[j]) AS s, count(*) AS n FROM a{t}, range(1, 65) r(j) GROUP BY m.k, j) GROUP BY k) u
  ON u.k = c{t}.k)"""
CENTROIDS = "WITH " + ",\n".join([_KEPT] + [x for t in range(10) for x in (_NEAREST.format(t=t), _MOVED.format(t=t, n=t + 1))]
                                + [_NEAREST.format(t=10)]) + """
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
       CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON c10.k = a10.m.k
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op3_quality_rules": QUALITY_RULES,
    "op4_exact_dedup": EXACT_DEDUP,
    "op11_conversation_prefix_trie": PREFIX_TRIE,
    "op12_centroid_clustering": CENTROIDS,
}
