"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

_OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS solid FROM d),
win AS (SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rn, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rn),
m AS (SELECT rn, doc_id, len(ws)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce((SELECT n FROM cov WHERE cov.rn = w.rn), 0)::BIGINT AS n_repeat_words,
             (length(solid) - length(regexp_replace(solid, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals FROM w),
l AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_symbols > 0.25 * n_words)::BIGINT
             + 8 * (n_dup_lines > 0.7 * n_lines)::BIGINT + 16 * (word_chars < 2.0 * n_words)::BIGINT
             + 32 * (word_chars > 25.0 * n_words)::BIGINT + 64 * (n_capitals > 0.6 * word_chars)::BIGINT) AS ledger FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (ledger & 3) <> 0 AS base_failed, ledger = 0 AS kept,
       n_lines, n_capitals, ledger FROM l
"""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
tot AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inn AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k)),
best AS (SELECT lang, phrase, max(a) AS m FROM inn GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN best USING (lang, phrase) WHERE m IS NULL OR m < c.a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS p1, array_to_string(ws[j + 1:k], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
sc AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, n, ((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2 JOIN tot ON tot.lang = cuts.lang),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM sc) WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM w) WHERE rank <= 2000
"""

_OP12 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP13 = rf"""
WITH RECURSIVE tab0 AS (SELECT i AS b, i::BIGINT AS c, 0 AS step FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM tab0 WHERE step < 8),
tab AS (SELECT b, c FROM tab0 WHERE step = 8),
docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
src AS (SELECT rn, regexp_extract_all({_ASCII_LOWER.format('t')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM docs
        UNION ALL SELECT -1, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT rn, unnest(ws) AS feature FROM src UNION ALL SELECT rn, ws[i] || ' ' || ws[i + 1] FROM (SELECT rn, ws, unnest(range(1, len(ws))) AS i FROM src)),
crc AS (SELECT feature, hex(encode(feature)) AS h, 4294967295::BIGINT AS c, 0 AS i FROM (SELECT DISTINCT feature FROM f)
        UNION ALL SELECT feature, h, xor(tab.c, crc.c // 256), i + 1 FROM crc JOIN tab ON tab.b = xor(crc.c % 256, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) WHERE 2 * i < length(h)),
b AS (SELECT feature, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * i = length(h)),
o AS (SELECT rn, bucket FROM f JOIN b USING (feature)),
tot AS (SELECT count(*) FILTER (WHERE rn >= 0)::DOUBLE AS s_all, count(*) FILTER (WHERE rn < 0)::DOUBLE AS t_all FROM o),
g AS (SELECT bucket, floor(1000 * ln((count(*) FILTER (WHERE rn < 0) + 1.0::DOUBLE) * (any_value(s_all) + 10000) / ((count(*) FILTER (WHERE rn >= 0) + 1.0::DOUBLE) * (any_value(t_all) + 10000)))) AS gain FROM o, tot GROUP BY bucket),
w AS (SELECT rn, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM o JOIN g USING (bucket) WHERE rn >= 0 GROUP BY rn),
sc AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(ws) >= 20 AS e,
              coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
       FROM docs d JOIN src USING (rn) LEFT JOIN w USING (rn)),
k AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY e) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN e AND place <= 25 * n // 100 THEN place END AS rank FROM k
"""

ORACLE_SQL: dict[str, str] = {"op9_quality_rules": _OP9, "op11_collocations": _OP11, "op12_exact_top_k": _OP12, "op13_importance_resampling": _OP13}
