"""DuckDB SQL for the corpus queries that SQL can state over whole tables."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_FINITE}),
 n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
 reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id),
 parts AS (SELECT id, min(c) AS component_id FROM reach GROUP BY 1), degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
 FROM embeddings JOIN parts ON id = vec_id LEFT JOIN degree ON a = vec_id"""

_TAILS = r"(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE\]|/ROLE\]|/TURN\]|NOROLE\]|\|endoftext\|>)"
_ESCAPED = rf"length(regexp_replace(text, '([<\[])(\\*){_TAILS}', '\1\2\\\3', 'g'))"

OP3 = f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
 x AS (SELECT *, {_ESCAPED} + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 11 ELSE 20 + length(role) END AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 CAST(3 + sum(size) AS BIGINT) AS formatted_chars FROM x GROUP BY conv_id"""

OP9 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_FINITE}),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
 n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s),
 both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
 reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id),
 parts AS (SELECT id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, n_shingles, component_id FROM n JOIN parts ON id = n.doc_id"""

_CRC32 = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
 lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))"""

OP11 = rf"""WITH o AS (SELECT doc_id, {_CRC32} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT *, len(w) AS n, h // 10 AS g FROM o), a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
 p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
 d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE w END AS w FROM p),
 u AS (SELECT doc_id, n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w FROM d),
 m AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i < x.i WHERE 4 * (x.i - y.i) <= x.n),
 k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
 s AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
 r AS (SELECT doc_id, start, length, min(q) AS q FROM s GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS best FROM r),
 n AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY 1),
 x AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
 c AS (SELECT u.doc_id, string_agg(w, ' ' ORDER BY u.i) AS t FROM u ANTI JOIN x ON u.doc_id = x.doc_id AND u.i = x.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
 CAST(1000 * b.length // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id AND best = 1 LEFT JOIN c ON c.doc_id = d.doc_id"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP12 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark),
 t AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE [w[i : i + 9] FOR i IN range(1, len(w) - 8)] END) AS t FROM b),
 g AS (SELECT DISTINCT len(t) AS n FROM t),
 u AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM d),
 l AS (SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM u),
 p AS (SELECT doc_id, i, n, array_to_string(l[1:n], ' ') AS t FROM l, g WHERE len(l) >= n),
 h AS (SELECT doc_id, i, n, item_id FROM p JOIN (SELECT item_id, array_to_string(t, ' ') AS t FROM t) t ON p.t = t.t),
 c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1),
 e AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id"""

OP13 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
 w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
 u AS (SELECT lang, piece, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM w),
 v AS (SELECT lang, w AS x, lead(w) OVER o AS y, lead(w, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY piece ORDER BY i)),
 g AS (SELECT lang, 1 AS k, x AS phrase FROM v UNION ALL SELECT lang, 2, x || ' ' || y FROM v WHERE y IS NOT NULL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM v WHERE z IS NOT NULL),
 f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
 c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
 s AS (SELECT c.*, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')),
 m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 inner_ AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
 o AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
 z AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN o ON o.lang = m.lang AND o.phrase = m.phrase
  WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2, "op3_chat_format": OP3, "op9_topk_search": OP9, "op10_ngram_jaccard": OP10, "op11_periodic_runs": OP11, "op12_decontamination": OP12, "op13_collocations": OP13}
