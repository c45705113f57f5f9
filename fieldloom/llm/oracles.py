"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from fieldloom.llm import quality

OP1 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         coalesce(floor(turn / 256.0)::bigint, -1) AS part
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
parts AS (SELECT DISTINCT conv_id, part FROM t),
x AS (
  SELECT t.conv_id, s.speaker, t.part, t.turn, t.role, t.text, t.role = s.speaker AS mine,
         '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system'
              ELSE 'user name=' || t.role END || chr(10) AS head,
         t.text || '<|im_end|>' || chr(10) AS body,
         row_number() OVER (PARTITION BY t.conv_id, s.speaker, t.part ORDER BY t.turn NULLS FIRST, t.role, t.text) AS n
  FROM t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY n) AS upto FROM x)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (mine) AS n_target_turns,
       string_agg(head || body, '' ORDER BY n) AS rendered,
       coalesce(string_agg((upto - length(body))::bigint::varchar || '-' || upto::bigint::varchar, ' ' ORDER BY n) FILTER (mine), '') AS mask,
       sum(length(head) + length(body))::bigint AS n_chars,
       coalesce(sum(length(body)) FILTER (mine), 0)::bigint AS n_masked_chars
FROM y GROUP BY conv_id, speaker, part
"""

OP2 = """
WITH rules(rule_host, rule_path, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, w.rule, coalesce(w.v, 'allow') AS verdict
FROM c LEFT JOIN LATERAL (
  SELECT rule_host || rule_path AS rule, v FROM rules
  WHERE (c.host = rule_host OR suffix(c.host, '.' || rule_host)) AND prefix(c.path, rule_path)
  ORDER BY length(rule_host) DESC, length(rule_path) DESC LIMIT 1) w ON true
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::bigint AS payload_bytes, sha1(h) AS payload_digest, row_number() OVER (PARTITION BY page_id, sha1(h)) AS n FROM p),
m AS (SELECT payload_digest, max(page_id) AS latest FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN latest IS NOT NULL AND (page_id <> latest OR n > 1) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> latest OR n > 1 THEN latest END AS refers_to
FROM q LEFT JOIN m USING (payload_digest)
"""

_WORDS = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)
_CLASSES = ", ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2).replace(chr(92) + chr(39) * 2, chr(39) * 2)}', '', 'g')) AS c_{k}" for k, p in quality.CHAR_CLASSES.items())
_BINS = [f"c_{k}" for k in quality.CHAR_CLASSES]
_PART = "CASE WHEN {a} > 0 THEN 0.5 * {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
_TERM = _PART.format(a="p", b="q") + " + " + _PART.format(a="q", b="p")

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
u AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT rid, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS z(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
f AS (SELECT rid, doc_id, lang, t, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {_CLASSES} FROM w),
h AS (SELECT *, length(t) - word_chars AS c_space, word_chars - {" - ".join(_BINS)} AS c_other FROM f),
cb AS (SELECT rid, lang, unnest(['space', 'other', {", ".join(f"'{b[2:]}'" for b in _BINS)}]) AS bin,
              unnest([c_space, c_other, {", ".join(_BINS)}]) AS n FROM h),
wu AS (SELECT u.rid, d.lang, CASE WHEN lower(u.word) IN ({_WORDS}) THEN lower(u.word) ELSE '' END AS bin, count(*) AS n FROM u JOIN d USING (rid) GROUP BY ALL),
b AS (SELECT rid, h.lang, h.n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, h.n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * h.n_words AS base_failed
      FROM h LEFT JOIN covered USING (rid)),
big AS (SELECT lang FROM b WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= {quality.MIN_REFERENCE_WORDS}),
cg AS (SELECT cb.lang, bin, sum(n) AS n FROM cb JOIN b USING (rid) WHERE NOT base_failed GROUP BY cb.lang, bin),
wg AS (SELECT wu.lang, bin, sum(n) AS n FROM wu JOIN b USING (rid) WHERE NOT base_failed GROUP BY wu.lang, bin),
langs AS (SELECT DISTINCT d.lang, big.lang IS NOT NULL AS own FROM d LEFT JOIN big USING (lang)),
cr AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS q FROM
        (SELECT l.lang, bin, sum(n) AS n FROM langs l JOIN cg ON cg.lang = l.lang OR NOT l.own GROUP BY l.lang, bin)),
wr AS (SELECT lang, bin, n / sum(n) OVER (PARTITION BY lang) AS q FROM
        (SELECT l.lang, bin, sum(n) AS n FROM langs l JOIN wg ON wg.lang = l.lang OR NOT l.own GROUP BY l.lang, bin)),
cd AS (SELECT rid, sqrt(greatest(0, sum({_TERM}))) AS char_distance FROM
        (SELECT rid, n / nullif(sum(n) OVER (PARTITION BY rid), 0) AS p, q FROM cb JOIN cr USING (lang, bin)) WHERE p IS NOT NULL GROUP BY rid),
own AS (SELECT rid, lang, bin, n / sum(n) OVER (PARTITION BY rid) AS p FROM wu),
both_ AS (SELECT o.rid, wr.bin, wr.q FROM (SELECT DISTINCT rid, lang FROM own) o JOIN wr USING (lang)),
wd AS (SELECT rid, sqrt(greatest(0, sum({_TERM}))) AS word_distance FROM
        (SELECT coalesce(own.rid, both_.rid) AS rid, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM both_ FULL JOIN own ON own.rid = both_.rid AND own.bin = both_.bin) GROUP BY rid),
r AS (SELECT doc_id, h.n_words, word_chars, c_symbol AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, b.n_repeat_words, base_failed, char_distance, word_distance
      FROM h JOIN b USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(char_distance, 4) AS char_distance, round(word_distance, 4) AS word_distance,
       NOT base_failed AND NOT (n_words >= {quality.MIN_WORDS}
         AND (coalesce(char_distance, 0) > {quality.MAX_CHAR_DISTANCE} OR coalesce(word_distance, 0) > {quality.MAX_WORD_DISTANCE})) AS kept
FROM r
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
b AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::bigint AS n_terms FROM d),
p AS (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
t AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint AS weight FROM t, s GROUP BY term, n_docs),
r AS (SELECT item_id, text, rid, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint AS score
      FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY item_id, text, rid, doc_id HAVING score > 0)
SELECT item_id, rank::int AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r) WHERE rank <= 10
"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v::double[], b.v::double[])::bigint AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::int AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
