"""DuckDB SQL of the queries that SQL can express, written independently of the Spark plans.

Language models, classifiers, tokenizers and page layout are beyond SQL; their queries are tested
against brute force, held-out labels, round trips and worked examples.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS key, len({_WORDS}) + 1 AS n,
         md5(concat_ws(':', '17', 'doc', coalesce(CAST(doc_id AS VARCHAR), ''))) AS digest
  FROM documents),
sources AS (SELECT key, CAST(sum(n) AS BIGINT) AS tokens FROM docs GROUP BY key),
stats AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM sources),
shares AS (SELECT key, tokens, tokens / CAST(total AS DOUBLE) AS p FROM sources, stats),
natural_mix AS (SELECT -sum(p * ln(p)) AS h FROM shares),
entropy(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= 0.95 * ln((SELECT n FROM stats)) THEN (low + high) / 2 ELSE low END,
         CASE WHEN h >= 0.95 * ln((SELECT n FROM stats)) THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high, (SELECT ln(sum(pow(p, (low + high) / 2)))
                - sum(pow(p, (low + high) / 2) * (low + high) / 2 * ln(p)) / sum(pow(p, (low + high) / 2)) FROM shares) AS h
        FROM entropy WHERE i < 40)),
repeats(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN m > 4 THEN (low + high) / 2 ELSE low END, CASE WHEN m > 4 THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high, (SELECT max(pow(p, (low + high) / 2 - 1)) / sum(pow(p, (low + high) / 2)) FROM shares) AS m
        FROM repeats WHERE i < 40)),
exponent AS (
  SELECT CASE WHEN (SELECT n FROM stats) < 2 OR (SELECT h FROM natural_mix) >= 0.95 * ln((SELECT n FROM stats)) THEN 1.0
              ELSE greatest((SELECT low FROM entropy WHERE i = 40),
                            CASE WHEN (SELECT max(1 / p) / count(*) FROM shares) > 4
                                 THEN (SELECT high FROM repeats WHERE i = 40) ELSE 0 END) END AS a),
granted AS (
  SELECT key, tokens, CAST(floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, exponent) * total + 1e-6) AS BIGINT) AS granted,
         CAST(greatest(1, least(4096, ceil(tokens / 65536.0))) AS BIGINT) AS blocks
  FROM shares, exponent, stats),
dealt AS (
  SELECT docs.*, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % blocks AS block, granted // tokens AS whole, granted % tokens AS rest
  FROM docs JOIN granted USING (key)),
blocks AS (SELECT key, block, whole, rest, CAST(sum(n) AS BIGINT) AS size FROM dealt GROUP BY ALL),
epochs AS (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM blocks),
ranked AS (
  SELECT *, row_number() OVER w AS rank, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS reached
  FROM epochs
  WINDOW w AS (PARTITION BY key, epoch ORDER BY md5(concat_ws(':', '17', 'block', key, CAST(epoch AS VARCHAR), CAST(block AS VARCHAR))), block)),
taken AS (
  SELECT key, block, epoch, rank, epoch < whole OR reached <= rest AS complete, rest - (reached - size) AS room FROM ranked
  WHERE epoch < whole OR reached <= rest OR rest - (reached - size) > 0),
part AS (
  SELECT dealt.key, dealt.block, epoch, digest, room,
         sum(n) OVER (PARTITION BY dealt.key ORDER BY digest RANGE UNBOUNDED PRECEDING) AS used
  FROM dealt JOIN taken ON dealt.key = taken.key AND dealt.block = taken.block AND NOT complete)
SELECT doc_id, source, dealt.block AS mix_block, taken.epoch AS mix_epoch, rank AS mix_rank
FROM dealt JOIN taken ON dealt.key = taken.key AND dealt.block = taken.block
WHERE complete OR EXISTS (SELECT 1 FROM part WHERE part.key = dealt.key AND part.digest = dealt.digest AND used <= room)
"""

REPEATED_WORDS = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS w FROM places),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS s FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, met = x.n AND met = y.n AS same FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * met >= 4 * (x.n + y.n - met)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, min(reach.b) AS class_id,
       least(doc_id, (SELECT min(b) FROM links WHERE a = doc_id AND same)) AS copy_id,
       (SELECT count(*) FROM links WHERE a = doc_id) AS n_links
FROM d JOIN reach ON reach.a = doc_id GROUP BY doc_id
"""

TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BENCHMARK = rf"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN} AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[s:s + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS s FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)),
found AS (SELECT doc_id, s, n, item FROM doc_windows JOIN item_windows USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * hit.n >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
later AS (SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY w)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM later),
removed AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before <> i - 1) AS spans
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit) GROUP BY doc_id),
bytes AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS x, i FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS h FROM bytes ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# crc32 of the id's digits, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

# A blank is the end of a text and two are its start: no word holds any.
LANGUAGE_MODEL = rf"""
WITH d AS (
  SELECT doc_id, {_CRC} % 5 = 1 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS ws
  FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(ws) AS w, unnest(list_prepend('  ', ws)[:-2]) AS before FROM d),
singles AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
pairs AS (SELECT before, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY ALL),
starts AS (SELECT before, sum(c) AS c FROM pairs GROUP BY before),
totals AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM singles),
p AS (
  SELECT doc_id, held_out, coalesce(singles.c, 0) AS c, (coalesce(singles.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p,
         coalesce(pairs.c, 0) AS together, coalesce(starts.c, 0) AS context, n
  FROM tokens CROSS JOIN totals LEFT JOIN singles USING (w) LEFT JOIN pairs ON pairs.before = tokens.before AND pairs.w = tokens.w
       LEFT JOIN starts ON starts.before = tokens.before)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, any_value(n) AS train_tokens,
       round(fsum(log10(p)), 6) AS base_score, round(fsum(log10((together + 500 * p) / (context + 500))), 6) AS score
FROM p GROUP BY doc_id, held_out
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
totals AS (SELECT count(*) FILTER (WHERE len(ts) > 0)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM d),
postings AS (SELECT doc_id, len AS n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS t FROM d) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(totals.n) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY t),
wanted AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * postings.n * totals.n) // totals.l)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (t) JOIN postings USING (t) CROSS JOIN totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def statements() -> dict[str, str]:
    return {
        "op1_mix_sources": MIX,
        "op2_suffix_automata": REPEATED_WORDS,
        "op3_ngram_join": NEAR,
        "op6_topk": TOP,
        "op7_decontaminate": BENCHMARK,
        "op8_suffix_arrays": REPEATED_BYTES,
        "op11_lm_score": LANGUAGE_MODEL,
        "op12_ranked_search": RANKED,
    }
