"""ANSI SQL of the catalogue's queries, written independently of the Spark plans, for DuckDB."""

from __future__ import annotations

from labelloom.plans.catalog import LABELS, MODEL, VARIANTS

SYSTEM = (
    "You are a text classifier for labels: english, french, german, spanish. When I send you a text to classify, respond "
    "only with the label and confidence score separated by a comma. For example: \"english,0.95\". Don''t include any "
    "other text in your response."
)
TASK_BEFORE, TASK_AFTER = (
    "Name the language of the text.",
    "I will send you texts to classify. For each text, respond with only the label and a confidence score (between 0 and 1) "
    "separated by a comma. No other text or explanation",
)
FORMAT_RULE = "For example, if you think a text is english with 95% confidence, respond with exactly: english,0.95"


def u(seed: int, *parts: str) -> str:
    """Hashed uniform of seed and parts."""
    key = f"md5(concat_ws(':', '{seed}', {', '.join(parts)}))"
    return f"(CAST('0x' || substr({key}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def key(seed: int, *parts: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(parts)}))"


def draws(seed: int, row_id: str, name: str) -> str:
    """Coefficients of the position hash."""
    k = key(seed, row_id, f"'{name}'")
    return "[" + ", ".join(f"CAST('0x' || substr({k}, {1 + 8 * j}, 8) AS BIGINT) % 2147483647" for j in range(3)) + "]"


def at(c: str, i: str) -> str:
    """Uniform of position ``i`` (0-based) from coefficients ``c``."""
    return f"(((({c}[3] * {i} + {c}[2]) % 2147483647) * {i} + {c}[1]) % 2147483647 / 2147483647.0::DOUBLE)"


LANGUAGE = "CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' END"
DOCS = f"docs AS (SELECT doc_id, text, {LANGUAGE} AS label FROM documents)"


def reply(i: str, label: str) -> str:
    return f"""CASE {i} % 12
    WHEN 0 THEN {label} || ',0.95' WHEN 1 THEN upper({label}) || ' , 95%'
    WHEN 2 THEN substr({label}, 1, 2) || substr({label}, 4, 20) || ',0.8'
    WHEN 3 THEN {label} WHEN 4 THEN 'I say ' || {label} || ' 0.8' WHEN 5 THEN 'not ' || {label}
    WHEN 6 THEN {label} || ',0' WHEN 7 THEN {label} || ',-0.5' WHEN 8 THEN {label} || ',nan'
    WHEN 9 THEN {label} || ',' WHEN 10 THEN 'klingon,0.7'
    ELSE CASE WHEN {label} = 'english' THEN 'french' ELSE 'english' END || ',0.9,sure' END"""


def reading(source: str) -> str:
    """CTEs that parse, match and score the ``response`` column of ``source``, ending in ``scored``."""
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    number = r"TRY_CAST(nullif(regexp_extract({}, '([0-9]+\.[0-9]+|[0-9]+)', 1), '') AS DOUBLE)"
    clamp = "(CASE WHEN {0} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0})) END)"
    contained = "\n".join(f"WHEN contains(lower(response), '{x}') THEN '{x}'" for x in LABELS)
    known = ", ".join(f"'{x}'" for x in LABELS)
    candidates = ", ".join(
        f"{{'d': levenshtein(lower(trim(raw_label)), '{x}'), 'i': {i}, 'x': '{x}'}}" for i, x in enumerate(LABELS)
    )
    return f"""
split AS (SELECT *, {strip.format('response')} AS t FROM {source}),
parts AS (SELECT *, strpos(t, ',') AS comma,
  substr(t, 1, strpos(t, ',') - 1) AS head, substr(t, strpos(t, ',') + 1) AS tail FROM split),
fields AS (SELECT *, {strip.format('tail')} AS f FROM parts),
parsed AS (SELECT *,
  CASE WHEN comma > 0 THEN {strip.format('head')} WHEN t IN ({known}) THEN t
       ELSE CASE {contained} ELSE t END END AS raw_label,
  CASE WHEN comma > 0 THEN
         CASE WHEN regexp_matches(f, '^[+-]?(nan|NaN|NAN)$') OR regexp_matches(lower(f), '^[+]?inf(inity)?$') THEN 1.0::DOUBLE
              WHEN regexp_matches(lower(f), '^-inf(inity)?$') THEN 0.0::DOUBLE
              WHEN regexp_matches(f, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
                THEN {clamp.format('CAST(f AS DOUBLE)')}
              ELSE coalesce({clamp.format(number.format('tail'))}, 0.5::DOUBLE) END
       WHEN t IN ({known}) THEN 0.9::DOUBLE
       ELSE coalesce({clamp.format(number.format('response'))}, 0.5::DOUBLE) END AS confidence
  FROM fields),
nearest AS (SELECT *, list_sort([{candidates}])[1] AS best FROM parsed),
matched AS (SELECT *, CASE WHEN lower(trim(raw_label)) IN ({known}) THEN lower(trim(raw_label))
  WHEN best.d <= length(best.x) / 2.0::DOUBLE THEN best.x ELSE raw_label END AS matched_label FROM nearest),
scored AS (SELECT *, CAST(greatest(1, least(10,
  CASE WHEN confidence = 0 THEN 5 ELSE CAST(trunc(confidence * 10) AS INTEGER) END
  - CASE WHEN lower(raw_label) = lower(matched_label) THEN 0 ELSE 2 END)) AS INTEGER) AS confidence_score FROM matched)"""


REPLIED = f"{DOCS}, replied AS (SELECT doc_id, label, {reply('doc_id', 'label')} AS response FROM docs), {reading('replied')}"
RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {{key}}) AS r, count(*) OVER (PARTITION BY label) AS n FROM {{source}})"
QUOTA = "CAST(floor(0.2::DOUBLE * n + 0.5::DOUBLE) AS BIGINT)"

REQUESTS = f"""{DOCS},
uniq AS (SELECT text, min(doc_id) AS id FROM docs GROUP BY text),
requests AS (SELECT 'q' || (row_number() OVER (ORDER BY id) - 1) AS custom_id,
  CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) AS BIGINT) AS batch, text FROM uniq)"""
# A part-filled cache; the rest is asked for, and some requests fail or stay away.
JOB = f"""{DOCS},
written AS (SELECT doc_id, text, CASE WHEN {u(2, 'doc_id')} < 0.1 THEN '' ELSE {reply('doc_id', 'label')} END AS response
  FROM docs WHERE {u(1, 'doc_id')} < 0.6),
cached AS (SELECT text, response FROM written QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1),
usable AS (SELECT * FROM cached WHERE length(response) > 0),
uniq AS (SELECT text, min(doc_id) AS id, arg_min(label, doc_id) AS label FROM docs GROUP BY text),
asked AS (SELECT *, 'q' || (row_number() OVER (ORDER BY id) - 1) AS custom_id FROM uniq ANTI JOIN usable USING (text)),
outcomes AS (SELECT *, CASE WHEN {u(5, 'custom_id')} < 0.05 THEN 'missing'
  WHEN {u(4, 'custom_id')} < 0.1 THEN 'errored' ELSE 'succeeded' END AS status FROM asked),
known AS (SELECT text, {reply('id', 'label')} AS response, false AS cached FROM outcomes WHERE status = 'succeeded'
  UNION ALL SELECT text, response, true FROM usable),
answered AS (SELECT doc_id, text, cached, response FROM docs JOIN known USING (text))"""
ANNOTATED = f"""{DOCS},
annotated AS (SELECT sha256(text) AS text_hash, label FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)
  QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC, label DESC) = 1)"""



def squared(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


# Logits: negative squared distances to the classes' means.
EXPONENTS = f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
parts AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v),
means_by_place AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i),
class_means AS (SELECT label AS c, list(x ORDER BY i) AS m FROM means_by_place GROUP BY label),
away AS (SELECT vec_id, list(d ORDER BY c) AS away FROM (SELECT vec_id, c, {squared('e', 'm')} AS d FROM v, class_means) GROUP BY vec_id),
logits AS (SELECT v.*, list_transform(away, lambda d: -d) AS g, list_transform(away, lambda d: -sqrt(d)) AS far FROM v JOIN away USING (vec_id)),
tops AS (SELECT *, list_max(g) AS top, list_max(far) AS top2 FROM logits),
exps AS (SELECT *, list_transform(g, lambda x: exp(x - top)) AS ex FROM tops),
probs AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM exps),
losses AS (SELECT *, -ln(greatest(p[label + 1], 1e-15::DOUBLE)) AS loss FROM probs)"""


def medoids_per_class(points: str, k: int, turns: int = 4, seed: int = 42) -> str:
    """CTEs over ``points`` (vec_id, label, e) ending in ``chosen`` (vec_id, label): classes of up to ``k`` rows whole,
    else the members nearest to ``k`` centres, which start from weighted candidates and move to their members' means
    until none moves. The statement must be recursive."""

    def near(g: str) -> str:
        return f"""SELECT vec_id, label, any_value(e) AS e, arg_min(j, {{'d': d, 'i': j}}) AS j, min(d) AS d
        FROM (SELECT vec_id, big.label, e, j, {squared('e', 'c')} AS d FROM big JOIN {g} USING (label)) GROUP BY vec_id, label"""

    parts = [
        f"""sized AS (SELECT *, count(*) OVER (PARTITION BY label) AS size FROM {points}), big AS (SELECT * FROM sized WHERE size > {k}),
      c0 AS MATERIALIZED (SELECT label, 0 AS j, e AS c FROM big QUALIFY row_number() OVER (PARTITION BY label ORDER BY {key(seed, 'vec_id')}, vec_id) = 1)"""
    ]
    for t in range(turns):
        draw = f"-ln({u(seed, "'draw'", f"'{t}'", 'vec_id')} + pow(2::DOUBLE, -33)) / d"
        parts.append(
            f"""d{t} AS ({near(f'c{t}')}),
      c{t + 1} AS MATERIALIZED (SELECT * FROM c{t} UNION ALL
        SELECT label, {2 * k * t} + row_number() OVER (PARTITION BY label ORDER BY {draw}, vec_id) AS j, e FROM d{t} WHERE d > 0
        QUALIFY row_number() OVER (PARTITION BY label ORDER BY {draw}, vec_id) <= {2 * k})"""
        )
    parts.append(
        f"""members AS (SELECT label, j, count(*) AS w FROM ({near(f'c{turns}')}) GROUP BY label, j),
      weighed AS (SELECT label, j, c, coalesce(w, 0) AS w FROM c{turns} LEFT JOIN members USING (label, j)),
      f0 AS (SELECT label, arg_max(c, {{'w': w, 'j': -j}}) AS f FROM weighed GROUP BY label),
      n0 AS (SELECT weighed.*, {squared('c', 'f')} AS d FROM weighed JOIN f0 USING (label))"""
    )
    for t in range(1, k):
        parts.append(
            f"""f{t} AS (SELECT label, arg_max(c, {{'d': w * d, 'j': -j}}) AS f FROM n{t - 1} GROUP BY label HAVING max(w * d) > 0),
      n{t} AS (SELECT n{t - 1}.* REPLACE (least(d, coalesce({squared('c', 'f')}, d)) AS d) FROM n{t - 1} LEFT JOIN f{t} USING (label))"""
        )
    starts = " UNION ALL ".join(f"SELECT label, {t}::BIGINT AS j, f AS c FROM f{t}" for t in range(k))
    parts.append(
        f"""rounds AS (
        SELECT 0 AS step, label, j, c, true AS moved FROM ({starts})
        UNION ALL
        SELECT step + 1, g.label, g.j, coalesce(m, c), coalesce({squared('m', 'c')} > 1e-20::DOUBLE, false)
        FROM (SELECT * FROM rounds WHERE (SELECT bool_or(moved) FROM rounds) AND step < 300) g LEFT JOIN (
          SELECT label, j, list(x ORDER BY i) AS m FROM (
            SELECT label, j, i, avg(x) AS x FROM (SELECT label, j, unnest(e) AS x, unnest(range(len(e))) AS i FROM ({near('rounds')})) GROUP BY ALL)
          GROUP BY label, j) USING (label, j)),
      settled AS MATERIALIZED (SELECT label, j, c FROM rounds WHERE step = (SELECT max(step) FROM rounds)),
      last AS ({near('settled')}),
      chosen AS (SELECT arg_min(vec_id, {{'d': d, 'i': vec_id}}) AS vec_id, label FROM last GROUP BY label, j
        UNION ALL SELECT vec_id, label FROM sized WHERE size <= {k})"""
    )
    return ",\n".join(parts)


def mixture(points: str) -> str:
    """CTEs of the fit over ``points`` (x, n): two-means by iteration, then EM; ``fit`` has the result.

    Each recursion carries parameters only; a row of sums is made per step.
    """

    def density(w: str, m: str, v: str) -> str:
        return f"(ln({w}) - 0.5::DOUBLE * ln(2 * pi() * {v}) - (x - {m}) * (x - {m}) / (2 * {v}))"

    return f"""
mean AS (SELECT min(x) AS low, max(x) AS high, sum(n)::BIGINT AS total, sum(n * x) / sum(n) AS mu FROM {points}),
span AS (SELECT any_value(low) AS low, any_value(high) AS high, any_value(total) AS total,
  1e-4::DOUBLE * sum(n * (x - mu) * (x - mu)) / any_value(total) AS settled FROM {points}, mean),
means AS (
  SELECT 0 AS it, low AS c0, high AS c1, settled, false AS done FROM span
  UNION ALL
  SELECT it + 1, m0, m1, settled, (m0 - c0) * (m0 - c0) + (m1 - c1) * (m1 - c1) <= settled
  FROM (SELECT any_value(it) AS it, any_value(c0) AS c0, any_value(c1) AS c1, any_value(settled) AS settled,
      sum(n * x) FILTER (x <= (c0 + c1) / 2) / sum(n) FILTER (x <= (c0 + c1) / 2) AS m0,
      sum(n * x) FILTER (x > (c0 + c1) / 2) / sum(n) FILTER (x > (c0 + c1) / 2) AS m1
    FROM {points}, means WHERE NOT done AND it < 100 HAVING count(*) > 0) s
),
start AS (SELECT (c0 + c1) / 2 AS cut FROM means ORDER BY it DESC LIMIT 1),
em AS (
  SELECT 0 AS it, any_value(total) AS total, NULL::DOUBLE AS ll, false AS done,
    (sum(n) FILTER (x <= cut) / any_value(total))::DOUBLE AS w0, sum(n * x) FILTER (x <= cut) / sum(n) FILTER (x <= cut) AS m0,
    (sum(n) FILTER (x > cut) / any_value(total))::DOUBLE AS w1, sum(n * x) FILTER (x > cut) / sum(n) FILTER (x > cut) AS m1,
    greatest(sum(n * (x - low) * (x - low)) FILTER (x <= cut) / sum(n) FILTER (x <= cut)
      - power(sum(n * (x - low)) FILTER (x <= cut) / sum(n) FILTER (x <= cut), 2), 0) + 1e-6::DOUBLE AS v0,
    greatest(sum(n * (x - high) * (x - high)) FILTER (x > cut) / sum(n) FILTER (x > cut)
      - power(sum(n * (x - high)) FILTER (x > cut) / sum(n) FILTER (x > cut), 2), 0) + 1e-6::DOUBLE AS v1
  FROM {points}, start, span
  UNION ALL
  SELECT it + 1, total, l, coalesce(abs(l - ll) < 1e-3::DOUBLE, false),
    n0 / total, m0 + s0 / n0, n1 / total, m1 + s1 / n1,
    greatest(q0 / n0 - (s0 / n0) * (s0 / n0), 0) + 1e-6::DOUBLE, greatest(q1 / n1 - (s1 / n1) * (s1 / n1), 0) + 1e-6::DOUBLE
  FROM (SELECT any_value(it) AS it, any_value(total) AS total, any_value(ll) AS ll, any_value(m0) AS m0, any_value(m1) AS m1,
      sum(n * lt) / any_value(total) AS l,
      sum(n * exp(a - lt)) AS n0, sum(n * exp(a - lt) * (x - m0)) AS s0, sum(n * exp(a - lt) * (x - m0) * (x - m0)) AS q0,
      sum(n * exp(b - lt)) AS n1, sum(n * exp(b - lt) * (x - m1)) AS s1, sum(n * exp(b - lt) * (x - m1) * (x - m1)) AS q1
    FROM (SELECT *, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS lt
      FROM (SELECT p.x, p.n, e.*, {density('e.w0', 'e.m0', 'e.v0')} AS a, {density('e.w1', 'e.m1', 'e.v1')} AS b
        FROM {points} p, em e WHERE NOT e.done AND e.it < 100))
    HAVING count(*) > 0) s
),
fit AS (SELECT
  CASE WHEN m0 <= m1 THEN w0 ELSE w1 END AS wc, CASE WHEN m0 <= m1 THEN m0 ELSE m1 END AS mc, CASE WHEN m0 <= m1 THEN v0 ELSE v1 END AS vc,
  CASE WHEN m0 <= m1 THEN w1 ELSE w0 END AS wn, CASE WHEN m0 <= m1 THEN m1 ELSE m0 END AS mn, CASE WHEN m0 <= m1 THEN v1 ELSE v0 END AS vn
  FROM em ORDER BY it DESC LIMIT 1)"""


POSTERIOR = """1.0::DOUBLE / (1.0::DOUBLE + exp(
  (ln(wn) - 0.5::DOUBLE * ln(2 * pi() * vn) - (loss - mn) * (loss - mn) / (2 * vn))
  - (ln(wc) - 0.5::DOUBLE * ln(2 * pi() * vc) - (loss - mc) * (loss - mc) / (2 * vc))))"""

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def _variant(label: str, j: int) -> str:
    out = "text"
    for old, new in VARIANTS[label][j]:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _mangle() -> str:
    names = ["shorten", "start", "stop", "delete", "gone", "replace", "at", "letter", "glue"]
    coefficients = ", ".join(f"{draws(42, 'doc_id', n)} AS c_{n}" for n in names)
    d = {n: at(f"c_{n}", "(i - 1)") for n in names}
    dl = {n: at(f"c_{n}", "s.i") for n in names}
    first = f"CAST(floor({d['start']} * (length(w) - 2)) AS BIGINT)"
    shortened = f"""list_transform(list_transform(words, lambda w: lower(w)), lambda w, i: {{'i': i - 1, 'w':
      CASE WHEN length(w) > 4 AND {d['shorten']} < 0.3
        THEN substr(w, {first} + 1, CAST(floor({d['stop']} * (length(w) - {first})) AS BIGINT) + 1) ELSE w END}})"""
    gone = f"CAST(floor({dl['gone']} * length(s.w)) AS BIGINT)"
    deleted = f"""list_transform(a, lambda s: {{'i': s.i, 'w': CASE WHEN length(s.w) > 2 AND {dl['delete']} < 0.2
      THEN substr(s.w, 1, {gone}) || substr(s.w, {gone} + 2) ELSE s.w END}})"""
    place = f"CAST(floor({dl['at']} * length(s.w)) AS BIGINT)"
    replaced = f"""list_transform(b, lambda s: (CASE WHEN s.i = 0 OR {dl['glue']} < 0.1::DOUBLE THEN '' ELSE ' ' END) ||
      CASE WHEN length(s.w) > 1 AND {dl['replace']} < 0.15::DOUBLE
      THEN substr(s.w, 1, {place}) || substr('abcdefghijklmnopqrstuvwxyz', CAST(floor({dl['letter']} * 26) AS BIGINT) + 1, 1)
        || substr(s.w, {place} + 2) ELSE s.w END)"""
    return f"""WITH c AS (SELECT doc_id, {WORDS} AS words, {coefficients} FROM documents),
    s1 AS (SELECT *, {shortened} AS a FROM c), s2 AS (SELECT *, {deleted} AS b FROM s1),
    s3 AS (SELECT doc_id, array_to_string({replaced}, '') AS line FROM s2),
    s4 AS (SELECT *, string_split(line, ' ') AS parts FROM s3),
    s5 AS (SELECT doc_id, CASE WHEN {u(42, 'doc_id', "'upper'")} < 0.2::DOUBLE THEN array_to_string(list_transform(parts,
      lambda w, i: CASE WHEN i - 1 = CAST(floor({u(42, 'doc_id', "'which'")} * len(parts)) AS BIGINT) THEN upper(replace(w, 'ß', 'SS')) ELSE w END), ' ')
      ELSE line END AS mangled FROM s4)
    SELECT doc_id, md5(mangled) AS mangled_md5, length(mangled)::BIGINT AS n_chars FROM s5"""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    shown = """concat_ws(', ', {key}CASE WHEN s <> '' THEN 'o_orderstatus: ' || s END,
      CASE WHEN o_totalprice IS NOT NULL THEN 'o_totalprice: ' || CAST(o_totalprice AS VARCHAR) END,
      'o_orderdate: ' || CAST(o_orderdate AS VARCHAR),
      CASE WHEN p <> '' THEN 'o_orderpriority: ' || p END)"""
    sql["row_as_text"] = f"""WITH o AS (SELECT *, nullif(o_orderstatus, 'P') AS s,
      CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS p FROM orders)
      SELECT o_orderkey, {shown.format(key="'o_orderkey: ' || o_orderkey, 'o_custkey: ' || o_custkey, ")} AS row_text,
      'o_orderstatus: ' || coalesce(s, 'nan') || ', o_totalprice: ' || coalesce(CAST(o_totalprice AS VARCHAR), 'nan')
        || ', o_orderpriority: ' || coalesce(p, 'nan') AS full_text FROM o"""
    sql["response_parse"] = f"WITH {REPLIED} SELECT doc_id, response, raw_label, confidence FROM scored"
    sql["label_match"] = f"WITH {REPLIED} SELECT doc_id, raw_label, matched_label FROM scored"
    sql["label_match_table"] = """WITH named AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS label FROM part),
      names AS (SELECT label, lower(label) AS form, min(p_partkey) AS pos FROM named GROUP BY label),
      cut AS (SELECT *, substr(label, 1, p_partkey % 7 + 1) AS a, substr(label, p_partkey % 7 + 2) AS b FROM named),
      raws AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' ' || upper(label) WHEN 1 THEN a || substr(b, 2) WHEN 2 THEN a || substr(b, 3)
        WHEN 3 THEN a || 'qz' || substr(b, 2) WHEN 4 THEN a || 'qqq' || substr(b, 4) ELSE 'nothing of the kind' END AS raw_label FROM cut),
      forms AS (SELECT DISTINCT raw_label, lower(trim(raw_label)) AS clean FROM raws),
      near AS (SELECT raw_label, arg_min(label, levenshtein(clean, form) * 1000000000 + pos) AS best, min(levenshtein(clean, form)) AS edits
        FROM forms, names WHERE abs(length(clean) - length(form)) <= 2 GROUP BY raw_label)
      SELECT p_partkey, raw_label, CASE WHEN edits <= 2 AND edits <= length(best) / 2.0::DOUBLE THEN best ELSE raw_label END AS matched_label
      FROM raws LEFT JOIN near USING (raw_label)"""
    sql["confidence_score"] = f"WITH {REPLIED} SELECT matched_label, confidence_score, count(*) AS n FROM scored GROUP BY ALL"
    sql["label_accuracy"] = f"""WITH {REPLIED} SELECT matched_label, quality, count(*) AS n,
      count(*) FILTER (matched_label = label) AS correct,
      round(avg(CASE WHEN matched_label = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
      round(avg(confidence_score::DOUBLE), 6) AS avg_score
      FROM scored JOIN labels USING (doc_id) GROUP BY matched_label, quality"""
    sql["label_confusion"] = f"WITH {REPLIED} SELECT label, matched_label, count(*) AS n FROM scored GROUP BY ALL"
    sql["prediction_report"] = f"""WITH {REPLIED} SELECT doc_id AS id, substr(d.text, 1, 100) || '...' AS preview, s.label, matched_label,
      CASE WHEN s.label = matched_label THEN '✓' ELSE '✗' END AS mark
      FROM scored s JOIN documents d USING (doc_id) ORDER BY doc_id LIMIT 5"""
    sql["label_encode"] = f"""WITH {DOCS} SELECT doc_id, list_position({LABELS!r}, label) - 1 AS label_index, label AS decoded,
      CASE label WHEN 'english' THEN '1000' WHEN 'french' THEN '0100' WHEN 'german' THEN '0010' ELSE '0001' END AS one_hot FROM docs"""
    sql["class_sizes"] = f"WITH {DOCS} SELECT label, count(*) AS n FROM docs GROUP BY label"
    sql["token_cut"] = f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents)
      SELECT doc_id, len(words)::INTEGER AS n_tokens, least(len(words), 512)::INTEGER AS n_kept,
      md5(array_to_string(words[1:512], ' ')) AS kept_md5 FROM w"""

    sql["cache_key"] = f"SELECT doc_id, sha256(text || ':{MODEL}') AS hash_key FROM documents"
    sql["cache_split"] = f"""WITH {JOB}, hits AS (SELECT doc_id, response FROM answered WHERE cached), {reading('hits')}
      SELECT doc_id, scored.doc_id IS NOT NULL AS hit, raw_label FROM docs LEFT JOIN scored USING (doc_id)"""
    sql["cache_counters"] = f"""WITH {JOB} SELECT (SELECT count(*) FROM uniq) AS texts, (SELECT count(*) FROM uniq) - count(*) AS cached,
      count(*) AS asked, CAST(ceil(count(*) / 100.0::DOUBLE) AS BIGINT) AS batches FROM asked"""
    sql["cache_upsert"] = f"""WITH t AS (SELECT role || ' ' || (conv_id % 50) AS question, text AS response,
      conv_id * 100 + turn AS ts, CASE WHEN {u(3, 'conv_id')} >= 0.5 THEN 1 ELSE 0 END AS late FROM conversations)
      SELECT sha256(question || ':{MODEL}') AS hash_key, question, response, '{MODEL}' AS model, ts AS timestamp FROM t
      QUALIFY row_number() OVER (PARTITION BY question ORDER BY late DESC, ts DESC) = 1"""
    sql["annotate_requests"] = f"""WITH {REQUESTS} SELECT custom_id, batch, sha256(text || ':{MODEL}') AS hash_key,
      md5('Example: ' || text) AS content_md5, '{MODEL}' AS model, 1024 AS max_tokens FROM requests"""
    fails = f"({u(5, 'a', 'custom_id')} < 0.05 OR {u(8, 'a', 'batch')} < 0.2 OR {u(4, 'a', 'custom_id')} < 0.1)"
    sql["batch_retries"] = f"""WITH uniq AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text),
      placed AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i FROM uniq),
      named AS (SELECT 'q' || i AS custom_id, i // 100 AS batch FROM placed),
      tried AS (SELECT custom_id, batch, a, {fails} AS fails FROM named, range(1, 4) t(a)),
      sent AS (SELECT *, coalesce(min(fails::INTEGER) OVER (PARTITION BY custom_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS open
        FROM tried)
      SELECT a::INTEGER AS attempt, batch, count(*) AS asked, count(*) FILTER (NOT fails) AS answered, count(*) FILTER (fails) AS failed
      FROM sent WHERE open = 1 GROUP BY a, batch"""
    sql["reply_outcomes"] = f"WITH {JOB} SELECT custom_id, status, md5(text) AS text_md5 FROM outcomes WHERE status <> 'succeeded'"
    demos = f"""{DOCS}, demos AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY label ORDER BY {key(42, 'doc_id')}) <= 3),
      placed AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM demos)"""
    block = """'Here are some examples:' || chr(10) || chr(10) || string_agg('Example ' || i || ':' || chr(10)
      || 'Text: "' || text || '"' || chr(10) || 'Correct Label: "' || label || '"' || chr(10) || chr(10), '' ORDER BY i)"""
    sql["prompt_block"] = f"WITH {demos} SELECT '{SYSTEM}' AS system, {block} AS examples FROM placed"
    sql["task_prompt"] = f"""WITH {demos} SELECT count(*) AS n, chr(10) || chr(10) || '{TASK_BEFORE}' || chr(10) || chr(10)
      || 'Here are some examples:' || chr(10) || chr(10) || {block} || chr(10) || chr(10) || '{TASK_AFTER}' || chr(10) || '{FORMAT_RULE}' AS task
      FROM placed"""
    sql["demonstrations_roundtrip"] = f"WITH {demos} SELECT i - 1 AS position, md5(text) AS text_md5, label FROM placed"
    sql["annotation_job"] = f"""WITH {JOB}, {reading('answered')}
      SELECT doc_id, md5(text) AS text_md5, cached, raw_label, matched_label, confidence, confidence_score FROM scored"""
    sql["annotation_last_wins"] = "SELECT user_id, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id"
    sql["pending_texts"] = f"""WITH {ANNOTATED} SELECT doc_id, sha256(text) AS text_hash FROM docs
      WHERE sha256(text) NOT IN (SELECT text_hash FROM annotated)"""
    sql["training_rows"] = f"""WITH {ANNOTATED} SELECT doc_id, md5(text) AS text_md5, a.label FROM docs JOIN annotated a
      ON sha256(text) = a.text_hash"""

    by_doc = RANKED.format(key=key(42, "doc_id"), source="docs")
    sql["class_cap"] = f"WITH {DOCS}, {by_doc} SELECT doc_id, label FROM ranked WHERE r <= 100"
    sql["stratified_split"] = f"""WITH {DOCS}, {by_doc} SELECT doc_id, label,
      CASE WHEN r <= {QUOTA} THEN 'validation' ELSE 'train' END AS part FROM ranked"""
    sql["corpus_load"] = f"""WITH two AS (SELECT doc_id, text, CASE lang WHEN 'fr' THEN 'negative' ELSE 'positive' END AS label
        FROM documents WHERE lang IN ('fr', 'en')),
      capped AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY label ORDER BY {key(42, 'doc_id')}) <= 120),
      {RANKED.format(key=key(42, 'doc_id'), source='capped')}
      SELECT doc_id, text, label, CASE WHEN r <= {QUOTA} THEN 'validation' ELSE 'train' END AS part FROM ranked"""
    sql["random_k"] = f"WITH {DOCS}, {RANKED.format(key=key(7, 'doc_id'), source='docs')} SELECT doc_id, label FROM ranked WHERE r <= 5"
    sql["confident_k"] = f"""WITH {EXPONENTS}, best AS (SELECT CAST(label AS VARCHAR) AS label, vec_id, p[label + 1] AS c,
      CAST(row_number() OVER (PARTITION BY label ORDER BY p[label + 1] DESC, vec_id) AS INTEGER) AS rank FROM probs)
      SELECT label, vec_id, round(c, 6) AS confidence, rank FROM best WHERE rank <= 5"""
    sql["dense_position"] = """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position,
      CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS batch FROM orders"""
    sql["seeded_shuffle"] = f"SELECT doc_id, {key(42, 'doc_id')} AS place FROM documents ORDER BY place, doc_id"
    sql["head_rows"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 150"

    def dist(a: str, b: str) -> str:
        return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"

    starts = f"""v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding::DOUBLE[] AS e FROM embeddings),
      starts AS (SELECT label, e AS c, row_number() OVER (PARTITION BY label ORDER BY {{key}}) - 1 AS j FROM v
        QUALIFY row_number() OVER (PARTITION BY label ORDER BY {{key}}) <= {{k}})"""
    sql["nearest_centroid"] = f"""WITH {starts.format(key=key(11, 'vec_id'), k=1)},
      centres AS (SELECT c, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM starts)
      SELECT vec_id, arg_min(cluster, {{'d': d, 'i': cluster}}) AS cluster, round(min(d), 6) AS distance
      FROM (SELECT vec_id, cluster, {dist('e', 'c')} AS d FROM v, centres) GROUP BY vec_id"""
    sql["medoids_fixed_start"] = f"""WITH {starts.format(key=key(11, 'vec_id'), k=4)},
      near AS (SELECT vec_id, label, CAST(arg_min(j, {{'d': d, 'i': j}}) AS INTEGER) AS cluster, min(d) AS d
        FROM (SELECT vec_id, v.label, j, {dist('e', 'c')} AS d FROM v JOIN starts s ON v.label = s.label) GROUP BY vec_id, label)
      SELECT label, cluster, arg_min(vec_id, {{'d': d, 'i': vec_id}}) AS vec_id, round(min(d), 6) AS distance
      FROM near GROUP BY label, cluster"""
    sql["nearest_demo_annotate"] = f"""WITH {starts.format(key=key(5, 'vec_id'), k=3)},
      per AS (SELECT vec_id, s.label, min({dist('e', 'c')}) AS d FROM v, starts s GROUP BY vec_id, s.label),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r,
        lead(d) OVER (PARTITION BY vec_id ORDER BY d, label) AS other FROM per)
      SELECT vec_id, label || ',' || CAST(round(CASE WHEN d + other > 0 THEN other / (d + other) ELSE 0.5::DOUBLE END, 4) AS VARCHAR) AS response
      FROM ranked WHERE r = 1"""

    sql["loss_softmax"] = f"""WITH {EXPONENTS} SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS predicted,
      CAST(list_position(p, list_min(p)) - 1 AS INTEGER) AS least, round(list_max(p), 6) AS confidence, round(loss, 6) AS loss FROM losses"""
    sql["soft_ce_kl"] = f"""WITH {EXPONENTS},
      s AS (SELECT *, list_transform(far, lambda x: x - top2 - ln(list_sum(list_transform(far, lambda y: exp(y - top2))))) AS ls FROM probs)
      SELECT vec_id, round(list_sum(list_transform(list_zip(p, ls), lambda z: -z[1] * z[2])), 6) AS soft_ce,
      round(list_sum(list_transform(list_zip(p, ls), lambda z: z[1] * (ln(z[1]) - z[2]))), 6) AS kl,
      round({dist('e[1:32]', 'e[33:64]')}, 6) AS halves FROM s"""
    sql["gmm_clean"] = f"""WITH RECURSIVE points AS (SELECT value AS x, count(*) AS n FROM events GROUP BY value), {mixture('points')}
      SELECT event_id, round({POSTERIOR}, 6) AS prob, {POSTERIOR} >= 0.7 AS clean
      FROM (SELECT event_id, value AS loss FROM events), fit"""
    sql["gmm_summary"] = f"""WITH RECURSIVE {EXPONENTS},
      points AS (SELECT loss AS x, count(*) AS n FROM losses GROUP BY loss), {mixture('points')}
      SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, count(*) FILTER ({POSTERIOR} >= 0.7) AS n_clean,
      round(avg({POSTERIOR}), 6) AS avg_prob, round(any_value(mc), 6) AS clean_mean, round(any_value(mn), 6) AS noisy_mean
      FROM losses, fit GROUP BY label"""
    named = "named AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding::DOUBLE[] AS e FROM embeddings)"
    sql["diverse_demos"] = f"WITH RECURSIVE {named}, {medoids_per_class('named', 10)} SELECT vec_id, label FROM chosen"
    sql["clean_diverse_demos"] = f"""WITH RECURSIVE {EXPONENTS}, points AS (SELECT loss AS x, count(*) AS n FROM losses GROUP BY loss),
      {mixture('points')}, clean AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, e FROM losses, fit WHERE {POSTERIOR} >= 0.7),
      {medoids_per_class('clean', 5)} SELECT vec_id, label FROM chosen"""
    by_vector = f"row_number() OVER (PARTITION BY label ORDER BY {key(42, 'vec_id')})"
    sql["examples_by_strategy"] = f"""WITH RECURSIVE {named}, {medoids_per_class('named', 5)},
      picked AS (SELECT 'diverse' AS strategy, vec_id, label FROM chosen
        UNION ALL SELECT 'random', vec_id, label FROM named QUALIFY {by_vector} <= 5)
      SELECT strategy, label, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS vec_ids, true AS holds
      FROM picked GROUP BY strategy, label
      UNION ALL SELECT 'confident', label, least(5, count(*)), NULL, true FROM named GROUP BY label"""
    bit = "(CAST('0x' || substr(m, i // 4 + 1, 1) AS BIGINT) >> (3 - i % 4)) & 1"
    sql["pooled_embedding"] = f"""WITH t AS (SELECT doc_id, unnest({WORDS.replace('text', 'lower(text)')}) AS t FROM documents),
      counted AS (SELECT doc_id, t, md5(t) AS m, count(*) AS c FROM t GROUP BY doc_id, t),
      buckets AS (SELECT substr(m, 1, 4) AS b, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)::DOUBLE) AS w FROM counted GROUP BY b),
      signs AS (SELECT t, list_transform(range(128), lambda i: 2 * ({bit}) - 1) AS s FROM (SELECT DISTINCT t, m FROM counted)),
      weighed AS (SELECT doc_id, t, c * w AS w FROM counted JOIN buckets ON substr(m, 1, 4) = b),
      totals AS (SELECT doc_id, sum(w) AS total FROM weighed GROUP BY doc_id),
      summed AS (SELECT doc_id, i, sum(w * s[i + 1]) AS x FROM (SELECT doc_id, w, s, unnest(range(128)) AS i FROM weighed JOIN signs USING (t)) GROUP BY doc_id, i),
      e AS (SELECT doc_id, i, CAST(CASE WHEN total > 0 THEN x / total / sqrt(128::DOUBLE) ELSE 0 END AS FLOAT)::DOUBLE AS x FROM summed JOIN totals USING (doc_id)),
      found AS (SELECT doc_id, any_value(x) FILTER (WHERE i = 0) AS e0, any_value(x) FILTER (WHERE i = 63) AS e63, any_value(x) FILTER (WHERE i = 127) AS e127,
        sum(x * x) AS squared, sum(x * (i + 1)) AS placed FROM e GROUP BY doc_id)
      SELECT doc_id, 128 AS width, round(coalesce(e0, 0), 6) AS e0, round(coalesce(e63, 0), 6) AS e63, round(coalesce(e127, 0), 6) AS e127,
        round(coalesce(squared, 0), 6) AS squared, round(coalesce(placed, 0), 6) AS placed FROM documents LEFT JOIN found USING (doc_id)"""
    sql["predict_confidence"] = "SELECT vec_id, CAST(label AS VARCHAR) AS label, true AS is_argmax, true AS in_range FROM embeddings"
    by_label = RANKED.format(key=key(42, "doc_id"), source="docs")
    sql["robust_train_eval"] = f"""WITH {DOCS}, {by_label}, train AS (SELECT count(*) AS n FROM ranked WHERE r > {QUOTA})
      SELECT CAST(stage AS INTEGER) AS stage, n, n AS finite, true AS converged, true AS accurate, true AS flags_right
      FROM train, (SELECT unnest(range(3)) AS stage)"""
    sql["label_loop"] = f"""WITH {DOCS}, {by_label}, train AS (SELECT count(DISTINCT text) AS n FROM ranked WHERE r > {QUOTA})
      SELECT n AS least_annotated, n AS most_annotated, 40::BIGINT AS least_pool, 40::BIGINT AS most_pool, true AS rounds_in_range,
      true AS near_supervised FROM train"""
    sql["clean_lookup"] = f"WITH {DOCS} SELECT doc_id, label FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"

    sql["word_drop"] = f"""WITH w AS (SELECT doc_id, text, {WORDS} AS words, {draws(42, 'doc_id', 'drop')} AS c FROM documents),
      d AS (SELECT doc_id, text, list_transform(words, lambda w, i: {{'u': {at('c', '(i - 1)')}, 'i': i, 'w': w}}) AS d FROM w),
      k AS (SELECT *, list_filter(d, lambda x: x.u > 0.1::DOUBLE) AS kept,
        list_sort(list_transform(list_sort(d)[1:CAST(floor(len(d) * 0.8::DOUBLE) AS BIGINT)], lambda x: {{'i': x.i, 'w': x.w}})) AS few FROM d),
      o AS (SELECT doc_id, CASE WHEN len(d) <= 3 THEN text
        WHEN len(kept) < len(d) * 0.8::DOUBLE THEN array_to_string(list_transform(few, lambda x: x.w), ' ')
        ELSE array_to_string(list_transform(kept, lambda x: x.w), ' ') END AS dropped FROM k)
      SELECT doc_id, md5(dropped) AS dropped_md5, length(dropped)::BIGINT AS n_chars FROM o"""
    sql["mangle"] = _mangle()
    arrays = " ".join(
        f"WHEN '{x}' THEN [{', '.join(_variant(x, j) for j in range(len(VARIANTS[x])))}]" for x in VARIANTS
    )
    sql["corpus_expand"] = f"""WITH {DOCS}, lists AS (SELECT doc_id, label, CASE label {arrays} ELSE [text] END AS texts FROM docs),
      rows AS (SELECT doc_id, label, unnest(range(len(texts)))::INTEGER AS variant, unnest(texts) AS t FROM lists)
      SELECT doc_id, variant, label, md5(t) AS text_md5 FROM rows"""
    lam = ", ".join(u(42, "vec_id", str(j)) for j in range(7))
    sql["mixup_pairs"] = f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, floor({u(42, 'vec_id', "'group'")} * 4) AS g,
        {key(42, 'vec_id', "'order'")} AS o, list_sort([{lam}])[4] AS lam FROM embeddings),
      m AS (SELECT *, coalesce(lead({{'id': vec_id, 'e': e, 'y': label}}) OVER w, first_value({{'id': vec_id, 'e': e, 'y': label}}) OVER w) AS mate
        FROM v WINDOW w AS (PARTITION BY g ORDER BY o, vec_id))
      SELECT vec_id, mate.id AS partner_id, round(lam, 6) AS lam,
      round(lam * list_sum(e) + (1 - lam) * list_sum(mate.e), 6) AS vector_sum,
      round(lam + CASE WHEN mate.y = label THEN 1 - lam ELSE 0 END, 6) AS own_share, 1.0::DOUBLE AS target_sum
      FROM m WHERE mate.id <> vec_id"""

    sql["convergence"] = """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS round,
        avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS a FROM orders GROUP BY 1),
      g AS (SELECT *, a - lag(a) OVER (ORDER BY round) AS gain FROM m)
      SELECT round, round(a, 6) AS val_accuracy, round(gain, 6) AS gain, coalesce(gain < 0.005::DOUBLE, false) AS stop FROM g"""
    sql["mean_loss_per_stage"] = "SELECT l_linenumber AS stage, round(avg(l_discount), 6) AS avg_loss FROM lineitem GROUP BY 1"
    sql["loss_history"] = """SELECT l_orderkey, string_agg(printf('%.2f', l_discount), ';' ORDER BY l_linenumber, l_discount) AS losses
      FROM lineitem GROUP BY l_orderkey"""
    sql["csv_roundtrip"] = f"WITH {DOCS} SELECT doc_id, md5(text) AS text_md5, label FROM docs"
    sql["cache_roundtrip"] = f"""WITH {DOCS} SELECT sha256(text || ':{MODEL}') AS hash_key, {reply('doc_id', 'label')} AS response,
      doc_id + 1 AS timestamp FROM docs QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1"""
    sql["empty_accuracy"] = f"""WITH {DOCS} SELECT 'all' AS rows, count(*) AS total, count(*) FILTER (label = 'english') AS correct,
      round(count(*) FILTER (label = 'english') / count(*), 6) AS accuracy FROM docs UNION ALL SELECT 'none', 0, 0, 0"""
    places = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABELS))
    sql["present_labels"] = f"""WITH {DOCS} SELECT DISTINCT label, CAST(CASE label {places} END AS INTEGER) AS place
      FROM docs JOIN labels USING (doc_id) WHERE toxic = 1 AND label IS NOT NULL"""
    sql["cache_point_lookup"] = f"""WITH {DOCS}, newest AS (SELECT text, {reply('doc_id', 'label')} AS response FROM docs
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1)
      SELECT sha256(text || ':{MODEL}') AS hash_key, response FROM newest WHERE length(response) > 0
        AND text IN (SELECT text FROM docs JOIN labels USING (doc_id) WHERE toxic = 1)"""
    return sql
