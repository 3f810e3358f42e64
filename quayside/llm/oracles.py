"""SQL that must agree with the corpus queries."""

from quayside.llm.licenses import BASE, GRAM, MORE

MIX_SQL = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, length(text) AS n
    FROM documents),
keyed AS (
    SELECT *, -ln((CAST('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 1) / 4503599627370496.0)
              / CASE WHEN n BETWEEN 3 * size AND 9 * size THEN 1.0 ELSE 0.5 END AS key
    FROM sized),
ranked AS (
    SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
total AS (SELECT CAST(SUM(source_size) AS DOUBLE) AS total FROM weighed),
levels AS (
    SELECT 0 AS step, CAST(0 AS DOUBLE) AS level, CAST(-1 AS DOUBLE) AS before
    UNION ALL
    SELECT step + 1,
           (SELECT (total - SUM(CASE WHEN w.weight * l.level > 3 * w.source_size THEN 3 * w.source_size ELSE 0 END))
                   / SUM(CASE WHEN w.weight * l.level > 3 * w.source_size THEN 0 ELSE w.weight END) FROM weighed w, total GROUP BY total),
           level
    FROM levels l WHERE level <> before),
targets AS (
    SELECT source, source_size, LEAST(weight * (SELECT arg_max(level, step) FROM levels), CAST(3 * source_size AS DOUBLE)) AS target FROM weighed),
budgets AS (
    SELECT *, LEAST(CAST(round(target) AS BIGINT), 3 * source_size) AS budget FROM targets),
ordered AS (
    SELECT k.doc_id, k.source, k.size, b.source_size, b.target, b.budget // NULLIF(b.source_size, 0) AS epochs, b.budget % NULLIF(b.source_size, 0) AS rest,
           SUM(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size) AS done
    FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE epochs * size + GREATEST(0, LEAST(size, rest - (done - size))) END AS BIGINT) AS taken
FROM ordered"""


WARC_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
first AS (SELECT h, min(page_id) AS id FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN id <> page_id THEN id END AS refers_to, TRUE AS digest_ok, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN first ON p.h = first.h"""

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT r.x AS vec_id, COALESCE(any_value(n.n), 0) AS n_links, min(r.y) AS component_id, min(r.y) = r.x AS kept
FROM reach r LEFT JOIN n ON n.x = r.x GROUP BY r.x"""

HARD_NEGATIVES_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id IS DISTINCT FROM anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3"""

_PART = "COALESCE(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _PART + ")"
# One step up for nodes (tree, p, n, h): the runs of a level, then the next level. A tree with one node stays as it is.
_LEVEL = """
r{0} AS (SELECT tree, p // 16 AS p, string_agg(h, '' ORDER BY p) AS run, any_value(n) AS n FROM n{0} GROUP BY tree, p // 16),
n{1} AS (SELECT tree, p, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS h FROM r{0}),"""
# The same step for what every leaf carries: its place, its version's node and the siblings so far.
_CLIMB = """
d{1} AS (
    SELECT d.* REPLACE (d.p // 16 AS p, CASE WHEN r.n = 1 THEN f ELSE sha256(run[:64 * (d.p % 16)] || f || run[64 * (d.p % 16) + 65:]) END AS f,
                        CASE WHEN r.n = 1 THEN proof ELSE proof || run[:64 * (d.p % 16)] || run[64 * (d.p % 16) + 65:] END AS proof)
    FROM d{0} d JOIN r{0} r ON d.{2} = r.tree AND d.p // 16 = r.p),"""
# Levels of the sources' trees (to 16^5 leaves) and of the tree above them (to 16^3 sources).
_LOWER, _UPPER = range(5), range(6, 9)
MERKLE_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
leaves AS (
    SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
           xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                           lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 5 = 0 AS tampered
    FROM documents, crc),
d0 AS (
    SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, 0 AS top, leaf, '' AS proof, CASE WHEN tampered THEN other ELSE leaf END AS f,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM leaves),
n0 AS (SELECT tree, p, n, leaf AS h FROM d0),{"".join(_LEVEL.format(k, k + 1) + _CLIMB.format(k, k + 1, "tree") for k in _LOWER)}
n6 AS (SELECT 0 AS tree, tree AS p, count(*) OVER () AS n, h FROM n5),
d6 AS (SELECT d5.* REPLACE (tree AS p) FROM d5),{"".join(_LEVEL.format(k, k + 1) + _CLIMB.format(k, k + 1, "top") for k in _UPPER)}
last AS (SELECT h FROM n9)
SELECT doc_id, leaf, n5.h AS subroot, last.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = last.h AS verified
FROM d9 JOIN n5 USING (tree), last"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {i < len(BASE)}, '{text}')" for i, (label, text) in enumerate([*BASE, *MORE]))
_WORDS = r"regexp_extract_all(translate(COALESCE({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = """SELECT {id}, i - 1 AS place, 3 AS k, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g FROM {t} WINDOW p AS (PARTITION BY {id} ORDER BY i)
    UNION ALL SELECT {id}, i - 1, 2, w || ' ' || lead(w, 1) OVER p FROM {t} WINDOW p AS (PARTITION BY {id} ORDER BY i)"""
LICENSES_SQL = f"""
WITH t(template, label, base, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT *, {_WORDS.format("text")} AS ws FROM t),
tp AS (SELECT template, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tw),
info AS (SELECT template, label, base, len(ws) AS words, least({GRAM}, len(ws)) AS k, len(ws) - least({GRAM}, len(ws)) + 1 AS grams FROM tw),
tg AS (SELECT x.*, label, base, words, grams FROM ({_GRAMS.format(id="template", t="tp")}) x JOIN info USING (template, k) WHERE g IS NOT NULL),
dw AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
dp AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM dw),
dg AS ({_GRAMS.format(id="doc_id", t="dp")}),
votes AS (SELECT doc_id, template, label, base, words, tg.k, grams, tg.place AS position, dg.place AS place, dg.place - tg.place AS diagonal FROM dg JOIN tg ON dg.g = tg.g AND dg.k = tg.k),
diagonals AS (SELECT DISTINCT doc_id, template, grams, diagonal FROM votes),
marked AS (SELECT *, CASE WHEN grams = 1 OR COALESCE(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 2, TRUE) THEN 1 ELSE 0 END AS apart FROM diagonals),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM marked),
spans AS (
    SELECT doc_id, template, label, base, min(place) AS start, count(DISTINCT position) / grams AS coverage
    FROM votes JOIN runs USING (doc_id, template, grams, diagonal) GROUP BY doc_id, template, label, base, words, k, grams, run
    HAVING count(DISTINCT position) / grams >= 0.6 AND max(place) + k - min(place) <= 2 * words)
SELECT d.doc_id, len(d.ws) AS n_words, count(s.start) FILTER (WHERE s.base) AS n_base, min(s.start) FILTER (WHERE s.base) AS first_word, max(s.start) FILTER (WHERE s.base) AS last_word,
       COALESCE(string_agg(DISTINCT s.label, ',' ORDER BY s.label) FILTER (WHERE s.base), '') AS base_labels,
       COALESCE(string_agg(DISTINCT s.label, ',' ORDER BY s.label), '') AS labels, COALESCE(max(s.coverage), 0.0) AS score
FROM dw d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.ws"""
