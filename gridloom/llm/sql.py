"""DuckDB SQL that gives the rows of the numbered queries, where SQL can."""

from __future__ import annotations

from gridloom.llm.quality_rules import COMMON, MIN_REFERENCE, Rules
from gridloom.llm.secret_ledger import RULES as SECRET_RULES

_RULES = Rules()
_HALF = "(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT k, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k),
l AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
s0 AS (SELECT *, regexp_replace(t, '[ \t-\r]+', '', 'g') AS a0 FROM d),
s1 AS (SELECT *, regexp_replace(a0, '[aeiou]+', '', 'g') AS a1 FROM s0),
s2 AS (SELECT *, regexp_replace(a1, '[b-df-hj-np-tv-z]+', '', 'g') AS a2 FROM s1),
s3 AS (SELECT *, regexp_replace(a2, '\p{{Lu}}+', '', 'g') AS a3 FROM s2),
s4 AS (SELECT *, regexp_replace(a3, '\p{{L}}+', '', 'g') AS a4 FROM s3),
s5 AS (SELECT *, regexp_replace(a4, '\p{{N}}+', '', 'g') AS a5 FROM s4),
s6 AS (SELECT *, regexp_replace(a5, '[.,;:!?''"()\-]+', '', 'g') AS a6 FROM s5),
b AS (SELECT d.k, d.doc_id, d.lang, d.t, len(ws)::BIGINT AS n_words, length(a0)::BIGINT AS word_chars, (length(a0) - length(regexp_replace(a0, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  CASE WHEN len(ws) < {_RULES.min_words} THEN 'few_words' WHEN coalesce(rep.n, 0) * 100 > len(ws) * {_RULES.max_repeat_percent} THEN 'repeats' END AS base,
  [length(a0) - length(a1), length(a1) - length(a2), length(a2) - length(a3), length(a3) - length(a4), length(a4) - length(a5), length(a5) - length(a6), length(a6)] AS chars
  FROM d JOIN w ON w.k = d.k JOIN l ON l.k = d.k JOIN s6 ON s6.k = d.k LEFT JOIN rep ON rep.k = d.k),
v AS (SELECT k, lang, base, word, count(*) AS n FROM (SELECT k, lang, base, unnest(string_split_regex(lower(t), '[^\p{{L}}]+')) AS word FROM b) WHERE word <> '' GROUP BY ALL),
vt AS (SELECT k, sum(n) AS total FROM v GROUP BY k),
lw AS (SELECT lang, word, sum(n) AS n FROM v WHERE base IS NULL AND lang IS NOT NULL GROUP BY lang, word),
lt AS (SELECT lang, sum(n) AS total FROM lw GROUP BY lang HAVING sum(n) >= {MIN_REFERENCE}),
rw AS (SELECT lang, word, n / total AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM lw) JOIN lt USING (lang) WHERE r <= {COMMON}),
ro AS (SELECT lang, 1 - sum(q) AS q FROM rw GROUP BY lang),
rc AS (SELECT lang, i, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM (SELECT lang, unnest(range(7)) AS i, unnest(chars) AS n FROM b WHERE base IS NULL) WHERE lang IN (SELECT lang FROM lt) GROUP BY lang, i),
dc AS (SELECT c.k, r.lang, sqrt(greatest(0, sum({_HALF.format(p="(n / word_chars)", q="q")}))) AS x
  FROM (SELECT k, word_chars, unnest(range(7)) AS i, unnest(chars) AS n FROM b WHERE word_chars > 0) c JOIN rc r ON r.i = c.i GROUP BY c.k, r.lang),
hit AS (SELECT v.k, r.lang, sum({_HALF.format(p="(n / total)", q="q")} - q / 2) AS x, sum(n / total) AS p FROM v JOIN vt ON vt.k = v.k JOIN rw r ON r.word = v.word GROUP BY v.k, r.lang),
dw AS (SELECT vt.k, ro.lang, sqrt(greatest(0, coalesce(x, 0) + (1 - ro.q) / 2 + {_HALF.format(p="greatest(0, 1 - coalesce(p, 0))", q="ro.q")})) AS x
  FROM vt CROSS JOIN ro LEFT JOIN hit ON hit.k = vt.k AND hit.lang = ro.lang),
nc AS (SELECT k, min(x) AS x FROM dc GROUP BY k),
nw AS (SELECT k, min(x) AS x FROM dw GROUP BY k),
vc AS (SELECT k, sum(n)::BIGINT AS n FROM v WHERE word IN (SELECT word FROM rw) GROUP BY k),
o AS (SELECT b.*, coalesce(vt.total, 0) AS letter_words, coalesce(vc.n, 0)::BIGINT AS n_common, (SELECT count(*) FROM lt) AS refs,
  CASE WHEN oc.x <= {_RULES.char_distance} THEN oc.x ELSE coalesce(nc.x, 1.0) END AS cd, CASE WHEN ow.x <= {_RULES.word_distance} THEN ow.x ELSE coalesce(nw.x, 1.0) END AS wd
  FROM b LEFT JOIN vt ON vt.k = b.k LEFT JOIN vc ON vc.k = b.k LEFT JOIN nc ON nc.k = b.k LEFT JOIN nw ON nw.k = b.k
  LEFT JOIN dc oc ON oc.k = b.k AND oc.lang = b.lang LEFT JOIN dw ow ON ow.k = b.k AND ow.lang = b.lang),
j AS (SELECT *, coalesce(base, CASE WHEN refs = 0 THEN NULL WHEN word_chars >= {_RULES.min_chars} AND cd > {_RULES.char_distance} THEN 'char_divergence'
  WHEN letter_words >= {_RULES.min_letter_words} AND wd > {_RULES.word_distance} THEN 'word_divergence' END) AS reason FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base IS NOT NULL AS base_failed, reason IS NULL AS kept, n_common,
  CASE WHEN refs = 0 THEN 0.0 ELSE round(cd, 9) END AS char_distance, CASE WHEN refs = 0 THEN 0.0 ELSE round(wd, 9) END AS word_distance, reason FROM j
"""

OP3 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[ \t-\r]+', '', 'g') AS k FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY k ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * (SELECT n FROM c) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t GROUP BY term),
q AS (SELECT DISTINCT r, item_id, term FROM (SELECT r, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS r, item_id, {_TERMS} AS ts FROM benchmark))),
m AS (SELECT k, doc_id, 10 + (90 * len(ts) * c.n) // c.l AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT r, item_id, k, doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

OP12 = """
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON len(a.v) = len(c.v) AND a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS place FROM s WHERE same),
n AS (SELECT p.ar, p.anchor_id, p.place, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.vec_id, s.r)::INTEGER AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _secrets() -> str:
    """Of every rule the matches and the texts between them, side by side; positions are running sums over them."""
    own = []
    for place, r in enumerate(SECRET_RULES):
        pattern = r.pattern.replace("'", "''")
        own.append(
            f"SELECT k, {place} AS place, '{r.kind}' AS kind, sum(gap + len(m)) OVER (PARTITION BY k ORDER BY i) AS stop, len(m) AS size FROM ("
            f"SELECT k, i, ms[i] AS m, len(gs[i]) AS own, len(gaps[i]) AS gap FROM (SELECT k, ms, gs, gaps, unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT k, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {r.group}) AS gs, string_split_regex(t, '{pattern}') AS gaps FROM d))) "
            f"QUALIFY own >= {r.least}"
        )
    return " UNION ALL ".join(own)


OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_secrets()}),
g AS (SELECT k, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg(kind || ':' || (stop - size)::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY stop - size, place) FILTER (place < 3) AS base,
  string_agg(kind || ':' || (stop - size)::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY stop - size, place) AS spans FROM f GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN g USING (k)
"""

ORACLES = {"op1_quality_rules": OP1, "op3_exact_dedup": OP3, "op11_lexical_search": OP11, "op12_hard_negatives": OP12, "op13_secret_ledger": OP13}
