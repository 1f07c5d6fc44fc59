"""DuckDB SQL for the digest of every operator that SQL can express."""

from __future__ import annotations

from farescope.llm import fill_middle, importance
from farescope.llm.mixing import MAX_REPEATS, RANK_BINS, SEED, WEIGHTS
from farescope.llm.quality import CHANCE, LEAST_WORDS, REACH, REPEAT_PERCENT, TAIL
from farescope.llm.secret_ledger import RULES

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{UPPER.lower()}')"


OP3 = rf"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')))
    END AS s FROM tokens
), sized AS (
  SELECT doc_id, len(s) AS n, md5(list_aggregate(list_sort(s), 'string_agg', chr(10))) AS m, s FROM sets
), one AS (
  SELECT n, m, min(doc_id) AS rep, any_value(s) AS s FROM sized WHERE n > 0 GROUP BY n, m
), held AS (SELECT rep, n, unnest(s) AS x FROM one),
repeated AS (SELECT x FROM held GROUP BY x HAVING count(*) > 1),
few AS (SELECT rep, n, x FROM held SEMI JOIN repeated USING (x)),
linked AS (
  SELECT a.rep AS a, b.rep AS b FROM few a JOIN few b ON a.x = b.x AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (
  SELECT rep AS node, rep AS comp FROM one
  UNION SELECT e.b, r.comp FROM reach r JOIN edges e ON e.a = r.node
), lowest AS (SELECT node, min(comp) AS comp FROM reach GROUP BY node)
SELECT z.doc_id, z.n::BIGINT AS n_shingles, coalesce(l.comp, z.doc_id) AS component_id
FROM sized z LEFT JOIN one o ON z.n = o.n AND z.m = o.m LEFT JOIN lowest l ON l.node = o.rep
"""

# The same links, counted: copies by the sizes of their classes.
OP3_LINKS = OP3.partition(", edges AS")[0] + """, classes AS (SELECT n, m, min(doc_id) AS rep, count(*) AS size FROM sized WHERE n > 0 GROUP BY n, m),
ends AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
others AS (SELECT e.a AS rep, sum(c.size) AS n FROM ends e JOIN classes c ON c.rep = e.b GROUP BY e.a)
SELECT z.doc_id, z.n::BIGINT AS n_shingles, coalesce(c.size - 1 + coalesce(o.n, 0), 0)::BIGINT AS n_links
FROM sized z LEFT JOIN classes c ON z.n = c.n AND z.m = c.m LEFT JOIN others o ON o.rep = c.rep
"""


def _rule(k: int, pattern: str, group: int, least: int, kind: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT doc_id, {k} AS nth, '{kind}' AS kind, s AS start, s + length(hits[i]) AS stop FROM (
  SELECT doc_id, hits, vals, i,
    coalesce(list_sum(gaps[1:i]), 0)::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (
    SELECT doc_id, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {group}) AS vals,
        list_transform(regexp_split_to_array(text, {p}), lambda x: length(x)) AS gaps
      FROM documents WHERE regexp_matches(text, {p})
    )
  )
) WHERE length(vals[i]) >= {least}"""


OP4 = f"""
WITH found AS ({" UNION ALL ".join(_rule(k, r.pattern, r.group, r.least, r.kind) for k, r in enumerate(RULES))}
), listed AS (
  SELECT doc_id, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access,
    count(*) FILTER (nth = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans
  FROM found GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""

_WEIGHT = f"[{', '.join(f'{float(w)}::DOUBLE' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]"

OP5 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, {_WEIGHT} AS weight, source_size::DOUBLE * {MAX_REPEATS} AS cap,
    (SELECT sum(source_size) FROM sources)::DOUBLE AS total FROM sources
), ordered AS (
  SELECT *, total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), capped AS (SELECT *, remaining * weight / among >= cap AS is_capped FROM ordered),
level AS (SELECT remaining, among FROM capped WHERE NOT is_capped ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN is_capped THEN cap
    ELSE (SELECT remaining FROM level) * weight / (SELECT among FROM level) END AS target FROM capped
), parts AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS certain,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM targets
), drawn AS (
  SELECT d.*, p.source_size, p.target, p.certain, p.copies - p.certain AS chance,
    floor(p.target + 0.5)::BIGINT - p.certain * p.source_size AS need,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), ranked AS (
  SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM drawn
), filled AS (
  SELECT *, coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY floor(u * {RANK_BINS}), rank NULLS FIRST, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM ranked
)
SELECT doc_id, size, source_size, target,
  (certain * size + greatest(0, least(size, need - before)))::BIGINT AS taken FROM filled
"""

OP7 = rf"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, {lower(r"trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM split
), shared AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.holder IS NOT NULL AND k.doc_id <> s.holder AS dropped FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Measure: count, of how many, size of one event.
_RATE = {
    "word_length": ("word_chars", "n_words", 0),
    "symbol_rate": ("n_symbols", "n_words", 1),
    "line_repeat_rate": ("n_dup_lines", "n_lines", 1),
    "word_repeat_rate": ("n_repeat_words", "n_words", 5),
}
_FENCED = ", ".join(f"quantile_disc({m}, [{TAIL}, 0.5, {1 - TAIL}]) AS q_{m}" for m in _RATE)
_INSIDE = " AND ".join(
    f"{m} + may_{m} >= q_{m}[1] - {REACH} * (q_{m}[2] - q_{m}[1])"
    f" AND {m} - may_{m} <= q_{m}[3] + {REACH} * (q_{m}[3] - q_{m}[2])"
    for m in _RATE
)

OP9 = rf"""
WITH tokens AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents
), placed AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM tokens WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times FROM placed) WHERE times > 1
), covered AS (SELECT doc_id, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n FROM again GROUP BY doc_id),
measured AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM tokens LEFT JOIN covered c USING (doc_id)
), rated AS (
  SELECT *, {", ".join(
      f"coalesce({c} / {of}, 0) AS {m}, coalesce({CHANCE * event} / nullif({of}, 0), 0) AS may_{m}"
      for m, (c, of, event) in _RATE.items())},
    n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM measured
), own AS (SELECT lang, source, {_FENCED} FROM rated GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_INSIDE} AS kept
FROM rated r JOIN own g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source
"""

OP10 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

def _crc_table() -> list[int]:
    """The CRC-32 of every byte value, by the rule of its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [0xEDB88320 ^ (c >> 1) if c & 1 else c >> 1 for c in table]
    return table


def _draw(digest: str, k: int) -> str:
    return f"('0x' || substr({digest}, {8 * k + 1}, 8))::BIGINT"


# CRC-32 of a text's bytes, read from its hex form.
CRC32 = f"""xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(hex(f)) // 2 + 1),
    lambda i: ('0x' || substr(hex(f), (2 * i - 1)::INTEGER, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])))"""

OP11 = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, true AS is_doc, text FROM documents
  UNION ALL SELECT NULL, NULL, false, text FROM benchmark
), tokens AS (
  SELECT r, doc_id, is_doc, regexp_extract_all({lower("coalesce(text, '')")}, '{importance.WORD}') AS w FROM texts
), listed AS (
  SELECT r, doc_id, is_doc, len(w) AS words,
    list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS fs FROM tokens
), held AS (SELECT r, is_doc, unnest(fs) AS f FROM listed),
dealt AS (SELECT f, ({CRC32}) % {importance.BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM held)),
counted AS (
  SELECT bucket, count(*) FILTER (is_doc)::DOUBLE AS s, count(*) FILTER (NOT is_doc)::DOUBLE AS t
  FROM held JOIN dealt USING (f) GROUP BY bucket
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + {importance.BUCKETS})
    / ((s + 1) * ((SELECT sum(t) FROM counted) + {importance.BUCKETS}))))::BIGINT AS gain FROM counted
), summed AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM held JOIN dealt USING (f) JOIN gained USING (bucket)
  WHERE is_doc GROUP BY r
), scored AS (
  SELECT doc_id, words, coalesce(n, 0) AS n, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    {_draw(f"sha256('{importance.SEED}:' || doc_id)", 0)} AS h
  FROM listed LEFT JOIN summed USING (r) WHERE is_doc
), final AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, CASE WHEN words >= {importance.LEAST_WORDS} AND score IS NOT NULL THEN row_number() OVER (
    PARTITION BY words >= {importance.LEAST_WORDS} AND score IS NOT NULL ORDER BY score DESC, doc_id, weight, n, words) END AS place
  FROM final
)
SELECT doc_id, n AS n_features, weight, score,
  CASE WHEN place <= {importance.PERCENT} * (SELECT count(place) FROM placed) // 100 THEN place END AS rank
FROM placed
"""

_P, _S, _M = fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE


def _joined(units: str) -> str:
    return f"coalesce(list_aggregate({units}, 'string_agg', ''), '')"


OP13 = f"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_middle.SEED}:' || doc_id) AS d,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents
), drawn AS (
  SELECT *, len(t) AS n, {_draw("d", 0)} % (len(t) + 1) AS one, {_draw("d", 1)} % (len(t) + 1) AS two,
    CASE WHEN text = '' OR d IS NULL OR contains(text, '{_P}') OR contains(text, '{_S}') OR contains(text, '{_M}')
        OR {_draw("d", 2)} % 100 >= {100 - fill_middle.KEPT_PERCENT} THEN 'plain'
      WHEN {_draw("d", 3)} % 100 < {fill_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM tokens
), cut AS (
  SELECT *, {_joined("t[1:least(one, two)]")} AS p, {_joined("t[least(one, two) + 1:greatest(one, two)]")} AS m,
    {_joined("t[greatest(one, two) + 1:]")} AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || p || '{_S}' || s || '{_M}' || m
    ELSE '{_S}' || s || '{_P}' || p || '{_M}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""

ORACLE_SQL = {
    "op3_signature_tree_join": OP3,
    "op3_link_counts": OP3_LINKS,
    "op4_secret_ledger": OP4,
    "op5_pareto_mix": OP5,
    "op7_line_dedup": OP7,
    "op9_adaptive_quality": OP9,
    "op10_histogram_topk": OP10,
    "op11_importance_resampling": OP11,
    "op13_fill_middle": OP13,
}
