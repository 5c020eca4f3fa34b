"""SQL for the queries of this package that SQL can express, in DuckDB's dialect.

Written from the operators' contracts: windows and joins in place of sketches' code paths,
plain edit distances, and all candidates scored.
"""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"

LINE_DEDUP = """
WITH l AS (SELECT * FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT line, min((doc_id, line_no)) AS f, len(line) AS n FROM l GROUP BY line),
p AS (SELECT a.line AS a, b.line AS b, b.f AS bf FROM c a JOIN c b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line AND least(a.n, b.n) >= 16 WHERE levenshtein(a.line, b.line) <= least(2, least(a.n, b.n) // 16)),
k AS (SELECT a, count(*) AS n_links, min(bf) AS nearest FROM p GROUP BY a)
SELECT l.doc_id, l.line_no::INTEGER AS line_no, c.f[1] AS class_doc_id, c.f[2]::INTEGER AS class_line_no, coalesce(n_links, 0) AS n_links,
 ((l.doc_id, l.line_no) = c.f AND coalesce(nearest > c.f, true)) AS kept
FROM l JOIN c USING (line) LEFT JOIN k ON k.a = l.line
""".replace("c.f[1]", "struct_extract_at(c.f, 1)").replace("c.f[2]", "struct_extract_at(c.f, 2)")

EXACT_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

MIXING = f"""
WITH RECURSIVE w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS n_tokens, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens, ceil(sqrt(count(*)))::BIGINT AS blocks FROM w GROUP BY source),
m AS (SELECT sum(tokens) AS total, min(tokens) FILTER (tokens > 0) AS least, max(tokens) AS most FROM s),
b(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, CASE WHEN most / least <= 2 THEN 0.0 ELSE 1.0 END::DOUBLE FROM m UNION ALL SELECT i + 1, CASE WHEN (most / least) ** (1 - (lo + hi) / 2) <= 2 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN (most / least) ** (1 - (lo + hi) / 2) <= 2 THEN (lo + hi) / 2 ELSE hi END FROM b, m WHERE i < 40),
a AS (SELECT hi AS a FROM b WHERE i = 40),
e AS (SELECT source, tokens, blocks, CASE WHEN tokens > 0 THEN (most / tokens) ** (1 - a) ELSE 1.0 END AS epochs FROM s, m, a),
x AS (SELECT w.*, tokens, blocks, epochs, ('0x' || substr(key, 1, 8))::BIGINT % blocks AS block, unnest(range(ceil(epochs)::BIGINT)) AS epoch FROM w JOIN e ON w.source IS NOT DISTINCT FROM e.source),
h AS (SELECT *, md5('17|' || epoch || '|' || coalesce(source, '') || '|' || block) AS of_block, md5('17|' || epoch || '|' || key) AS own FROM x),
t AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY of_block, block, own, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, block, CASE WHEN tokens > 0 THEN round((epoch * tokens + before) / (epochs * tokens), 6) ELSE 0.0 END AS slot FROM t WHERE epochs >= epoch + 1 OR before < (epochs - epoch) * tokens
"""


def quality_rules(metrics: dict[str, tuple[str, bool]], gamma: float, min_rows: int, trim: float, edge: float, slack: float) -> str:
    """The verdicts: counts by windows, sketches by grouping, fences by rank in the grouped counts."""
    value = {k: f"({e.replace('n_words', 'greatest(n_words, 1)')})::DOUBLE" for k, (e, _) in metrics.items()}
    two_sided = ", ".join(f"'{k}'" for k, (_, low) in metrics.items() if low)

    def sketches(name: str, rows: str, near: float, far: float) -> str:
        """Quantiles of each group, language and the corpus; buckets' lower edges for a and b, upper ones for c and d."""
        each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {e} AS value FROM {rows}" for k, e in value.items())
        lower, upper = (f"CASE WHEN bucket = -100000 THEN 0.0 ELSE exp({gamma!r}) ** (bucket - {x}) END" for x in (1, 0))
        return f"""
{name}b AS (SELECT lang, source, metric, CASE WHEN value <= 1e-9 THEN -100000 ELSE ceil(ln(value) / {gamma!r})::BIGINT END AS bucket, count(*) AS n FROM ({each}) GROUP BY ALL),
{name}l AS (SELECT 2 AS level, lang, source, metric, bucket, n FROM {name}b UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM {name}b GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, metric, bucket, sum(n) FROM {name}b GROUP BY ALL),
{name}u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total, {lower} AS lower, {upper} AS upper FROM {name}l),
{name}q AS (SELECT level, lang, source, metric, min(lower) FILTER (upto >= {near!r} * total) AS a, min(lower) FILTER (upto >= 0.5 * total) AS b, min(upper) FILTER (upto >= 0.5 * total) AS c, min(upper) FILTER (upto >= {far!r} * total) AS d FROM {name}u GROUP BY level, lang, source, metric HAVING max(total) >= {min_rows} OR level = 0)"""

    def limits(name: str, low: str, high: str) -> str:
        return f"{name} AS (SELECT level, lang, source, map_from_entries(list((metric, CASE WHEN metric IN ({two_sided}) THEN {low} ELSE -1e300 END))) AS lows, map_from_entries(list((metric, {high}))) AS highs FROM {name}q GROUP BY level, lang, source)"

    def judged(name: str, limits: str, rows: str) -> str:
        inside = " AND ".join(f"{e} BETWEEN coalesce(o.lows['{k}'], g.lows['{k}'], z.lows['{k}']) AND coalesce(o.highs['{k}'], g.highs['{k}'], z.highs['{k}'])" for k, e in value.items())
        return f"{name} AS (SELECT s.*, coalesce({inside}, true) AS inside FROM {rows} s LEFT JOIN {limits} o ON o.level = 2 AND o.lang IS NOT DISTINCT FROM s.lang AND o.source IS NOT DISTINCT FROM s.source LEFT JOIN {limits} g ON g.level = 1 AND g.lang IS NOT DISTINCT FROM s.lang LEFT JOIN {limits} z ON z.level = 0)"

    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
tri AS (SELECT id, i, (w[i], w[i+1], w[i+2]) AS t FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
hit AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, t) AS k FROM tri) WHERE k > 1),
rep AS (SELECT id, count(DISTINCT i + o) AS n FROM hit, range(3) r(o) GROUP BY id),
ln AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORDS}') GROUP BY id),
st AS (SELECT d.id, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[!?]')) AS n_marks, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN rep USING (id) LEFT JOIN ln USING (id)),
ok AS (SELECT * FROM st WHERE NOT base_failed),{sketches('c', 'ok', 0.25, 0.75)},
{limits('c', f'CASE WHEN a < b THEN b - {trim} * (b - a) ELSE -1e300 END', f'CASE WHEN d > c THEN c + {trim} * (d - c) ELSE 1e300 END')},
{judged('core', 'c', 'ok')},
inner_rows AS (SELECT * FROM core WHERE inside),{sketches('f', 'inner_rows', 1 - edge, edge)},
{limits('f', f'a - {slack} * (b - a)', f'd + {slack} * (d - c)')},
{judged('final', 'f', 'st')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND inside) AS kept FROM final
"""
