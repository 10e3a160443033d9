"""DuckDB SQL of those corpus queries that SQL can express, written from their definitions."""

from __future__ import annotations

from parley.llm.quality_rules import METRICS
from parley.llm.secret_scan import RULES

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, {_quoted(r.kind)} AS kind, i, length(p[i]) AS gap, length(m[i]) AS size, length(regexp_extract(m[i], {_quoted(r.regex)}, {r.group})) >= {r.least} AS ok FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {_quoted(r.regex)}) AS m, string_split_regex(t, {_quoted(r.regex)}) AS p FROM d) WHERE len(m) > 0)"
        for i, r in enumerate(RULES)
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({parts}),
x AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM s),
y AS (SELECT doc_id, rank, kind, stop - size AS start, kind || ':' || (stop - size)::BIGINT::VARCHAR || ':' || stop::BIGINT::VARCHAR AS span FROM x WHERE ok),
z AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN z USING (doc_id)"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

_KEY = _LOWER.format(f"trim(line, {_SPACE})")

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {_KEY} AS key FROM l), n AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(n.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (n.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN n USING (key) GROUP BY doc_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, url FROM pages), r AS (SELECT page_id, h, CASE WHEN octet_length(encode(h)) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS holder FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN holder != page_id THEN holder END AS refers_to FROM r"""

MIXING = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(concat_ws('/', coalesce(doc_id::VARCHAR, ''), 'mix', coalesce(text, ''))) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
v AS (SELECT *, [5.0, 2.0, 1.0][1 + place % 3]::DOUBLE AS w FROM s),
o AS (SELECT *, 2 * source_size AS cap, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM v),
f AS (SELECT arg_min((budget - stopped) / rest, cap / w) FILTER ((budget - stopped) / rest <= cap / w) AS time FROM o),
g AS (SELECT source, place, w, source_size, CASE WHEN time IS NULL OR w * time > cap THEN cap::DOUBLE ELSE w * time END AS target FROM o, f),
q AS (SELECT d.*, place, w, source_size, target, (sum(size) OVER (PARTITION BY place ORDER BY turn, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT place, w, source_size, least(start + size, start + i * 256) AS stop, least(256, size - (i - 1) * 256) AS n FROM (SELECT *, unnest(range(1, ceil(size / 256)::BIGINT + 1)) AS i FROM q)),
x AS (SELECT place, n, e, stop, (stop + e * source_size) / w AS finish FROM p, (VALUES (0), (1)) AS t(e)),
y AS (SELECT place, n, sum(n) OVER (ORDER BY finish, place, e, stop ROWS UNBOUNDED PRECEDING) - n AS before FROM x),
z AS (SELECT place, sum(greatest(0, least(n, (SELECT floor(sum(size) * 1.5) FROM d) - before)))::BIGINT AS words FROM y GROUP BY place)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, coalesce(words, 0) - start)) + greatest(0, least(size, coalesce(words, 0) - start - source_size)) AS BIGINT) AS taken FROM q LEFT JOIN z USING (place)"""



def _quality_rules() -> str:
    """Counts of each text, then quantiles of log-linear buckets by group, language and corpus, and fences from them."""
    word = "[^\\x20\\x09-\\x0D]"
    shown = ", ".join(f"('{m}', {scale}, {p}::DOUBLE, {reach}::DOUBLE)" for m, (scale, p, reach) in METRICS.items())
    low = "((({0}) - greatest(({0}) // 32 - 1, 0) * 32) << greatest(({0}) // 32 - 1, 0)::INTEGER)"
    at = lambda q: f"min(CASE WHEN upto >= {q} * n_rows THEN b END)"

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        return f"""{name} AS (SELECT {by}, any_value(n_rows) AS n, {low.format(at("(1 - p)"))} AS ql, {low.format(at("p") + " + 1")} - 1 AS qh FROM (SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(c) OVER (PARTITION BY {by}) AS n_rows FROM (SELECT {by}, b, any_value(p) AS p, sum(c) AS c FROM sk GROUP BY {by}, b)) GROUP BY {by})"""

    weigh = lambda c: f"(g.n * g.{c} + 100 * ((l.n * l.{c} + 100 * a.{c}) / (l.n + 100)::DOUBLE)) / (g.n + 100)::DOUBLE"
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
wi AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))), rp AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM wi WHERE n > 1) GROUP BY doc_id),
li AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '{word}')) - count(DISTINCT line) FILTER (regexp_matches(line, '{word}')) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, n_lines FROM d JOIN li USING (doc_id) LEFT JOIN rp USING (doc_id)),
fb AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f), m AS (SELECT * FROM (VALUES {shown}) v(metric, scale, p, reach)),
rt AS (SELECT doc_id, lang, source, base_failed, metric, p, reach, CASE metric WHEN 'word_len' THEN scale * word_chars // greatest(n_words, 1) WHEN 'symbol_rate' THEN scale * n_symbols // greatest(n_words, 1) WHEN 'dup_line_rate' THEN scale * n_dup_lines // greatest(n_lines, 1) ELSE scale * n_repeat_words // greatest(n_words, 1) END AS v FROM fb, m),
bk AS (SELECT *, greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)::INTEGER) AS b FROM rt), sk AS (SELECT lang, source, metric, p, b, count(*) AS c FROM bk WHERE NOT base_failed GROUP BY ALL),
{quantiles("qg", "lang, source")}, {quantiles("ql", "lang")}, {quantiles("qa", "")},
fe AS (SELECT g.lang, g.source, g.metric, lo - reach * (hi - lo) AS low, hi + reach * (hi - lo) AS high FROM (SELECT g.lang, g.source, g.metric, {weigh("ql")} AS lo, {weigh("qh")} AS hi FROM qg g JOIN ql l ON g.lang IS NOT DISTINCT FROM l.lang AND g.metric = l.metric JOIN qa a ON a.metric = g.metric) g JOIN m ON m.metric = g.metric),
ok AS (SELECT doc_id, bool_and(fe.low IS NULL OR (v >= fe.low AND v <= fe.high)) AS good FROM rt LEFT JOIN fe ON fe.lang IS NOT DISTINCT FROM rt.lang AND fe.source IS NOT DISTINCT FROM rt.source AND fe.metric = rt.metric GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM fb JOIN ok USING (doc_id)"""


def _vector_codes(rounds: int = 6) -> str:
    d = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        """WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x[part * w + 1:(part + 1) * w] AS x FROM v, (SELECT max(len(x)) // 8 AS w FROM v), (SELECT unnest(range(8)) AS part)),
c0 AS MATERIALIZED (SELECT part, e, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)) USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, x, b.e AS e, b.d AS d FROM (SELECT vec_id, p.part, any_value(label) AS label, any_value(p.x) AS x, min({{'d': {d}, 'e': c.e}}) AS b FROM p JOIN c{r} c ON p.part = c.part GROUP BY vec_id, p.part))")
        if r < rounds:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(m, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM (SELECT part, e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM (SELECT part, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, e, i) GROUP BY part, e) USING (part, e))"
            )
    return (
        ",\n".join(parts)
        + f""",
o AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"""
    )


FILTER_AUDIT = """WITH RECURSIVE f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS filter_order, 0 AS before UNION ALL SELECT filter_order || f, before | bit FROM o, f WHERE before & bit = 0),
s AS (SELECT a.filter_order, length(b.filter_order) + 1 AS step, b.before, (SELECT bit FROM f WHERE f = a.filter_order[length(b.filter_order) + 1]) AS bit FROM o a JOIN o b ON length(a.filter_order) = 5 AND length(b.filter_order) < 5 AND starts_with(a.filter_order, b.filter_order)),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 200)::INT | ((100 * len(list_distinct(w)) < 50 * len(w))::INT << 1) | ((100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT << 2) | (regexp_matches(t, '[#$%&*|]')::INT << 3) | ((doc_id > min(doc_id) OVER (PARTITION BY t))::INT << 4) AS mask FROM t),
l AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad FROM m LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
x AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & bit = 0 AND mask & before = 0) AS kept, sum(n) FILTER (mask & bit != 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit != 0 AND mask & before != 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit != 0 AND mask & before = 0) AS good_lost, sum(bad) FILTER (mask & bit != 0 AND mask & before = 0) AS toxic_lost FROM l, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x"""

ORACLE_SQL = {"op1_secret_scan": _secrets(), "op2_decontaminate": DECONTAMINATE, "op3_quality_rules": _quality_rules(), "op5_line_dedup": LINE_DEDUP, "op6_warc": WARC, "op9_mixing": MIXING, "op12_vector_codes": _vector_codes(), "op13_filter_audit": FILTER_AUDIT}
