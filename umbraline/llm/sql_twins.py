"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from . import decontaminate, filter_audit, licenses, line_dedup, quality, url_filter

UPPER, LOWER = url_filter.UPPER, url_filter.LOWER
GAP = r"[\x20\x09-\x0D]+"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_twin(rules: list[tuple[str, str, str]]) -> str:
    ordered = sorted(rules, key=lambda r: -len((r[1] + r[2]).encode()))
    fits = [f"((host = {literal(h)} OR ends_with(host, {literal('.' + h)})) AND starts_with(path, {literal(p)}))" for _, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN {literal(h + p)}" for f, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN {literal(v)}" for f, (v, _, _) in zip(fits, ordered, strict=True))
    blocked = " OR ".join(f"regexp_matches(canonical, {literal(url_filter.glob_regex(g))})" for g in url_filter.BLOCK_GLOBS)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1) AS query FROM r),
c AS (SELECT page_id, host, path, host || path || query AS canonical FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM c"""


def containment_twin() -> str:
    k = decontaminate.WORDS
    parts = " || ' ' || ".join(f"w[i{f' + {j}' if j else ''}]" for j in range(k))
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark), d AS (SELECT doc_id, {words} AS w FROM documents),
si AS (SELECT DISTINCT item_id, {parts} AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM i WHERE len(w) >= {k})),
sd AS (SELECT DISTINCT doc_id, {parts} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})),
n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sd JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM h JOIN n USING (item_id)
WHERE 100 * n_shared >= {decontaminate.PERCENT} * n_shingles"""


def line_twin() -> str:
    least = line_dedup.MIN_WORDS
    return rf"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM t),
w AS (SELECT doc_id, n, l[n] AS line, len(list_filter(string_split_regex(l[n], '{GAP}'), lambda x: x <> '')) AS words FROM lines),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM w),
f AS (SELECT a.doc_id, a.n, min(b.n) AS e FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.n >= a.n AND b.upto - a.upto + a.words >= {least} GROUP BY ALL),
g AS (SELECT b.doc_id, max(a.n) AS n, b.n AS e FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.n >= a.n AND b.upto - a.upto + a.words >= {least} GROUP BY b.doc_id, b.n),
runs AS (SELECT DISTINCT r.doc_id, r.n, r.e, array_to_string(l[r.n:r.e], chr(10)) AS body FROM (SELECT * FROM f UNION SELECT * FROM g) r JOIN t USING (doc_id)),
first AS (SELECT body, min((doc_id, n)) AS p FROM runs GROUP BY body),
gone AS (SELECT DISTINCT doc_id, unnest(range(n, e + 1)) AS n FROM runs JOIN first USING (body) WHERE (doc_id, n) > p),
kept AS (SELECT s.doc_id, count(*) AS n_lines, count(gone.n) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY s.n) FILTER (WHERE gone.n IS NULL), '') AS body
         FROM s LEFT JOIN gone ON s.doc_id = gone.doc_id AND s.n = gone.n GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""


def quality_twin() -> str:
    k = quality.WINDOW
    body = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    soft = {"symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > 3 * n_lines", "lengths": "(word_chars < 2 * n_words OR word_chars > 15 * n_words)"}
    hosts = ", ".join(f"count(*) FILTER (soft_{r}) AS n_{r}" for r in soft)
    weights = ", ".join(f"""avg(n_{r} / n) AS mean_{r}, greatest(CASE WHEN var_pop(n_{r} / n) * ({quality.MOST_PRIOR} + 1) <= avg(n_{r} / n) * (1 - avg(n_{r} / n))
        THEN {quality.MOST_PRIOR} ELSE avg(n_{r} / n) * (1 - avg(n_{r} / n)) / var_pop(n_{r} / n) - 1 END, 0) AS weight_{r}""" for r in soft)
    bad = ", ".join(f"round((n_{r} + mean_{r} * weight_{r}) / (n + weight_{r}), 9) > {quality.BAD_SHARE} AS bad_{r}" for r in soft)
    caught = " OR ".join(f"(soft_{r} AND coalesce(bad_{r}, false))" for r in soft)
    return rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
a AS (SELECT doc_id, source, x, list_filter(string_split_regex(x, '{GAP}'), lambda y: y <> '') AS w,
        list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM t),
wins AS (SELECT doc_id, i, {body} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM a WHERE len(w) >= {k})),
twice AS (SELECT doc_id, s FROM wins GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {k})) AS j FROM wins SEMI JOIN twice USING (doc_id, s)) GROUP BY doc_id),
m AS (SELECT a.doc_id, source AS host, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
        length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
        coalesce(rep.n, 0) AS n_repeat_words FROM a LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
        {', '.join(f'{c} AS soft_{r}' for r, c in soft.items())} FROM m),
hosts AS (SELECT host, count(*) AS n, {hosts} FROM b WHERE host IS NOT NULL GROUP BY host),
prior AS (SELECT {weights} FROM hosts),
bad AS (SELECT host, {bad} FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({caught}) AS kept
FROM b LEFT JOIN bad USING (host)"""


def license_twin() -> str:
    rules = ", ".join(f"({p}, {literal(g)}, {literal(k)}, {literal(x)}, {w}, {literal(lab)})" for p, g, k, x, w, lab in licenses.build_rules())
    gates = " OR ".join(f"contains(line, {literal(g)})" for g in licenses.GATES)
    places = " UNION ALL ".join(
        f"SELECT id, i - 1 AS place, {literal(label)} AS label FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE "
        + " AND ".join(f"w[i + {j}] = {literal(word)}" for j, word in enumerate(phrase.split())) for phrase, label in licenses.PHRASES)
    return rf"""
WITH t AS (SELECT doc_id AS id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low,
        list_filter(string_split_regex(low, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
base AS (SELECT id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM ({places}) GROUP BY id),
lines AS (SELECT id, n, line FROM (SELECT id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT id, string_split(low, chr(10)) AS l FROM t)) WHERE {gates}),
rules(pri, gate, key, rx, weight, label) AS (VALUES {rules}),
d AS (SELECT id, n, pri, label, weight, strpos(line, regexp_extract(line, rx)) AS a, length(regexp_extract(line, rx)) AS k
      FROM lines JOIN rules ON contains(line, gate) AND contains(line, key) WHERE regexp_matches(line, rx)),
k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.id = d.id AND e.n = d.n AND e.pri < d.pri AND e.a <= d.a AND e.a + e.k >= d.a + d.k)),
m AS (SELECT id, list(DISTINCT label) AS labels, max(weight) AS weight, count(*) AS n FROM k GROUP BY id)
SELECT t.id AS doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CAST(greatest(coalesce(m.weight, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score, coalesce(m.n, 0) AS n_detections
FROM t LEFT JOIN base USING (id) LEFT JOIN m USING (id)"""


def warc_twin() -> str:
    return """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""


def audit_twin() -> str:
    a = filter_audit
    sums = ", ".join(f"coalesce(sum({what}) FILTER (WHERE (mask & seen) = 0 AND (mask & bit) {test} 0), 0)::BIGINT AS {name}" for what, test, name in (
        ("n", "=", "kept"), ("n", "<>", "removed"), ("good", "<>", "good_lost"), ("toxic", "<>", "toxic_lost")))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT t AS first_text, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(w) < {a.MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {a.DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {a.UPPER_PERCENT} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '{a.SYMBOLS}') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first_id THEN 16 ELSE 0 END AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d JOIN f ON t = first_text LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM v a, v b, v c, v d, v e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS seen FROM o, (SELECT unnest(range(1, 6)) AS step)),
p AS (SELECT part, filter_order, step, bit, {sums},
    coalesce(sum(n) FILTER (WHERE (mask & seen) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM p"""


def twins(url_rules: list[tuple[str, str, str]]) -> dict[str, str]:
    return {
        "op3_url_filter": url_twin(url_rules), "op5_benchmark_decontamination": containment_twin(), "op6_line_dedup": line_twin(),
        "op7_quality_rules": quality_twin(), "op8_license_scan": license_twin(), "op9_warc": warc_twin(),
        "op11_filter_audit": audit_twin()}
