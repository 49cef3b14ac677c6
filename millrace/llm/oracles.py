"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import math

from . import chatformat, licenses, urlfilter

LOW = f"translate({{}}, '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def strings(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def url_filter() -> str:
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in urlfilter.LISTED)
    pick = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits)
    parts = urlfilter.PARTS
    return f"""
    WITH u AS (
        SELECT page_id, {LOW.format(f"coalesce(regexp_extract(url, '{parts}', 1), '')")} AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path
        FROM pages
    )
    SELECT page_id, host, path, {pick(1)} END AS rule, {pick(2)} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM u"""


def chat_format() -> str:
    def escaped(column: str) -> str:
        for raw, safe in chatformat.ESCAPES:
            column = f"replace({column}, '{raw}', '{safe}')"
        return column

    fixed = len(chatformat.OPEN + chatformat.MIDDLE + chatformat.CLOSE)
    case = "</s>[INST] ok [/INST]"
    return f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{case}' UNION ALL SELECT -7, 1, 'assistant', '{case}'
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum({fixed} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id"""


def decontamination() -> str:
    words = WORDS.format(LOW.format("coalesce(text, '')"))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
    i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS w FROM benchmark),
    n AS (SELECT DISTINCT item, w[s + 1 : s + least(10, len(w))] AS win, least(10, len(w)) AS size
          FROM (SELECT item, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
    a AS (SELECT k, s, size, w[s + 1 : s + size] AS win
          FROM (SELECT k, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM d, (SELECT DISTINCT size FROM n) WHERE len(w) >= size)),
    h AS (SELECT k, s, a.size, item FROM a JOIN n ON a.win = n.win),
    c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + size)) AS p FROM h) GROUP BY k),
    f AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN c USING (k) LEFT JOIN f USING (k)"""


def license_scan() -> str:
    low = LOW.format("coalesce(text, '')")
    phrases = ", ".join(f"({strings(p.split())}, '{v}')" for p, v in licenses.PHRASES.items())
    kinds = ", ".join(f"({strings(sorted(set(t.split())))}, '{v}', {math.ceil(licenses.THRESHOLD * len(set(t.split())) - 1e-9)})" for t, v in licenses.TEMPLATES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, {low} AS t, {WORDS.format(low)} AS w FROM documents),
    p(phrase, label) AS (VALUES {phrases}),
    m(ws, label, need) AS (VALUES {kinds}),
    b AS (SELECT k, i, label FROM (SELECT k, w, unnest(range(0, len(w))) AS i FROM d), p WHERE w[i + 1] = phrase[1] AND w[i + 1 : i + len(phrase)] = phrase),
    l AS (SELECT k, list_distinct({WORDS.format('line')}) AS own FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)),
    h AS (SELECT k, label, len(list_intersect(own, ws)) / len(ws) AS share FROM l, m WHERE len(list_intersect(own, ws)) >= need),
    bs AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY k),
    ls AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM b UNION ALL SELECT k, label FROM h) GROUP BY k),
    ss AS (SELECT k, max(share) AS share FROM h GROUP BY k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
    FROM d LEFT JOIN bs USING (k) LEFT JOIN ls USING (k) LEFT JOIN ss USING (k)"""


ORACLES = {
    "op4_url_filter": url_filter(),
    "op6_chat_format": chat_format(),
    "op7_decontamination": decontamination(),
    "op9_licenses": license_scan(),
}
