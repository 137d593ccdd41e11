"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS k FROM d WHERE len(w) >= 5)),
ish AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS k FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN ish USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM hit JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_shingles
"""

OP1 = """
WITH RECURSIVE w AS (SELECT source, CAST(floor(sqrt(count(*))) AS BIGINT) AS w, row_number() OVER (ORDER BY source) AS i FROM documents GROUP BY source),
g AS (SELECT max(d) AS d FROM (SELECT unnest(generate_series(1, (SELECT min(w) FROM w))) AS d) WHERE (SELECT bool_and(w % d = 0) FROM w)),
v AS (SELECT source, w // (SELECT d FROM g) AS s, i FROM w),
a AS (SELECT list(s ORDER BY i) AS s, CAST(sum(s) AS BIGINT) AS q FROM v),
e AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS c, CAST(0 AS BIGINT) AS p FROM a
  UNION ALL
  SELECT t + 1, list_transform(c, lambda v, i: v + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (
    SELECT t, c, q, list_min(list_filter(list_transform(c, lambda v, i: CASE WHEN (v * q) // s[i] <= t + 1
      THEN {'due': ((v + 1) * q + s[i] - 1) // s[i], 'i': i} END), lambda z: z IS NOT NULL)).i AS pick
    FROM e, a WHERE t + 1 < q)),
slots AS (SELECT w.source, w.s, t AS slot, row_number() OVER (PARTITION BY w.source ORDER BY t) - 1 AS k FROM e JOIN v w ON w.i = e.p WHERE t >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents)
SELECT doc_id, d.source, rank // 16 AS block, CAST(rank % 16 AS INTEGER) AS place, ((rank // 16) // slots.s) * (SELECT q FROM a) + slot AS slot
FROM d JOIN slots ON slots.source = d.source AND slots.k = (rank // 16) % slots.s
"""


OP7 = """
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
place AS (SELECT doc, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT doc, i, array_to_string(w[i:i + 34], ' ') AS s FROM place),
rep AS (SELECT doc, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc, unnest(generate_series(i, i + 34)) AS j FROM rep),
word AS (SELECT doc, unnest(generate_series(1, len(w))) AS j, unnest(w) AS x FROM d),
kept AS (SELECT doc, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc, j) GROUP BY doc)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc)
"""


def _op3() -> str:
    """The rules and the vocabulary as expressions over one URL."""
    from .urls import LOWER, RULES, SOFT, SOFT_LIMIT, STRICT, UPPER

    def terms(words: list[str]) -> str:
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') AS BIGINT)" for w in words)

    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(try(url_decode(url)), url, ''), '{UPPER}', '{LOWER}') AS u,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
  {terms(STRICT)} AS n_strict, {terms(SOFT)} AS n_soft FROM p)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits)} END AS rule,
  CASE {" ".join(f"WHEN {c} THEN '{v}'" for v, _, c in fits)} WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM s
"""


def _op8() -> str:
    """The rules as a table; words have a space before and after them, so that matches need not look around."""
    from .licenses import BASE, BASE_SURE, rules

    spaced = lambda p: p.replace(" ", "  ")
    table = ", ".join(f"({i}, '{label}', {list(keys)}, {priority}, CAST({sure} AS DOUBLE), ' (?:{spaced(pattern)}) ')" for i, (label, keys, priority, sure, pattern) in enumerate(rules()))
    words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    base = " UNION ALL ".join(
        f"SELECT doc, '{label}' AS label, i AS place FROM (SELECT doc, w, unnest(generate_series(0, len(w) - {len(p.split())})) AS i FROM d WHERE len(w) >= {len(p.split())}) WHERE {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))}"
        for p, label in BASE.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
r AS (SELECT * FROM (VALUES {table}) AS v(rule, label, keys, priority, sure, pattern)),
k AS (SELECT list_distinct(flatten(list(keys))) AS k FROM r),
t AS (SELECT doc, w, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d WHERE list_has_any(w, (SELECT k FROM k))),
m AS (SELECT doc, label, priority, sure, regexp_extract_all(t, pattern) AS m, regexp_split_to_array(t, pattern) AS p FROM t JOIN r ON list_has_any(w, keys)),
e AS (SELECT doc, label, priority, sure, unnest(m) AS x, generate_subscripts(m, 1) AS i, m, p FROM m WHERE len(m) > 0),
f AS (SELECT doc, label, priority, sure,
    list_sum(list_transform(p[1:i], lambda y: {words('y')})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: {words('y')})), 0) AS first, {words('x')} AS n FROM e),
g AS (SELECT *, first + n - 1 AS last FROM f),
s AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g AS o WHERE o.doc = g.doc AND o.first <= g.first AND o.last >= g.last AND (o.priority > g.priority OR (o.priority = g.priority AND o.n > g.n)))),
b AS ({base}),
bs AS (SELECT doc, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b GROUP BY doc),
ls AS (SELECT doc, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(sure) AS sure FROM (SELECT doc, label, sure FROM s UNION ALL SELECT doc, label, {BASE_SURE} FROM b) GROUP BY doc)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(sure, 0.0) AS score
FROM d LEFT JOIN bs USING (doc) LEFT JOIN ls USING (doc)
"""


ORACLES: dict[str, str] = {
    "op1_mixing": OP1,
    "op2_decontamination": OP2,
    "op3_urls": _op3(),
    "op7_substrings": OP7,
    "op8_licenses": _op8(),
}
