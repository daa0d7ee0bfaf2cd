"""The queries again as DuckDB SQL, written independently of the operators."""

from __future__ import annotations

import re

from .licenses import PHRASES, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CHAR_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE_WORD = r"[^\x20\x09-\x0D]+"

# Base32 of the 20 bytes of sha1, five bits at a time.
OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, octet_length(body) AS n, hex FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(CAST(instr('0123456789abcdef', substr(hex, i, 1)) - 1 AS BIGINT)), 4, '0')), '') AS z FROM b),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(16 * CAST(substr(z, k * 5 + 1, 1) AS INT) + 8 * CAST(substr(z, k * 5 + 2, 1) AS INT) + 4 * CAST(substr(z, k * 5 + 3, 1) AS INT)
             + 2 * CAST(substr(z, k * 5 + 4, 1) AS INT) + CAST(substr(z, k * 5 + 5, 1) AS INT) + 1 AS INT), 1)), '') AS digest FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY digest) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY digest) THEN NULL ELSE min(page_id) OVER (PARTITION BY digest) END AS refers_to
FROM d
"""

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_CHAR_WORD}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{_CHAR_WORD}') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM pat),
win AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
        FROM d, ms, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
hit AS (SELECT DISTINCT win.r, win.i, win.m, pat.item FROM win JOIN pat USING (m, p)),
pos AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, m FROM hit) h, unnest(range(0, m)) AS t(k) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}') AS w FROM documents),
lines AS (SELECT r, line FROM d, unnest(string_split(text, chr(10))) AS t(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS p FROM d, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) >= 8),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, p) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS t(k) GROUP BY r),
m AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words AND 10 * n_symbols <= n_words
       AND 10 * n_dup_lines <= 3 * len(string_split(text, chr(10)))
       AND 10 * (length(text) - length(replace(text, '!', ''))) <= n_words
       AND 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) <= word_chars AS kept
FROM f
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM documents),
c AS (SELECT *, greatest(len(bin(size)) - 5, 0) * 16 + (size >> CAST(greatest(len(bin(size)) - 5, 0) AS BIGINT)) AS cls FROM d),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS weight, 3 * source_size AS room FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY CAST(room AS DOUBLE) / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER (ORDER BY CAST(room AS DOUBLE) / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM w),
t AS (SELECT key, source_size, least(CAST(room AS DOUBLE), max(lev) OVER () * weight) AS target FROM l),
r AS (SELECT c.doc_id, c.size, t.source_size, t.target, row_number() OVER (PARTITION BY c.key ORDER BY c.cls, c.h, c.doc_id NULLS LAST, c.size) AS rank,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             CAST(CAST('0x' || substr(md5('mix-1@' || c.key), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS off
      FROM c JOIN t USING (key))
SELECT doc_id, size, source_size, target, CAST(floor(off + rate * rank) - floor(off + rate * (rank - 1)) AS BIGINT) * size AS taken FROM r
"""


OP3 = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS k, ls[i] AS line FROM t, unnest(range(1, len(ls) + 1)) AS u(i) WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
d AS (SELECT line, min((doc_id, k)) AS place FROM l GROUP BY line),
s AS (SELECT row_number() OVER (ORDER BY place) AS sid, line, place, list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) AS w FROM d),
e AS (SELECT sid, len(w) AS n, unnest(w) AS x FROM s),
later AS (SELECT DISTINCT b FROM (SELECT a.sid AS a, b.sid AS b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.sid < b.sid
          WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL) WHERE 100 * o >= 75 * (na + nb - o)),
g AS (SELECT l.doc_id, list(k ORDER BY k) AS ks FROM l JOIN s USING (line) WHERE sid IN (SELECT b FROM later) OR (doc_id, k) <> place GROUP BY l.doc_id)
SELECT t.doc_id, len(coalesce(ls, ['']))::BIGINT AS n_lines, coalesce(len(ks), 0)::BIGINT AS n_removed, coalesce(array_to_string(ks, ','), '') AS removed_lines FROM t LEFT JOIN g USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE_WORD}') AS w FROM documents),
t AS (SELECT row_number() OVER () AS sid, w, min(doc_id) AS first FROM d WHERE len(w) > 0 GROUP BY w),
e AS (SELECT DISTINCT sid, array_to_string(w[i : i + 4], ' ') AS x FROM t, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)),
n AS (SELECT sid, count(*) AS n FROM e GROUP BY sid),
p AS (SELECT a.sid AS a, b.sid AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.sid <> b.sid GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON na.sid = a JOIN n nb ON nb.sid = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
reach(sid, other) AS (SELECT sid, sid FROM t UNION SELECT reach.sid, links.b FROM reach JOIN links ON reach.other = links.a),
c AS (SELECT reach.sid, min(t.first) AS component FROM reach JOIN t ON t.sid = reach.other GROUP BY reach.sid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM d LEFT JOIN t USING (w) LEFT JOIN n USING (sid) LEFT JOIN c USING (sid)
"""


def _regex(template: str) -> str:
    """The markup as a regular expression over words that each end in a space."""
    out = ""
    for mark, word in re.findall(r"(\[\[|\]\]|\{\{\w+:\d+\}\})|([a-z0-9]+)", template):
        if mark.startswith("{"):
            out += "(?:[^ ]+ ){0,%s}" % re.search(r":(\d+)", mark)[1]
        else:
            out += {"[[": "(?:", "]]": ")?"}.get(mark, f"{word} ")
    return out.replace("(?:)?", "")


def _op9() -> str:
    places = " UNION ALL ".join(f"SELECT r, i, '{label}' AS label FROM w3 WHERE array_to_string(w[i : i + {len(p.split()) - 1}], ' ') = '{p}'" for p, label in PHRASES.items())
    found = ", ".join(f"CASE WHEN regexp_matches(line, ' {_regex(t)}') THEN '{name}' END" for name, t in TEMPLATES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_CHAR_WORD}') AS w FROM documents),
w3 AS (SELECT r, i, w FROM d, unnest(range(1, len(w) + 1)) AS t(i) WHERE w[i] IN ({", ".join(sorted({repr(p.split()[0]) for p in PHRASES}))})),
hits AS ({places}),
g AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list_distinct(list(label))) AS base FROM hits GROUP BY r),
e AS (SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base, []) AS base, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d LEFT JOIN g USING (r)),
x AS (SELECT *, list_filter([{found}], lambda v: v IS NOT NULL) AS more FROM e)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
       CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM x
"""


OP9 = _op9()

def _op13(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Every distance is taken in every round."""
    steps = []
    for i in range(rounds + 1):
        # The square of every distance, and the cluster with the smallest (then the smallest number).
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.r, m.c, list_sum(list_transform(list_zip(v.v, m.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, m{i} m) GROUP BY r)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT best.c AS c, j, sum(v.v[j])::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} JOIN v USING (r), unnest(range(1, {dims + 1})) AS t(j) GROUP BY ALL)")
            steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(any_value(x.m), any_value(m.m)) AS m FROM m{i} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY c) x USING (c) GROUP BY m.c)")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v AS m FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v) ORDER BY h NULLS LAST, v LIMIT {k}),
{", ".join(steps)}
SELECT vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN m{rounds} m ON m.c = best.c
"""


OP13 = _op13()

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1, "op3_line_dedup": OP3, "op4_decontamination": OP4, "op6_quality_rules": OP6, "op7_source_mixing": OP7, "op9_license_scan": OP9, "op10_ngram_join": OP10, "op13_centroid_clustering": OP13}
