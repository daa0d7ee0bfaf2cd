"""The queries again as DuckDB SQL."""

from __future__ import annotations

# Python's white space, and the punctuation that answers lose, for RE2.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _match(x: str) -> str:
    return _collapse(f"lower({x})")


def _answer(x: str) -> str:
    bare = _collapse(f"translate(lower({x}), '{_PUNCT}', '')")
    return f"list_filter(string_split({bare}, ' '), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


_PAIRS = """SELECT g.conv_id, g.turn, p.text AS pred, g.text AS gold FROM conversations g JOIN conversations p
            ON p.conv_id = g.conv_id AND p.turn = g.turn + 1 WHERE g.role = 'user' AND p.role = 'assistant'"""

_F1 = f"""
pt AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_answer("pred")}) AS t FROM pairs) GROUP BY id, t),
gt AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_answer("gold")}) AS t FROM pairs) GROUP BY id, t),
same AS (SELECT id, sum(least(pt.n, gt.n)) AS n FROM pt JOIN gt USING (id, t) GROUP BY id),
f1 AS (SELECT pairs.*, CASE WHEN len({_answer("pred")}) + len({_answer("gold")}) = 0 THEN 1.0
              ELSE 2.0 * coalesce(same.n, 0) / (len({_answer("pred")}) + len({_answer("gold")})) END AS f1 FROM pairs LEFT JOIN same USING (id))"""

_TURNS = f"WITH pairs AS (SELECT row_number() OVER () AS id, * FROM ({_PAIRS})), {_F1} SELECT conv_id, turn, round(f1, 6)::DOUBLE AS f1 FROM f1"

_GRAPH = """refs AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
corpus AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size <= 10 UNION SELECT src FROM refs),
nodes AS (SELECT id, bool_or(k) AS in_corpus FROM (SELECT id, true AS k FROM corpus UNION ALL SELECT dst, false FROM refs) GROUP BY id),
edges AS (SELECT DISTINCT src, dst FROM refs)"""

_TOPK = """SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
           FROM embeddings q JOIN embeddings v ON {on} WHERE q.vec_id % 20 = 0"""


def _topk(on: str) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_TOPK.format(on=on)})"
    return f"SELECT query_id, vec_id, rank::INT AS rank, score FROM ({ranked}) WHERE rank <= 5"


_FIELDS = r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
    list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<p>(.*?)</p>', 1),
        lambda p: trim(regexp_replace(p, '<[^>]*>', '', 'g'))), lambda p: p <> '') AS ps,
    (length(html) - length(replace(html, 'href="', ''))) // 6 AS n_links FROM pages"""

_PROBE = """SELECT c_custkey AS paper_id, CASE WHEN body IS NULL THEN 'miss' WHEN body = '{"_s2_not_found": true}' THEN 'negative' ELSE 'hit' END AS status
FROM customer LEFT JOIN (SELECT user_id, CASE WHEN event_type = 'click' THEN '{"_s2_not_found": true}' ELSE props END AS body
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) ON user_id = c_custkey"""

_KEYS = ("TL;DR", "Problem", "Method", "Results", "Limitations")


def _field(i: int) -> str:
    x = f"coalesce(nullif(regexp_replace(ps[{i}], '^{_WS}|{_WS}$', '', 'g'), ''), 'Unknown')"
    lines = f"regexp_split_to_array({x}, '\\r\\n|\\r|\\n')"
    return f"array_to_string(list_filter({lines}, lambda v: regexp_replace(v, '^{_WS}|{_WS}$', '', 'g') <> '---'), chr(10))"


_PAGE = " || ".join(f"chr(10) || '## {h}' || chr(10) || coalesce({_field(i + 1)}, '') || chr(10)" for i, h in enumerate(_KEYS))

#: Lines of documents as the stripped text of a section, and the length of their XML.
_LINES = f"""s AS (SELECT row_number() OVER () AS r, doc_id::VARCHAR AS arxiv_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, arxiv_id, i, regexp_replace(ls[i + 1], '^{_WS}|{_WS}$', '', 'g') AS t,
      length(ls[i + 1]) + 4 * (length(ls[i + 1]) - length(replace(ls[i + 1], '&', ''))) + 3 * (length(ls[i + 1]) - length(regexp_replace(ls[i + 1], '[<>]', '', 'g'))) AS escaped
      FROM s, unnest(range(0, len(ls))) AS u(i))"""

ORACLE_SQL: dict[str, str] = {
    "scoped_topk": _topk("q.label = v.label"),
    "global_topk": _topk("true"),
    "topk_clamped": "SELECT q.vec_id AS query_id, count(*) AS n, count(*) AS last_rank FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0 GROUP BY 1",
    "scope_semi_join": "SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'de') GROUP BY source",
    "unit_vectors": """SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 6) AS first FROM (
        SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
        FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings)))""",
    "hashed_embedding": f"""WITH t AS (SELECT doc_id, unnest(string_split({_match("text")}, ' ')) AS w FROM documents),
        c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 6))::BIGINT % 64 AS bucket, count(*) AS n FROM t WHERE w <> '' GROUP BY 1, 2)
        SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
    "chunk_windows": f"""WITH w AS (SELECT doc_id, list_filter(string_split({_collapse("text")}, ' '), lambda x: x <> '') AS w FROM documents),
        k AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 128) / 96.0) AS BIGINT), 0) + 1)) AS i FROM w WHERE len(w) > 0)
        SELECT doc_id || '::' || i AS chunk_id, doc_id, i AS chunk_idx, array_to_string(w[i * 96 + 1 : i * 96 + 128], ' ') AS text, len(w[i * 96 + 1 : i * 96 + 128]) AS token_count FROM k""",
    "normalized_answers": f"SELECT conv_id, turn, coalesce(array_to_string({_answer('text')}, ' '), '') AS norm, len({_answer('text')}) AS n_tokens FROM conversations",
    "match_keys": f"SELECT doc_id, md5({_match('text')}) AS key FROM documents",
    "dedup_first_seen": f"SELECT doc_id, length(text) AS n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY {_match('text')} ORDER BY doc_id) = 1",
    "token_f1_turns": _TURNS,
    "max_token_f1": f"""WITH pairs AS (SELECT row_number() OVER () AS id, p.conv_id, p.turn, p.text AS pred, g.text AS gold FROM conversations p
        JOIN conversations g ON p.conv_id = g.conv_id AND g.role = 'user' WHERE p.role = 'assistant'), {_F1}
        SELECT a.conv_id, a.turn, round(coalesce(max(f1), 0), 6)::DOUBLE AS f1 FROM conversations a LEFT JOIN f1 ON a.conv_id = f1.conv_id AND a.turn = f1.turn
        WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn""",
    "evidence_coverage": f"SELECT item_id FROM benchmark b WHERE {_match('b.text')} <> '' AND EXISTS (SELECT 1 FROM documents d WHERE contains({_match('d.text')}, {_match('b.text')}))",
    "evidence_recall": f"""WITH g AS (SELECT conv_id, {_match("s")} AS k FROM (SELECT conv_id, unnest(string_split(text, '. ')) AS s FROM conversations WHERE turn = 0)),
        c AS (SELECT conv_id, k, EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = g.conv_id AND t.turn > 0 AND contains({_match("t.text")}, k)) AS hit FROM g)
        SELECT conv_id, round(count(*) FILTER (k <> '' AND hit) / nullif(count(*) FILTER (k <> ''), 0)::DOUBLE, 6) AS recall FROM c GROUP BY conv_id""",
    "run_summary": f"""SELECT count(*) AS n_evaluated, count(*) FILTER (f1 > 0.1) AS n_with_evidence, round(avg(f1) FILTER (f1 > 0.1), 6) AS mean_recall_at_k,
        round(avg(f1), 6) AS mean_answer_f1 FROM ({_TURNS})""",
    "running_mean": f"SELECT conv_id, turn, round(avg(len({_answer('pred')})) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 6) AS running FROM ({_PAIRS})",
    "gold_extraction": f"""WITH a AS (SELECT conv_id, turn, text, list_filter(string_split(text, '. '), lambda x: x <> '') AS spans FROM conversations),
        ans AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'Unanswerable' WHEN turn % 5 = 3 AND length(text) % 2 = 0 THEN 'Yes' WHEN turn % 5 = 3 THEN 'No'
                WHEN turn % 5 = 2 AND len(spans) > 0 THEN array_to_string(spans, ' ') WHEN trim(text) <> '' THEN text END AS v FROM a),
        s AS (SELECT conv_id, turn, i, sents[i] AS s FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND len(spans) > 0 THEN spans ELSE [text] END AS sents FROM a), unnest(range(1, len(sents) + 1)) AS u(i)),
        f AS (SELECT * FROM s WHERE {_match("s")} <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, {_match("s")} ORDER BY turn, i) = 1)
        SELECT c.conv_id, coalesce((SELECT string_agg(v, '|' ORDER BY turn) FROM ans WHERE ans.conv_id = c.conv_id), '') AS answers,
               coalesce((SELECT string_agg(s, '|' ORDER BY turn, i) FROM f WHERE f.conv_id = c.conv_id), '') AS evidence FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    "page_extract": f"SELECT page_id, title, h1, coalesce(array_to_string(ps, chr(10)), '') AS body, len(ps) AS n_paragraphs, n_links FROM ({_FIELDS})",
    "section_filter": f"""SELECT doc_id, count(*) AS n_sections, sum(length(l))::BIGINT AS n_chars, min(i - 1) AS first_idx FROM (
        SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))
        WHERE length(regexp_replace(l, '^{_WS}|{_WS}$', '', 'g')) >= 10 GROUP BY doc_id""",
    "graph_metrics": f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM refs) AS total_refs, (SELECT count(*) FROM refs WHERE dst IN (SELECT id FROM corpus)) AS in_corpus_edges,
        (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes) AS n_nodes,
        round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes)::DOUBLE * ((SELECT count(*) FROM nodes) - 1)), 8) AS density,
        round((SELECT avg(n) FROM (SELECT count(*) AS n FROM edges GROUP BY src)), 6) AS avg_out_degree""",
    "graph_nodes": f"WITH {_GRAPH} SELECT id, in_corpus FROM nodes",
    "graph_out_degrees": f"WITH {_GRAPH} SELECT src, count(*) AS out_degree FROM edges GROUP BY src",
    "page_link_graph": "SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)",
    "resume_pending": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1995-01-01')",
    "corpus_gate": """SELECT count(*) AS n, count(*) FILTER (p_partkey IS NOT NULL) AS kept, count(*) FILTER (p_partkey IS NULL) AS skipped
        FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 10) ON p_partkey = l_partkey""",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "cache_probe": _PROBE,
    "cache_hit_rate": f"SELECT count(*) AS n, count(*) FILTER (status <> 'miss') AS n_ok, round(100.0 * count(*) FILTER (status <> 'miss') / greatest(count(*), 1), 4)::DOUBLE AS pct FROM ({_PROBE})",
    "status_counters": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "parse_coverage": "SELECT lang, count(*) AS n, count(*) FILTER (n_chars >= 500) AS n_ok, round(100.0 * count(*) FILTER (n_chars >= 500) / greatest(count(*), 1), 4)::DOUBLE AS pct FROM documents GROUP BY lang",
    "status_merge": """SELECT coalesce(r.id, c_custkey) AS id, coalesce(r.stage, 'download') AS stage, c_mktsegment AS note, n_orders
        FROM customer FULL JOIN (SELECT o_custkey AS id, 'parsed' AS stage, count(*) AS n_orders FROM orders GROUP BY o_custkey) r ON r.id = c_custkey""",
    "ordered_ids": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "first_sorted": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100",
    "corpus_union": "SELECT s_nationkey AS id FROM supplier UNION SELECT c_nationkey FROM customer",
    "ids_not_on_disk": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "multiset_intersection": """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM (SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_custkey % 2 = 0
        INTERSECT ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_custkey % 2 = 1) GROUP BY 1, 2""",
    "rows_per_split": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "json_validation": "SELECT event_id, json_valid(props) AND json_exists(props, '$.k') AS valid, json_valid(props) AND json_exists(props, '$.k') AND json_exists(props, '$.tldr') AS has_both FROM events",
    "excerpt_budget": """WITH l AS (SELECT doc_id, i - 1 AS k, chr(10) || CASE WHEN (i - 1) % 3 = 0 THEN 'SECTION' ELSE 'S' || (i - 1) END || ':' || chr(10) || ls[i] AS b
            FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
        r AS (SELECT *, greatest(1000 - coalesce(sum(length(b)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS room FROM l)
        SELECT doc_id, string_agg(CASE WHEN length(b) > room THEN left(b, room) || ' [...]' ELSE b END, chr(10) ORDER BY k) AS excerpt FROM r WHERE k = 0 OR room > 0 GROUP BY doc_id""",
    "context_builder": """SELECT conv_id, string_agg('[' || n || '] ' || text, chr(10) || chr(10) ORDER BY n) AS context
        FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) GROUP BY conv_id""",
    "markdown_pages": f"""SELECT page_id, '---' || chr(10) || 'arxiv_id: ' || page_id || chr(10) || 'title: "' || replace(title, '"', '\\"') || '"' || chr(10) || 'generated_by: extractive' || chr(10)
        || 'generated_at: 2000-01-01T00:00:00+00:00' || chr(10) || 'status: ok' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || {_PAGE} AS markdown FROM ({_FIELDS})""",
    "magic_bytes": "SELECT page_id, starts_with(html, '<!DOCTYPE') AS valid FROM pages",
    "tei_sections": f"""WITH {_LINES} SELECT arxiv_id, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS sec_idx, CASE WHEN i % 3 = 0 THEN '[untitled]' ELSE 'S' || i END AS head,
        CASE WHEN i % 3 = 0 THEN '' ELSE i::VARCHAR END AS n, t AS text FROM l WHERE length(t) >= 10""",
    "tei_papers": f"""WITH {_LINES} SELECT arxiv_id, 'ok' AS status, 'Paper ' || arxiv_id AS title, count(*) FILTER (length(t) >= 10) AS num_sections,
        (length('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Paper </title></titleStmt></fileDesc><profileDesc><abstract><p></p></abstract></profileDesc></teiHeader><text><body></body></text></TEI>')
         + length(arxiv_id) + sum(CASE WHEN i = 0 THEN escaped ELSE 0 END) + sum(escaped + length('<div><p></p></div>') + CASE WHEN i % 3 = 0 THEN 0 ELSE length('<head n="">S</head>') + 2 * length(i::VARCHAR) END))::BIGINT AS xml_size,
        NULL::VARCHAR AS error FROM l GROUP BY r, arxiv_id""",
    "full_texts": f"""WITH {_LINES} SELECT arxiv_id, 'Paper ' || arxiv_id || coalesce(chr(10) || chr(10) || nullif(max(t) FILTER (i = 0), ''), '') ||
        coalesce(chr(10) || chr(10) || string_agg(CASE WHEN i % 3 = 0 THEN t ELSE 'S' || i || chr(10) || t END, chr(10) || chr(10) ORDER BY i) FILTER (length(t) >= 10), '') AS body FROM l GROUP BY r, arxiv_id""",
    "offset_windows": f"""WITH b AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(text, '^{_WS}', '') AS b FROM documents),
        w AS (SELECT r, doc_id, regexp_extract_all(b, '{_WS.replace("[", "[^", 1)}') AS w, regexp_extract_all(b, '{_WS}') AS g FROM b),
        s AS (SELECT r, doc_id, w, g, unnest(range(0, greatest(ceil((len(w) - 128) / 96.0), 0)::BIGINT + 1)) AS k FROM w WHERE len(w) > 0)
        SELECT doc_id, k AS chunk_idx, array_to_string(list_transform(range(96 * k + 1, least(96 * k + 128, len(w)) + 1),
            lambda j: w[j] || CASE WHEN j < least(96 * k + 128, len(w)) THEN g[j] ELSE '' END), '') AS text, least(128, len(w) - 96 * k) AS token_count FROM s""",
    "question_rows": "SELECT conv_id::VARCHAR AS paper_id, conv_id || '-' || turn AS question_id, text AS question, 0::BIGINT AS n_answers FROM conversations WHERE role = 'user'",
    "reference_edges": "SELECT 'c' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_linenumber % 3 > 0 AND l_orderkey % 7 > 0",
    "first_after_joins": """SELECT l_orderkey, l_linenumber, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE c_mktsegment = 'BUILDING' ORDER BY l_orderkey, l_linenumber LIMIT 250""",
    "until_successes": """WITH s AS (SELECT o_orderkey, o_orderstatus, sum((o_orderstatus = 'F')::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders)
        SELECT o_orderkey, o_orderstatus FROM s WHERE coalesce(before, 0) < 500""",
    "paper_picker": """SELECT p_partkey::VARCHAR AS id, CASE p_partkey WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 11 THEN 4 ELSE 5 END::BIGINT AS place FROM part WHERE p_partkey IN (7, 3, 11, 5)
        UNION ALL (SELECT id, 5 + row_number() OVER (ORDER BY id) FROM (SELECT p_partkey::VARCHAR AS id FROM part WHERE p_size <= 5 ORDER BY id LIMIT 5))""",
    "metadata_requests": """SELECT p_partkey, 'https://api.semanticscholar.org/graph/v1/paper/ARXIV:1706.' || lpad(p_partkey::VARCHAR, 5, '0')
        || '?fields=paperId,title,externalIds,references.paperId,references.title,references.externalIds' AS url FROM part""",
    "retrieval_eval": f"""WITH w AS (SELECT doc_id, list_filter(string_split({_collapse("text")}, ' '), lambda x: x <> '') AS w FROM documents),
        c AS (SELECT doc_id || '::' || k AS chunk_id, array_to_string(w[96 * k + 1 : 96 * k + 128], ' ') AS text
              FROM (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 128) / 96.0), 0)::BIGINT + 1)) AS k FROM w WHERE len(w) > 0)),
        t AS (SELECT 'c' || chunk_id AS id, text FROM c UNION ALL SELECT 'q' || item_id, text FROM benchmark),
        n AS (SELECT id, ('0x' || substr(md5(x), 1, 6))::BIGINT % 64 AS b, count(*) AS n FROM (SELECT id, unnest(string_split({_match("text")}, ' ')) AS x FROM t) WHERE x <> '' GROUP BY 1, 2),
        v AS (SELECT id, b, (n::FLOAT / sqrt(sum(n * n) OVER (PARTITION BY id))::FLOAT)::FLOAT AS x FROM n),
        m AS (SELECT id, list_transform(range(0, 64), lambda b: coalesce(element_at(m, b)[1], 0)::DOUBLE) AS v FROM (SELECT id, map(list(b), list(x)) AS m FROM v GROUP BY id)),
        r AS (SELECT q.id AS q, c.id AS c, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.v, c.v) DESC, c.id) AS rank FROM m q JOIN m c ON q.id[1] = 'q' AND c.id[1] = 'c'),
        hits AS (SELECT substr(q, 2) AS question_id, rank, text FROM r JOIN c ON r.c = 'c' || chunk_id WHERE rank <= 5),
        gold AS (SELECT item_id::VARCHAR AS question_id, {_match("s")} AS k FROM (SELECT item_id, unnest(string_split(text, '. ')) AS s FROM benchmark)),
        e AS (SELECT question_id, k, EXISTS (SELECT 1 FROM hits WHERE hits.question_id = gold.question_id AND contains({_match("hits.text")}, k)) AS hit FROM gold),
        pairs AS (SELECT item_id::VARCHAR AS id, {_collapse("coalesce(hits.text, '')")} AS pred, benchmark.text AS gold FROM benchmark LEFT JOIN hits ON question_id = item_id::VARCHAR AND rank = 1), {_F1}
        SELECT f1.id AS question_id, NULL::VARCHAR AS paper_id, (SELECT count(*) FROM hits WHERE hits.question_id = f1.id) AS n_hits,
               (SELECT round(count(*) FILTER (k <> '' AND hit) / nullif(count(*) FILTER (k <> ''), 0)::DOUBLE, 6) FROM e WHERE e.question_id = f1.id) AS recall_at_k, round(f1, 6)::DOUBLE AS answer_f1 FROM f1""",
}
