"""Queries against SQL, and against plain Python where SQL has none."""

from collections import Counter, defaultdict

import pytest
from compare import same
from pyspark.sql import functions as F

from scriptorium.llm.queries import QUERIES
from scriptorium.llm.shared import held_out
from scriptorium.llm.sql import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def shingles(text, width=5):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def similar_pairs(sets):
    where = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, o in common.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                yield j, i


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in similar_pairs(sets):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def line_words(line):
    import re

    return frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)


def brute_lines(rows):
    """Lines that go, by document: tokens are the distinct words of a line."""
    lines = [(k, i, x) for k, t in sorted(rows) for i, x in enumerate((t or "").split("\n")) if line_words(x)]
    first = list(dict.fromkeys(x for _, _, x in lines))
    later = {first[b] for _, b in similar_pairs([line_words(x) for x in first])}
    seen, gone = set(), defaultdict(list)
    for k, i, x in lines:
        if x in seen or x in later:
            gone[k].append(i)
        seen.add(x)
    return gone


def test_ngram_join_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op10_ngram_join"](spark, sf).collect())
    assert got == brute_components(rows)


def test_line_dedup_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_lines(rows)
    got = {r.doc_id: r for r in QUERIES["op3_line_dedup"](spark, sf).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        assert (got[k].n_lines, got[k].removed_lines) == (len(t.split("\n")), ",".join(map(str, want.get(k, []))))


def test_toxicity_scores(spark):
    """Held-out rows of sf0.01: toxic ones are caught, clean ones are left alone."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [r for r in held if labels[r.doc_id]], [r for r in held if not labels[r.doc_id]]
    better = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean)
    assert better >= 0.9 * len(toxic) * len(clean) and sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)


def test_quality_classifier_tells_labels_apart(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op2_quality_classifier"](spark, sf).collect() if r.doc_id in labels]
    good = [r.score for r in rows if labels[r.doc_id] == 1]
    bad = [r.score for r in rows if labels[r.doc_id] == 0]
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(r.kept for r in rows if labels[r.doc_id] == 1) >= 0.97 * len(good)


def test_secrets_on_held_out_documents(spark):
    """Tokens that stand in documents which no training passage comes from."""
    import re

    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").where(held_out(F.col("doc_id"))).collect()}
    planted = {(k, *m.span(1)) for k, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    found = {(r.doc_id, f.start, f.end) for r in QUERIES["op5_secret_scan"](spark, sf).where(held_out(F.col("doc_id"))).collect() for f in r.findings}
    assert len(planted) >= 30 and len(planted & found) >= 0.95 * len(planted)
    assert len(found - planted) <= 0.05 * len(planted)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "lang", "source", "n_chars", "size", "copy_no"} == set(out.columns)
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} <= set(docs)
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    texts = {r.doc_id: r.text for r in rows}
    assert all(set(t.split("\n")) <= set(docs[k].text.split("\n")) for k, t in texts.items())
    assert all(r.n_chars == len(r.text) for r in rows) and all(t.strip() or not docs[k].text.strip() for k, t in texts.items())
    assert all(k == component for k, _, component in brute_components(sorted(texts.items())))
