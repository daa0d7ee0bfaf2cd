"""The quality query against its formulas in plain Python, and on rows that it was not fitted on."""

import math
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import shared, site_quality
from scriptorium.llm.queries import QUERIES


def logit(p):
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def strength(sites, mean):
    several = [x for x in sites if len(x) > 1]
    n = sum(map(len, several))
    if not n:
        return 20.0
    spread = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in several)
    within = sum(sum(p * (1 - p) for p in x) / len(x) for x in several)
    between = (spread - within) / n
    return min(1000.0, max(2.0, mean * (1 - mean) / between - 1)) if between > 1e-9 else 1000.0


def test_posteriors_are_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_quality_classifier"](spark, sf).collect()
    assert len(rows) == len(docs)
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in rows:
        d = docs[r.doc_id]
        hosts[d.source].append(r.doc_score)
        paths[d.source, d.lang].append(r.doc_score)
    mean = (sum(r.doc_score for r in rows) + 0.5) / (len(rows) + 1)
    by_host, by_path = strength(hosts.values(), mean), strength(paths.values(), mean)
    for r in rows:
        h, p = hosts[docs[r.doc_id].source], paths[docs[r.doc_id].source, docs[r.doc_id].lang]
        host = (sum(h) - r.doc_score + by_host * mean) / (len(h) - 1 + by_host)
        path = (sum(p) - r.doc_score + by_path * host) / (len(p) - 1 + by_path)
        score = 1 / (1 + math.exp(-(logit(r.doc_score) + 0.5 * (logit(path) - logit(mean)))))
        assert abs(r.host_posterior - host) < 1e-5 and abs(r.path_posterior - path) < 1e-5 and abs(r.score - score) < 1e-4
        assert r.kept == (r.score >= 0.3)


def test_labels_that_were_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (shared.read_table(spark, sf, t) for t in ("documents", "labels"))
    seen = labels.where(~shared.held_out(F.col("doc_id")))
    out = {r.doc_id: r.score for r in site_quality.quality(docs, seen, (F.col("source"), F.col("lang"))).collect()}
    held = [(out[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert len(bad) >= 5 and sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.9 * len(good) * len(bad)
