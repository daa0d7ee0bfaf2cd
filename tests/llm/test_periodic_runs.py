"""Runs against brute force over every start and period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import periodic_runs
from scriptorium.llm.queries import QUERIES


def brute(words, least=24, repeats=3):
    """Every maximal stretch for every period, kept if no smaller period holds."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                part = words[i : i + length]
                if length >= max(least, repeats * q) and not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    kind = rng.randrange(5)
    n = rng.randrange(0, 220)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rng.choice("abcdefgh") for _ in range(n)]
    if kind == 2:
        return ["a"] * n
    out = []
    while len(out) < n:
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 3)
        out += (unit * rng.randrange(1, 14))[rng.randrange(2) :] + [rng.choice("abxyz") for _ in range(rng.randrange(0, 6))]
    return out[:n]


@pytest.mark.parametrize("border", [0, 0.02, 3])
@pytest.mark.parametrize("shape", [(24, 3), (6, 2), (1, 3)])
def test_runs_are_brute_force(monkeypatch, border, shape):
    """With border 0 every word is heavy; short minima make many runs that overlap."""
    monkeypatch.setattr(periodic_runs, "PAIRS_PER_PLACE", border)
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    rng = random.Random(str((border, shape)))
    for _ in range(250):
        words = random_words(rng)
        ids = periodic_runs.numbered([w.encode() for w in words])
        assert periodic_runs.find_runs(ids, *shape) == brute(words, *shape)


def test_lag_counts():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.2, 3000), 40) - 1
    want = [int((ids[: len(ids) - q] == ids[q:]).sum()) for q in range(1, 1001)]
    assert periodic_runs.lag_counts(ids, 1000).tolist() == [0, *want]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = periodic_runs.find_runs(periodic_runs.numbered([w.encode() for w in words])) if n > 400 else brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *numbers, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs) and sum(v[0] > 0 for v in got.values()) >= len(docs) // 25
    assert all(got[d.doc_id] == expected(d.doc_id, d.text) for d in docs)


def test_odd_rows(spark):
    cycle = " ".join(f"w{i % 40}" for i in range(60_000))
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a " * 24, " x ".join(["a"] * 30), cycle, " ".join(["same"] * 200_000)]
    rows = [(k, t, 1, "s", 0.5) for k, t in enumerate(texts)] + [(None, "b\t" * 30, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, `a.b` string, `_` double")
    out = periodic_runs.periodic_runs(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "a.b", "_", "runs", "collapsed"])
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert got[0] == got[1] == got[2] == ([], "") and got[3] == ([], "one") and got[4] == ([], " ".join("a" * 23))
    assert got[5] == got[6] == ([(0, 24, 1)], "a") and got[7] == ([(0, 59, 2)], "a x") and got[None] == ([(0, 30, 1)], "b")
    assert got[8] == ([(0, 60_000, 40)], " ".join(f"w{i}" for i in range(40))) and got[9] == ([(0, 200_000, 1)], "same")
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
