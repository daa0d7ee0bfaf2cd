"""Fetch feeding parse, retries by timers, faults, and the limit of a run."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import http
from scriptorium.sources.snapshots import Snapshots
from scriptorium.streaming import fetching

QUICK = http.Policy(spacing=0.0, attempts=3, wait=0.2, most=0.4)


def scripted(log):
    """Answers by what the URL says; every call is written down."""

    def build():
        def fetch(url):
            with open(log, "a") as f:
                f.write(f"{url}\n")
            with open(log) as f:
                before = f.read().split("\n").count(url) - 1
            if url.startswith("flaky") and before == 0:
                return 429, b""
            if url.startswith("down"):
                raise OSError("no route")
            if url.startswith("gone"):
                return 404, b""
            return 200, f"body of {url}".encode()

        return fetch

    return build


def ask(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.part", "w") as f:
        f.write("".join(json.dumps({"id": i, "url": u}) + "\n" for i, u in rows))
    os.rename(f"{folder}/{name}.part", f"{folder}/{name}.json")


def test_killed_and_restarted_fetches_nothing_twice(spark, tmp_path):
    src, out, cp, log = (str(tmp_path / x) for x in ("in", "out", "cp", "log"))
    requests = [(f"{k}{i}", f"{k}-{i}") for k, n in (("good", 8), ("flaky", 3), ("gone", 2), ("down", 1)) for i in range(n)]
    for i in range(0, len(requests), 5):
        ask(src, f"f{i}", requests[i : i + 5])
    ask(src, "nulls", [("null", None)])

    def fault(batch):  # in the second batch that has asked for something, before it is published
        if os.path.exists(log) and len(open(log).read().split()) > 5:
            raise RuntimeError("killed")

    run = lambda **more: fetching.run_fetching(spark, src, out, cp, scripted(log), QUICK, timeout=120, files_per_batch=1, lanes=2, every="100 milliseconds", **more)
    with pytest.raises(Exception, match="killed"):
        run(before_publish=fault)
    asked = Counter(open(log).read().split())
    assert asked and len(Snapshots(spark, out).read("answers").collect()) < len(asked)
    parsing = fetching.start_parsing(spark, out, cp + "-parse", lambda rows: rows.select("id", F.length(F.col("body").cast("string")).alias("n")), every="100 milliseconds")
    try:
        run()
        ask(src, "again", [("good0", "good-0"), ("good9", "good-9"), ("good9", "good-9")])  # one known, one new
        run()
        parsing.processAllAvailable()
    finally:
        parsing.stop()
    got = {r.id: (r.status, bytes(r.body or b"")) for r in Snapshots(spark, out).read("answers").collect()}
    # The same rows as the batch plan gives.
    rows = spark.createDataFrame([*requests, ("good9", "good-9")], "id string, url string")
    batch = {r.id: (r.status, bytes(r.body or b"")) for r in http.fetched(rows, scripted(str(tmp_path / "log2")), QUICK, lanes=2).collect()}
    assert got == batch | {"null": ("failed", b"")} and Counter(s for s, _ in got.values()) == {"ok": 12, "missing": 2, "failed": 2}
    asked = Counter(open(log).read().split())
    assert asked == {u: {"flaky": 2, "down": 3}.get(u.split("-")[0], 1) for _, u in [*requests, ("good9", "good-9")]}
    parsed = Snapshots(spark, out).read("parsed").collect()
    assert sorted((r.id, r.n) for r in parsed) == sorted((i, len(b)) for i, (s, b) in got.items() if s == "ok")
    assert fetching.waiting(spark, out) == 0


def test_the_limit_holds_for_the_run(spark, tmp_path):
    """Eight tasks at once: no more requests in any window than the limit and one for each lane."""
    log, spacing, lanes = str(tmp_path / "times"), 0.05, 8

    def build():
        def fetch(url):
            with open(log, "a") as f:
                f.write(f"{time.time()}\n")
            return 200, b"x"

        return fetch

    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit("u").alias("url"))
    assert http.fetched(rows, build, http.Policy(spacing=spacing), lanes=lanes).count() == 60
    times = sorted(float(x) for x in open(log).read().split())
    assert len(times) == 60
    for i, a in enumerate(times):
        for j in range(i, len(times)):
            assert j - i + 1 <= (times[j] - a) / spacing + lanes + 1


def test_pace():
    now, slept = [0.0], []
    pace = http.Pace(0.5, lane=1, lanes=4, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    pace()
    pace()
    now[0] += 10
    pace()
    pace()
    assert slept == [0.5, 2.0, 2.0]
    assert http.Pace(0.5, lane=1, lanes=4, again=True, clock=lambda: 0.0).next == 2.5
