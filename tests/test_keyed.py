"""Point look-ups, pruned files, compaction beside appends."""

import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import incremental
from scriptorium.sources.keyed import KeyedStore
from scriptorium.sources.snapshots import Conflict


def answers(spark, lo, hi, at, negative=False):
    text = F.lit(incremental.NOT_FOUND) if negative else F.concat(F.lit("{} "), F.lit(at).cast("string"))
    return spark.range(lo, hi).select(F.concat(F.lit("p"), "id").alias("paper_id"), text.alias("response_json"), F.lit(at).cast("long").alias("fetched_at"))


def asked(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "paper_id string")


def got(df):
    return {r.paper_id: r.fetched_at for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path), buckets=16)
    s.put(answers(spark, 0, 400, 1))
    s.put(answers(spark, 100, 200, 2))
    s.put(answers(spark, 150, 160, 3, negative=True))
    return s


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return sum(int(n) for n in re.findall(r"numFiles -> SQLMetric\(.*?value: (\d+)", scan_metrics(plan)))


def scan_metrics(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scan_metrics(plan.executedPlan())
    if "QueryStage" in name:
        return scan_metrics(plan.plan())
    own = f"numFiles -> SQLMetric(value: {plan.metrics().apply('numFiles').value()}" if name == "FileSourceScanExec" else ""
    return own + "".join(scan_metrics(plan.children().apply(i)) for i in range(plan.children().size()))


def test_equals_the_probe_of_the_whole_cache(spark, store):
    ids = asked(spark, *[f"p{i}" for i in range(90, 460, 3)], None)
    whole = incremental.probe(ids, store.log.read("log").drop("bucket"))
    same = lambda df: sorted((str(r.paper_id), r.status, str(r.fetched_at), str(r.response_json)) for r in df.collect())
    assert same(store.probe(ids)) == same(whole) and {"hit", "miss", "negative"} == {r.status for r in whole.collect()}
    many = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("paper_id"))  # more than fit the filter
    assert got(store.get(many)) == got(incremental.latest(store.log.read("log").drop("bucket"), "paper_id", "fetched_at", "response_json"))


def test_reads_only_the_touched_buckets(spark, store):
    all_files = len(store.log.read("log").inputFiles())
    assert all_files >= 40 and files_read(store.get(asked(spark, "p7"))) <= 3
    assert files_read(store.get(asked(spark, "p7", "p8", "p155"))) <= 9


def test_empty_store(spark, tmp_path):
    empty = KeyedStore(spark, str(tmp_path))
    assert empty.get(asked(spark, "p1")).count() == 0 and [r.status for r in empty.probe(asked(spark, "p1")).collect()] == ["miss"]


def test_compaction_beside_an_append(spark, store, monkeypatch):
    before = got(store.get(asked(spark, "p5", "p120", "p155")))
    publish = store.log.publish

    def late(**what):  # another writer appends while the compaction runs
        monkeypatch.setattr(store.log, "publish", publish)
        store.put(answers(spark, 5, 6, 9))
        return publish(**what)

    monkeypatch.setattr(store.log, "publish", late)
    store.compact()
    assert len(store.log.version().folders["log"]) == 2 and store.log.read("log").count() == 401
    assert got(store.get(asked(spark, "p5", "p120", "p155"))) == before | {"p5": 9}
    store.compact()
    assert len(store.log.read("log").inputFiles()) <= 16 and store.log.read("log").count() == 400
    with pytest.raises(Conflict):
        store.log.publish(swap={"log": (store.log.read("log"), ["log/gone"])})
