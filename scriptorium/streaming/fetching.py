"""Fetch and parse as two streams, with retries as timers.

*Fetch.*  Requests arrive as files; each trigger takes a bounded number of them.
Every id has a state: how often it was asked, and what came of it.  An answer
that is worth another attempt sets a timer instead of blocking the task, so a
slow server holds up nothing else; the timer asks again in a later batch.  An id
that is settled is never asked again, whatever arrives.  Tasks share the rate
limit of the run by their number.

*Spool.*  A batch that fails after some requests would ask again.  So each task
puts an answer into the spool of its batch before it goes on, and a batch that
comes again takes it from there.  The spool of a batch goes when a later one has
been published, so it never holds more than a trigger's requests.

*Sink.*  Answers and attempts are published as snapshots tagged with the number
of the batch: a batch that comes again adds nothing, and no table is read to
know it.

*Parse.*  The folders of answers are the source of the second stream, which
starts as soon as the first has published something.

Defined results: an id asked for with several URLs is asked for with the first
that arrives; a null id or URL fails without a request; statuses are ``ok``,
``missing`` and ``failed``; what is due again is ``waiting`` among the attempts.
"""

from __future__ import annotations

import hashlib
import pickle
import time
from collections.abc import Callable, Iterator

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.http import Fetcher, Pace, Policy, attempt_one, wait_after
from ..sources.snapshots import Snapshots

ANSWER = "id string, status string, body binary, error string"
ATTEMPT = f"{ANSWER}, attempt int"
#: The store that keeps keys and timers on disk and checkpoints changes only.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Spool:
    """Answers of one batch that is not published yet, a file each."""

    def __init__(self, root: str, batch: str):
        self.files, base = arrow_fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        self.folder = f"{base}/{batch}"
        self.files.create_dir(self.folder)

    def _path(self, key: str, attempt: int) -> str:
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}-{attempt}"

    def get(self, key: str, attempt: int) -> tuple | None:
        path = self._path(key, attempt)
        if self.files.get_file_info(path).type == arrow_fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(path) as f:
            return pickle.loads(f.read())

    def put(self, key: str, attempt: int, answer: tuple) -> None:
        path = self._path(key, attempt)
        with self.files.open_output_stream(f"{path}.part") as f:
            f.write(pickle.dumps(answer))
        self.files.move(f"{path}.part", path)


class Fetching(StatefulProcessor):
    """State of one id: URL, attempts so far, and whether it is settled."""

    def __init__(self, build: Callable[[], Fetcher], policy: Policy, spool: str, lanes: int):
        self.build, self.policy, self.spool_root, self.lanes = build, policy, spool, lanes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fetch", "url string, attempts int, settled boolean")
        self.fetch = self.pace = self.spool = None

    def _ready(self) -> None:
        if self.fetch is None:
            task = TaskContext.get()
            self.fetch = self.build()
            self.pace = Pace(self.policy.spacing, task.partitionId(), self.lanes, task.attemptNumber() > 0)
            self.spool = Spool(self.spool_root, task.getLocalProperty("streaming.sql.batchId"))

    def _attempt(self, key: str, url: str, before: int, now_ms: int) -> Row:
        self._ready()
        number = before + 1
        if (answer := self.spool.get(key, number)) is None:
            self.pace()
            answer = attempt_one(url, self.fetch, self.policy)
            self.spool.put(key, number, answer)
        status, body, problem = answer
        if status == "waiting" and number >= self.policy.attempts:
            status = "failed"
        self.state.update((url, number, status != "waiting"))
        if status == "waiting":
            self.handle.registerTimer(now_ms + int(1000 * wait_after(number, self.policy)))
        return Row(id=key, status=status, body=body, error=problem, attempt=number)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        url = next((r.url for r in rows if r.url is not None), None)
        if self.state.exists():
            return
        if key[0] is None or url is None:
            self.state.update((url, 0, True))
            yield Row(id=key[0], status="failed", body=None, error="no request", attempt=0)
            return
        yield self._attempt(key[0], url, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        url, attempts, settled = self.state.get()
        if not settled:
            yield self._attempt(key[0], url, attempts, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        self.fetch = None


def start_fetching(spark: SparkSession, source: str, target: str, checkpoint: str, build: Callable[[], Fetcher], policy: Policy, files_per_batch: int = 8, lanes: int = 8, every: str = "1 second", before_publish: Callable[[int], None] = lambda batch: None) -> StreamingQuery:
    """Fetch the requests (``id, url`` as JSON lines) that arrive in ``source``.

    Publishes ``answers`` (settled ids) and ``attempts`` (all of them, without
    bodies) as snapshots in ``target``.  ``lanes`` is the number of tasks that
    ask at once; the checkpoint keeps the one of the first run.
    """
    spool = f"{target.rstrip('/')}/_spool"
    session = spark.newSession()  # the state store of this query is no other's
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", str(lanes))
    asked = session.readStream.schema("id string, url string").option("maxFilesPerTrigger", files_per_batch).json(source)
    made = asked.groupBy("id").transformWithState(Fetching(build, policy, spool, lanes), ATTEMPT, "Append", "ProcessingTime")

    def publish(rows: DataFrame, number: int) -> None:
        rows.persist()  # written twice; a lost part asks the spool again, not the server
        try:
            before_publish(number)
            settled = rows.where("status <> 'waiting'").select("id", "status", "body", "error")
            seen = rows.select("id", "status", "error", "attempt", F.lit(number).cast("long").alias("batch"))
            if rows.count():  # of all partitions, so that the state of each is made even if the batch is known
                Snapshots(spark, target).publish(append={"answers": settled, "attempts": seen}, batch=("fetch", number))
        finally:
            rows.unpersist()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spool}/{number - 1}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return made.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def idle(query: StreamingQuery) -> bool:
    """Two batches in a row had no new rows.  The first batch of a run may be one of an earlier
    run again; a later one without rows has seen all files, and what is left then are timers."""
    last = query.recentProgress[-2:]
    return len({p["batchId"] for p in last}) == 2 and not any(p["numInputRows"] for p in last)


def waiting(spark: SparkSession, target: str) -> int:
    """Ids whose last attempt is to be repeated."""
    known = Snapshots(spark, target)
    if not known.numbers():
        return 0
    last = known.read("attempts").groupBy("id").agg(F.max_by("status", "attempt").alias("status"))
    return last.where("status = 'waiting'").count()


def run_fetching(spark: SparkSession, source: str, target: str, checkpoint: str, build: Callable[[], Fetcher], policy: Policy, timeout: float = 3600.0, poll: float = 0.5, **options) -> None:
    """Fetch until every request there is settled, then stop."""
    query = start_fetching(spark, source, target, checkpoint, build, policy, **options)
    ends = time.monotonic() + timeout
    try:
        while time.monotonic() < ends:
            if query.exception():
                raise query.exception()
            if idle(query) and not waiting(spark, target):
                return
            time.sleep(poll)
        raise TimeoutError(f"requests are still open after {timeout} seconds")
    finally:
        query.stop()


def start_parsing(spark: SparkSession, target: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], table: str = "parsed", once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Parse answers while others are fetched: what has been published is the source.

    The pointers of the snapshots arrive as a stream.  A batch reads the folders
    of answers that the last parsed version did not have, and publishes their
    rows tagged with the version it has read, so each answer is parsed once.
    Compact or vacuum the answers only when they have all been parsed.
    """
    pointers = spark.readStream.schema("value string").option("pathGlobFilter", "*.json").option("wholetext", "true").text(f"{target.rstrip('/')}/_log")

    def publish(_: DataFrame, batch: int) -> None:
        known = Snapshots(spark, target)
        now = known.version()
        last = now.batches.get(table, -1)
        old = set(known.version(last).folders.get("answers", [])) if last >= 0 else set()
        new = [f for f in now.folders.get("answers", []) if f not in old]
        if new:
            rows = spark.read.schema(ANSWER).parquet(*[f"{known.root}/{f}" for f in new]).where("status = 'ok'")
            known.publish(append={table: parse(rows)}, batch=(table, now.number))

    stream = pointers.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=every)).start()
