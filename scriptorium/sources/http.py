"""Fetching over HTTP from executor tasks, with throttle and backoff.

A fetcher is any callable ``(url) -> (status, body)`` that raises ``OSError``
on network failure; tests pass scripted ones.

A rate limit holds for the whole run.  Requests are dealt to a fixed number of
lanes, one task each, and each lane has its share of the limit: with spacing s
and n lanes a lane asks every ``n * s`` seconds, beginning at a time of its own.
However many lanes run at once, no more than one request in s seconds leaves
on average, and at most n at once.  A task that is done again waits its share
before it asks.  Repeated attempts count as requests.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib import error, request

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import NOT_FOUND

Fetcher = Callable[[str], tuple[int, bytes]]


@dataclass(frozen=True)
class Policy:
    """Spacing and retries; waits double from ``wait`` up to ``most``."""

    spacing: float = 0.1
    attempts: int = 6
    wait: float = 2.0
    most: float = 60.0
    magic: bytes = b""


#: Metadata look-ups, downloads of PDFs, and downloads that are tried once.
METADATA = Policy()
PDF = Policy(spacing=3.0, attempts=3, wait=5.0, most=600.0, magic=b"%PDF")
PDF_ONCE = Policy(spacing=3.0, attempts=1, magic=b"%PDF")

# The public metadata and conversion services.
METADATA_URL = "https://api.semanticscholar.org/graph/v1/paper/ARXIV:"
METADATA_FIELDS = ("paperId", "title", "externalIds", "references.paperId", "references.title", "references.externalIds")
METADATA_KEY_VARIABLE, METADATA_KEY_HEADER = "SEMANTIC_SCHOLAR_API_KEY", "x-api-key"
PDF_URL = "https://arxiv.org/pdf/"
CONVERTER_URL, CONVERTER_PATH, CONVERTER_FIELD = "http://localhost:8070", "/api/processFulltextDocument", "input"


def metadata_url(arxiv_id: Column, fields: Sequence[str] = METADATA_FIELDS) -> Column:
    """Where the metadata record of a paper is, with the fields to return."""
    return F.concat(F.lit(METADATA_URL), F.url_encode(arxiv_id), F.lit(f"?fields={','.join(fields)}"))


def pdf_url(arxiv_id: Column) -> Column:
    return F.concat(F.lit(PDF_URL), arxiv_id)


def metadata_fetcher(api_key: str | None = None) -> Fetcher:
    """Sends the key that is given, else that of the environment, else none."""
    key = api_key if api_key is not None else os.environ.get(METADATA_KEY_VARIABLE)
    return url_fetcher(30.0, {METADATA_KEY_HEADER: key} if key else None)


def url_fetcher(timeout: float = 30.0, headers: dict[str, str] | None = None) -> Fetcher:
    def fetch(url: str) -> tuple[int, bytes]:
        try:
            with request.urlopen(request.Request(url, headers=headers or {}), timeout=timeout) as r:
                return r.status, r.read()
        except error.HTTPError as e:
            return e.code, e.read()

    return fetch


class Pace:
    """The share of a run-wide rate limit that one of ``lanes`` lanes has."""

    def __init__(self, spacing: float, lane: int = 0, lanes: int = 1, again: bool = False, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.share, self.clock, self.sleep = spacing * max(1, lanes), clock, sleep
        # Lanes begin one after the other; what an earlier attempt of the task has just asked for counts.
        self.next = clock() + spacing * (lane % max(1, lanes)) + (self.share if again else 0.0)

    def __call__(self) -> None:
        """Wait until the lane may ask."""
        now = self.clock()
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.share


def attempt_one(url: str, fetch: Fetcher, policy: Policy) -> tuple[str, bytes | None, str | None]:
    """``(status, body, error)`` of one attempt: ``ok``, ``missing`` (404),
    ``failed`` for good, or ``waiting`` where it is worth another attempt (too
    many requests, network failures)."""
    try:
        code, body = fetch(url)
    except OSError as e:
        return "waiting", None, str(e)
    if code == 429:
        return "waiting", None, "too many requests"
    if code == 404:
        return "missing", None, None
    if code >= 400:
        return "failed", None, f"status {code}"
    if policy.magic and not body.startswith(policy.magic):
        return "failed", None, "not the expected format"
    return "ok", body, None


def wait_after(attempts: int, policy: Policy) -> float:
    """Seconds to wait after so many attempts."""
    return min(policy.most, policy.wait * 2 ** (attempts - 1))


def fetch_one(url: str, fetch: Fetcher, policy: Policy, sleep: Callable[[float], None] = time.sleep, pace: Callable[[], None] = lambda: None) -> tuple[str, bytes | None, str | None]:
    """``(status, body, error)``: ``ok``, ``missing`` (404) or ``failed``."""
    problem = "no attempt"
    for attempt in range(policy.attempts):
        if attempt:
            sleep(wait_after(attempt, policy))
        pace()
        status, body, problem = attempt_one(url, fetch, policy)
        if status != "waiting":
            return status, body, problem
    return "failed", None, problem


def fetched(requests: DataFrame, build: Callable[[], Fetcher], policy: Policy = METADATA, id_col: str = "id", url_col: str = "url", lanes: int = 8) -> DataFrame:
    """``id, status, body, error`` for rows ``id, url``, no faster together than the policy allows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        pace = Pace(policy.spacing, task.partitionId(), lanes, task.attemptNumber() > 0)
        fetch = build()
        for batch in batches:
            rows = [(key, *fetch_one(url, fetch, policy, pace=pace)) for key, url in zip(batch["id"], batch["url"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "status", "body", "error"])

    kind = requests.schema[id_col].dataType.simpleString()
    # A stated number of partitions is kept by adaptive execution.
    dealt = requests.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).repartition(lanes)
    return dealt.mapInPandas(run, f"id {kind}, status string, body binary, error string")


Poster = Callable[[str, bytes], tuple[int, bytes]]


def multipart(field: str, name: str, content: bytes, kind: str) -> tuple[bytes, str]:
    """A form with one file, and its content type."""
    mark = uuid.uuid4().hex
    while mark.encode() in content:
        mark = uuid.uuid4().hex
    file = name.replace("\\", "_").replace('"', "_").replace("\r", "_").replace("\n", "_")
    head = f'--{mark}\r\nContent-Disposition: form-data; name="{field}"; filename="{file}"\r\nContent-Type: {kind}\r\n\r\n'
    return head.encode() + content + f"\r\n--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


def converter(url: str = CONVERTER_URL, timeout: float = 120.0) -> Poster:
    """Posts a PDF as a form and returns ``(status, TEI)``."""

    def post(name: str, content: bytes) -> tuple[int, bytes]:
        body, kind = multipart(CONVERTER_FIELD, name, content, "application/pdf")
        try:
            with request.urlopen(request.Request(f"{url.rstrip('/')}{CONVERTER_PATH}", body, {"Content-Type": kind}), timeout=timeout) as r:
                return r.status, r.read()
        except error.HTTPError as e:
            return e.code, e.read()

    return post


def converted(pdfs: DataFrame, build: Callable[[], Poster] = converter, id_col: str = "arxiv_id", content_col: str = "content") -> DataFrame:
    """``arxiv_id, tei, error`` for PDFs; an answer of 400 or more is an error
    with its first 200 characters, and so is a failure of the network."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        post = build()
        for batch in batches:
            rows = []
            for key, content in zip(batch["id"], batch["content"], strict=True):
                try:
                    code, body = post(f"{key}.pdf", bytes(content or b""))
                    text = body.decode("utf-8", "replace")
                    rows.append((key, text, None) if code < 400 else (key, None, f"status {code}: {text[:200]}"))
                except OSError as e:
                    rows.append((key, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["arxiv_id", "tei", "error"])

    kind = pdfs.schema[id_col].dataType.simpleString()
    return pdfs.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).mapInPandas(run, f"arxiv_id {kind}, tei string, error string")


def cache_rows(answers: DataFrame, fetched_at: int) -> DataFrame:
    """Cache entries for answers; papers that do not exist are cached as such."""
    body = F.when(F.col("status") == "missing", NOT_FOUND).otherwise(F.col("body").cast("string"))
    return answers.where("status in ('ok', 'missing')").select(F.col("id").alias("paper_id"), body.alias("response_json"), F.lit(fetched_at).cast("long").alias("fetched_at"))
