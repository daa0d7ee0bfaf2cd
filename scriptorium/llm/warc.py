"""WARC archives and a two-level capture index.

*Archives.*  Each page becomes one gzip member with one WARC record; members
stand one after the other in the files of Spark's text writer, whose line
separator is an empty gzip member, so that every file is a readable
``.warc.gz`` in any store Spark can write and a lost task is simply redone.
Of pages with equal payloads the one with the smallest id is a ``response``,
the others are ``revisit`` records that refer to it and carry no payload.

*Index.*  Captures are sorted by reversed-host key (``org,example,blog)/path``)
and packed into compressed blocks; a sparse directory has the first key,
record, file, offset and length of every block.  A look-up searches the
directory by bisection, reads the range of one block, and then the ranges of the
records; many look-ups are sorted first, so that each block is read once.

*Skew.*  Copies are found by aggregation, with partial sums in each task, and
joined back under a salt: a payload, host or url with a third of all pages is
spread over all tasks.  Range sorting uses the whole key with the id, so that
a hot host is cut into many ranges.

Range reads use ``pyarrow.fs``: the shared folder must be one it can open
(local or network mounts, HDFS, S3, GCS, ABFS).

Defined results: null html is an empty payload; a null url has an empty key; a
null id comes last, so such a page is a response only if all its copies have
null ids, and its ``refers_to`` is then null; repeated rows with the id of the
response are responses too; ids may be empty or hold any character; extra
columns are ignored, whatever their names; very long pages are one record each,
up to 2 GB, and files are read in steps, so that only one record of a task is in
memory; an empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import MAP_BITS, bitmap, has_bits, materialize, scratch_path

# Fixed value: an empty gzip member (header, empty deflate block, crc, size).
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
SALTS = 32
DATE = "2000-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key: lower-case host parts from the top, then path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    """A record id that any page id, also an empty one or one with line breaks, comes back from."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC 1.1 record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127)))}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: {urn(refers_to)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


_URN = re.compile(r"<urn:page:(.*)>")


def parse_record(data: bytes) -> dict:
    """Headers and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length: (\d+)", http)
    revisit = fields["WARC-Type"] == "revisit"
    ids = {k: (unquote(m[1]) if (m := _URN.match(fields.get(k, ""))) else None) for k in ("WARC-Record-ID", "WARC-Refers-To")}
    return {
        "page_id": ids["WARC-Record-ID"],
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": int(told[1]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload),
        "refers_to": ids["WARC-Refers-To"],
    }


def members(file, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that is not empty, of an
    open file that is read in steps: no more than one member is in memory."""
    at, view, pos = 0, memoryview(file.read(step)), 0
    while pos < len(view):
        reader, parts, used = zlib.decompressobj(31), [], 0
        while not reader.eof:
            if pos == len(view):
                view, pos = memoryview(file.read(step)), 0
                if not len(view):
                    raise EOFError("a gzip member is cut off")
            given = view[pos : pos + 4096]
            parts.append(reader.decompress(given))
            taken = len(given) - len(reader.unused_data)
            used, pos = used + taken, pos + taken
        if content := b"".join(parts):
            yield at, used, content
        at += used
        if pos == len(view):
            view, pos = memoryview(file.read(step)), 0


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, sha1, first_id, revisit`` for every page.

    A bitmap of the payloads that occur more than once parts the pages first:
    those that surely have no copy are not shuffled.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    page = page.withColumn("sha1", F.unhex(F.sha1("payload")))
    copies = page.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialize(copies, "copies")
    bits = page.sparkSession.sparkContext.broadcast(bitmap(copies, F.xxhash64("sha1")))
    page = page.withColumn("at", F.pmod(F.xxhash64("sha1"), F.lit(MAP_BITS)))

    def part(copied: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(has_bits(bits.value, batch["at"].to_numpy()) == copied))

        return page.mapInArrow(run, page.schema).drop("at")

    salted = copies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    again = part(True).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["sha1", "salt"], "left").drop("salt")
    out = part(False).withColumn("first_id", F.lit(None).cast(page.schema["page_id"].dataType)).unionByName(again)
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return out.select("page_id", "url", "payload", "sha1", "first_id", revisit.alias("revisit"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [
            record(i, u, p, base64.b32encode(d).decode(), f if r else None, r)
            for i, u, p, d, f, r in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha1", "first_id", "revisit")], strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])


def _write_members(rows: DataFrame, path: str, per_file: int) -> None:
    """Write the binary column ``value``, one gzip member for each row."""
    writer = rows.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("ISO-8859-1"))
    writer.option("maxRecordsPerFile", per_file).text(path)


def write_archives(pages: DataFrame, path: str, records_per_file: int = 5000, **options) -> None:
    _write_members(classify(pages, **options).mapInArrow(_records, "value binary"), path, records_per_file)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files; their contents are read in steps by the tasks."""
    return spark.read.format("binaryFile").load(path).select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def _capture_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    for path in (p for batch in batches for p in batch["path"].to_pylist()):
        rows: list[tuple] = []
        with open_range_reader(path) as file:
            for offset, length, data in members(file):
                head, _, _ = data.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                rows.append((surt(fields.get("WARC-Target-URI")), fields["WARC-Record-ID"], path, offset, length))
                if len(rows) == 10_000:
                    yield _batch(rows, types, ENTRIES)
                    rows = []
        yield _batch(rows, types, ENTRIES)


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


ENTRIES = ["key", "record", "path", "offset", "length"]
ENTRY = "key string, record string, path string, offset long, length long"


def _pack_blocks(per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def block() -> pa.RecordBatch:
            data = gzip.compress("\n".join(held).encode(), 6, mtime=0)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("key", "record", "path", "offset", "length")], strict=True):
                held.append(json.dumps(row))
                if len(held) == per_block:
                    yield block()
        if held:
            yield block()

    return run


DIRECTORY = "first_key string, first_record string, path string, offset long, length long"


def _block_directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    for path in (p for batch in batches for p in batch["path"].to_pylist()):
        with open_range_reader(path) as file:
            rows = [(*json.loads(data.split(b"\n", 1)[0])[:2], path, offset, length) for offset, length, data in members(file)]
        yield _batch(rows, types, ["first_key", "first_record", "path", "offset", "length"])


def build_index(spark: SparkSession, archives: str, path: str, per_block: int = 1000, blocks_per_file: int = 2000) -> None:
    """Write ``blocks`` and ``directory`` of the archives below ``path``."""
    entries = materialize(_files(spark, archives).mapInArrow(_capture_entries, ENTRY), "captures")  # range sorting reads them twice
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(parts, "key", "record").sortWithinPartitions("key", "record")
    _write_members(ordered.mapInArrow(_pack_blocks(per_block), "value binary"), f"{path}/blocks", blocks_per_file)
    directory = _files(spark, f"{path}/blocks").mapInArrow(_block_directory, DIRECTORY)
    directory.write.parquet(f"{path}/directory")


def open_range_reader(path: str):
    """A file of the shared folder, opened for range reads."""
    fs, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(name)


def read_ranges(ranges: Iterable[tuple[str, int, int]]) -> Iterator[bytes]:
    """The members at (path, offset, length), unpacked; a file stays open while
    the ranges that follow are in it too."""
    name, file = None, None
    for path, offset, length in ranges:
        if path != name:
            if file is not None:
                file.close()
            name, file = path, open_range_reader(path)
        yield zlib.decompress(file.read_at(length, offset), 31)
    if file is not None:
        file.close()


class CaptureIndex:
    """Look-ups of single urls through the two levels.

    A directory of up to ``max_blocks`` rows is held in memory and bisected; a
    larger one is asked with Spark for the few blocks that may hold the key.
    """

    def __init__(self, spark: SparkSession, path: str, max_blocks: int = 2_000_000):
        self.directory = spark.read.parquet(f"{path}/directory")
        self.rows = _sorted_blocks(self.directory) if self.directory.count() <= max_blocks else None
        self.keys = [r[0] for r in self.rows or ()]
        self.blocks_read = 0

    def _blocks(self, key: str) -> list[tuple]:
        if self.rows is not None:
            at = max(0, bisect.bisect_left(self.keys, key) - 1)
            return self.rows[at : bisect.bisect_right(self.keys, key)]
        last = self.directory.where(F.col("first_key") < key).agg(F.max(F.struct("first_key", "first_record")).alias("m")).first()["m"]
        wanted = F.col("first_key") == key
        if last is not None:
            wanted |= (F.col("first_key") == last[0]) & F.col("first_record").eqNullSafe(last[1])
        return _sorted_blocks(self.directory.where(wanted))

    def lookup(self, url: str) -> list[dict]:
        """All captures of the url, as :func:`parse_record` returns them."""
        key, found = surt(url), []
        for block in self._blocks(key):
            self.blocks_read += 1
            for line in next(read_ranges([block[2:]])).decode().split("\n"):
                entry = json.loads(line)
                if entry[0] == key:
                    found.append(tuple(entry[2:]))
        return [parse_record(data) for data in read_ranges(sorted(found))]


def _sorted_blocks(directory: DataFrame) -> list[tuple]:
    return sorted(tuple(r) for r in directory.select("first_key", "first_record", "path", "offset", "length").collect())


def lookup_many(spark: SparkSession, path: str, wanted: DataFrame, max_blocks: int = 500_000) -> DataFrame:
    """Index entries of the captures ``key, record`` that are asked for.

    The wanted captures are sorted; each task finds the blocks of its run of
    them by bisection of the directory and reads each block once.  The directory
    is broadcast in segments of at most ``max_blocks`` blocks, of which each
    serves the captures between its first and the first of the next.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    directory = spark.read.parquet(f"{path}/directory")
    fences = _fences(directory, max_blocks)
    at = F.struct("key", "record")
    asked = materialize(wanted.select("key", "record").distinct(), "wanted")
    asked = asked.repartitionByRange(parts, "key", "record").sortWithinPartitions("key", "record")
    out = None
    for low, high in zip(fences, [*fences[1:], None], strict=False):
        block = F.struct(F.col("first_key").alias("key"), F.col("first_record").alias("record"))
        edge = lambda f: F.struct(F.lit(f[0]).alias("key"), F.lit(f[1]).alias("record"))
        segment = directory.where(block < edge(high)) if high else directory
        mine = asked.where(at < edge(high)) if high else asked
        before = []
        if low != fences[0]:  # the captures of the first id may begin in the block before
            last = directory.where(block < edge(low)).agg(F.max(F.struct("first_key", "first_record", "path", "offset", "length")).alias("m")).first()["m"]
            before = [tuple(last)]
            segment, mine = segment.where(block >= edge(low)), mine.where(at >= edge(low))
        sent = spark.sparkContext.broadcast(before + _sorted_blocks(segment))
        found = mine.mapInArrow(_bisect_blocks(sent), ENTRY)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], ENTRY)


def _fences(directory: DataFrame, max_blocks: int) -> list[tuple[str, str]]:
    """First captures of the segments of the directory."""
    total = directory.count()
    if not total:
        return []
    if total <= max_blocks:
        return [tuple(directory.agg(F.min(F.struct("first_key", "first_record")).alias("m")).first()["m"])]
    segments = -(-total // (max_blocks // 2))
    rows = directory.select("first_key", "first_record").repartitionByRange(segments, "first_key", "first_record")
    return sorted({tuple(r["m"]) for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("first_key", "first_record")).alias("m")).collect()})


def _bisect_blocks(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        blocks = sent.value
        firsts = [b[:2] for b in blocks]
        held: dict[int, dict[tuple, list]] = {}

        def entries_of(at: int) -> dict[tuple, list]:
            if at not in held:
                for old in [k for k in held if k < at - 1]:
                    del held[old]  # the captures ascend
                mine: dict[tuple, list] = {}
                for line in next(read_ranges([blocks[at][2:]])).decode().split("\n"):
                    entry = json.loads(line)
                    mine.setdefault((entry[0], entry[1]), []).append(tuple(entry))
                held[at] = mine
            return held[at]

        for batch in batches:
            rows: list[tuple] = []
            for wanted in zip(batch["key"].to_pylist(), batch["record"].to_pylist(), strict=True):
                # A capture may stand in the block before the first that begins with it, and in all that do.
                for at in range(max(0, bisect.bisect_left(firsts, wanted) - 1), bisect.bisect_right(firsts, wanted)):
                    rows += entries_of(at).get(wanted, ())
                    if len(rows) >= 10_000:
                        yield _batch(rows, types, ENTRIES)
                        rows = []
            yield _batch(rows, types, ENTRIES)

    return run


def _block_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = list(zip(*[batch[c].to_pylist() for c in ("path", "offset", "length")], strict=True))
        for data in read_ranges(ranges):
            rows = [json.loads(x) for x in data.decode().split("\n")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "record", "path", "offset", "length"])


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        ranges = list(zip(*[batch[c].to_pylist() for c in ("path", "offset", "length")], strict=True))
        rows = [[r[n] for n in names] for r in map(parse_record, read_ranges(ranges))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_captures(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Every capture whose key begins with ``prefix``, read through the index.

    Blocks that cannot hold such a key are skipped by the directory.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    directory = spark.read.parquet(f"{path}/directory")
    if prefix:
        last = directory.where(F.col("first_key") <= prefix).agg(F.max("first_key")).first()[0]
        directory = directory.where((F.col("first_key") < prefix + "\U0010ffff") & (F.col("first_key") >= (last or "")))
    entries = directory.repartition(parts, "path", "offset").mapInArrow(_block_entries, ENTRY)
    return read_entries(entries.where(F.col("key").startswith(prefix)) if prefix else entries)


def read_entries(entries: DataFrame) -> DataFrame:
    """The records of index entries; their ranges are sorted by file and offset before they are read."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(entries.select("path", "offset", "length"), "ranges")  # range sorting reads them twice
    return ranges.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(_read_records, READ)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls = [quote(u, safe="".join(chr(c) for c in range(33, 127))) if u is not None else None for u in batch["url"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in urls], pa.string()), pa.array([urn(i) for i in batch["id"].to_pylist()], pa.string())], ["key", "record"])


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """Write the pages into archives, index these, and look every page up again."""
    spark = pages.sparkSession
    base = scratch_path(spark, "warc")
    write_archives(pages, f"{base}/archives", id_col=id_col, url_col=url_col, **options)
    build_index(spark, f"{base}/archives", f"{base}/index")
    wanted = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(_wanted, "key string, record string")
    found = read_entries(lookup_many(spark, f"{base}/index", wanted))
    kind = pages.schema[id_col].dataType
    return found.select(F.col("page_id").cast(kind).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
