"""``spark.read.format("json_archive")``: members of ``.tar.gz`` files as rows.

Each archive is a partition.  A task opens it where it lies and streams through
it once: nothing is unpacked, no member but the one at hand is in memory, and of
a member of JSON lines only the line at hand.

Options: ``path`` (a file, a folder, or a pattern for the last part of the
path), ``suffixes`` (comma-separated endings of the members to take; default
``.json,.jsonl``), ``mode`` (``FAILFAST``, the default, or ``PERMISSIVE``).

Rows: ``archive`` and ``member`` (their names), ``line`` (from 0, without blank
lines; 0 for a whole JSON member), ``value`` (the JSON text), ``problem``.

Defined results: an archive without members, or without one of these endings,
gives no rows, and so does an empty member of JSON lines; folders and links are
skipped; a damaged archive fails the query, or, if permissive, gives what comes
before the damage and one row with ``problem`` and no value; text that is not
UTF-8 is damage too.
"""

from __future__ import annotations

import fnmatch
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "json_archive"
SCHEMA = "archive string, member string, line int, value string, problem string"
SUFFIXES = ".json,.jsonl"
DAMAGE = (tarfile.TarError, EOFError, OSError, UnicodeDecodeError, zlib.error)


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return arrow_fs.LocalFileSystem(), path


def listed(path: str) -> list[str]:
    """The archives that a path names, as URIs or paths that a task can open."""
    files, inner = file_system(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    folder, _, last = inner.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    if pattern is None:
        info = files.get_file_info(inner)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.is_file:
            return [path]
        folder, pattern = inner, "*"
    found = files.get_file_info(arrow_fs.FileSelector(folder))
    return sorted(f"{prefix}{f.path}" for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern) and f.base_name.endswith((".tar.gz", ".tgz")))


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("option path is missing")
        self.path = options["path"]
        self.suffixes = tuple(s.strip() for s in options.get("suffixes", SUFFIXES).split(","))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in listed(self.path)]

    def read(self, partition: Archive | None) -> Iterator[tuple]:
        if partition is None:  # no archive at all
            return
        name = partition.path.rpartition("/")[2]
        at = [None]
        try:
            for member, line, value in members(partition.path, self.suffixes, at):
                yield name, member, line, value, None
        except DAMAGE as e:
            if not self.permissive:
                raise ValueError(f"{partition.path}, {at[0] or 'its start'}: {e}") from e
            yield name, at[0], None, None, f"{type(e).__name__}: {e}"


def members(path: str, suffixes: tuple[str, ...], at: list) -> Iterator[tuple[str, int, str]]:
    """``member, line, value`` of one archive; ``at`` is told the member at hand."""
    files, inner = file_system(path)
    with files.open_input_stream(inner, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz", bufsize=1 << 16) as tar:
        for member in tar:
            if not member.isfile() or not member.name.endswith(suffixes):
                continue
            at[0] = member.name
            body = tar.extractfile(member)
            if member.name.endswith(".jsonl"):
                kept = (x for x in lines(body) if x.strip())
                yield from ((member.name, i, line.decode().strip()) for i, line in enumerate(kept))
            else:
                yield member.name, 0, body.read().decode()


def lines(body: IO[bytes]) -> Iterator[bytes]:
    """Lines of a member that can only be read forward."""
    rest: list[bytes] = []
    while part := body.read(1 << 16):
        *whole, last = part.split(b"\n")
        for line in whole:
            yield b"".join([*rest, line])
            rest = []
        rest.append(last)
    yield b"".join(rest)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, suffixes: str = SUFFIXES, permissive: bool = False) -> DataFrame:
    """The rows of all archives that ``path`` names."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(NAME).option("suffixes", suffixes).option("mode", "PERMISSIVE" if permissive else "FAILFAST").load(path)


def json_values(rows: DataFrame, schema: str) -> DataFrame:
    """``archive, member, line, value`` parsed with a given schema; null where a value does not fit."""
    return rows.select("archive", "member", "line", F.from_json("value", schema).alias("value"))


def keyed_papers(rows: DataFrame, schema: str) -> DataFrame:
    """``archive, member, id, entry`` of members that are one object keyed by id."""
    return json_values(rows, f"map<string,{schema}>").select("archive", "member", F.explode("value").alias("id", "entry"))
