"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The symbols are words, not letters.  A pattern is a window of ``window``
consecutive words of a benchmark item; an item of fewer words is one pattern.
Patterns of one length share a shift table over blocks of two words: the
distance by which the search may jump without passing an occurrence.  Where
the shift is zero, the last block selects a bucket of patterns, and these are
compared word by word.  Each document word inside an occurrence is hit.

The search is one pass over the documents without a shuffle.  A compiled shard
is arrays of numbers, five to six times ``shard_bytes`` of benchmark text; only
one is broadcast and held at a time: a larger benchmark is searched shard after
shard, and the spans found so far are written between them.

Defined results: null and empty texts have no words and are clean; null or
empty items have no pattern; a null item id counts as an empty string;
repeated items with one id count once; extra columns pass through (the three
result columns replace columns of the same name); an empty benchmark leaves
every document clean; texts of any length are searched whole, in memory of
about 60 times their bytes for the words of one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

#: Bytes of words ([^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z): every other byte becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(WORD_BYTES).split() if text else []


#: Odd multipliers of the block and suffix hashes.
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Words of the suffix that selects a bucket.
SUFFIX = 4


def _hash(words: Sequence, mask: int):
    """The low bits of a weighted sum: of numbers, or of arrays of them."""
    total = 0
    for k, w in enumerate(words):
        total = total + w * _MIX[k]
    return (total ^ (total >> 15)) & mask


class Searcher:
    """Shift tables and buckets for windows of words, by window length.

    Words are numbered and the items are one array of numbers; a pattern is a
    place in it.  The shift table and the buckets of a length are arrays, whose
    size is that of the number of patterns.  Blocks that fall on one entry of a
    shift table take the smaller shift, which is safe.
    """

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int = 10, compiled: tuple | None = None):
        if compiled is None:
            compiled = self._compile(items, window)
        vocabulary, self.names, self.item_starts, stream, self.groups = compiled
        self.compiled = compiled
        self.number = {w: i for i, w in enumerate(vocabulary.split(b" "), 1)} if vocabulary else {}
        self.stream = stream.tobytes()

    @staticmethod
    def _compile(items: Iterable[tuple[str, bytes | None]], window: int) -> tuple:
        number: dict[bytes, int] = {}
        names: list[str] = []
        parts: list[np.ndarray] = []
        for name, text in items:
            if words := words_of(text):
                names.append(name)
                parts.append(np.array([number.setdefault(w, len(number) + 1) for w in words], np.int32))
        lengths = np.array([len(x) for x in parts], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        groups = []
        for m in np.unique(np.minimum(lengths, window)).tolist():
            mine = np.flatnonzero(lengths == m if m < window else lengths >= window)
            count = lengths[mine] - m + 1
            places = np.arange(int(count.sum())) + np.repeat(starts[mine] - (np.cumsum(count) - count), count)
            groups.append(Searcher._group(stream, places, m))
        return b" ".join(number), names, starts, stream, groups

    @staticmethod
    def _group(stream: np.ndarray, places: np.ndarray, m: int) -> tuple:
        block, suffix = min(2, m), min(SUFFIX, m)
        mask = (1 << max(10, int(2 * len(places)).bit_length())) - 1
        wide = stream.astype(np.int64)
        shift = np.full(mask + 1, m - block + 1, np.uint8)
        for end in range(block, m + 1):  # later ends have smaller shifts, which overwrite
            shift[_hash([wide[places + end - block + k] for k in range(block)], mask)] = m - end
        bucket = _hash([wide[places + m - suffix + k] for k in range(suffix)], mask)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(mask + 2)).astype(np.int32)
        return m, block, suffix, mask, shift.tobytes(), starts, places[order].astype(np.int32)

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (start, end) of all occurrences, and the items that occur."""
        get = self.number.get
        ids = [get(w, 0) for w in words]
        text = np.array(ids, np.int32).tobytes()
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        n, stream = len(ids), self.stream
        for m, block, suffix, mask, shift, starts, places in self.groups:
            end = m
            one, two = _MIX[:2]
            while end <= n:
                last = ids[end - 1]
                if not last:  # in no item: no window holds this place
                    end += m
                    continue
                if block == 1:
                    code = last * one
                elif before := ids[end - 2]:
                    code = before * one + last * two
                else:
                    end += m - 1
                    continue
                if step := shift[(code ^ (code >> 15)) & mask]:
                    end += step
                    continue
                at = _hash(ids[end - suffix : end], mask)
                here = text[4 * (end - m) : 4 * end]
                hits = [p for p in places[starts[at] : starts[at + 1]].tolist() if stream[4 * p : 4 * (p + m)] == here]
                if hits:
                    spans.append((end - m, end))
                    found.update(hits)
                end += 1
        at = np.searchsorted(self.item_starts, np.fromiter(found, np.int64, len(found)), "right") - 1
        return merged(spans), {self.names[i] for i in at.tolist()}


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("hit_items", T.ArrayType(T.StringType()))])
_ARROW = {"n_words": pa.int64(), "hit_spans": pa.list_(pa.list_(pa.int32())), "hit_items": pa.list_(pa.string())}


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, shard_bytes: int = 32 << 20) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` (start and end word) and ``hit_items``.

    ``keep`` names the columns to carry along; all by default.  With several
    shards the text is carried until the last one has searched it.
    """
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("binary").alias("body")).where("body is not null")
    total = items.agg(F.coalesce(F.sum(F.length("body") + F.length("name")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    out = docs.select(*dict.fromkeys([*keep, text_col]))
    if shards > 1:
        items = materialize(items.withColumn("shard", F.pmod(F.xxhash64("name", "body"), F.lit(shards))).repartition("shard"), "benchmark")
    for k in range(shards):
        part = items.where(F.col("shard") == k) if shards > 1 else items
        searcher = docs.sparkSession.sparkContext.broadcast(Searcher(((r["name"], bytes(r["body"])) for r in part.toLocalIterator()), window).compiled)
        first, last = k == 0, k == shards - 1
        schema = T.StructType([f for f in out.schema if f.name not in RESULT.names and (not last or f.name in keep)] + RESULT.fields)
        out = out.mapInArrow(_search(searcher, text_col, [f.name for f in schema if f.name not in RESULT.names], first), schema)
        if not last:
            out = materialize(out, "searched")
            searcher.destroy()
    return out


def _search(searcher, text_col: str, carry: list[str], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Searcher((), compiled=searcher.value).spans
        for batch in batches:
            counts, spans, names = [], [], []
            before = [([], [])] * len(batch) if first else zip(batch["hit_spans"].to_pylist(), batch["hit_items"].to_pylist(), strict=True)
            for text, (old_spans, old_names) in zip(batch[text_col].cast(pa.binary()), before, strict=True):
                words = words_of(text.as_py())
                new_spans, new_names = find(words)
                counts.append(len(words))
                spans.append(merged([*map(tuple, old_spans), *new_spans]))
                names.append(sorted({*old_names, *new_names}))
            made = [pa.array(v, _ARROW[c]) for c, v in (("n_words", counts), ("hit_spans", spans), ("hit_items", names))]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in carry], *made], [*carry, *RESULT.names])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, **options) -> DataFrame:
    """The decision on each document: columns as in :func:`find_windows`, plus
    ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    out = find_windows(docs, items, window, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = out.withColumn("n_hit", hit).withColumn("n_items", F.size("hit_items").cast("long"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("hit_items", ","), 256)).withColumn("contaminated", F.col("n_hit") > 0)
