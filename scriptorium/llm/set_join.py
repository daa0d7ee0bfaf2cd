"""Exact similarity join of shingle sets: Jaccard of 75 % or more.

Steps, each distributed:

1. *Sieve.*  Under one order of all shingles (their hashes), two similar sets
   share at least ``tenth(n) + 1`` of the first ``prefix(n) + tenth(n)``
   shingles of either.  These are dealt out by hash range, packed; a set
   whose shingles are seen in too few other sets can have no partner and goes.
   Equal sets are one set from here on.
2. *Rarity.*  The sets that stay are read again.  All their shingles are
   counted in a counting sketch of fixed size; shingles in crowded counters
   come last in the order, so that a passage that many sets hold is in the
   prefix of a set only if the set holds little else.
3. *Index lists.*  Each prefix shingle has a list of sets, kept in blocks by
   position.  A block whose best position and largest set cannot reach the
   overlap needed is skipped as a whole, and then its entries one by one.
4. *Answers from answers.*  A list is asked for its first set (the pivot)
   only, and the answers are verified on the whole sets.  What a set can learn
   from a similar set that was answered before is not asked again: only sets
   that the pivots leave unsettled meet the others of their list.

Any total order gives right results in 1 and 2, so the sketch only affects
speed.  Sets are compared by 64-bit hashes of their shingles.

Defined results: null and empty texts have the empty set, which is in no list;
equal sets are one set with several members; of equal first places the smaller
id counts, null ids last; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import MAP_BITS, bitmap, has_bits, materialize
from .shingles import chunks, shingle_sets

#: Similarity as a whole-number ratio.
PART, WHOLE = 75, 100
#: Counters of the sketch: a fixed size, of which the crowded ones are broadcast.
COUNTERS = 1 << 18
#: Slots that spread the entries of one position band of a list.
SLOTS = 64
#: Hash ranges for each shuffle partition, and shingles that a task packs at once.
RANGES = 8
PACK = 1 << 20


def least_share(n):
    """Shingles of a set of n that any partner holds: ceil(0.75 n)."""
    return -(-PART * n // WHOLE)


def prefix(n):
    return n - least_share(n) + 1


def tenth(n):
    return n // 10


def sieve_need(n):
    """Shared shingles among the first ones, for the smallest partner."""
    return tenth(least_share(n)) + 1


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ``lengths[i]`` elements from each ``starts[i]``."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


_SIEVE = T.StructType(
    [T.StructField("kind", T.ByteType()), T.StructField("tid", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("sid", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("n", "cnt", "range_no")]
    + [T.StructField("hashes", T.BinaryType()), T.StructField("sids", T.BinaryType())]
)
_SIEVE_ARROW = [pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
#: Kinds of row: a set, the text it is from (lines only), packed shingles, shared shingles counted.
SET, TEXT, PACKED, CREDIT = 0, 1, 2, 3


def _rows(ids: pa.Array | None, id_type: pa.DataType, kind: int, length: int, **columns) -> pa.RecordBatch:
    made = [pa.nulls(length, id_type) if ids is None else ids]
    for f, t in zip(_SIEVE, _SIEVE_ARROW, strict=True):
        if f.name == "kind":
            made.append(pa.array(np.full(length, kind, np.int8)))
        elif f.name in columns:
            made.append(pa.array(columns[f.name], t))
        else:
            made.append(pa.nulls(length, t))
    return pa.RecordBatch.from_arrays(made, ["id", *_SIEVE.names])


def _pack(by_line: bool, min_words: int, ranges: int):
    edges = np.array([-(1 << 63) + k * (1 << 64) // ranges for k in range(1, ranges)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, id_type, tids = batch["id"], batch["id"].type, batch["tid"].to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in batch["text"].to_pylist()]
            held: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            for a, b in chunks(texts):
                s = shingle_sets(texts[a:b], by_line, min_words)
                yield _rows(ids.take(pa.array(s.text + a)), id_type, SET, len(s.n), tid=tids[s.text + a], line_no=s.line.astype(np.int32), sid=s.sid, n=s.n.astype(np.int32), range_no=(s.sid.view(np.uint64) % np.uint64(ranges)).astype(np.int32))
                if by_line:
                    yield _rows(ids.slice(a, b - a), id_type, TEXT, b - a, tid=tids[a:b], n=s.lines_in_text.astype(np.int32), range_no=(tids[a:b].view(np.uint64) % np.uint64(ranges)).astype(np.int32))
                _, once = np.unique(s.sid, return_index=True)
                once = once[s.n[once] > 0]
                length = np.minimum(s.n[once], prefix(s.n[once]) + tenth(s.n[once]))
                held.append(s.hashes[_runs(s.starts[once], length)])
                owners.append(np.repeat(s.sid[once], length))
                if sum(map(len, held)) >= PACK:
                    yield from _flush(np.concatenate(held), np.concatenate(owners), edges, id_type)
                    held, owners = [], []
            if held:
                yield from _flush(np.concatenate(held), np.concatenate(owners), edges, id_type)

    return run


def _flush(h: np.ndarray, s: np.ndarray, edges: np.ndarray, id_type) -> Iterator[pa.RecordBatch]:
    """Pack the shingles of a batch by hash range.

    A shingle that several sets of the batch hold is known to be shared: those
    sets get their credit here, and only a mark (set 0) travels on.
    """
    h, s = _distinct(h, s)
    fresh = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    many = np.diff(np.concatenate((first, [len(h)]))) > 1
    shared = s[np.repeat(many, np.diff(np.concatenate((first, [len(h)]))))]
    sid, count = np.unique(shared, return_counts=True)
    if len(sid):
        yield _rows(None, id_type, CREDIT, len(sid), sid=sid, cnt=count.astype(np.int32), range_no=(sid.view(np.uint64) % np.uint64(len(edges) + 1)).astype(np.int32))
    keys, sets = h[first], np.where(many, 0, s[first])
    bounds = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        yield _rows(None, id_type, PACKED, len(full), range_no=full.astype(np.int32), hashes=[keys[bounds[k] : bounds[k + 1]].tobytes() for k in full], sids=[sets[bounds[k] : bounds[k + 1]].tobytes() for k in full])


def _distinct(h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((s, h))
    h, s = h[order], s[order]
    if not len(h):
        return h, s
    keep = np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])))
    return h[keep], s[keep]


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass sets on; turn the packed shingles of the partition's hash ranges into credits."""
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    id_type = None
    for batch in batches:
        id_type = batch["id"].type
        packed = np.asarray(batch["kind"].to_numpy(zero_copy_only=False)) == PACKED
        rows = np.flatnonzero(packed)
        if len(rows):
            mine = batch.take(pa.array(rows))
            for k, h, s in zip(mine["range_no"].to_pylist(), mine["hashes"].to_pylist(), mine["sids"].to_pylist(), strict=True):
                held.setdefault(k, []).append((h, s))
        rest = np.flatnonzero(~packed)
        if len(rest):
            yield batch.take(pa.array(rest))
    for k in list(held):
        blobs = held.pop(k)
        h, s = _distinct(np.frombuffer(b"".join(x for x, _ in blobs), np.int64), np.frombuffer(b"".join(y for _, y in blobs), np.int64))
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.concatenate((first, [len(h)])))
        marked = np.add.reduceat((s == 0).astype(np.int64), first) > 0
        shared = s[np.repeat((size > 1) | marked, size)]
        sid, count = np.unique(shared[shared != 0], return_counts=True)
        if len(sid):
            yield _rows(None, id_type, CREDIT, len(sid), sid=sid, cnt=count.astype(np.int32))


def _reread(by_line: bool, min_words: int, wanted_texts, wanted_sets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of, sets_of = wanted_texts.value, wanted_sets.value
        for batch in batches:
            here = np.flatnonzero(has_bits(texts_of, batch["at"].to_numpy()))
            texts = [t or b"" for t in batch["text"].take(pa.array(here)).to_pylist()]
            for a, b in chunks(texts):
                s = shingle_sets(texts[a:b], by_line, min_words)
                kept = np.flatnonzero((s.n > 0) & has_bits(sets_of, (s.sid.view(np.uint64) % np.uint64(MAP_BITS)).astype(np.int64)))
                _, once = np.unique(s.sid[kept], return_index=True)
                kept = kept[once]
                values = s.hashes[_runs(s.starts[kept], s.n[kept])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(s.n[kept]))).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(s.sid[kept]), lists], ["sid", "hashes"])

    return run


def _prefixes(hot_keys, hot_counts):
    """The rarest ``prefix(n)`` shingles of each set, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = hot_keys.value, hot_counts.value
        for batch in batches:
            lists = batch["hashes"]
            values = lists.flatten().to_numpy()
            n = lists.value_lengths().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            counter = (values.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)
            rank = np.zeros(len(values), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, counter), len(keys) - 1)
                rank = np.where(keys[at] == counter, counts[at], 0)
            order = np.lexsort((values, rank, owner))
            starts = np.cumsum(n) - n
            length = prefix(n)
            chosen = values[order[_runs(starts, length)]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(chosen))
            yield pa.RecordBatch.from_arrays([batch["sid"], batch["n"], batch["okey"], lists], ["sid", "n", "okey", "prefix"])

    return run


def overlap_needed(a: Column, b: Column) -> Column:
    """Smallest o with 100 o >= 75 (a + b - o)."""
    return F.ceil((PART * (a + b)).cast("double") / (WHOLE + PART)).cast("int")


def may_reach(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length and positional filter for sets whose first common shingle is at
    p1 and p2: all that they share stands there or later in both.

    A pair that is not similar by this shingle may be so by an earlier one,
    which has a list of its own.
    """
    return (WHOLE * F.least(n1, n2) >= PART * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= overlap_needed(n1, n2))


class SetTable:
    """Sets of all texts after the sieve.

    ``members`` has a row for each set of the input (``id``, ``tid``,
    ``line_no``, ``sid``, ``n``, ``okey``), ``texts`` one for each text (lines
    only), ``sets`` the hashes of the sets that may have partners.
    """

    def __init__(self, docs: DataFrame, by_line: bool, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1):
        spark = docs.sparkSession
        source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).cast("binary").alias("text"))
        schema = T.StructType([source.schema["id"], *_SIEVE.fields])
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        packed = source.mapInArrow(_pack(by_line, min_words, parts * RANGES), schema)
        counted = materialize(packed.repartition(parts, "range_no").mapInArrow(_count_shared, schema).drop("range_no", "hashes", "sids"), "sieve")
        okey = F.struct(F.col("id").isNull().alias("no_id"), "id", "tid", "line_no").alias("okey")
        self.members = counted.where(f"kind = {SET}").select("id", "tid", "line_no", "sid", "n", okey)
        self.texts = counted.where(f"kind = {TEXT}").select("id", "tid", F.col("n").alias("n_lines"))
        credits = counted.where(f"kind = {CREDIT}").groupBy("sid").agg(F.sum("cnt").alias("cnt"))
        #: One row for each distinct set: its first member and the number of members.
        self.first = self.members.where("n > 0").groupBy("sid", "n").agg(F.min("okey").alias("okey"), F.count("*").alias("copies"))
        share = F.floor((F.col("n") * PART + WHOLE - 1) / WHOLE)
        candidates = materialize(self.first.join(credits, "sid").where(F.col("cnt") >= F.floor(share / 10) + 1).select("sid", "n", "okey"), "sieved")
        texts_of = spark.sparkContext.broadcast(bitmap(candidates, F.xxhash64("okey.id")))
        sets_of = spark.sparkContext.broadcast(bitmap(candidates, F.col("sid")))
        again = source.select("text", F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)).alias("at")).mapInArrow(_reread(by_line, min_words, texts_of, sets_of), "sid long, hashes array<bigint>")
        self.sets = materialize(again.join(candidates, "sid").dropDuplicates(["sid"]), "sets")

    def lists(self) -> DataFrame:
        """Index entries ``h, sid, n, pos, okey`` of shingles that two sets hold."""
        spark = self.sets.sparkSession
        counts = self.sets.select(F.explode("hashes").alias("h")).groupBy(F.pmod(F.col("h") + F.lit(0), F.lit(COUNTERS)).alias("c")).count()
        counts = materialize(counts, "sketch")
        mean = (counts.agg(F.sum("count")).first()[0] or 0) / COUNTERS
        crowded = counts.where(F.col("count") > F.lit(mean + 6 * mean**0.5 + 8)).orderBy("c").toArrow()
        keys = spark.sparkContext.broadcast(crowded["c"].to_numpy())
        values = spark.sparkContext.broadcast(crowded["count"].to_numpy())
        schema = T.StructType([*[self.sets.schema[c] for c in ("sid", "n", "okey")], T.StructField("prefix", T.ArrayType(T.LongType()))])
        self.prefixes = materialize(self.sets.mapInArrow(_prefixes(keys, values), schema), "prefixes")
        entries = self.prefixes.select("sid", "n", "okey", F.posexplode("prefix").alias("pos", "h"))
        several = entries.groupBy("h").count().where("count > 1").select("h")
        return materialize(entries.join(several, "h").select("h", "sid", "n", "pos", "okey"), "lists")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (``a``, ``b``) whose sets are similar.

        The prefixes, a quarter of the sets, are compared first: what one set
        has past its prefix bounds what they may share beyond the prefixes.
        """
        both = self._beside(pairs, self.prefixes, "prefix")
        past = F.greatest("na", "nb") - prefix_length(F.greatest("na", "nb"))
        both = both.where(F.size(F.array_intersect("xa", "xb")) + past >= overlap_needed(F.col("na"), F.col("nb")))
        both = self._beside(materialize(both.select("a", "b"), "pairs"), self.sets, "hashes")
        common = F.size(F.array_intersect("xa", "xb"))
        return both.where(WHOLE * common >= PART * (F.col("na") + F.col("nb") - common)).select("a", "b")

    @staticmethod
    def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col(column).alias("xa"))
        two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col(column).alias("xb"))
        return pairs.join(two, "b").join(one, "a")


def prefix_length(n: Column) -> Column:
    return n - F.floor((PART * n + WHOLE - 1) / WHOLE) + 1


def blocks(lists: DataFrame) -> DataFrame:
    """Index lists as blocks of entries of one position band."""
    band = F.length(F.bin(F.col("pos"))).alias("band")
    slot = F.pmod(F.xxhash64("sid"), F.lit(SLOTS)).alias("slot")
    return lists.groupBy("h", band, slot).agg(F.min("pos").alias("min_pos"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.collect_list(F.struct("sid", "n", "pos", "okey")).alias("entries"))


def pivots(lists: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """The first entry of each list, or the first one past that of ``after``."""
    entry = F.struct("okey", "sid", "n", "pos")
    if after is not None:
        lists = lists.join(after.select("h", F.col("p").alias("last")), "h").where(entry > F.col("last"))
    return lists.groupBy("h").agg(F.min(entry).alias("p"))


def pivot_pairs(lists: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs (pivot, entry) that pass the filters, blocks being skipped first."""
    near = blocks(lists).join(first, "h")
    room = F.least(F.col("p.n") - F.col("p.pos"), F.col("max_n") - F.col("min_pos"))
    near = near.where((room >= overlap_needed(F.col("p.n"), F.col("min_n"))) & (WHOLE * F.col("max_n") >= PART * F.col("p.n")) & (WHOLE * F.col("p.n") >= PART * F.col("min_n")))
    one = near.select("p", F.explode("entries").alias("e")).where(F.col("p.sid") != F.col("e.sid"))
    one = one.where(may_reach(F.col("p.n"), F.col("p.pos"), F.col("e.n"), F.col("e.pos")))
    return one.select(F.col("p.sid").alias("a"), F.col("e.sid").alias("b")).distinct()


def rest_pairs(unsettled: DataFrame, lists: DataFrame, more: Callable[[Column, Column], Column], carry: str) -> DataFrame:
    """Pairs of an unsettled entry ``b`` with all others of its list for which
    ``more`` holds of their ``carry`` columns."""
    y = unsettled.select("h", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col(carry).alias("kb"))
    x = lists.select("h", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col(carry).alias("ka"))
    on = x.join(y, "h").where((F.col("a") != F.col("b")) & more(F.col("ka"), F.col("kb")) & may_reach(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")))
    return on.select("a", "b").distinct()
