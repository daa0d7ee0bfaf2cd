"""Exact top-k by inner product.

Queries and chunks are packed into tiles, rows of up to some thousand vectors of
one scope.  Tiles of the same scope meet in a join, whose keys are salted so that
a scope is dealt over ``SALTS`` groups; a search without a scope is one of a
single scope.  A pair of tiles is a matrix product, taken ``CELLS`` scores at a
time, and a task keeps k rows for each query of the tiles that it has just seen.
So neither a task's memory nor what the driver holds grows with the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a tile at most.
TILE = 4096
#: Groups over which the chunks of a scope are dealt; its queries go to each.
SALTS = 64
#: Scores that a task computes at once, and hits that it holds at most before it hands them on.
CELLS, HELD = 1 << 20, 1 << 18
#: Magnitude from which a product is not left to the matrix product.
WILD = 1e100


def check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def top_k(scored: DataFrame, query: str, k: int, score: str = "score", tie: str = "chunk_ord") -> DataFrame:
    """The k rows of largest score for each query; ties by ascending ``tie``."""
    check_k(k)
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def scoped_top_k(queries: DataFrame, chunks: DataFrame, scope: str, query_id: str, chunk_id: str, k: int, query_vec: str = "q", chunk_vec: str = "v") -> DataFrame:
    """Top k of the chunks that share the scope of the query.

    Further columns of the chunks are joined to the hits by scope and id, which must name one row then.
    """
    asked, found = queries.select(F.col(scope).alias("scope"), query_id, query_vec), chunks.select(F.col(scope).alias("scope"), chunk_id, chunk_vec)
    hits = _nearest(asked, found, query_id, chunk_id, k, query_vec, chunk_vec, TILE).withColumnRenamed("scope", scope)
    more = [c for c in chunks.columns if c not in (scope, chunk_id, chunk_vec)]
    return hits.join(chunks.select(scope, chunk_id, *more), [scope, chunk_id]) if more else hits


def hits_per_query(queries: DataFrame, chunks: DataFrame, scope: str, query_id: str, k: int) -> DataFrame:
    """``query_id, n, last_rank``: number of hits of :func:`scoped_top_k` and rank of the last, for queries with any.

    Ranks have no gaps, so both are k or all chunks in scope; nothing is scored, and no pair is made.
    """
    check_k(k)
    there = chunks.groupBy(scope).agg(F.count("*").alias("there"))
    n = F.least(F.sum("there"), F.lit(k).cast("long"))
    return queries.select(query_id, scope).join(there, scope).groupBy(query_id).agg(n.alias("n"), n.alias("last_rank"))


def global_top_k(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str, k: int, query_vec: str = "q", chunk_vec: str = "v", query_block: int = TILE) -> DataFrame:
    """Top k of all chunks for a stated set of queries, of which a tile holds ``query_block`` at most."""
    asked, found = queries.select(F.lit(0).alias("scope"), query_id, query_vec), chunks.select(F.lit(0).alias("scope"), chunk_id, chunk_vec)
    return _nearest(asked, found, query_id, chunk_id, k, query_vec, chunk_vec, query_block).drop("scope")


def _nearest(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str, k: int, query_vec: str, chunk_vec: str, query_block: int) -> DataFrame:
    check_k(k)
    q = _tiles(queries, query_id, query_vec, query_block, "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    c = _tiles(chunks, chunk_id, chunk_vec, TILE, "c").withColumn("salt", F.pmod(F.hash("c_tile"), F.lit(SALTS)))
    kinds = dict(queries.dtypes) | dict(chunks.dtypes)
    schema = f"scope {kinds['scope']}, `{query_id}` {kinds[query_id]}, `{chunk_id}` {kinds[chunk_id]}, score double"
    hits = q.join(c.hint("shuffle_merge"), ["scope", "salt"]).drop("salt").mapInArrow(_best_of_pairs(k, [query_id, chunk_id]), schema)
    return top_k(hits, query_id, k, tie=f"`{chunk_id}`")


def _tiles(rows: DataFrame, id_col: str, vec_col: str, most: int, side: str) -> DataFrame:
    """``scope, <side>_tile, <side>_ids, <side>_vecs``: a name, the ids and the vectors of up to ``most`` rows of one scope."""
    kinds = dict(rows.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.table(batch.columns, ["scope", "id", "vec"]).sort_by("scope").combine_chunks()
            of = batch["scope"].to_pylist()
            start = 0
            for end in range(1, len(of) + 1):
                if end == len(of) or of[end] != of[start] or end - start == most:
                    ids, vecs = (pa.concat_arrays(batch[c].slice(start, end - start).chunks) for c in ("id", "vec"))
                    ends = pa.array([0, end - start], pa.int32())
                    columns = [batch["scope"].slice(start, 1).combine_chunks(), pa.array([str(uuid.uuid4())]), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, vecs)]
                    yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["scope", f"{side}_tile", f"{side}_ids", f"{side}_vecs"])
                    start = end

    schema = f"scope {kinds['scope']}, {side}_tile string, {side}_ids array<{kinds[id_col]}>, {side}_vecs array<{kinds[vec_col]}>"
    return rows.where("scope is not null").select("scope", id_col, vec_col).mapInArrow(pack, schema)


class _Vectors:
    """The vectors of a tile: a matrix of the plain ones, which are finite and of the usual length."""

    def __init__(self, column: pa.Array):
        self.column = column
        lengths = np.array(pc.list_value_length(column).fill_null(-1))
        self.dims = int(np.bincount(lengths + 1).argmax()) - 1
        at = np.flatnonzero(lengths == max(self.dims, 0))
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        part = flat.reshape(len(at), max(self.dims, 0))
        fine = (np.abs(part) < WILD).all(1)  # false for infinite ones, and for nulls, which have become NaN
        self.at, self.matrix = at[fine], part[fine]
        self.plain = np.zeros(len(column), bool)
        self.plain[self.at] = True

    def values(self, i: int) -> list | None:
        return self.column[i].as_py()


def _score(left: list | None, right: list | None) -> float | None:
    """The inner product of any two vectors, as SQL has it: null for nulls and for different lengths."""
    if left is None or right is None or len(left) != len(right) or None in left or None in right:
        return None
    out = 0.0
    for x, y in zip(left, right, strict=True):
        out += x * y
    return out


def _best_of_pairs(k: int, names: list[str]):
    """The k best of the chunks seen for each query; the same query may come again, with others."""

    def candidates(q: _Vectors, c: _Vectors, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, list | np.ndarray]]:
        fine = (q.at >= lo) & (q.at < hi)
        same = q.dims == c.dims
        if same and fine.any() and len(c.at):
            rows, at, scores = best_products(q.matrix[fine], c.matrix, k)
            yield q.at[fine][rows], c.at[at], scores
        odd = ~(q.plain[lo:hi, None] & c.plain[None, :]) if same else np.ones((hi - lo, len(c.plain)), bool)
        if odd.any():
            rows, at = np.nonzero(odd)
            left, right = [q.values(i) for i in range(lo, hi)], [c.values(i) for i in range(len(c.plain))]
            yield rows + lo, at, [_score(left[i], right[j]) for i, j in zip(rows, at, strict=True)]

    def best(hits: pa.Table) -> pa.Table:
        """Ordered like SQL: by score, NaN as the largest, null last; then by id, null first."""
        score = hits["score"]
        nan = pc.fill_null(pc.is_nan(score), False)
        kind = pc.if_else(pc.is_null(score), 2, pc.if_else(nan, 0, 1))
        down = pc.negate(pc.if_else(pc.fill_null(nan, False), 0.0, pc.fill_null(score, 0.0)))
        order = pc.sort_indices(pa.table({"row": hits["row"], "kind": kind, "down": pc.add(down, 0.0), "id": hits["id"]}), sort_keys=[("row", "ascending"), ("kind", "ascending"), ("down", "ascending"), ("id", "ascending")], null_placement="at_start")
        row = np.array(hits["row"])[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        return hits.take(pa.array(np.array(order)[rank < k]))

    def out(scope: pa.Array, ids: pa.Array, held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        hits = pa.concat_tables(held)
        columns = [pa.array([scope[0].as_py()] * len(hits), scope.type), ids.take(hits["row"].combine_chunks()), hits["id"].combine_chunks(), hits["score"].combine_chunks()]
        columns = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns]
        yield from pa.Table.from_arrays(columns, ["scope", *names, "score"]).to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = q = ids = scope = None
        held: list[pa.Table] = []
        for batch in batches:
            for i in range(len(batch)):
                name = batch["q_tile"][i].as_py()
                if name != tile:
                    if held:
                        yield from out(scope, ids, held)
                    tile, held, scope, ids, q = name, [], batch["scope"].slice(i, 1), batch["q_ids"][i].values, _Vectors(batch["q_vecs"][i].values)
                c, chunk_ids = _Vectors(batch["c_vecs"][i].values), batch["c_ids"][i].values
                step = max(1, CELLS // max(1, len(chunk_ids)))
                for lo in range(0, len(ids), step):
                    for rows, at, scores in candidates(q, c, lo, min(lo + step, len(ids))):
                        held.append(best(pa.table({"row": pa.array(rows, pa.int64()), "id": chunk_ids.take(pa.array(at, pa.int64())), "score": pa.array(scores, pa.float64())})))
                    if sum(map(len, held)) > HELD:
                        held = [best(pa.concat_tables(held).combine_chunks())]
                        if len(held[0]) > HELD // 2:
                            yield from out(scope, ids, held)
                            held = []
        if held:
            yield from out(scope, ids, held)

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def best_products(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and inner product of at least the k best columns of each row.

    One matrix product finds them with a margin for rounding; their products
    are then summed anew in the order of the components, as SQL sums them.
    """
    rough = left @ right.T
    n = rough.shape[1]
    if n > k:
        margin = 1e-9 * (1 + np.abs(rough).max())
        rows, at = np.nonzero(rough >= np.partition(rough, n - k, axis=1)[:, n - k, None] - margin)
    else:
        rows, at = np.divmod(np.arange(rough.size), n)
    out = np.zeros(len(rows))
    for d in range(left.shape[1]):
        out += left[rows, d] * right[at, d]
    return rows, at, out


def covered_evidence(evidence: DataFrame, texts: DataFrame, needle: Column, haystack: Column, evidence_id: str, shard_bytes: int = 4 << 20) -> DataFrame:
    """Ids of evidence that some text contains (both columns are match keys).

    A hit forces every inner word of the needle to be a whole word of the
    text, so the join is by one inner word (the longest) and then verified.
    Needles of fewer than three words have no inner word; one automaton of all
    of them goes over every text once (see :func:`contained`).
    """
    parts = F.split("needle", " ")
    longest = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    keys = evidence.select(F.col(evidence_id).alias("eid"), needle.alias("needle")).where("needle <> ''").withColumn("word", F.when(F.size(parts) > 2, longest))
    bodies = texts.select(haystack.alias("body")).withColumn("text_key", F.unhex(F.md5(F.col("body").cast("binary"))))
    # Only digests and words are shuffled at first; a text follows once for each needle that asks for its word.
    words = bodies.select("text_key", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    asked = words.join(keys.where("word is not null"), "word").select("text_key", "eid", "needle").distinct()
    found = bodies.join(asked, "text_key").where(F.contains("body", F.col("needle"))).select("eid")
    short = keys.where("word is null")
    hits = short.join(contained(short.select("needle"), bodies.select("body"), shard_bytes), "needle", "left_semi").select("eid")
    return found.unionByName(hits).distinct().withColumnRenamed("eid", evidence_id)


def contained(needles: DataFrame, texts: DataFrame, shard_bytes: int = 4 << 20) -> DataFrame:
    """The ``needle`` strings that some text contains.

    The distinct needles go to the driver and out again as an Aho-Corasick
    automaton, so one scan of the texts finds any number of them; needles of more
    than ``shard_bytes`` characters together are taken in shards, a scan each.
    Each task names a needle once.
    """
    spark = texts.sparkSession
    out = spark.createDataFrame([], "needle string")
    for shard in _shards((r[0] for r in needles.where("needle <> ''").distinct().toLocalIterator()), shard_bytes):
        out = out.unionByName(texts.select(F.col(texts.columns[0]).alias("body")).mapInArrow(_search_for(spark.sparkContext.broadcast(shard)), "needle string"))
    return out.distinct()


def _shards(needles: Iterator[str], most: int) -> Iterator[list[str]]:
    shard: list[str] = []
    size = 0
    for needle in needles:
        if shard and size + len(needle) > most:
            yield shard
            shard, size = [], 0
        shard.append(needle)
        size += len(needle)
    if shard:
        yield shard


def _search_for(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle in sent.value:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        known: set[str] = set()
        for batch in batches:
            fresh = {hit for text in batch["body"].to_pylist() if text for _, hit in automaton.iter(text)} - known
            known |= fresh
            yield pa.RecordBatch.from_arrays([pa.array(sorted(fresh), pa.string())], ["needle"])

    return run
