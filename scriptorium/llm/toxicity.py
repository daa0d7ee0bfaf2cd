"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are the lower-cased words of the whole texts; no term is left out.  The
weight of a term is ``(1 + log tf) * idf * (1 + ratio / RATIO)``, where the
ratio is the likelihood ratio of the term and the label among the examples
(supervised term weighting): the more a word tells of the label, the nearer
texts that share it.  A bounded sample of labelled rows (``max_examples``, the
smallest hashes of their ids) gives the examples and their statistics; a term
that no example has counts in the length of a document's vector.

The examples lie in an inverted index of blocks of 64.  For each term a block
has its largest weight; the sum of these bounds what any example of the block
can score.  Blocks are opened by falling bound until no other can hold one of
the ``k`` nearest, which makes the answer exact.  Neighbours vote with the
square of their cosine.  Votes become probabilities through an isotonic fit of
the examples' own votes, each with itself left out; equal votes are pooled.

Terms are told apart by 64-bit hashes.  The index is broadcast; its size is
that of the sample's texts, which ``max_examples`` bounds by rows.

Defined results: null and empty texts, and texts without a word of any
example, have no neighbour and score the rate of label 1; labels that are null
or neither 0 nor 1 are ignored, and repeated labels of an id count once (the
largest); examples of equal cosine are ordered by number, which is that of
their id; long texts are read whole; with no labelled rows every score is 0;
with labels of one kind every score is that label; repeated rows give repeated
results; extra columns pass through if named in ``keep``, and columns with the
name of a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held_out, materialize, release_memory, spread
from .shingles import chunks, word_hashes
from .wu_manber import WORD_BYTES

BLOCK = 64
#: Blocks that are opened first before the bounds are looked at again; then eight times as many each time.
OPENED = 8
#: Terms that are held as full columns: at most so many, in such a share of the examples.
COMMON, SHARE = 512, 1 / 64
#: Documents whose product with the full columns is taken together, and its rounding.
TOGETHER, MARGIN = 32, 2e-5
#: Likelihood ratio that doubles the weight of a term.  Of 5, 10, 25, 50, 100, 400 and none it has the
#: smallest log loss of the votes of labelled rows that are not held out, each with itself left out.
RATIO = 10.0


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, term and its count, ascending."""
    text, term = word_hashes(texts, WORD_BYTES)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    fresh = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])))) if len(text) else np.zeros(0, np.int64)
    return text[fresh], term[fresh], np.diff(np.concatenate((fresh, [len(text)])))


class Space:
    """Terms (ascending hashes) and their weights without term frequency."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, unknown: float):
        self.terms, self.weight, self.unknown = terms, weight, unknown

    def vectors(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ascending term numbers and weights of each text, as unit vectors;
        terms that the space lacks are left out after the length is taken."""
        return self.of_counts(*term_counts(texts), len(texts))

    def of_counts(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.searchsorted(self.terms, term)
        known = self.terms[np.minimum(at, len(self.terms) - 1)] == term if len(self.terms) else np.zeros(len(term), bool)
        weight = (1 + np.log(count)) * np.where(known, self.weight[np.minimum(at, len(self.terms) - 1)] if len(self.terms) else 0, self.unknown)
        length = np.sqrt(np.bincount(text, weight**2, n))
        text, at, weight = text[known], at[known], weight[known] / length[text[known]]
        bounds = np.searchsorted(text, np.arange(n + 1))
        return [(at[a:b], weight[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class BlockMaxIndex:
    """Inverted lists of examples with the largest weight of each block.

    Only the (term, block) pairs with an entry are held, by term.  The lists of
    the commonest terms (at most ``COMMON``, each in a ``SHARE`` of the examples
    or more) are held as full columns, for which a block's bound is exact: a
    matrix product of some documents with them gives it.
    """

    @classmethod
    def of(cls, n_terms: int, vectors: Sequence[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        lengths = [len(v[0]) for v in vectors]
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        return cls(n_terms, len(vectors), np.repeat(np.arange(len(vectors), dtype=np.int32), lengths), term.astype(np.int32), weight.astype(np.float32))

    def __init__(self, n_terms: int, size: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray):
        """``owner`` (ascending within a term), ``term`` and ``weight`` of every entry."""
        self.size = size
        self.blocks = max(1, -(-self.size // BLOCK))
        held = np.bincount(term, minlength=n_terms)
        common = np.argsort(-held, kind="stable")[:COMMON]
        common = common[held[common] >= max(1, SHARE * self.size)]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.columns = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        full = self.column[term] >= 0
        self.columns[self.column[term[full]], owner[full]] = weight[full]
        term, owner, weight = term[~full], owner[~full], weight[~full]
        order = np.lexsort((owner, term))
        term, self.owner, self.weight = term[order], owner[order], weight[order]
        del order, full, owner, weight
        block = self.owner // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.cell_block = block[first].astype(np.int16 if self.blocks < 1 << 15 else np.int32)
        self.cell_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        #: Where the entries of a cell and the cells of a term begin.
        self.cell_start = np.concatenate((first, [len(term)])).astype(np.int32)
        self.term_start = np.searchsorted(term[first], np.arange(n_terms + 1)).astype(np.int32)

    def nearest(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]], k: int, skip: Sequence[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector the ``k`` examples of largest positive cosine, ties by number."""
        for at in range(0, len(vectors), TOGETHER):
            some = vectors[at : at + TOGETHER]
            asked = np.zeros((len(some), len(self.columns)))
            for row, (ids, weights) in zip(asked, some, strict=True):
                column = self.column[ids]
                row[column[column >= 0]] = weights[column >= 0]
            rough = asked.astype(np.float32) @ self.columns
            for i, (ids, weights) in enumerate(some):
                rare = self.column[ids] < 0
                yield self._one(ids[rare], weights[rare], asked[i], rough[i], k, -1 if skip is None else skip[at + i])

    def _one(self, ids: np.ndarray, weights: np.ndarray, asked: np.ndarray, rough: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        begin, count = self.term_start[ids], self.term_start[ids + 1] - self.term_start[ids]
        cells = _runs(begin, count)
        of_cell = np.repeat(weights, count)
        block = self.cell_block[cells]
        bound = np.bincount(block, of_cell * self.cell_most[cells], self.blocks) + rough.reshape(self.blocks, BLOCK).max(1)
        listed = np.zeros(self.blocks * BLOCK)
        near, best, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        closed, opened = bound > 0, OPENED
        while True:
            some = np.flatnonzero(closed & (bound >= least - MARGIN))
            if not len(some):
                break
            if len(some) > opened:  # those of the highest bounds first
                some = some[np.argpartition(-bound[some], opened)[:opened]]
            closed[some] = False
            now = np.zeros(self.blocks, bool)
            now[some] = True
            pick = np.flatnonzero(now[block])
            here, w = cells[pick], of_cell[pick]
            size = self.cell_start[here + 1] - self.cell_start[here]
            entries = _runs(self.cell_start[here], size)
            listed += np.bincount(self.owner[entries], np.repeat(w, size) * self.weight[entries], len(listed))
            mine = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            score = listed[mine] + rough[mine]
            good = (score > max(0.0, least - MARGIN)) & (mine != skip)
            near, best = np.concatenate((near, mine[good])), np.concatenate((best, score[good]))
            if len(best) > k:
                least = np.partition(best, -k)[-k]
                near, best = near[best >= least - MARGIN], best[best >= least - MARGIN]
            opened *= 8
        # What is left is scored anew in double precision.
        exact = asked @ self.columns[:, near] + listed[near]
        top = np.lexsort((near, -exact))[:k]
        return near[top], exact[top]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ``lengths[i]`` elements from each ``starts[i]``."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool equal x, then adjacent violators: rising levels at rising x."""
    values, owner = np.unique(x, return_inverse=True)
    levels: list[list[float]] = []
    for a, total, n in zip(values, np.bincount(owner, y), np.bincount(owner), strict=True):
        levels.append([a, a, total, float(n)])
        while len(levels) > 1 and levels[-2][2] * levels[-1][3] >= levels[-1][2] * levels[-2][3]:
            last = levels.pop()
            levels[-1] = [levels[-1][0], last[1], levels[-1][2] + last[2], levels[-1][3] + last[3]]
    xs = [v for lo, hi, _, _ in levels for v in (lo, hi)]
    ys = [s / n for _, _, s, n in levels for _ in range(2)]
    return np.array(xs), np.array(ys)


class Model:
    """Space, index, labels and calibration; plain data, so that it can be sent.

    ``sent`` is its broadcast, made before the calibration and used by both.
    """

    sent = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "sent"}

    def __init__(self, space: Space, index: BlockMaxIndex, labels: np.ndarray, names: list[str], base: float, k: int, smooth: float):
        self.space, self.index, self.names = space, index, names
        self.labels = np.asarray(labels, np.float64)
        self.base, self.k, self.smooth = base, k, smooth
        self.xs, self.ys = np.zeros(1), np.full(1, base)

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2
        return float((w @ self.labels[ids] + self.smooth * self.base) / (w.sum() + self.smooth))

    def scores(self, texts: list[bytes]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Score, neighbours and cosines of each text."""
        if not self.index.size:
            yield from ((self.base, np.zeros(0, np.int64), np.zeros(0)) for _ in texts)
            return
        for near, cosines in self.index.nearest(self.space.vectors(texts), self.k):
            p = float(np.interp(self.vote(near, cosines), self.xs, self.ys)) if len(near) else self.base
            yield min(1.0, max(0.0, p)), near, cosines


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in chunks(texts):
            text, term, count = term_counts(texts[a:b])
            offsets = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.view(np.int64)))
            counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(count.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a).cast(pa.string()), batch["y"].slice(a, b - a), terms, counts], ["id", "y", "terms", "counts"])


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row, term and count of all terms of ``terms`` and ``counts``."""
    lists = batch["terms"].combine_chunks() if isinstance(batch["terms"], pa.ChunkedArray) else batch["terms"]
    counts = batch["counts"].combine_chunks() if isinstance(batch["counts"], pa.ChunkedArray) else batch["counts"]
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return owner, lists.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy()


def _log_part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return k * np.log(p) + (n - k) * np.log1p(-p)


def likelihood_ratio(with0: np.ndarray, with1: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Twice the log likelihood ratio of terms held by so many of the examples of each label."""
    both = (with0 + with1) / (n0 + n1)
    return np.maximum(0, 2 * (_log_part(with1, n1, with1 / n1) + _log_part(with0, n0, with0 / n0) - _log_part(with1, n1, both) - _log_part(with0, n0, both)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_examples: int = 5_000, k: int = 16, smooth: float = 0.05) -> Model:
    """Fit on at most ``max_examples`` labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_examples)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    counted = texts.join(F.broadcast(chosen), "id").mapInArrow(_counted, "id string, y int, terms array<long>, counts array<int>")
    table = materialize(counted.withColumn("row", F.monotonically_increasing_id()), "toxic-sample")
    sample = table.toArrow()
    sample = sample.take(pa.array(np.lexsort((sample["row"].to_numpy(), sample["id"].to_numpy(zero_copy_only=False).astype(str)))))
    y = sample["y"].to_numpy().astype(np.float64)
    n1 = float(y.sum())
    n0 = len(y) - n1
    if not n0 or not n1:
        return Model(Space(np.zeros(0, np.uint64), np.zeros(0), 1.0), BlockMaxIndex.of(0, []), [], [], 1.0 if n1 else 0.0, k, smooth)
    names, rows = sample["id"].to_pylist(), sample["row"].to_numpy()
    owner, held, count = _flat(sample)
    del sample  # the driver holds each of the large arrays no longer than it needs it
    owner, tf = owner.astype(np.int32), (1 + np.log(count)).astype(np.float32)
    del count
    terms, number = np.unique(held, return_inverse=True)
    number = number.astype(np.int32)
    del held
    with1 = np.bincount(number, y[owner], len(terms))
    with0 = np.bincount(number, minlength=len(terms)) - with1
    idf = np.log((1 + n0 + n1) / (1 + with0 + with1)) + 1
    space = Space(terms, idf * (1 + likelihood_ratio(with0, with1, n0, n1) / RATIO), float(np.log(1 + n0 + n1) + 1))
    weight = tf * space.weight.astype(np.float32)[number]
    del tf
    weight /= np.sqrt(np.bincount(owner, weight.astype(np.float64) ** 2, len(y))).astype(np.float32)[owner]
    place = _placed(owner, number, weight, len(y))
    index = BlockMaxIndex(len(terms), len(y), np.argsort(place).astype(np.int32)[owner], number, weight)
    model = Model(space, index, y[place], [names[i] for i in place], n1 / (n0 + n1), k, smooth)
    del owner, number, weight, with0, with1, idf
    release_memory()
    model.sent = docs.sparkSession.sparkContext.broadcast(model)
    model.xs, model.ys = calibration(table, model, rows[place])
    return model


def _placed(owner: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Examples by their heaviest terms, so that like ones share blocks and their bounds are close."""
    starts = np.searchsorted(owner, np.arange(n + 1))
    heaviest = np.full((n, 2), -1)
    for i in range(n):
        mine = slice(starts[i], starts[i + 1])
        top = np.lexsort((number[mine], -weight[mine]))[:2]
        heaviest[i, : len(top)] = number[mine][top]
    return np.lexsort((np.arange(n), heaviest[:, 1], heaviest[:, 0]))


def calibration(sample: DataFrame, model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit of every example's vote without itself, voted by the
    executors; ``rows`` has the row of the sample of each example."""
    sent, order = model.sent, np.argsort(rows)
    places = sample.sparkSession.sparkContext.broadcast((rows[order], order))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, (known, place) = sent.value, places.value
        for batch in batches:
            mine = place[np.searchsorted(known, batch["row"].to_numpy())]
            near = here.index.nearest(here.space.of_counts(*_flat(batch), len(batch)), here.k, mine.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array([here.vote(*x) for x in near], pa.float64())], ["at", "vote"])

    found = spread(sample.select("row", "terms", "counts")).mapInArrow(votes, "at long, vote double").toArrow()
    places.destroy()
    release_memory()
    vote = np.zeros(len(rows))
    vote[found["at"].to_numpy()] = found["vote"].to_numpy()
    return isotonic(vote, model.labels)


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("neighbours", T.ArrayType(T.StructType([T.StructField("example", T.StringType()), T.StructField("cosine", T.DoubleType())])))])


def score(docs: DataFrame, model: Model, keep: Sequence[str] | None = None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score``, ``predicted`` and the five nearest ``neighbours``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in keep] + RESULT.fields)
    sent = model.sent or docs.sparkSession.sparkContext.broadcast(model)
    xs, ys = model.xs, model.ys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = sent.value
        here.xs, here.ys = xs, ys
        for batch in batches:
            texts = [t or b"" for t in batch[text_col].cast(pa.binary()).to_pylist()]
            scores, near = [], []
            for a, b in chunks(texts):
                for p, ids, cosines in here.scores(texts[a:b]):
                    scores.append(p)
                    near.append([{"example": here.names[i], "cosine": c} for i, c in zip(ids[:5].tolist(), cosines[:5].tolist(), strict=True)])
            made = [pa.array(scores, pa.float64()), pa.array([int(p >= threshold) for p in scores], pa.int32()), pa.array(near, pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *made], [*keep, *RESULT.names])

    return spread(docs.select(*dict.fromkeys([*keep, text_col]))).mapInArrow(run, schema)
