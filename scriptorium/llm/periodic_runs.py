"""Maximal periodic runs of words, found by counting matches at every lag.

A run is a stretch of words with smallest period q, at least ``least`` words and
``repeats`` periods long, that neither neighbour extends.  Its words match those
q places on at ``max(least - q, (repeats - 1) q)`` places in a row.

1. *Heavy/light counts.*  The number of matches at every lag up to n / repeats:
   frequent words give theirs by one FFT each (autocorrelation of the word's
   places; the power spectra are added and turned back once), rare ones by the
   differences of their pairs of places.  The border lies where a pair list
   costs as much as an FFT, so n words take n^1.5 steps and not n^2.  Counts are
   whole numbers below n, and an error of an FFT of doubles is far below a half
   for any n that fits in memory: rounding makes them exact.
2. *Lags with enough matches*, in ascending order, are scanned for islands of
   matches.  A run of period p explains its matches at multiples of p, which are
   taken off: a run of smallest period q shares fewer than q words with it, so
   none of its own matches is among them.  Before the scan three probes in each
   block of half the needed length show whether any island is possible.
3. *Smallest period.*  An island at lag q is a run of its own unless its words
   repeat at q / r for a prime r.

A document is worked on by one task, whole; memory grows with its words, and
pairs are made a few million at a time.

Defined results: null and empty texts, and texts without a word, have no run
and collapse to the empty text; words are compared byte by byte; a text of any
length is worked on whole; repeated rows have the same runs; columns of other
names, whatever they are, pass through (one named like a result gives way to
it); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD, spread

#: Pairs of places that are made at once.
PAIRS = 1 << 22
#: A word is heavy where the pairs of its places exceed this many times the places of the FFT.
PAIRS_PER_PLACE = 3


def light_counts(places: np.ndarray, left: np.ndarray, top: int) -> np.ndarray:
    """Matches at lags 0 to ``top`` of words whose places stand together in
    ``places``, ascending, each with the number of later ones of its word in ``left``."""
    counts = np.zeros(top + 1, np.int64)
    ends = np.cumsum(left)
    at = 0
    while at < len(places):
        done = int(ends[at - 1]) if at else 0
        until = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = left[at:until]
        first = np.repeat(np.arange(at, until), n)
        step = np.arange(1, len(first) + 1) - np.repeat(ends[at:until] - done - n, n)
        lags = places[first + step] - places[first]
        counts += np.bincount(lags[lags <= top], minlength=top + 1)
        at = until
    return counts


def heavy_counts(groups: list[np.ndarray], n: int, top: int) -> np.ndarray:
    """Matches at lags 0 to ``top`` of words given by their places, by FFT."""
    size = 1 << (n + top).bit_length()
    power = np.zeros(size // 2 + 1)
    for places in groups:
        marks = np.zeros(size)
        marks[places] = 1
        spectrum = np.fft.rfft(marks)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)


def lag_counts(ids: np.ndarray, top: int) -> np.ndarray:
    """For each lag 1 to ``top`` the number of places whose word stands again so much later."""
    n = len(ids)
    often = np.bincount(ids)
    order = np.argsort(ids, kind="stable")
    ends = np.cumsum(often)
    heavy = often.astype(float) ** 2 / 2 > PAIRS_PER_PLACE * 2 * (n + top)
    sorted_ids = ids[order]
    left = ends[sorted_ids] - 1 - np.arange(n)
    light = ~heavy[sorted_ids]
    counts = light_counts(order[light], left[light], top)
    if heavy.any():
        counts += heavy_counts([order[ends[w] - often[w] : ends[w]] for w in np.flatnonzero(heavy)], n, top)
    counts[0] = 0
    return counts


def islands(ids: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """Start and length of the stretches of at least ``need`` matches in a row at ``lag``."""
    last = len(ids) - lag
    block = (need + 1) // 2  # an island of the needed length covers a whole block
    starts = np.arange(0, last - block + 1, block)
    for at in (0, block - 1, block // 2):
        starts = starts[ids[starts + at] == ids[starts + at + lag]]
    if not len(starts):
        return []
    same = np.zeros(last + 2, np.int8)
    same[1:-1] = ids[:last] == ids[lag:]
    edges = np.flatnonzero(np.diff(same))
    first, past = edges[::2], edges[1::2]
    long = past - first >= need
    return list(zip(first[long].tolist(), (past - first)[long].tolist(), strict=True))


def primes_of(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def find_runs(ids: np.ndarray, least: int = 24, repeats: int = 3) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start, then period."""
    n = len(ids)
    if n < least:
        return []
    top = n // repeats
    lags = np.arange(top + 1)
    need = np.maximum(least - lags, (repeats - 1) * lags)
    counts = lag_counts(ids, top)
    runs = []
    for q in (np.flatnonzero(counts[1:] >= need[1:]) + 1).tolist():
        if counts[q] < need[q]:
            continue
        for start, matches in islands(ids, q, int(need[q])):
            shorter = (q // r for r in primes_of(q))
            if any((ids[start : start + q] == ids[start + p : start + p + q]).all() for p in shorter):
                continue
            length = matches + q
            runs.append((start, length, q))
            multiples = np.arange(2 * q, min(length, top + 1), q)
            counts[multiples] -= length - multiples
    return sorted(runs, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    index: dict[bytes, int] = {}
    return np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


_FIELDS = ("start", "length", "period")
RUN = T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS])
MADE = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
_ARROW = pa.list_(pa.struct([(f, pa.int64()) for f in _FIELDS]))


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 24, repeats: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Add ``runs`` (start, length, period of each) and the ``collapsed`` text.

    ``keep`` names the columns to carry along; all by default.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c not in MADE.names]
    text = F.col(f"`{text_col}`").cast("binary")
    given = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("string")
    rows = spread(docs.select(given.alias("row"), text.alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for body in batch["body"]:
                words = (body.as_py() or b"").split()  # of bytes: at ASCII white space only
                runs = find_runs(numbered(words), least, repeats) if len(words) >= least else []
                found.append([dict(zip(_FIELDS, r, strict=True)) for r in runs])
                texts.append(collapsed(words, runs).decode())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, _ARROW), pa.array(texts, pa.string())], ["row", *MADE.names])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], *MADE.fields]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in carried], *MADE.names)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared in whole numbers; the earliest of equals."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda a, b: F.when(better(a, b), b).otherwise(a))


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of a tenth of all documents made periodic, as a known case to find.

    With h = crc32 of the decimal id, n words, g = h div 10 and h mod 10 = 0, the
    words from a = g mod n on repeat with period 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    n, g = F.size("_words"), F.floor(h / 10).cast("long")
    tenth = docs.withColumn("_words", F.when(h % 10 == 0, words))
    at = (g % n).cast("int")
    period = (1 + F.floor((n - at) / (3 + g % 8))).cast("int")
    tenth = tenth.withColumn("_at", F.when(n > 0, at)).withColumn("_period", F.when(n > 0, period))
    place = lambda i: F.when(i < F.col("_at"), i).otherwise(F.col("_at") + (i - F.col("_at")) % F.col("_period"))
    made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", place(i))), " ")
    return tenth.withColumn(text_col, F.when(n > 0, made).otherwise(F.col(text_col))).drop("_words", "_at", "_period")
