"""Shingle sets of many texts at once, as sorted 64-bit hashes, with numpy.

A text, or each of its lines, becomes the set of its distinct runs of five
words.  The words are those of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.
Work is done for a chunk of texts together: word hashes come from one running
sum over the bytes, shingle hashes from five shifted sums over the words.

Defined results: empty texts and texts without a word have no hash; a text of
any length is worked on whole; repeated words and shingles of a text count once
in its set; no texts give no sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WIDTH = 5
#: Bytes of text that are worked on at once (a longer text is worked on whole).
CHUNK = 2 << 20

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(WIDTH)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 11, 12, 13) else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and 64-bit hash of every word of all texts, in order.

    ``table`` maps each byte; what it maps to a space or a line feed stands
    between words.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    raw = np.frombuffer((b"\n".join(texts) + b"\n").translate(table), np.uint8)
    first, past, words = _words_in(raw)
    return np.searchsorted(offsets, first, "right") - 1, words


def _words_in(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = (raw == 10) | (raw == 32)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(gap, np.uint64(0), _BYTE[raw] * power[: len(raw)]))))
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    past = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    return first, past, mix((sums[past] - sums[first]) * inverse[first] + (past - first).astype(np.uint64))


@dataclass
class Sets:
    """Sets of a chunk: ``text`` and ``line`` say where each is from, ``starts``
    where its ascending hashes begin in ``hashes`` (one more entry at the end)."""

    text: np.ndarray
    line: np.ndarray
    n: np.ndarray
    sid: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray
    lines_in_text: np.ndarray


def shingle_sets(texts: list[bytes], by_line: bool, min_words: int = 1) -> Sets:
    """One set for each text, or for each line of at least ``min_words`` words.

    With fewer than five words the whole run is one shingle; without words the
    set is empty.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    raw = np.frombuffer((b"\n".join(texts) + b"\n").translate(_LOWER), np.uint8)
    breaks = raw == 10
    first, _, words = _words_in(raw)

    if by_line:
        ends = np.flatnonzero(breaks)
        unit_text = np.searchsorted(offsets, ends, "right") - 1
        unit_of = np.searchsorted(ends, first)
        first_unit = np.searchsorted(unit_text, np.arange(len(texts)))
        unit_line = np.arange(len(ends)) - first_unit[unit_text]
    else:
        unit_text = np.arange(len(texts))
        unit_of = np.searchsorted(offsets, first, "right") - 1
        unit_line = np.zeros(len(texts), np.int64)
    units = len(unit_text)
    count = np.bincount(unit_of, minlength=units)

    token = np.zeros(len(words), np.uint64)
    if len(words) >= WIDTH:
        m = len(words) - WIDTH + 1
        part = np.zeros(m, np.uint64)
        for k in range(WIDTH):
            part += words[k : k + m] * _Q[k]
        token[:m] = mix(part)
    whole = np.flatnonzero(unit_of[: max(0, len(words) - WIDTH + 1)] == unit_of[WIDTH - 1 :])
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    at = np.searchsorted(unit_of, short)
    for size in range(1, WIDTH):
        here = count[short] == size
        part = np.full(int(here.sum()), size, np.uint64)
        for k in range(size):
            part += words[at[here] + k] * _Q[k]
        token[at[here]] = mix(part)
    chosen = np.sort(np.concatenate((whole, at))) if len(at) else whole
    hashes = token[chosen].view(np.int64).copy()
    owner = unit_of[chosen]
    bounds = np.searchsorted(owner, np.arange(units + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    wanted = count >= min_words if by_line else np.ones(units, bool)
    fresh &= wanted[owner] if len(owner) else fresh
    hashes, owner = hashes[fresh], owner[fresh]
    kept = np.flatnonzero(wanted)
    starts = np.concatenate((np.searchsorted(owner, kept), [len(hashes)]))
    n = np.diff(starts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes.view(np.uint64) ^ np.uint64(_P)))))
    sid = mix(sums[starts[1:]] - sums[starts[:-1]] + n.astype(np.uint64)).view(np.int64)
    return Sets(unit_text[kept], unit_line[kept], n, sid, starts, hashes, np.bincount(unit_text, minlength=len(texts)))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHUNK`` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
