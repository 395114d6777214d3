"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A hash depends only on the token's bytes: a prefix sum of bytes times powers of an odd number gives, for every token, the
same polynomial wherever the token stands (arithmetic modulo 2**64).
"""

from __future__ import annotations

from functools import cache

import numpy as np

SPACE, WORD, MARK = 0, 1, 2
_PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _classes() -> np.ndarray:
    """ASCII letters, digits and every byte of other characters make words; other ASCII signs are marks."""
    kinds = np.full(256, MARK, np.uint8)
    kinds[:33] = SPACE
    kinds[127] = SPACE
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        kinds[ord(a) : ord(b) + 1] = WORD
    kinds[128:] = WORD
    return kinds


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(_PIECE, n)
    if n not in _POWERS:
        _POWERS.clear()
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of h over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pieces(data: bytes):
    at = 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut <= at:  # one token longer than a piece: up to its end
                found = [x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0]
                cut = min(found, default=len(data) - 1)
            end = cut + 1
        yield at, data[at:end]
        at = end


def hashed(texts: list[str | None], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in order (lower-cased), and for text i their range bounds[i]:bounds[i + 1].

    A null text has no tokens. marks: runs of other signs are tokens too.
    """
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = b"\n".join(encoded) + b"\n"
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=offsets[1:])
    hashes, begins = [], []
    for at, piece in _pieces(data):
        raw = np.frombuffer(piece, np.uint8)
        kinds = _classes()[raw]
        starts = np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1))
        ends = np.append(starts[1:], len(raw))
        kept = kinds[starts] != SPACE if marks else kinds[starts] == WORD
        starts, ends = starts[kept], ends[kept]
        up, down = _powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        hashes.append(mixed((total[ends] - total[starts]) * down[starts]))
        begins.append(starts + at)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, np.searchsorted(begin, offsets)


def shingled(h: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` tokens of each text, and their bounds; a shorter text with tokens has one of all its tokens."""
    counts = np.diff(bounds)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    if not len(h):
        return np.zeros(0, np.uint64), out_bounds
    factor = np.uint64(_BASE)
    runs = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        runs = runs * factor + h[k : len(h) - words + 1 + k]
    out = np.zeros(out_bounds[-1], np.uint64)
    long = counts >= words
    first = np.repeat(bounds[:-1][long] - out_bounds[:-1][long], n[long])
    place = np.repeat(long, n)
    where = np.flatnonzero(place)
    out[where] = runs[where + first]
    for i in np.flatnonzero((counts > 0) & ~long):
        value = np.uint64(counts[i])
        for x in h[bounds[i] : bounds[i + 1]]:
            with np.errstate(over="ignore"):
                value = value * factor + x
        out[out_bounds[i]] = value
    return mixed(out), out_bounds


def runs(h: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` tokens within a text, and the token at which each begins. A text of just so many tokens
    has the same hash here as in ``shingled``, where it is shorter than a shingle."""
    value = np.full(max(0, len(h) - words + 1), np.uint64(words), np.uint64)
    for k in range(words):
        value = value * np.uint64(_BASE) + h[k : len(h) - words + 1 + k]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.flatnonzero(text[: len(value)] == text[words - 1 :]) if len(value) else np.zeros(0, np.int64)
    return mixed(value[place]), place


_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)


def simhash_windows(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` (1 to 254) consecutive hashes: a bit is 1 if set in over half of them.

    Eight counters share a 64-bit word, a byte each; window counts are differences of prefix sums modulo 2**64.
    """
    n = len(h) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    if n <= 0:
        return out
    over = _ONES * np.uint64(127 - size // 2)
    for k in range(8):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum((h >> np.uint64(k)) & _ONES, out=total[1:])
        out |= ((total[size:] - total[:-size] + over) & _TOPS) >> np.uint64(7 - k)
    return out


def simhash(h: np.ndarray) -> int:
    """Fingerprint of all hashes, zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        counts += np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])
