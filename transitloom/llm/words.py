"""Word and shingle hashes of whole Arrow string batches, in numpy.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; ASCII letters are
folded to lower case here, other letters by the caller (``F.lower``) where it matters. A null
text has no words. Texts of any length are taken whole: batches are cut into chunks of about
``CHUNK`` bytes only between texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_fold = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _fold[_b] = _b + 32 if 65 <= _b <= 90 else _b
_fold.setflags(write=False)
_code = np.zeros(256, np.uint64)
_code[1:] = np.random.default_rng(20240611).integers(1, 2**63, 255, dtype=np.uint64)
_space = np.ones(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = False

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _P)])
            _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _P_INV)])
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows, about ``CHUNK`` bytes each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1 : len(inside)]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1 : len(inside)]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, row, start, end)`` of each word of a chunk, in order."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    folded = _fold[raw]
    starts, ends = _bounds(folded != 0, offsets)
    powers, inverses = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(_code[folded] * powers[: len(raw)])
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        hashes = mix((total[ends - 1] - before) * inverses[starts])
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def spaced_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in bytes of the runs of bytes other than space and \\t to \\r."""
    return _bounds(_space[raw], offsets) if len(raw) else (np.zeros(0, np.int64),) * 2


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of each run of n words within a row; a row of 1 to n - 1 words has one, of them all."""
    out = np.zeros(0, np.uint64)
    at = np.zeros(0, rows.dtype)
    with np.errstate(over="ignore"):
        if len(hashes) >= n:
            same = rows[: len(rows) - n + 1] == rows[n - 1 :]
            out = np.zeros(len(hashes) - n + 1, np.uint64)
            for i in range(n):
                out = out * _P + hashes[i : len(hashes) - n + 1 + i]
            out, at = mix(out[same]), rows[: len(same)][same]
        if len(rows):
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            count = np.diff(np.r_[first, len(rows)])
            short = count < n
            if short.any():
                for k in np.unique(count[short]):
                    f = first[count == k]
                    h = np.full(len(f), np.uint64(k))
                    for i in range(k):
                        h = h * _P + hashes[f + i]
                    out, at = np.r_[out, mix(h)], np.r_[at, rows[f]]
                order = np.argsort(at, kind="stable")
                out, at = out[order], at[order]
    return out, at


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row, end to end, and their offsets."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(n_rows + 1))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges inside words, folded as words are; a whole word's equals ``word_hashes``'."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    powers, inverses = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(_code[_fold[raw]] * powers[: len(raw)])
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        return mix((total[ends - 1] - before) * inverses[starts])


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges of values; empty ranges sum to 0."""
    total = np.r_[np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)]
    return total[offsets[1:]] - total[offsets[:-1]]
