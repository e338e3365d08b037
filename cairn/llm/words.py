"""Words of Arrow text columns as numpy arrays, straight from the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once: temporary arrays take some 40 times as much.
CHUNK_BYTES = 512 << 10

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def lower_ascii() -> np.ndarray:
    """A table of 256 bytes that maps A-Z to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def not_space() -> np.ndarray:
    """Which bytes are in words [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, bool)
    t[32] = False
    t[9:14] = False
    return t


def letters_digits() -> np.ndarray:
    """Which bytes are in words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased text."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


_VALUES = mix64((np.arange(256, dtype=U64) + U64(1)) * U64(_ODD))[lower_ascii()]
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & _MASK, U64)
    p[:1] = 1
    return np.multiply.accumulate(p, dtype=U64)


_POWER: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER.get("up", ())) < n:
        _POWER["up"], _POWER["down"] = _powers(_ODD, n), _powers(_INVERSE, n)
    return _POWER["up"], _POWER["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunk_words(b: np.ndarray, heads: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of b; heads: where texts begin."""
    mask = in_word[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[heads] = True
    before = np.empty(len(b) + 1, bool)
    before[0] = False
    before[1:] = mask
    after = np.empty(len(b) + 1, bool)
    after[:-1] = mask
    after[-1] = False
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    if not len(starts):
        return starts, ends, np.empty(0, U64)
    up, down = _tables(len(b) + 1)
    v = _VALUES[b]
    v *= up[: len(b)]
    np.cumsum(v, out=v)
    h = v[ends - 1]
    first = np.where(starts > 0, v[starts - 1], U64(0))
    h = (h - first) * down[starts]
    return starts, ends, mix64(h)


def words(texts: pa.Array, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, start, end, hash): first[i]:first[i + 1] are text i's words; start and end are in buffers(texts).

    The hash is that of the word with A-Z lower-cased.
    """
    data, offsets = buffers(texts)
    starts, ends, hashes, lo, n = [], [], [], 0, len(data)
    while lo < n:
        hi = min(lo + CHUNK_BYTES, n)
        if hi < n:  # back to the last place that isn't within a word, or on to the next one
            gap = np.flatnonzero(~in_word[data[lo:hi]])
            at = np.searchsorted(offsets, hi, "right") - 1
            back = max(lo + int(gap[-1]) + 1 if len(gap) else lo, int(offsets[at]))
            if back > lo:
                hi = back
            else:
                while hi < n:
                    more = min(hi + CHUNK_BYTES, n)
                    gap = np.flatnonzero(~in_word[data[hi:more]])
                    stop = min(hi + int(gap[0]) if len(gap) else n + 1, int(offsets[np.searchsorted(offsets, hi, "left")]))
                    if stop <= more:
                        hi = stop
                        break
                    hi = more
        a, z = np.searchsorted(offsets, lo, "left"), np.searchsorted(offsets, hi, "right")
        s, e, h = _chunk_words(data[lo:hi], offsets[a:z] - lo, in_word)
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(h)
        lo = hi
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    end = np.concatenate(ends) if ends else np.empty(0, np.int64)
    return np.searchsorted(start, offsets, "left"), start, end, np.concatenate(hashes) if hashes else np.empty(0, U64)


def slices(texts: pa.Array, limit: int = 2 * CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each, or of one longer text."""
    _, offsets = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi
