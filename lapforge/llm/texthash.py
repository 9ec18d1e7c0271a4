"""Words of Arrow string arrays as numpy arrays of 64-bit hashes, without Python objects.

A word's hash is a polynomial over its bytes, modulo 2**64, with a random value for each
byte and a final mix. Texts are handled a few MB at a time, so memory stays bounded however
long a batch or a text is. Unequal words of one text share a hash with a chance of about
n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BLOCK = 1 << 18
_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
_NO_PUNCTUATION = np.arange(256, dtype=np.uint8)
_NO_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = 32


def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return values


def _powers(base: np.uint64) -> np.ndarray:
    """base ** 0 ... base ** _BLOCK; made when first needed, not sent along."""
    p = np.full(_BLOCK + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p, dtype=np.uint64)


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of the texts in them); null texts are empty."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(raw) else raw, offsets - offsets[0]


def text_blocks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together (one text alone may be longer)."""
    _, offsets = buffers(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end
        start = end


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word. A word never crosses two texts."""
    word = ~_IS_WS[raw]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    starts[cuts] |= word[cuts]
    ends[cuts - 1] |= word[cuts - 1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets, begin, "right") - 1


def word_hashes(texts: pa.Array, fold: bool, split_punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text). fold: A-Z count as a-z.
    split_punctuation: ASCII punctuation parts words like white space."""
    raw, offsets = buffers(texts)
    if split_punctuation:
        raw = _NO_PUNCTUATION[raw]
    begin, end, owner = word_spans(raw, offsets)
    power, inverse = _powers(_BASE), _powers(_INVERSE)
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):  # blocks of whole words
        to = max(k + 1, int(np.searchsorted(end, begin[k] + _BLOCK, "right")))
        lo, hi = begin[k], end[to - 1]
        if hi - lo <= _BLOCK:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[fold][raw[lo:hi]] * power[: hi - lo], dtype=np.uint64)])
            out[k:to] = (sums[end[k:to] - lo] - sums[begin[k:to] - lo]) * inverse[begin[k:to] - lo]
        else:  # one word of over a MB: block by block
            h = np.zeros(1, np.uint64)
            for at in range(lo, hi, _BLOCK):
                part = _VALUES[fold][raw[at : min(hi, at + _BLOCK)]]
                h = mix(h) + (part * power[: len(part)]).sum(dtype=np.uint64)
            out[k] = h[0]
        k = to
    counts = np.bincount(owner, minlength=len(texts))
    return mix(out), counts.astype(np.int64)


def windows(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every window of n words inside a text, number of windows of every text).
    Texts with fewer words have none."""
    per_text = np.maximum(counts - n + 1, 0)
    if len(h) < n:
        return np.zeros(0, np.uint64), per_text
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(32)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(per_text)[:-1]]), per_text)
    return mix(out[np.arange(per_text.sum()) + first]), per_text
