"""Word shingles of whole texts as sets of 64-bit hashes, computed over Arrow buffers.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the
lower-cased text.  A shingle is five consecutive words; a text of one to four words has one
shingle, all its words; a text without words (or null) has none.  A set holds each shingle once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_STEP = 1 << 20  # bytes of text hashed at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), ord("_"), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that behaves like a random one."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and how many words each text has.

    Text ``i`` is ``data[bounds[i]:bounds[i + 1]]`` (UTF-8 bytes).
    """
    is_word = np.zeros(len(data) + 2, dtype=bool)
    is_word[1:-1] = _IS_WORD[data]
    inner = bounds[1:-1][bounds[1:-1] < len(data)]
    starts_text = np.zeros(len(data) + 2, dtype=bool)
    starts_text[inner + 1] = True
    starts = np.flatnonzero(is_word[1:-1] & (~is_word[:-2] | starts_text[1:-1]))
    ends = np.flatnonzero(is_word[1:-1] & (~is_word[2:] | starts_text[2:])) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all texts in order, and how many each text has (before duplicates go)."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    padded = np.concatenate([words, np.zeros(n, dtype=np.uint64)])
    place = _powers(np.uint64(0xD1342543DE82EF95), n + 1)[1:]
    full = sum(padded[k:k + len(words)] * place[k] for k in range(n)) if len(words) else words
    per_text = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    where = np.repeat(first - np.concatenate([[0], np.cumsum(per_text)])[:-1], per_text) + np.arange(per_text.sum())
    out = full[where]
    at = np.concatenate([[0], np.cumsum(per_text)])
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[first[i]:first[i] + counts[i]]
        out[at[i]] = (own * place[:len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), per_text


def sets_of(texts, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text of an Arrow string array, in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(lower, pa.ChunkedArray):
        lower = lower.combine_chunks()
    bounds = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset:lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(lower):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _STEP, side="right")) - 1)
        words, counts = word_hashes(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
        hashes, per_text = shingle_hashes(words, counts, n)
        for part in np.split(hashes, np.cumsum(per_text)[:-1]):
            yield np.unique(part)
        i = j
