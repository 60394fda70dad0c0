"""Vectorised tokenising and shingle hashing over batches of whole texts.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D,
with the letters A-Z lower-cased.  All functions work on UTF-8 bytes, where
those separators are single bytes, so no character is ever decoded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes that separate words (space, tab to carriage return).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are hashed at once; bounds the memory of the arrays below.
SLICE_BYTES = 1 << 19

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64, which spread every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def slices(texts: Sequence[str | None], size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8 of about `size` bytes each, with the first one's index."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and total + len(raw) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(raw)
        total += len(raw) + 1
    if held:
        yield first, held


def words(texts: Sequence[bytes], inside_table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text's first word, and each word's byte span.

    Text t owns words first[t] to first[t + 1]; spans count within the text.  inside_table
    tells of each byte whether it belongs to words, where that isn't the module's rule.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(lengths)))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_IS_SEPARATOR[raw] if inside_table is None else inside_table[raw]
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw] + np.uint64(1)) * up[: len(raw)])))
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, begin)
    shift = np.repeat(begin[:-1], np.diff(first))
    return hashes, first, start - shift, end - shift


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text, and each text's first run.

    A text with fewer words, but at least one, has its whole sequence as its only run.
    """
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], runs)
    out = np.full(len(at), np.uint64(width))
    factor = 1
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    for step in range(width):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        out += padded[at + step] * np.uint64(factor)
    for t in np.flatnonzero((count > 0) & (count < width)):
        total = int(count[t])
        for w in hashes[first[t] : first[t + 1]]:
            total = (total * 0xD6E8FEB86659FD93 + int(w)) % (1 << 64)
        out[bounds[t]] = np.uint64(total)
    return mix(out), bounds


def sets_of_shingles(texts: Sequence[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, first, _, _ = words(texts)
    runs, bounds = shingle_hashes(hashes, first, width)
    return [np.unique(runs[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
