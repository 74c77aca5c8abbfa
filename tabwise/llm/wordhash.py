"""Vectorised word hashes of many texts at once, for use inside Arrow batches.

Words are runs of bytes other than space, tab, LF, VT, FF, CR; these are single
bytes in UTF-8, so words are found on the bytes of the concatenated texts.
Everything is 64-bit arithmetic modulo 2**64 on whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (murmur style): every input bit changes every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """1, base, base**2, ... (n of them)."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and the offsets of the texts
    (text i has the words ``offsets[i]:offsets[i + 1]``)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = ~_IS_SEPARATOR[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(before & ~inside)
    offsets = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.empty(0, np.uint64), offsets
    lengths = stops - starts
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else \
        np.concatenate([np.zeros(starts[0], np.int64),
                        np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))])
    power = powers(int(lengths.max()), _BASE)
    with np.errstate(over="ignore"):
        values = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)],
                          np.uint64(0))
        sums = np.add.reduceat(values, starts)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), offsets


def rolling(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every window of ``size`` words of the whole array (one entry per
    start; windows that cross a text's end are the caller's to leave out)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = mix(np.array([seed + 7], np.uint64))[0] | np.uint64(1)
    with np.errstate(over="ignore"):
        power = powers(len(words), base)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words, seed) * power)])
        back = powers(n, np.uint64(pow(int(base), -1, 2**64)))
        # sum of words[i + j] * base**(i + j), times base**-i: the same wherever the window starts
        return mix((sums[size:] - sums[:-size]) * back, seed + 1)


def whole_windows(offsets: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask over window starts: True where the window lies in one text."""
    mask = np.zeros(n, dtype=bool)
    firsts, lasts = offsets[:-1], offsets[1:] - size + 1
    ok = lasts > firsts
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, firsts[ok], 1)
    np.add.at(steps, lasts[ok], -1)
    mask[:] = np.cumsum(steps[:-1]) > 0
    return mask


def batches(texts: Sequence[str | None], chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about ``chars`` characters each, so that the
    arrays of a batch stay small whatever the texts are."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
