"""Words of many texts at once, and their hashes, with numpy over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space in ASCII: U+0020 and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SEEDS = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)
#: Masks of the first bytes of eight, by their number.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Powers are kept up to so many; longer stretches make their own.
KEPT_POWERS = 1_100_000
#: Bytes whose words are hashed together.
STRETCH = 250_000
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts end to end, and len + 1 offsets; a null is empty."""
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "").cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in ``data``, and for each text the number of words before it, and of all."""
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begins = np.flatnonzero(begins)
    return begins, np.flatnonzero(ends) + 1, np.searchsorted(begins, offsets)


def _polynomials(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words in rising order, for buckets: words made to do so share one. By stretches of some bytes, or one longer word, whose
    powers are at hand."""
    out = np.empty(len(begins), np.uint64)
    for some, start, stop in _stretches(begins, ends):
        out[some] = _polynomials(_BYTE[data[start:stop]], begins[some] - start, ends[some] - start)
    return out


def _stretches(begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    """Words of about STRETCH bytes together, or one longer word, and the bytes in which they are."""
    at = 0
    while at < len(begins):
        start = begins[at]
        stop = max(at + 1, int(np.searchsorted(ends, start + STRETCH, side="right")))
        yield slice(at, stop), start, ends[stop - 1]
        at = stop


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The beginnings of consecutive spans of these sizes, and for each of their members its place in its span."""
    starts = np.cumsum(sizes) - sizes
    return starts, np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def _sums(values: np.ndarray, places: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each span of ``values``: the sum of what mixes each value with its place in the span, mixed with the span's size."""
    salts = mix(np.arange(int(places.max(initial=0)) + 1, dtype=np.uint64) * _BASE + np.uint64(_SEEDS[seed]))
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if len(values):
        out[full] = np.add.reduceat(mix(values + salts[places]), starts[full])
    return mix(out + mix(sizes.astype(np.uint64) + np.uint64(_SEEDS[seed])))


def word_digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words in rising order, each byte of which counts at its place; those of two seeds are independent."""
    out = np.empty(len(begins), np.uint64)
    for some, start, stop in _stretches(begins, ends):
        padded = np.r_[data[start:stop], np.zeros(8, np.uint8)]
        eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        sizes = ends[some] - begins[some]
        lanes = (sizes + 7) // 8
        starts, places = _places(lanes)
        left = np.repeat(sizes, lanes) - 8 * places
        values = eights[np.repeat(begins[some] - start, lanes) + 8 * places] & _FIRST_BYTES[np.minimum(left, 8)]
        out[some] = _sums(values, places, starts, sizes, seed)
    return out


def span_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the numbers in each span; equal numbers, equal hash, wherever they stand. Spans may overlap."""
    out = np.empty(len(begins), np.uint64)
    sizes = ends - begins
    total = np.cumsum(sizes)
    at = 0
    while at < len(begins):
        stop = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + STRETCH, side="right")))
        starts, places = _places(sizes[at:stop])
        out[at:stop] = _sums(values[np.repeat(begins[at:stop], sizes[at:stop]) + places], places, starts, sizes[at:stop], seed)
        at = stop
    return out


def run_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each n consecutive numbers of ``words``; len(words) - n + 1 of them, or none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(base)
        out += words[j : len(words) - n + 1 + j]
    return mix(out)


def slices(texts: pa.Array, most: int = 1_000_000) -> list[tuple[int, int]]:
    """(begin, length) of consecutive texts with about ``most`` bytes together, or one longer text."""
    _, offsets = text_bytes(texts)
    out, begin = [], 0
    for i in range(1, len(texts) + 1):
        if i == len(texts) or offsets[i + 1] - offsets[begin] > most:
            out.append((begin, i - begin))
            begin = i
    return out
