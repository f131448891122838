"""Arrow text as numpy arrays of code points, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Code points handled at once; longer texts are handled alone.
BLOCK = 1 << 18


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the byte offset of each row and of the end."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of whole rows with about BLOCK bytes each, nulls replaced by empty text."""
    texts = texts.cast(pa.string()).fill_null("")
    if not len(texts):
        return
    _, offsets = _buffers(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + BLOCK, "right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield texts.slice(start, end - start)
        start = end


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and the offset of each row and of the end."""
    raw, offsets = _buffers(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    if len(points) == len(raw):
        return points, offsets
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return points, before[offsets]


def encode(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of decode."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) != len(points):
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        before = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=before[1:])
        offsets = before[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def select(points: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the code points where ``keep`` is set."""
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return points[keep], before[offsets]


def expand(points: np.ndarray, offsets: np.ndarray, at: np.ndarray, lengths: np.ndarray, starts: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace the code point at each position of ``at`` by ``lengths`` entries of ``pool`` from ``starts`` on."""
    sizes = np.ones(len(points), np.int64)
    sizes[at] = lengths
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(sizes, out=before[1:])
    out = np.repeat(points, sizes)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(before[at], lengths) + inner] = pool[np.repeat(starts, lengths) + inner]
    return out, before[offsets]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the code points of each span, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, back = np.full(len(points), _ODD), np.full(len(points), _INVERSE)
        power[0] = back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(back, out=back)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        h = (total[ends] - total[starts]) * back[starts]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def rows_with(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows hold any of the positions ``at``."""
    found = np.zeros(len(offsets) - 1, bool)
    found[np.searchsorted(offsets, at, "right") - 1] = True
    return found


def mapped(texts: pa.Array, change: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], touched: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Array:
    """``change`` applied block by block to the rows that ``touched`` marks; the others and nulls stay as they are."""
    parts = []
    for block in blocks(texts):
        points, offsets = decode(block)
        rows = touched(points, offsets)
        if rows.any():
            keep = np.repeat(rows, np.diff(offsets))
            own = np.r_[0, np.cumsum(np.diff(offsets)[rows])]
            block = pa.compute.replace_with_mask(block, pa.array(rows), encode(*change(points[keep], own)))
        parts.append(block)
    if not parts:
        return pa.array([], pa.string())
    out = pa.concat_arrays(parts)
    if not texts.null_count:
        return out
    return pa.compute.if_else(texts.is_valid(), out, pa.scalar(None, pa.string()))
