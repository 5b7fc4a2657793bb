"""Vectorised text helpers that run inside Spark tasks.

Everything works on an Arrow text column seen as one byte buffer plus
document offsets, so a batch is tokenised and hashed with a few numpy passes
and no per-word Python objects. Spark decides which documents meet in a task;
these helpers never see more than one batch or one block of documents.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling hash of byte strings.
BASE_A = 0x9E3779B97F4A7C15
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def pow_table(base: int, n: int) -> np.ndarray:
    """``base ** i`` for ``i < n``; sizes are rounded up so that tables are shared."""
    size = 1 << max(12, int(n).bit_length())
    return powers(base, size)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial sum: ``h[j] - h[i]`` identifies ``data[i:j]`` at position i."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(data.astype(U64) * pow_table(base, len(data)), out=out[1:])
    return out


@functools.lru_cache(maxsize=16)
def _multipliers(seed: int, size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


def multipliers(seed: int, n: int) -> np.ndarray:
    """``n`` odd numbers without a pattern; sizes are rounded up so that tables are shared."""
    return _multipliers(seed, 1 << max(6, int(n).bit_length()))[:n]


#: Keeps the first bytes of an eight-byte lane.
LANE_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


#: Seeds of the two hashes of a span.
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...] = SEEDS) -> list[np.ndarray]:
    """Independent 64-bit hashes of each ``data[start:end]``, the same wherever it stands.

    Lanes of eight bytes are mixed and summed with a random multiplier for each
    lane, so there are no periodic texts that cancel out as in a polynomial.
    """
    size = (end - start).astype(np.int64)
    n = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(n) - n
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(start, n) + 8 * step
    value = mix((lanes[at] & LANE_MASK[np.clip(np.repeat(size, n) - 8 * step, 0, 8)]) + U64(0x9E3779B97F4A7C15))
    out = []
    for seed in seeds:
        each = value * multipliers(seed, int(n.max(initial=1)))[step]
        out.append(mix((np.add.reduceat(each, first) if len(each) else each) + size.astype(U64) * U64(0xD6E8FEB86659FD93)))
    return out


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first of the two hashes of each span."""
    return span_hashes(data, start, end, SEEDS[:1])[0]


def sequence_hash(tokens: np.ndarray, width: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of the ``width`` tokens from each place on."""
    n = max(0, len(tokens) - width + 1)
    out = np.zeros(n, U64)
    for k, by in enumerate(multipliers(seed, width)):
        out += tokens[k : k + n] * by
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc row) of each maximal run of word bytes inside a document.

    ``is_word`` is a table of 256 booleans.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:]
    stop = inside[:n] & (~inside[1:] | begins[1:])
    s = np.flatnonzero(start[:n])
    e = np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def byte_class(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return ~out if invert else out


#: Words as runs of anything but ASCII white space.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), invert=True)
#: Words as runs of ASCII letters and digits and of all bytes beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + 32, data).astype(np.uint8) if upper.any() else data


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def chunks_of(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Row ranges of whole documents, each of about ``size`` bytes."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        out.append((a, b))
        a = b
    return out
