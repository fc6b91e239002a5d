"""Word hashes of whole Arrow text columns, computed with NumPy inside Spark tasks.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``; the
separators are ASCII, so the UTF-8 bytes can be cut without decoding them. All
functions take flat arrays (the bytes of many texts end to end), never one text at
a time. Empty and null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; only a single longer text makes a larger piece.
PIECE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LONGEST = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BYTE = constants(256, 17)
_BYTE[_SPACE] = 0
_POWER = constants(_LONGEST, 23)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offsets, dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], raw[o[0]:o[-1]]


def pieces(batch, column: str = "text", most: int = PIECE_BYTES) -> Iterator:
    """Row slices of a batch or table with at most ``most`` bytes of text each
    (a longer single text makes a slice of its own)."""
    offsets, _ = flat(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def _bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = True
    before[1:] = ~solid[:-1]
    after = np.empty(n, dtype=bool)
    after[-1:] = True
    after[:-1] = ~solid[1:]
    return (np.flatnonzero(solid & (before | edge[:-1])),
            np.flatnonzero(solid & (after | edge[1:])) + 1)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=U64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = int(np.searchsorted(ends, starts[first] + PIECE_BYTES, side="right"))
            last = max(last, first + 1)
            if last - first > 1:  # a word over the table's length is hashed on its own
                big = np.flatnonzero(ends[first:last] - starts[first:last] > _LONGEST)
                last = first + max(1, int(big[0])) if len(big) else last
            lo, hi = int(starts[first]), int(ends[last - 1])
            s, n = starts[first:last] - lo, hi - lo
            head = np.zeros(n, dtype=np.int64)
            head[s] = s
            at = np.arange(n, dtype=np.int64)
            at -= np.maximum.accumulate(head, out=head)  # place of each byte in its word
            value, power = head.view(U64), np.empty(n, dtype=U64)
            # mode="clip" or "wrap" with out= writes straight to the buffer; no index is out of range
            np.take(_POWER, at, out=power, mode="clip" if n <= _LONGEST or last - first > 1 else "wrap")
            np.take(_BYTE, data[lo:hi], out=value, mode="clip")
            value *= power
            if last - first == 1 and hi - lo > _LONGEST:  # tells far positions of a huge word apart
                value *= mix((at // _LONGEST).astype(U64)) | U64(1)
            out[first:last] = np.add.reduceat(value, s)
            first = last
        long = ends - starts
        return mix(out + long.astype(U64) * U64(0x9E3779B97F4A7C15))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, starts, ends, hashes, bytes): text ``i`` holds the words ``first[i]`` to
    ``first[i + 1]``; a word's bytes are ``bytes[start:end]``; equal words have equal hashes."""
    offsets, data = flat(texts)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(len(offsets), dtype=np.int64), none, none, np.zeros(0, dtype=U64), data
    starts, ends = _bounds(offsets, data)
    return np.searchsorted(starts, offsets), starts, ends, _hash(data, starts, ends), data


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each position on, over the whole array; the
    caller leaves out those that run past their text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=U64)
        for k, c in enumerate(constants(width, 1000 + seed)):
            total += hashes[k:k + n] * c
        return mix(total)


def inside(first: np.ndarray, n: int, width: int) -> np.ndarray:
    """Of ``n`` positions over all texts, those whose window of ``width`` words stays in its text."""
    keep = np.zeros(n + 1, dtype=np.int32)
    size = np.diff(first)
    full = size >= width
    np.add.at(keep, first[:-1][full], 1)
    np.add.at(keep, first[1:][full] - width + 1, -1)
    return np.flatnonzero(np.cumsum(keep[:n]) > 0)
