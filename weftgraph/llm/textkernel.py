"""Vectorised text kernels: Arrow string batches in, numpy arrays out.

A batch of texts is handled as one byte buffer. Words are maximal runs of ASCII letters, digits and non-ASCII
characters, each CJK character being a word of its own; ASCII and Latin-1 capitals are folded. Hashes are polynomial
prefix sums modulo 2**64, finished by a bijective mixer, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_STEP_INV = pow(_STEP, -1, 1 << 64)

_LETTERS = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _LETTERS[list(_r)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for i, base in enumerate((_STEP, _STEP_INV)):
                grown = np.full(size, base, U)
                grown[0] = 1
                _powers[i] = np.cumprod(grown)
    return _powers[0], _powers[1]


class Block(NamedTuple):
    """Some rows of a batch: their bytes, where each row begins and ends in them, and the first row's number."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[Block]:
    """Cut a string column into blocks of about `most` bytes; a longer row is a block of its own. Nulls count as empty."""
    first = 0
    for arr in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if arr.null_count:
            arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
        wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
        n = len(arr)
        if not n:
            continue
        _, where, raw = arr.buffers()
        ends = np.frombuffer(where, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
            j = min(j, n)
            yield Block(first + i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            i = j
        first += n


class Words(NamedTuple):
    """Word hashes of a block in order, each with the row it is in and the bytes it spans; `prefix` hashes any span."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    prefix: np.ndarray


def fold(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case."""
    low = _FOLD[data]
    if len(low) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][latin] += 0x20
    return low


def prefix_sums(low: np.ndarray) -> np.ndarray:
    power, _ = _upto(len(low) + 1)
    sums = np.zeros(len(low) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[low] * power[: len(low)], out=sums[1:])
    return sums


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes have equal hashes wherever they stand."""
    _, inverse = _upto(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U) * _MULT)


def words(block: Block) -> Words:
    data, offsets = block.data, block.offsets
    if not len(data):
        e = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), e, e, e, np.zeros(1, U))
    low = fold(data)
    is_word = _LETTERS[low]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = is_word[heads]
    wide = (low >= 0xE3) & (low <= 0xE9)
    if wide.any():
        begins |= wide
        begins[3:] |= wide[:-3] & is_word[3:]
    start = np.flatnonzero(begins)
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | begins[1:]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    prefix = prefix_sums(low)
    return Words(span_hash(prefix, start, end), row, start, end, prefix)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of k words within a row; a row of fewer words is one shingle, of none has none."""
    counts = np.bincount(row, minlength=n_rows)
    heads = np.zeros(n_rows + 1, np.int64)
    np.cumsum(counts, out=heads[1:])
    n = len(hashes)
    if not n:
        return hashes, row
    place = np.arange(n) - heads[row]
    full = np.ones(n, bool)
    total = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for t in range(min(k, n)):  # beyond n no row has a word
            inside = place + t < counts[row]
            shifted = np.zeros(n, U)
            shifted[: n - t] = hashes[t:]
            total = np.where(inside, total * U(0x100000001B3) + shifted, total)
            full &= inside
    full &= counts[row] >= k
    full |= (counts[row] < k) & (place == 0)
    return mix(total[full]), row[full]


def weigh(element: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each row with how often each occurs, sorted by row, then element."""
    if not len(element):
        return element, row, np.zeros(0)
    order = np.lexsort((element, row))
    element, row = element[order], row[order]
    new = np.ones(len(element), bool)
    new[1:] = (element[1:] != element[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return element[at], row[at], np.diff(np.append(at, len(element))).astype(float)


def sequence_hash(hashes: np.ndarray, row: np.ndarray, n_rows: int, salt: int) -> np.ndarray:
    """One hash for each row's sequence of words; 0 for a row without words."""
    out = np.zeros(n_rows, U)
    if not len(hashes):
        return out
    counts = np.bincount(row, minlength=n_rows)
    heads = np.zeros(n_rows + 1, np.int64)
    np.cumsum(counts, out=heads[1:])
    power, inverse = _upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(mix(hashes + U(salt) * _MULT) * power[: len(hashes)], out=sums[1:])
        some = np.flatnonzero(counts)
        a, b = heads[some], heads[some + 1]
        out[some] = mix((sums[b] - sums[a]) * inverse[a] + counts[some].astype(U) * _MULT) | U(1)
    return out
