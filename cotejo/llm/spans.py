"""Vectorised helpers for tasks over Arrow batches: texts as one byte array, words, rolling hashes.

All hashes are sums of table values times powers of an odd number, modulo 2**64, so that the
hash of any run of bytes or words comes from two prefix sums; a finaliser then mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(m, base, dtype=_U)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche (murmur3's)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    """A random number for each byte; with fold_case A-Z count as a-z."""
    table = mix(np.arange(1, 257, dtype=_U) * _U(2 * seed + 1) + _U(seed))
    if fold_case:
        table[65:91] = table[97:123]
    return table


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the runs [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


#: White space of the word contracts: blank and \x09-\x0D.
SPACE = np.ones(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def text_parts(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows with together about `most` bytes (one row may hold more): the rows, their
    bytes as one array, and offsets into it. Nulls are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.binary()).cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, n)
        yield slice(row, end), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at
    the end). No word crosses rows."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of `width` items inside one row, and the row of each."""
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    return start, row


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(i).type) for i, x in enumerate(columns)], schema=schema)


def as_runs(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct positions as runs [start, end)."""
    if not len(position):
        return position, position
    cut = np.flatnonzero(np.diff(position) > 1)
    return position[np.r_[0, cut + 1]], position[np.r_[cut, len(position) - 1]] + 1
