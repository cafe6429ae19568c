"""Array work on the bytes of many texts at once.

An Arrow string column already is one byte buffer with offsets; these helpers find and hash words in it without
making a Python object for each word. A chunk holds about ``CHUNK`` bytes of whole texts, which bounds memory
however many rows a batch has (a longer text makes a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: All of ASCII but letters and digits.
IS_BREAK = IS_SPACE.copy()
IS_BREAK[:128] |= ~np.array([chr(i).isalnum() for i in range(128)])
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, np.uint64) | U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i for i < n modulo 2**64, or those of the base's inverse."""
    kind = "inverse" if inverse else "base"
    if kind not in _POWERS or len(_POWERS[kind]) < n:
        p = np.full(max(n, CHUNK + (CHUNK >> 2)), pow(_BASE, -1, 2**64) if inverse else _BASE, np.uint64)
        p[0] = 1
        _POWERS[kind] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[kind][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about ``size`` bytes of text, each with its bytes and offsets."""
    if not batch.num_rows:
        return
    buf, offs = flat(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(at, end - at), buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(buf: np.ndarray, offs: np.ndarray, separates: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, a run of bytes that ``separates`` leaves out (``[^\\x20\\x09-\\x0D]+``); none crosses a text's end."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    inside = ~separates[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z if ``fold``; equal words have equal hashes wherever they stand."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[buf] * powers(n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n + 1, True)[starts] + (ends - starts).astype(np.uint64))


def counts_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a per-byte flag over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every ``width``-word shingle; a shorter text has one, of all its words."""
    full = np.zeros(0, bool)
    if len(hashes) >= width:
        full = rows[: len(rows) - width + 1] == rows[width - 1 :]
    acc = np.zeros(len(full), np.uint64)
    for j in range(width):
        acc = acc * U(0xC2B2AE3D27D4EB4F) + hashes[j : j + len(full)]
    out, at = mix(acc[full] + U(width)), rows[: len(full)][full]
    n_words = counts_by_row(rows, n_rows)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            more = n_words[short] > j
            extra[more] = extra[more] * U(0xC2B2AE3D27D4EB4F) + hashes[first[more] + j]
        out, at = np.concatenate([out, mix(extra + n_words[short].astype(np.uint64))]), np.concatenate([at, short])
    return out, at
