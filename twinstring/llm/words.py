"""Words of a batch of texts as 64-bit hashes, without a Python object per word.

A block of texts is one byte array. A prefix sum of byte values times powers of an odd
multiplier gives the hash of any byte span as a difference, so words, word prefixes and
shingles of millions of words cost a few array operations. All hashes depend on bytes only and
are the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
#: Text bytes handled at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: Word separators of the contracts: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: ASCII bytes that are neither letter nor digit.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        step = np.full(n, U(_MULT))
        step[0] = 1
        _powers = np.cumprod(step)
        step[1:] = U(_INV)
        _inverse = np.cumprod(step)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Block:
    """Texts of consecutive rows: ``first`` is the row of the batch that the block starts at,
    ``n`` the number of rows. ``starts``, ``ends``: byte spans of the words; words of row i are
    ``at[i]:at[i + 1]``."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.first, self.n, self.offsets = first, len(offsets) - 1, offsets
        self.bytes = LOWER[data]
        gap = separators[self.bytes]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = True, gap[:-1]
            after[-1], after[:-1] = True, gap[1:]
            before |= edge[:-1]
            after |= edge[1:]
        self.starts = np.flatnonzero(before & ~gap)
        self.ends = np.flatnonzero(after & ~gap) + 1
        self.at = np.searchsorted(self.starts, offsets)
        self._sums: np.ndarray | None = None

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte span."""
        if self._sums is None:
            _grow(len(self.bytes) + 1)
            self._sums = np.zeros(len(self.bytes) + 1, U)
            np.cumsum((self.bytes.astype(U) + U(1)) * _powers[: len(self.bytes)], out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * _inverse[starts]
        return mix(h ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def prefix_hashes(self, k: int) -> np.ndarray:
        """Hash of the first k bytes of each word, tagged so that it differs from a word of k
        bytes; 0 for words that have no more than k."""
        h = self.spans(self.starts, np.minimum(self.starts + k, self.ends))
        return np.where(self.ends - self.starts > k, mix(h + U(k)), U(0))


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; ``len(h) - k + 1`` of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    z = h[:m] + U(k)
    for j in range(1, k):
        z = mix(z * U(_MULT) + h[j : j + m])
    return mix(z) if k == 1 else z


def shingle_sets(block: Block, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingles of each row; with fewer words the whole sequence is the
    only one, without words there is none."""
    h = block.hashes()
    every = chain(h, k)
    at = block.at
    for i in range(block.n):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= k:
            yield np.unique(every[lo : hi - k + 1])
        elif hi > lo:
            yield chain(h[lo:hi], hi - lo)
        else:
            yield np.zeros(0, U)


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off


def blocks(
    batch: pa.RecordBatch, name: str, separators: np.ndarray = SPACES, size: int = BLOCK_BYTES
) -> Iterator[Block]:
    """The rows of a batch, in order, in blocks of about ``size`` bytes of whole texts."""
    data, off = text_column(batch, name)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Block(i, data[off[i] : off[j]], off[i : j + 1] - off[i], separators)
        i = j


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's LONG."""
    return h.view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


class Lookup:
    """Sorted hashes with a value each; absent hashes give ``default``. Picklable, so it can be
    captured by a function that runs on executors; its size is that of two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default):
        order = np.argsort(keys)
        self.keys, self.values, self.default = keys[order], values[order], default

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), self.default, self.values.dtype)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, self.values[i], self.values.dtype.type(self.default))
