"""Packed exchange of sorted keys between blocks of texts and ranges of keys.

A block asks for its distinct keys; a row holds those of one block that fall into one range, as compressed differences,
with a number for each. A range adds the numbers up by key and answers each block in the order of its keys. A key meets
a range at most once from each block, so frequent keys make no range large; the number of ranges grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

KEYS = "block long, range int, n int, keys binary"
ANSWERS = "block long, range int, n int, found binary"


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, the first bytes of all values before the second ones."""
    turned = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(turned, "zstd", asbytes=True)


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    turned = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(turned.T).view(kind).ravel()


def unpacked(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [unpack(data, n, kind) for data, n in zip(table[column].to_pylist(), table["n"].to_pylist(), strict=True)]


def asked(block: int, keys: np.ndarray, bits: int, ranges: int, more: dict[str, np.ndarray]) -> pa.Table:
    """A row for each range that a block has keys in; the keys are sorted and below 2**bits, ``more`` goes with them."""
    bounds = np.array([(r << bits) // ranges for r in range(1, ranges)], np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    filled = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    columns = {
        "block": pa.array([block] * len(filled), pa.int64()),
        "range": pa.array([r for r, _, _ in filled], pa.int32()),
        "n": pa.array([b - a for _, a, b in filled], pa.int32()),
        "keys": pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in filled], pa.binary()),
    }
    for name, values in more.items():
        columns[name] = pa.array([pack(values[a:b]) for _, a, b in filled], pa.binary())
    return pa.table(columns)


class Range:
    """The rows of one range: equal keys are brought together, in the order of the blocks."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by("block")
        self.keys = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in unpacked(self.table, "keys", np.uint64)])
        self.order = np.argsort(self.keys, kind="stable")
        ordered = self.keys[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))

    def sums(self, column: str, kind) -> np.ndarray:
        """The sum of a column for each key."""
        values = np.concatenate(unpacked(self.table, column, kind))
        return np.add.reduceat(values[self.order].astype(np.int64), self.starts)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of keys for all rows' keys."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, np.diff(self.starts, append=len(self.order)))
        return out

    def first(self) -> np.ndarray:
        """Whether a row's key comes from the first of the blocks that have it."""
        out = np.zeros(len(self.order), bool)
        out[self.order[self.starts]] = True
        return out

    def answers(self, values: np.ndarray) -> dict[str, pa.Array]:
        cuts = np.cumsum([0, *self.table["n"].to_pylist()])
        found = pa.array([pack(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
        return {"block": self.table["block"], "range": self.table["range"], "n": self.table["n"], "found": found}


def answered(table: pa.Table, kind) -> np.ndarray:
    """All answers to a block, in the order of its keys."""
    return np.concatenate([np.zeros(0, kind), *unpacked(table.sort_by("range"), "found", kind)])
