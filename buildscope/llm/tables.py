"""Fixed-size counter tables that every task fills and that are summed block by block.

A table's size is a parameter of its model and does not grow with the corpus. A task sends
the blocks that it touched, compressed; blocks are summed by block number, so the work is
spread over as many tasks as there are blocks, and the sum that reaches the driver has the
table's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BLOCK = 1 << 16
_SCHEMA = "block int, counts binary"


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def summed(rows: DataFrame, fill: Callable, sizes: list[tuple[int, type]]) -> list[np.ndarray]:
    """Sums over all tasks of the arrays in the list fill(batches); sizes: their lengths and kinds.

    A sum beyond what its kind holds stays at the most that it holds.
    """

    def run(batches):
        keys, out, at = [], [], 0
        for part in fill(batches):
            for a in range(0, len(part), BLOCK):
                b = part[a : a + BLOCK]
                if b.any():
                    keys.append(at + a // BLOCK)
                    out.append(packed(np.pad(b.astype(np.int64), (0, BLOCK - len(b)))))
            at += -(-len(part) // BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(out, pa.binary())], names=["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                total.setdefault(k, np.zeros(BLOCK, np.int64))
                total[k] += unpacked(b.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([packed(b) for b in total.values()], pa.binary())], names=["block", "counts"])

    out = [np.zeros(-(-n // BLOCK) * BLOCK, kind) for n, kind in sizes]
    first = np.cumsum([0] + [len(a) // BLOCK for a in out])
    for r in rows.mapInArrow(run, _SCHEMA).repartition(min(int(first[-1]), 32), "block").mapInArrow(add, _SCHEMA).collect():
        k = int(np.searchsorted(first, r.block, side="right")) - 1
        at = (r.block - int(first[k])) * BLOCK
        most = np.iinfo(sizes[k][1]).max
        out[k][at : at + BLOCK] = np.minimum(unpacked(r.counts, np.int64), most)
    return [a[:n] for a, (n, _) in zip(out, sizes, strict=True)]
