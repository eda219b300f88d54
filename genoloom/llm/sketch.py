"""Fixed-size arrays gathered over all tasks: hashed counts and Bloom filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from genoloom.llm.common import mixed

CHUNK = 1 << 14
FAN_IN = 64
BLOOM_BITS = 1 << 24
BLOOM_IDS = 4_000_000  # ids that one task gathers: it sends as many bytes for few as for many
SCHEMA = "chunk int, part int, counts binary"


def chunk_rows(values: np.ndarray) -> pa.RecordBatch:
    """A task's 64-bit values as rows of ``SCHEMA``, chunks of zeros left out."""
    part = TaskContext.get().partitionId() // FAN_IN
    kept = [(k, c) for k, c in enumerate(values.astype(np.int64).reshape(-1, CHUNK)) if c.any()]
    return _batch([k for k, _ in kept], [part] * len(kept), [zlib.compress(c.tobytes(), 1) for _, c in kept])


def _batch(chunks: list, parts: list, raws: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "chunk": pa.array(chunks, pa.int32()), "part": pa.array(parts, pa.int32()),
        "counts": pa.array(raws, pa.binary())})


def gathered(rows: DataFrame, size: int, combine: np.ufunc) -> np.ndarray:
    """All tasks' arrays of ``size`` values combined into one.

    Two levels, the first with a fan-in of ``FAN_IN`` tasks, each group read as a stream; what
    reaches the driver is ``size`` numbers, whatever the input.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(CHUNK, np.int64), None
        for batch in batches:
            for chunk, part, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "counts")), strict=True):
                key, total = (chunk, part), combine(total, np.frombuffer(zlib.decompress(raw), np.int64))
        if key:
            yield _batch([key[0]], [key[1]], [zlib.compress(total.tobytes(), 1)])

    once = rows.groupBy("chunk", "part").applyInArrow(fold, SCHEMA)
    out = np.zeros(size, np.int64)
    for r in once.groupBy("chunk").applyInArrow(fold, SCHEMA).select("chunk", "counts").collect():
        out[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(ids.astype(np.int64).view(np.uint64))
    mask = np.uint64(BLOOM_BITS - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter, packed to 2 MB, of the ids of a one-column table.

    With very many ids it lets all rows pass; an exact join has to follow anyway.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            for slots in _slots(batch.column(0).drop_null().to_numpy()):
                bits[slots] = True
        yield chunk_rows(np.packbits(bits).view(np.int64))

    few = ids.coalesce(ids.count() // BLOOM_IDS + 1)
    return gathered(few.mapInArrow(work, SCHEMA), BLOOM_BITS // 64, np.bitwise_or).view(np.uint8)


def in_bloom(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter."""
    found = np.ones(len(ids), bool)
    for slots in _slots(ids):
        found &= (packed[slots >> np.uint64(3)] >> (7 - (slots & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return found
